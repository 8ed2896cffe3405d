"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells. Each shard owns the cells up to each of its virtual nodes; a key goes to the cell of its
hash, and when the owner is full it continues clockwise to the next shard with room. Capacities are n / shards, one
more for the first n mod shards of them, so counts are at most one apart (law `rows`). With `slack` all capacities are
(1 + slack) * n / shards, rounded up (law `bounded`): fewer keys overflow, and fewer move when a shard is added. Rows are
placed in ring order: only counts of cells decide, so the plan is one row made by SQL functions over at most 65,536 counts,
and a row needs its place in its cell alone. With `bounded=False` the owner keeps all (law `key`): id and shard count
decide, and one more shard takes rows only into itself.

Equal rows are counted first and placed as one, and a cell is dealt into parts by what its rows say; so neither a frequent
id, nor many copies of a row, nor rows without an id meet in one task. Placed copies are dealt out before they are listed.

Defined cases: a null text has size 1 and checksum 0; a null id has a hash of its own; repeated ids get slots of their
own; an empty table gives no rows; other columns are not read. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 65_536
VNODES = 64
#: Parts of a cell, and copies of a row that one step lists.
PARTS = 256
COPIES = 65_536


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """(cell, arc, owner, turn): every cell, the virtual node that it belongs to, and its place on the way round."""
    nodes = spark.range(shards * vnodes, numPartitions=1).select((F.col("id") % shards).cast("int").alias("owner"), F.pmod(F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(CELLS)).cast("int").alias("arc"))
    nodes = nodes.groupBy("arc").agg(F.min("owner").alias("owner"))
    every = nodes.agg(F.array_sort(F.collect_list(F.struct("arc", "owner"))).alias("nodes"))  # shards * vnodes entries
    spans = every.select(F.expr("transform(nodes, (x, i) -> struct(x.arc AS arc, x.owner AS owner, if(i = 0, -1, nodes[i - 1].arc) AS after, i = 0 AS wraps))").alias("s"), F.expr(f"sequence(element_at(nodes, -1).arc + 1, {CELLS})").alias("tail"))
    one = spans.select(F.inline("s"), "tail")
    cells = one.select("arc", "owner", F.explode(F.expr(f"filter(concat(transform(sequence(after + 1, arc), c -> struct(c AS cell, c AS turn)), if(wraps, transform(tail, c -> struct(c AS cell, c - {CELLS} AS turn)), array())), p -> p.cell < {CELLS})")).alias("p"))
    return cells.select("p.cell", "arc", "owner", "p.turn")


def _plan(counts: DataFrame, shards: int, slack: float) -> DataFrame:
    """(arc, shard, lo, hi, base): rows lo..hi-1 of an arc, in ring order, are slots base.. of a shard."""
    arcs = counts.groupBy("arc").agg(F.first("owner").alias("owner"), F.sum("n").alias("n"))
    one = arcs.agg(F.array_sort(F.collect_list(F.struct("arc", "owner", "n"))).alias("arcs"))  # at most shards * vnodes entries
    one = one.withColumn("owners", F.expr("transform(arcs, x -> x.owner)")).withColumn("total", F.expr("aggregate(arcs, 0L, (a, x) -> a + x.n)"))
    one = one.withColumn("way", F.expr("transform(arcs, (x, i) -> struct(x.arc AS arc, x.n AS n, array_distinct(concat(slice(owners, i + 1, size(owners)), slice(owners, 1, i))) AS stops))"))
    room = f"cast(ceil(total * {1 + slack}D / {shards}) AS bigint)" if slack else f"total div {shards} + if(s < total % {shards}, 1L, 0L)"
    one = one.withColumn("room", F.expr(f"transform(sequence(0, {shards - 1}), s -> {room})"))
    took = "least(b.rest, b.room[s])"
    inner = f"""aggregate(x.stops, struct(a.room AS room, a.out AS out, x.n AS rest), (b, s) -> if({took} <= 0, b, struct(
        transform(b.room, (v, i) -> if(i = s, v - {took}, v)) AS room,
        concat(b.out, array(struct(x.arc AS arc, s AS shard, x.n - b.rest AS lo, x.n - b.rest + {took} AS hi, room[s] - b.room[s] AS base))) AS out,
        b.rest - {took} AS rest)), b -> struct(b.room AS room, b.out AS out))"""
    empty = "cast(array() AS array<struct<arc:int,shard:int,lo:bigint,hi:bigint,base:bigint>>)"
    return one.select(F.inline(F.expr(f"aggregate(way, struct(room AS room, {empty} AS out), (a, x) -> {inner}, a -> a.out)")))


def assign_shards(docs: DataFrame, shards: int = 16, *, vnodes: int = VNODES, bounded: bool = True, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    equal = equal.withColumn("key", F.xxhash64(F.lit("key"), "doc_id")).withColumn("cell", F.pmod("key", F.lit(CELLS)).cast("int")).withColumn("part", F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), F.lit(PARTS)).cast("int"))
    upto = F.sum("n").over(Window.partitionBy("cell", "part").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    equal = equal.withColumn("within", upto - F.col("n"))
    parts = equal.groupBy("cell", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("cell", "part", "n", (F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")).alias("ahead"))

    cells = ring(spark, shards, vnodes)
    # every cell, so that the ring is the same whatever the rows; both sides have at most CELLS rows
    counts = cells.join(F.broadcast(parts.groupBy("cell").agg(F.sum("n").alias("n"))), "cell", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    ranked = equal.join(parts.select("cell", "part", "ahead"), ["cell", "part"]).withColumn("rank", F.col("ahead") + F.col("within"))
    if not bounded:
        owner = ranked.join(F.broadcast(cells.select("cell", F.col("owner").alias("shard"))), "cell")
        owner = owner.join(F.broadcast(ring(spark, shards + 1, vnodes).select("cell", F.col("owner").alias("grown_shard"))), "cell")
        before = counts.select("cell", (F.sum("n").over(Window.partitionBy("owner").orderBy("arc", "turn")) - F.col("n")).alias("before"))
        placed = owner.join(F.broadcast(before), "cell").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank")).alias("from"), "n", "grown_shard")
    else:
        # at most CELLS rows: where each cell starts in its arc
        starts = counts.select("cell", "arc", (F.sum("n").over(Window.partitionBy("arc").orderBy("turn")) - F.col("n")).alias("before"))
        at = ranked.join(F.broadcast(starts), "cell").withColumn("at", F.col("before") + F.col("rank")).withColumn("end", F.col("at") + F.col("n"))
        plan = _plan(counts, shards, slack)
        met = at.join(F.broadcast(plan), (at["arc"] == plan["arc"]) & (at["at"] < plan["hi"]) & (at["end"] > plan["lo"]))
        begin, end = F.greatest("at", "lo"), F.least("end", "hi")
        placed = met.select("doc_id", "size", "text_crc32", F.lit("bounded" if slack else "rows").alias("law"), "shard", (F.col("base") + begin - F.col("lo")).alias("from"), (end - begin).alias("n"), F.lit(None).cast("int").alias("grown_shard"))
    # copies of a row are listed step by step, in tasks that share them
    steps = placed.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("step")).withColumn("from", F.col("from") + F.col("step") * COPIES).withColumn("n", F.least(F.col("n") - F.col("step") * COPIES, F.lit(COPIES)))
    slots = steps.repartition("shard", "from").select("doc_id", "size", "text_crc32", "law", "shard", F.explode(F.expr("sequence(`from`, `from` + n - 1)")).alias("slot"), "grown_shard")
    return slots
