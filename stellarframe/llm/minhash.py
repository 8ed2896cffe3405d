"""Near-duplicates by fast similarity sketching, banding and exact verification on full shingle sets.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a document's set holds its distinct shingles of five words, or
the whole sequence if it has fewer. A sketch has a number of coordinates n: in round i below n each shingle is hashed to
one bin, in round n + j all compete for bin j, the smallest (round, hash) wins its bin, so every coordinate fills
and estimates concentrate as if the shingles had been sampled without replacement. `BAND_ROWS` coordinates make a band;
two sets of similarity 0.85 miss each other in all bands with a chance of about 1e-5.

Documents of equal sets are one node, so that copies never meet in pairs; a node is numbered when it is written, and only
numbers travel. In each bucket of a band the member that shares most buckets is the centre; it is compared with the others
by texts joined to the pairs (hot centres are ordinary skewed joins, which Spark splits). The links found join components.
Members of a bucket that are not of its centre's component are then compared with all its other members: a large bucket is
cut into blocks of bounded size, and only those few members are sent to every block, so that a text of a hot bucket is
sent about once. The comparison is by an inverted index of full sets and gives out only links that join two components. So
no pair between two components goes unseen, and no pairs of a group are listed.

Defined cases: texts that are null or have no words link with nothing and are their own component; a null doc_id gets its
component's smallest id, or null; equal ids with different texts are different nodes under one id; repeated rows get equal
results; a very long text is sketched and compared whole; of members that share equally many buckets the one of the highest number
is the centre, which changes no component; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, estimated_bytes
from .components import components

SHINGLE = 5
BANDS = 24
BAND_ROWS = 6
#: Seeds are made for so many coordinates.
MOST_COORDS = 256
#: A link needs 100 * intersection >= LINK_PERCENT * union.
LINK_PERCENT = 85
#: Shingles of a bucket's members that one group compares, on average; its members of other components are so many times more.
BLOCK_SHINGLES = 16_000
OTHERS = 8
#: Bytes of documents whose sketches go into one file.
FILE_BYTES = 64 << 20
#: Words of at most 64 bytes that a task remembers hashes of, about 200 bytes each.
WORD_CACHE = 60_000
_U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen of late."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_POWERS = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(SHINGLE + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: str | None, known: WordHashes | None = None) -> np.ndarray:
    """The sorted distinct shingles of a text, as 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = WordHashes() if known is None else known
    if len(known) > WORD_CACHE:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(w))], np.uint64)
    n = len(w) - SHINGLE + 1
    h = w[:n] * _U(_POWERS[SHINGLE])
    for i in range(1, SHINGLE):
        h = h + w[i : i + n] * _U(_POWERS[SHINGLE - i])
    return np.unique(_mix(h))


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = _mix(np.arange(1, 2 * MOST_COORDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
#: Rounds are taken in blocks of about so many hashes, some of them beyond the round that fills the last bin; those lose.
_BLOCK = 1536


def sketch(hashes: np.ndarray, coords: int = BANDS * BAND_ROWS) -> np.ndarray:
    """The coordinates of a set that isn't empty."""
    out = np.full(coords, _EMPTY)
    at = 0
    while at < 2 * coords and (out == _EMPTY).any():
        free = at < coords
        rounds = np.arange(at, min(at + max(1, _BLOCK // len(hashes)), coords if free else 2 * coords))
        g = _mix(hashes[None, :] ^ _SEEDS[rounds][:, None])
        value = (rounds.astype(np.uint64) << _U(55))[:, None] | (g >> _U(9))
        if free:
            bins = ((g & _U(0xFFFFFFFF)) * _U(coords)) >> _U(32)
            np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        else:
            np.minimum.at(out, rounds - coords, value.min(axis=1))
        at = int(rounds[-1]) + 1
    return out


def band_hashes(coords: np.ndarray, band_rows: int = BAND_ROWS) -> np.ndarray:
    rows = coords.reshape(-1, band_rows)
    h = _SEEDS[: len(rows)].copy()
    for i in range(band_rows):
        h = _mix(h ^ rows[:, i])
    return h.view(np.int64)


def similar(x: np.ndarray, y: np.ndarray, percent: int = LINK_PERCENT) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _sketched(docs: DataFrame, n_bands: int, band_rows: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands) of every document; node and bands are null without words."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sizes, nodes, bands = [], [], []
            for text in b.column("text"):
                h = shingle_hashes(text.as_py(), known)
                sizes.append(len(h))
                nodes.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                bands.append(band_hashes(sketch(h, n_bands * band_rows), band_rows) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    # the narrow side is the one that is hashed, so that texts of members are not sorted; those of centres come in order
    met = texts.select(F.col("k").alias("b"), F.col("text").alias("text_b")).join(pairs.hint("shuffle_hash"), "b").join(texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, known = None, None, WordHashes()
        for batch in batches:
            a, keep = batch.column("a").to_pylist(), []
            for i, (x, tx, ty) in enumerate(zip(a, batch.column("text_a"), batch.column("text_b"), strict=True)):
                if x != last:
                    last, own = x, shingle_hashes(tx.as_py(), known)
                if similar(own, shingle_hashes(ty.as_py(), known), percent):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return met.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each group of consecutive rows (bucket, p, q): links that join its components, found on full sets."""
    key, rows, known = None, [], WordHashes()
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("bucket", "p", "q", "root", "asks", "answers")]
        for *group, root, asks, answers, text in zip(*columns, b.column("text"), strict=True):
            if group != key:
                yield from _joins(rows, percent)
                key, rows = group, []
            rows.append((root, asks, answers, shingle_hashes(text.as_py(), known)))
    yield from _joins(rows, percent)


def _joins(rows: list[tuple[int, bool, bool, np.ndarray]], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of components that a member which asks and one that answers have in common, each pair at most once."""
    roots = np.array([r[0] for r in rows], np.int64)
    asking, answering = (np.flatnonzero(np.array([r[i] for r in rows], bool)) for i in (1, 2))
    if not len(asking) or not len(answering):
        return
    first = roots.copy()
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    # which members hold each shingle, one shingle's after the other's
    known, ids = np.unique(np.concatenate([rows[j][3] for j in answering]), return_inverse=True)
    holders = np.repeat(answering, sizes[answering])[np.argsort(ids, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    links = []
    for i in asking:
        place = np.searchsorted(known, rows[i][3])
        place = place[known[np.minimum(place, len(known) - 1)] == rows[i][3]]
        if not len(place):
            continue
        size = at[place + 1] - at[place]
        stop = np.cumsum(size)
        shared = np.bincount(holders[np.repeat(at[place] - (stop - size), size) + np.arange(stop[-1])], minlength=len(rows))
        near = (100 * shared >= percent * (sizes + sizes[i] - shared)) & (roots != roots[i])
        for j in np.flatnonzero(near):
            if roots[j] != roots[i]:
                links.append((first[i], first[j]))
                roots[roots == roots[j]] = roots[i]
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])


def _only(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; tasks leave one of each before they send any."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.col(k) for k in keys])))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _roots(nodes: DataFrame, docs: DataFrame, percent: int, block_shingles: int, stages: Stages, files: int) -> DataFrame:
    """(node, root) of all nodes that a link was found for."""
    every = nodes.select(F.explode("bands").alias("bucket"), "k", "n")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stages.write(every.join(shared, "bucket"), files=files)
    rank = met.groupBy("k").agg(F.sum("members").alias("rank"))

    # texts of the nodes that share a bucket, one each
    wanted = nodes.join(rank, "k", "left_semi").select("k", F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    same = keyed.join(wanted.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(wanted["i"]) & (keyed["text_hash"] == wanted["h"])).select("k", "text")
    texts = stages.write(_only(same, ["k"]))

    # the centre of each bucket against its other members: the highest rank, then number, as one number
    span = F.lit(str(1 << 63)).cast("decimal(20,0)")
    both = (F.col("rank").cast("decimal(18,0)") * span + F.col("k").cast("decimal(20,0)")).cast("decimal(38,0)")
    members = met.join(rank, "k")
    center = members.groupBy("bucket").agg(F.max(both).alias("both")).select("bucket", F.pmod("both", span).cast("long").alias("a"))
    held = stages.write(members.join(center, "bucket").where("k <> a").select("bucket", "k", "n", "members", "a"), files=files)
    pairs = held.select("a", F.col("k").alias("b"), "n").distinct().join(nodes.select(F.col("k").alias("a"), F.col("n").alias("m")), "a")
    pairs = pairs.where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select("a", "b")
    roots = stages.write(components(_confirmed(pairs, texts, percent), stages=stages, files=files), files=files)

    # what is left: buckets whose other members are of several components; one bucket of those with equal members
    root = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
    rest = held.where("members > 2").join(root("k", "own"), "k", "left").join(root("a", "center"), "a", "left")
    rest = rest.select("bucket", "k", "a", "n", F.coalesce("own", "k").alias("root"), (F.coalesce("own", "k") != F.coalesce("center", "a")).alias("apart"))
    mark = F.xxhash64("k")
    opened = rest.groupBy("bucket", "a").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor"), F.sum("n").alias("shingles"), F.sum(F.when(F.col("apart"), F.col("n")).otherwise(0)).alias("apart_shingles")).where("x <> y")
    opened = opened.groupBy("a", "size", "sum", "xor").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles"), F.max("apart_shingles").alias("apart_shingles"))
    parts = lambda c, size, name: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(size))).cast("int").alias(name)
    opened = opened.select("bucket", parts("shingles", block_shingles, "ps"), parts("apart_shingles", OTHERS * block_shingles, "qs"))
    own = rest.join(opened, "bucket").select("bucket", "k", "root", "apart", "ps", "qs", F.pmod(F.xxhash64("k"), F.col("ps")).cast("int").alias("own_p"), F.pmod(F.xxhash64("k", F.lit(1)), F.col("qs")).cast("int").alias("own_q"))
    # a member answers in its own block to each share of those apart; one that is apart asks in every block
    answers = own.select("*", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q")).select("bucket", F.col("own_p").alias("p"), "q", "k", "root", (F.col("apart") & (F.col("q") == F.col("own_q"))).alias("asks"), F.lit(True).alias("answers"))
    asks = own.where("apart").select("*", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p")).where("p <> own_p").select("bucket", "p", F.col("own_q").alias("q"), "k", "root", F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    groups = answers.union(asks).join(texts, "k").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "k")
    across = groups.select("bucket", "p", "q", "root", "asks", "answers", "text").mapInArrow(lambda batches: _across(batches, percent), "a long, b long")
    again = stages.write(components(across, stages=stages, files=files).withColumnsRenamed({"node": "old", "root": "new"}), files=files)
    first = nodes.select("k").join(root("k", "own"), "k", "left").select("k", F.coalesce("own", "k").alias("old"))
    return first.join(again, "old", "left").select(F.col("k").alias("node"), F.coalesce("new", "old").alias("root"))


def _grouped(docs: DataFrame, percent: int, block_shingles: int, n_bands: int, band_rows: int, stages: Stages, keep: bool) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (node, least_id, root) of all nodes; nodes of one root are a component. `keep` for what is read
    after `stages` end."""
    # what is written for each document is narrow; small tables get few files
    files = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(docs) // FILE_BYTES)))
    dealt = _sketched(docs, n_bands, band_rows).repartition(F.xxhash64("doc_id", "text_hash"))
    meta = stages.write(dealt.withColumn("r", F.monotonically_increasing_id()), keep=keep, files=files)
    # a node has the number of its first row; what was written keeps its numbers
    heads = meta.where("node IS NOT NULL").groupBy("node").agg(F.min("r").alias("k"), F.min("doc_id").alias("least_id"))
    nodes = stages.write(meta.select(F.col("r").alias("k"), "doc_id", "text_hash", "node", F.col("n_shingles").alias("n"), "bands").join(heads.select("k", "least_id"), "k"), files=files)
    roots = _roots(nodes, docs, percent, block_shingles, stages, files).withColumnRenamed("node", "k")
    grouped = nodes.select("k", "node", "least_id").join(roots, "k", "left").select("node", "least_id", F.coalesce("root", "k").alias("root"))
    return meta, stages.write(grouped, keep=keep, files=files)


def near_duplicates(docs: DataFrame, *, percent: int = LINK_PERCENT, block_shingles: int = BLOCK_SHINGLES, n_bands: int = BANDS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text", outer: Stages | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`; `outer` deletes what the result is read from."""
    with Stages(docs.sparkSession, outer) as stages:
        meta, grouped = _grouped(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), percent, block_shingles, n_bands, band_rows, stages, True)
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component"))
    named = grouped.join(least, "root").select("node", "component")
    out = meta.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, percent: int = LINK_PERCENT, block_shingles: int = BLOCK_SHINGLES, n_bands: int = BANDS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text", outer: Stages | None = None) -> DataFrame:
    """One row of `docs` for each component: of its smallest id, or of none if all are null, and there of one text.

    A row without words is its own component, so that of each id and text one is left. Ids say nothing of a text: rows that
    share an id, or have none, go or stay by their texts. Which rows stay is decided on ids and hashes of texts; the texts
    themselves are sent once. `outer` deletes what the result is read from.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with Stages(docs.sparkSession, outer) as stages:
        meta, grouped = _grouped(own, percent, block_shingles, n_bands, band_rows, stages, False)
        least = grouped.groupBy("root").agg(F.min("least_id").alias("component"))
        rows = meta.select("doc_id", "text_hash", "node").join(grouped.join(least, "root").select("node", "root", "component"), "node")
        first = rows.where(F.col("doc_id").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min("component").alias("doc_id"), F.min("text_hash").alias("text_hash"))
        chosen = first.select("doc_id", "text_hash").union(meta.where("node IS NULL").select("doc_id", "text_hash").distinct())
        key = lambda i, h: [F.col(i).isNull().alias("no_id"), F.coalesce(F.col(i).cast("string"), F.lit("")).alias("id"), h.alias("hash")]
        copies = meta.groupBy(*key("doc_id", F.col("text_hash"))).agg(F.count(F.lit(1)).alias("copies"))
        chosen = stages.write(chosen.select(*key("doc_id", F.col("text_hash"))).join(copies, ["no_id", "id", "hash"]), keep=True)
    keyed = docs.select(*key(f"`{id_col}`", F.xxhash64(f"`{text_col}`")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # keys are hashed, so that texts are not sorted
    single = keyed.join(chosen.where("copies = 1").select("no_id", "id", "hash").hint("shuffle_hash"), ["no_id", "id", "hash"], "left_semi")
    # of rows of one id and text the first by its other columns, so that repeated rows leave one
    order = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if f.name != text_col and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    several = _only(keyed.join(chosen.where("copies > 1").select("no_id", "id", "hash"), ["no_id", "id", "hash"], "left_semi"), ["no_id", "id", "hash"], *order)
    return single.union(several).select("row.*")
