"""Merkle manifest of a dataset: a tree of digests for each language, one tree over their roots, and a proof for each row.

A leaf is the digest of a row's fields. The place of a leaf among its language is an exact rank that needs no global sort: the
row's key (id, then leaf) is cut into digits, rows are counted by each prefix of digits, and what lies before a prefix is what
lies before the next shorter one and, within that, below smaller digits. The binary digits of the rank are the leaf's path
in the trie: nodes that share all but the last BITS digits are reduced together, in one group of bounded size, then their
parents likewise, so that a tree of n leaves takes log(n) / BITS rounds.

Equal rows can't be told apart and lie side by side. Rows that share an id, or have none, are ranked on by their leaf's first
digits and by the task that read them, so that no window or group grows with them.

Defined cases: null fields are `-` and differ from empty ones; rows without an id come first in their language, rows
without a language form the first tree; an empty or a very long text is a text like others, hashed whole in its own
task; repeated rows are leaves of their own, side by side; an empty table has no row; extra columns are neither hashed nor
returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree that one round reduces: a group has 2 ** BITS nodes at most.
BITS = 7
#: Every one in so many ids, by crc32, is tampered with in the proof's test.
TAMPERED = 7
#: A step of a proof: the other digest of the pair, null if there is none, and whether it stands before.
_STEP = "struct<sibling:string,before:boolean>"


def sha(*parts: Column) -> Column:
    """Lowercase hex digest of the parts, which are concatenated; a null part counts as none."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def field(x: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digit_histograms(counts: DataFrame, tree: str, digits: dict[str, Column], n: str = "n") -> DataFrame:
    """`counts` with `first`, how many of the rows of the same `tree` lie before, and `size`, how many the tree has.

    `digits` are from the most to the least significant, together unique within a tree, and never null. A window sees the
    distinct values of one digit below one prefix.
    """
    names = list(digits)
    finest = counts.withColumns(digits)
    found = None
    for k in range(1, len(names) + 1):
        prefix, last = [tree, *names[: k - 1]], names[k - 1]
        w = Window.partitionBy(*prefix)
        level = finest if k == len(names) else finest.groupBy(*prefix, last).agg(F.sum(n).alias(n))
        level = level.withColumn("first", F.sum(n).over(w.orderBy(last)) - F.col(n))
        if found is None:
            found = level.withColumn("size", F.sum(n).over(w))
        else:
            above = found.select(*prefix, F.col("first").alias("_above"), "size")
            found = level.join(above, prefix).withColumn("first", F.col("first") + F.col("_above")).drop("_above")
    return found.drop(*[c for c in names if c not in counts.columns])


def _height(size: str) -> Column:
    """Levels above the leaves: 0 for a lone leaf."""
    return F.when(F.col(size) > 1, F.length(F.bin(F.col(size) - 1))).otherwise(F.lit(0))


def _parents(nodes: Column) -> Column:
    """The digests of every two consecutive nodes; a last one alone is hashed too."""
    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int")), lambda i: sha(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)))


def _round(nodes: DataFrame, k: int) -> DataFrame:
    """The groups of round `k`: their nodes in order, the levels above these, and the digest at their top."""
    group = nodes.groupBy("tree", "size", F.shiftright("index", BITS).alias("group")).agg(F.array_sort(F.collect_list(F.struct("index", "digest", "of"))).alias("nodes"))
    levels = F.greatest(F.lit(0), F.least(F.lit(BITS), _height("size") - F.lit(k * BITS)))
    up = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    all_levels = F.reduce(up, F.array(F.col("nodes.digest")), lambda made, _: F.array_append(made, _parents(F.element_at(made, -1))))
    return group.withColumn("levels", all_levels).withColumn("top", F.element_at(F.element_at("levels", -1), 1))


def reduce_trees(stages: Stages, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Each round's groups, and (tree, digest) of every root. `nodes` has tree, size, index, digest and `of`, which is passed on."""
    largest = nodes.agg(F.max("size")).first()[0] or 1  # one number
    rounds = []
    for k in range(max(1, -(-(largest - 1).bit_length() // BITS))):
        rounds.append(stages.write(_round(nodes, k)))
        nodes = rounds[-1].select("tree", "size", F.col("group").alias("index"), F.col("top").alias("digest"), F.lit(None).alias("of"))
    return rounds, nodes.select("tree", "digest")


def proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, of, steps and what `above` has) of every leaf; `above` has the tree and the steps from its root on."""
    steps = lambda x: F.transform(F.sequence(F.lit(0), F.size("levels") - 2), lambda k: _step(x, k))
    own = lambda x: F.when(F.size("levels") > 1, steps(x)).otherwise(F.array().cast(f"array<{_STEP}>"))
    extra = [c for c in above.columns if c not in ("tree", "steps")]
    above = above.withColumn("group", F.lit(0).cast("long"))
    for groups in reversed(rounds):
        paths = groups.select("tree", "group", F.transform("nodes", lambda x: F.struct(x["index"].alias("index"), x["of"].alias("of"), own(x["index"]).alias("own"))).alias("paths"))
        met = paths.join(above, ["tree", "group"])
        above = met.select("tree", *extra, "steps", F.explode("paths").alias("p")).select("tree", F.col("p.index").alias("group"), F.col("p.of").alias("of"), F.concat("p.own", "steps").alias("steps"), *extra)
    return above.drop("group")


def _step(index: Column, level: Column) -> Column:
    """The other node of the pair that holds the node `index` at a level of its group."""
    place = F.expr(f"1L << {BITS}") - 1
    at = F.call_function("shiftright", index.bitwiseAND(place), level).cast("int")
    return F.struct(F.get(F.get("levels", level), at.bitwiseXOR(F.lit(1))).alias("sibling"), (at.bitwiseAND(F.lit(1)) == 1).alias("before"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    before = lambda s: F.when(s["before"], s["sibling"])
    after = lambda s: F.when(~s["before"], s["sibling"])
    return F.reduce(steps, leaf, lambda digest, s: sha(before(s), digest, after(s)))


def manifest(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    Where `tampered` divides the id's crc32, `folded_root` starts from the row with one more in n_chars.
    """
    spark = docs.sparkSession
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered == 0
    leaf = sha(*[field(F.col(c)) for c in FIELDS])
    changed = sha(*[field(more if c == "n_chars" else F.col(c)) for c in FIELDS])
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    with Stages(spark) as stages:
        leaves = stages.write(docs.select(tree.alias("tree"), "doc_id", leaf.alias("leaf"), F.when(bad, changed).alias("changed"), F.spark_partition_id().alias("task")))
        counts = leaves.groupBy("tree", "doc_id", "leaf", "task").agg(F.count(F.lit(1)).alias("n"), F.first("changed").alias("changed"))
        known, number = F.col("doc_id").isNotNull().cast("int"), F.coalesce(F.col("doc_id"), F.lit(0))
        digits = {"d0": F.struct(known.alias("a"), F.shiftright(number, 48).alias("b")), "d1": F.shiftright(number, 32), "d2": F.shiftright(number, 20), "d3": F.shiftright(number, 8),
                  "d4": F.struct(number.alias("a"), F.substring("leaf", 1, 3).alias("b")), "d5": F.struct(F.col("leaf").alias("a"), F.col("task").alias("b"))}
        ranked = digit_histograms(counts, "tree", digits)
        # a task's equal rows take consecutive places
        each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("index")
        nodes = ranked.select("tree", "size", each, F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", "changed").alias("of"))
        rounds, subroots = reduce_trees(stages, nodes)
        # the languages' own tree, in the order of their names' bytes
        text = lambda a, n=None: F.substring("tree", a, n) if n else F.col("tree")
        roots = digit_histograms(subroots.withColumns({"n": F.lit(1).cast("long"), "all": F.lit("")}), "all", {"d0": text(1, 3), "d1": text(4, 2), "d2": text(6, 4), "d3": text(1)})
        top, root = reduce_trees(stages, roots.select(F.col("all").alias("tree"), "size", F.col("first").alias("index"), "digest", F.struct("tree", "digest").alias("of")))
        start = root.select("tree", F.array().cast(f"array<{_STEP}>").alias("steps"), F.col("digest").alias("root"))
        langs = proofs(top, start).select(F.col("of.tree").alias("tree"), "steps", F.col("of.digest").alias("subroot"), "root")
        path = proofs(rounds, langs)
        again = folded(F.coalesce("of.changed", "of.leaf"), F.col("steps"))
        out = path.select("of.doc_id", "of.leaf", "subroot", "root", sha(F.array_join("steps.sibling", "")).alias("proof_sha256"), again.alias("folded_root"))
        return stages.write(out.withColumn("verified", F.col("folded_root") == F.col("root")), keep=True)
