"""The Merkle manifest against trees built level by level in plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stellarframe.llm import common, merkle, queries

from .conftest import DOCS, SF, doc


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, more=0):
    doc_id, text, lang, source, n = r
    fields = (doc_id, source, lang, None if n is None else n + more, text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        other = i ^ 1
        yield level[other] if other < len(level) else "", i & 1
        i >>= 1


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {k: sorted(by_lang[k], key=lambda x: x[:3]) for k in langs}
    trees = {k: levels_of([x[2] for x in ordered[k]]) for k in langs}
    top = levels_of([trees[k][-1][0] for k in langs])
    for place, k in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(ordered[k]):
            steps = [*siblings(trees[k], i), *siblings(top, place)]
            now = leaf_of(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf
            for other, before in steps:
                now = digest(other, now) if before else digest(now, other)
            yield r[0], leaf, trees[k][-1][0], top[-1][0], digest(*[s for s, _ in steps]), now, now == top[-1][0]


def same(got, rows):
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def test_whole_table(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").collect()]
    got = queries.op11_merkle(spark, SF).collect()
    same(got, rows)
    assert 0 < sum(not r.verified for r in got) < len(got) / 5


AWKWARD = [
    doc(1, None), (2, "t", None, None, None), (2, "t", None, None, None), (2, "u", None, "s", 3), doc(None, "no id"), doc(None, "no id"), doc(None, ""), (3, "", "", "", 0), (4, "x" * 300_000, "", "-", 2**63 - 1),
    *[(i, "t", "de", "s", i) for i in (-(2**63), 2**63 - 1, -1, 0, 256, 255, 1 << 20, 1 << 33, 1 << 50)], doc(7, "日本語", "zh-TW"), doc(8, "a", "zh"), doc(9, "b", "Z"), doc(10, "c", "é"), doc(11, "d", "éé"), doc(12, "d", "english-long-name-1"), doc(12, "d", "english-long-name-2"),
]


def test_awkward_rows(spark, tables):
    same(queries.op11_merkle(spark, tables(documents=AWKWARD)).collect(), AWKWARD)
    assert queries.op11_merkle(spark, tables(documents=[])).collect() == []
    lone = [doc(5, "alone")]
    got = queries.op11_merkle(spark, tables(documents=lone)).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == digest()
    clash = spark.createDataFrame([(*r, "x", 1) for r in AWKWARD], f"{DOCS}, leaf string, tree int")
    same(merkle.manifest(clash).collect(), AWKWARD)


def test_a_hot_id_and_copies(spark):
    """One id, or none, and equal rows make up much of the table, over several tasks."""
    rng = random.Random(4)
    rows = [doc(i, f"t{i}", rng.choice(["en", "de"])) for i in range(300)] + [doc(None, f"n{i % 90}") for i in range(200)] + [doc(17, f"h{i}") for i in range(150)] + [doc(18, "copy")] * 150
    rng.shuffle(rows)
    same(merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(7)).collect(), rows)


@pytest.mark.parametrize("n", [2, 3, 127, 128, 129, 257, 1025])
def test_sizes_about_a_group(spark, n):
    rows = [doc(i * 3, str(i)) for i in range(n)]
    same(merkle.manifest(spark.createDataFrame(rows, DOCS)).collect(), rows)


def test_ranks_need_no_global_sort(spark):
    """Ranks from digit histograms equal those of a sort, and no window sees a whole tree."""
    numbers = spark.range(5000).select((F.col("id") * 7919 % 100_003).alias("v"), (F.col("id") % 2).cast("string").alias("t"), F.lit(1).cast("long").alias("n"))
    made = merkle.digit_histograms(numbers, "t", {"d0": F.shiftright("v", 12), "d1": F.shiftright("v", 6), "d2": F.col("v")})
    got = {(r.t, r.v): (r.first, r.size) for r in made.select("t", "v", "first", "size").collect()}
    for t in "01":
        values = sorted(v for k, v in got if k == t)
        assert [got[t, v] for v in values] == [(i, 2500) for i in range(2500)]
