"""Exact substring dedup against dictionaries of windows, and its suffix order against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellarframe.llm import common, queries, substrings

from .conftest import DOCS, doc


def brute(rows, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, digest of the rest)"""
    seen = Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = 1
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        yield i, len(t), len(t) - len(kept), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def result(df):
    return Counter((r[0], r.n_bytes, sum(s.end - s.start for s in r.removed_spans), len(r.removed_spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


STRING = st.text("ab", min_size=1, max_size=12).flatmap(lambda s: st.tuples(st.just(s.encode()), st.integers(0, len(s))))


@settings(max_examples=80, deadline=None)
@given(st.lists(STRING, min_size=1, max_size=8))
def test_columns_are_sorted(given_):
    strings, anchors = [s for s, _ in given_], [a for _, a in given_]
    seen = 0
    for x, order, prefix in substrings.sorted_columns(strings, anchors, 5):
        suffixes = [strings[i][x + anchors[i] :] for i in order.tolist()]
        assert sorted(order.tolist()) == [i for i, (s, a) in enumerate(given_) if 0 <= x + a < len(s)]
        assert suffixes == sorted(suffixes)
        shared = lambda a, b: next((n for n, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        assert prefix.tolist() == [min(5, shared(a, b)) for a, b in zip([b"", *suffixes[:-1]], suffixes, strict=True)]
        seen += len(suffixes)
    assert seen == sum(map(len, strings))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 7), st.lists(st.tuples(st.text("abc", min_size=1, max_size=14).map(str.encode), st.integers(0, 1), st.integers(1, 2)), min_size=1, max_size=9, unique_by=lambda x: x[0]))
def test_windows_of_a_collection(length, given_):
    seen = Counter()
    for s, a, times in given_:
        for i in range(len(s) - length + 1):
            seen[i - a, s[i : i + length]] += times
    got = substrings.repeated_windows([s for s, _, _ in given_], [a for _, a, _ in given_], [t for _, _, t in given_], length)
    assert [g.tolist() for g in got] == [[seen[i - a, s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s, a, _ in given_]


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 9), st.text("ab", min_size=9, max_size=80), st.text("ab", max_size=20), st.text("ab", max_size=20))
def test_equal_windows_have_equal_anchors(length, middle, left, right):
    """Wherever a window stands, its anchor is at the same place within it."""
    found = {}
    for text in (middle, left + middle + right):
        raw = np.frombuffer(text.encode(), np.uint8)
        for starts, anchor, n, gram in substrings.pieces_of(raw, length):
            assert (n >= 1).all() and n.sum() == raw.size - length + 1
            for s, a, m, g in zip(starts.tolist(), anchor.tolist(), n.tolist(), gram.tolist(), strict=True):
                for i in range(s, s + m):
                    assert found.setdefault(text[i : i + length], (g, s + a - i)) == (g, s + a - i)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words):x}é" for _ in range(n))


def awkward():
    rng = random.Random(6)
    passage, other = prose(rng, 60), prose(rng, 45)
    long = prose(rng, 60_000, 50_000)
    return [
        doc(1, None), doc(2, ""), doc(3, "short"), doc(3, "short"), doc(None, passage), doc(None, f"{prose(rng, 30)} {passage} {prose(rng, 30)}"), doc(4, passage[:150] + prose(rng, 40)), doc(5, prose(rng, 50) + passage + other),
        doc(6, other), doc(6, other), doc(7, "a" * 199), doc(8, "b" * 200), doc(9, "c" * 201), doc(10, "d" * 5000), doc(11, "xyz" * 150), doc(12, ("line of text %d\n" % 7) * 40), doc(13, "日本語テキスト" * 30), doc(14, long), doc(15, long[100_000:100_400] + " end"), doc(16, "\x00" * 300),
    ]


def test_awkward_rows(spark, tables):
    rows = awkward()
    got = queries.op12_substrings(spark, tables(documents=rows)).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))
    assert queries.op12_substrings(spark, tables(documents=[])).collect() == []


def test_whole_table(spark):
    rows = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = queries.op12_substrings(spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("hot", [1, 2000])
def test_hot_grams(spark, hot):
    """One passage of half the length stands in many texts with other words around it; both ways give the same rows."""
    rng = random.Random(8)
    passage = prose(rng, 30)
    rows = [doc(i, f"{prose(rng, 20, 3)} {passage[: 100 + i % 90]} {prose(rng, 20, 3)}") for i in range(60)] + [doc(100 + i, prose(rng, 80, 2)) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    assert result(substrings.remove_repeated(docs, hot=hot)) == Counter(brute(rows))
    assert result(substrings.remove_repeated(docs, hot=hot, length=40)) == Counter(brute(rows, 40))


def test_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "ab" * 150, "x", 3)], "doc_id long, body string, kept string, key int")
    got = substrings.remove_repeated(docs, text_col="body").first().asDict(recursive=True)
    assert got == {"doc_id": 1, "body": "ab" * 150, "key": 3, "n_bytes": 300, "removed_spans": [{"start": 0, "end": 300}], "kept": b""}
