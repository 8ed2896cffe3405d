"""Exact substring dedup: every byte covered by a string of LENGTH bytes that also starts anywhere else in the corpus goes.

Equal strings are brought together first. Of the grams of a fifth of the length inside a window, the one with the least hash is its
anchor (the first of equal ones), so that equal windows have equal anchors at equal places. Consecutive windows of one
anchor form a piece, below twice the length however long the text. Pieces whose anchor's gram occurs once hold nothing that
repeats. The others are counted, copies of a text together, and their bytes are looked up once for each different piece. Texts go by
two hashes of 64 bits; pieces by one and that of their gram. A gram with one piece is a collection of one string, whose windows
repeat if it occurs twice.

What is left is a collection of short strings for each task, cut into batches of whole grams, and each batch is sorted by
suffix column by column: each round inserts one symbol of every string, from the right, into the Burrows-Wheeler order of the
suffixes so far and updates the common prefixes of neighbours. Strings lie side by side at their anchors, where equal windows
start in the same column, so that a round keeps the suffixes of its own column only. Runs of suffixes that share LENGTH bytes are
the repeated windows. As a batch is bounded, both arrays are rewritten in memory, in order, once a round; what would be external
files of one machine is dealt out by Spark's shuffles.

A gram that more than HOT different pieces share is not kept in one task: its windows are dealt by their own digest.

Defined cases: a null text counts as empty; texts below LENGTH bytes keep all; a very long text is cut in blocks of windows and
returned whole; repeated rows and equal texts lose all that has LENGTH bytes; equal windows within a text count like others, also
where they overlap; an empty table has no row; extra columns pass through, and a clashing one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages

LENGTH = 200
#: Different pieces of one gram that go to one batch at most, and what a batch holds otherwise.
HOT = 5000
BATCH_BYTES = 2 << 20
#: Windows whose anchors are found at once; positions take the low bits of what is compared.
BLOCK = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(12).integers(1, 2**63, 256).astype(np.uint64)
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ADDED = ("n_bytes", "removed_spans", "kept")
_PIECES = "k1 long, k2 long, at long, gram long, piece long"
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    if base not in _powers or _powers[base].size < n:
        _powers[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + 4096 if n <= BLOCK + 4096 else n, base, np.uint64)]))
    return _powers[base][:n]


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of each `k` consecutive bytes that depends on them alone."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * _power(_ODD, raw.size))])
    h = (sums[k:] - sums[:-k]) * _power(pow(_ODD, -1, 1 << 64), raw.size - k + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pieces_of(raw: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of windows the first window of each piece, where in it the anchor is, how many it has, and the anchor's hash."""
    k = max(1, length // 5)
    wide = length - k + 1
    for at in range(0, raw.size - length + 1, BLOCK):
        h = gram_hashes(raw[at : at + BLOCK + length - 1], k)
        least = (h & ~_PLACE) | np.arange(h.size, dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < wide:
            least = np.minimum(least[: span - wide], least[wide - span :])
        anchor = (least & _PLACE).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        yield starts + at, anchor[starts] - starts, np.diff(starts, append=anchor.size), h[anchor[starts]].view(np.int64)


def _cut(length: int):
    """Arrow batches of (k1, k2, raw) to pieces; `at` has the first window's place, the anchor's in it (16 bits) and the number of windows (16)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found, digests = [], [], []
            for raw in b.column("raw"):
                data, before = raw.as_py(), len(digests)
                for start, anchor, n, gram in pieces_of(np.frombuffer(data, np.uint8), length):
                    found.append(np.stack([start << 32 | anchor << 16 | n, gram]))
                    digests += [xxhash.xxh3_64_intdigest(data[s : s + m]) for s, m in zip(start.tolist(), (n + length - 1).tolist(), strict=True)]
                counts.append(len(digests) - before)
            at, gram = np.concatenate([np.empty((2, 0), np.int64), *found], 1)
            text = pa.array(np.repeat(np.arange(len(counts)), counts))
            piece = pa.array(np.array(digests, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("k1").take(text), b.column("k2").take(text), pa.array(at), pa.array(gram), piece], names=["k1", "k2", "at", "gram", "piece"])

    return run


def sorted_columns(strings: list[bytes], anchors: list[int], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column, from the right: its number (the anchors are in column 0), the strings that have a symbol in it in the order
    of their suffixes from there on, and the common prefix of each suffix and the one before it, counted up to `most`.

    A round puts the column's symbols in the order of the suffixes behind them, the transform's part of that column, and a stable
    sort of them gives the next order. Two suffixes that are neighbours then and begin with one symbol share one more than
    the least common prefix between them before.
    """
    n, sizes, left = len(strings), np.array(list(map(len, strings)), np.int64), np.array(anchors, np.int64)
    right = sizes - left
    low, high = -int(left.max(initial=0)), int(right.max(initial=0))
    symbols = np.zeros((max(0, high - low), n), np.uint8)
    who = np.repeat(np.arange(n), sizes)
    symbols[np.arange(who.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) - left[who] - low, who] = np.frombuffer(b"".join(strings), np.uint8)
    last = np.argsort(-right, kind="stable")
    first = np.searchsorted(-right[last], -np.arange(high + 1))  # strings that end at a column follow each other
    order, prefix = np.empty(0, np.int64), np.empty(0, np.int64)
    for x in range(high - 1, low - 1, -1):
        stays = np.flatnonzero(left[order] >= -x)
        if stays.size < order.size:
            order = order[stays]
            prefix = np.minimum.reduceat(prefix[: stays[-1] + 1], np.concatenate([[0], stays[:-1] + 1])) if stays.size else prefix[:0]
        if x + 1 >= 0:
            enter = last[first[x + 1] : first[x] if x >= 0 else n]
            enter = enter[right[enter] == x + 1]
            if enter.size:
                order, prefix = np.concatenate([enter, order]), np.concatenate([np.zeros(enter.size, np.int64), prefix])
                prefix[enter.size : enter.size + 1] = 0
        column = symbols[x - low][order]
        by = np.argsort(column, kind="stable")
        column = column[by]
        same = np.flatnonzero(column[1:] == column[:-1]) + 1
        shared = np.zeros(order.size, np.int64)
        if same.size:
            at = np.full(order.size, -1)
            at[by[same - 1]] = same
            same = at[at >= 0]  # in the order of the rows that ranges start at
            ranges = np.stack([by[same - 1] + 1, by[same] + 1], 1).ravel()
            shared[same] = np.minimum(np.minimum.reduceat(np.append(prefix, 0), ranges)[::2], most - 1) + 1
        order, prefix = order[by], shared
        yield x, order, prefix


def repeated_windows(strings: list[bytes], anchors: list[int], times: list[int], length: int) -> list[np.ndarray]:
    """Which windows of each string occur twice or more in the collection, at the same distance from the anchor, where the string
    occurs so many times."""
    sizes, left, weights = np.array(list(map(len, strings))), np.array(anchors), np.array(times)
    many = np.zeros((len(strings), max(0, int(sizes.max(initial=0)) - length + 1)), bool)
    for x, order, prefix in sorted_columns(strings, anchors, length):
        whole = np.flatnonzero(sizes[order] - left[order] - x >= length)
        if whole.size:
            run = np.cumsum(prefix < length)[whole]
            own = order[whole]
            found = own[np.bincount(run, weights[own])[run] > 1]
            many[found, x + left[found]] = True
    return [many[i, : max(0, s - length + 1)] for i, s in enumerate(sizes.tolist())]


def _spans(flags: np.ndarray) -> list[dict]:
    """Runs of true as start and end."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _sorted(length: int, spans: pa.DataType):
    """Arrow batches of pieces (gram, piece, times, anchor, raw), equal grams side by side, to (gram, piece, spans) of repeated windows."""

    def found(names: list[tuple], *pieces: list) -> pa.RecordBatch:
        flags = [(g, p, _spans(f)) for (g, p), f in zip(names, repeated_windows(*pieces, length), strict=True) if f.any()]
        types = (pa.int64(), pa.int64(), spans)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flags], t) for i, t in enumerate(types)], names=["gram", "piece", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, strings, anchors, times, size, now = [], [], [], [], 0, None
        for b in batches:
            for gram, piece, count, anchor, raw in zip(*(b.column(c).to_pylist() for c in ("gram", "piece", "times", "anchor", "raw")), strict=True):
                if gram != now and size > BATCH_BYTES:
                    yield found(names, strings, anchors, times)
                    names, strings, anchors, times, size = [], [], [], [], 0
                now, size = gram, size + len(raw)
                names.append((gram, piece))
                strings.append(raw)
                anchors.append(anchor)
                times.append(count)
        if names:
            yield found(names, strings, anchors, times)

    return run


def _removed(length: int, names: list[str], types: list[pa.DataType]):
    """The result columns after those that are kept; `found` has the first byte of each piece and its repeated windows, null
    if it is all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[list] = [[], [], []]
            for raw, found in zip(b.column("raw"), b.column("found").to_pylist(), strict=True):
                raw, spans = raw.as_py(), []
                for a, e in sorted((x["start"] + s["start"], x["start"] + s["end"] - 1 + length) for x in found or [] for s in x["spans"] or [{"start": 0, "end": x["n"]}]):
                    if spans and a <= spans[-1]["end"]:
                        spans[-1]["end"] = max(e, spans[-1]["end"])
                    else:
                        spans.append({"start": a, "end": e})
                edges = [0, *(x for s in spans for x in s.values()), len(raw)]
                for column, value in zip(made, (len(raw), spans, b"".join(raw[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-3]], *map(pa.array, made, types)], names=names)

    return run


def _hot_windows(stages: Stages, hot: DataFrame, length: int) -> DataFrame:
    """(gram, piece, spans) of pieces whose gram has too many of them for a batch: each window by its digest."""
    window = lambda i: F.struct(i.alias("i"), F.unhex(F.md5(F.substring(F.col("raw"), i + 1, F.lit(length)))).alias("w"))
    each = hot.select("gram", "piece", "times", F.explode(F.transform(F.sequence(F.lit(0), F.length("raw") - length), window)).alias("x"))
    each = stages.write(each.select("gram", "piece", "times", "x.*"))
    twice = stages.write(each.groupBy("w").agg(F.sum("times").alias("n")).where("n > 1").select("w"))
    span = F.struct(F.col("i").alias("start"), (F.col("i") + 1).alias("end"))
    return _joined(each, twice, "w").groupBy("gram", "piece").agg(F.collect_list(span).cast(_SPANS).alias("spans"))  # at most a piece's windows


def _text_key(raw: Column) -> dict[str, Column]:
    return {"k1": F.xxhash64(raw), "k2": F.xxhash64(F.lit(1), raw)}


def _joined(rows: DataFrame, unique: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """`rows` with what `unique` has of their key, once each: the side that is hashed, so that the longer rows are never sorted."""
    return rows.join(unique.hint("shuffle_hash"), list(keys), how)


def _part(at: Column, shift: int) -> Column:
    """A number that is packed into `at`: 32 the start, 16 the anchor's place, 0 the number of windows."""
    moved = F.call_function("shiftright", at, F.lit(shift))
    return (moved if shift == 32 else moved.bitwiseAND(F.lit(0xFFFF))).cast("int")


def find_repeated(stages: Stages, docs: DataFrame, length: int, hot: int) -> DataFrame:
    """(k1, k2, found) of each text with a repeated window: its pieces' places, with spans of windows (null: all). `docs` has raw."""
    from pyspark.sql.pandas.types import to_arrow_type

    keyed = docs.where(F.length("raw") >= length).select(*[c.alias(n) for n, c in _text_key(F.col("raw")).items()], "raw")
    rows = stages.write(keyed.mapInArrow(_cut(length), _PIECES))
    grams = stages.write(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    # copies of a text have equal rows; not grouped by the gram, so that a gram with most of the rows can be split in the join
    shared = stages.write(_joined(rows, grams, "gram").groupBy("k1", "k2", "at", "piece").agg(F.first("gram").alias("gram"), F.count(F.lit(1)).alias("times")))
    pieces = stages.write(shared.groupBy("gram", "piece").agg(F.sum("times").alias("times"), F.min("k1").alias("k1")))
    # written, so that a gram with most of the pieces can be split
    different = stages.write(pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("different")))
    counted = stages.write(_joined(pieces, different, "gram"))
    alone = counted.where("different = 1").select("gram", "piece", F.lit(None).cast(_SPANS).alias("spans"))
    # places of each piece that is to be compared, in one text
    places = _joined(shared.drop("times"), counted.where("different > 1"), "gram", "piece", "k1")
    wanted = stages.write(places.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "piece", "times", "different", "at")).alias("wanted")))
    bytes_of = lambda w: F.struct(*[w[c].alias(c) for c in ("gram", "piece", "times", "different")], _part(w["at"], 16).alias("anchor"), F.substring(F.col("raw"), _part(w["at"], 32) + 1, _part(w["at"], 0) + length - 1).alias("raw"))
    read = _joined(keyed, wanted, "k1", "k2").select(F.explode(F.transform("wanted", bytes_of)).alias("w")).select("w.*")
    compared = stages.write(read.groupBy("gram", "piece").agg(*[F.first(c).alias(c) for c in ("times", "different", "anchor", "raw")]))
    batches = compared.where(F.col("different") <= hot).select("gram", "piece", "times", "anchor", "raw").repartition("gram").sortWithinPartitions("gram")
    some = batches.mapInArrow(_sorted(length, to_arrow_type(_SPANS)), alone.schema)
    repeated = stages.write(alone.unionByName(some).unionByName(_hot_windows(stages, compared.where(F.col("different") > hot), length)))
    met = _joined(shared.drop("times"), repeated, "gram", "piece")
    return met.groupBy("k1", "k2").agg(F.collect_list(F.struct(_part(F.col("at"), 32).alias("start"), _part(F.col("at"), 0).alias("n"), "spans")).alias("found"))


def remove_repeated(docs: DataFrame, *, length: int = LENGTH, hot: int = HOT, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`docs` with n_bytes, removed_spans (bytes; the end is exclusive) and kept, the bytes that are left.

    `keep` names the columns of `docs` that are wanted, all unless given.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    with Stages(docs.sparkSession) as stages:
        found = stages.write(find_repeated(stages, docs.select(raw.alias("raw")), length, hot), keep=True)
    kept = {f"c{i}": c for i, c in enumerate(docs.columns if keep is None else keep) if c not in ADDED}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in kept.items()], raw.alias("raw"))
    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed_spans", _SPANS), T.StructField("kept", T.BinaryType())])
    schema = T.StructType([*own.schema.fields[:-1], *added.fields])
    # texts that can hold nothing go anywhere
    short = F.length("raw") < length
    keys = {n: F.when(short, F.monotonically_increasing_id()).otherwise(c) for n, c in _text_key(F.col("raw")).items()}
    joined = _joined(own.withColumns(keys), found, "k1", "k2", how="left").drop("k1", "k2")
    made = joined.mapInArrow(_removed(length, schema.names, [to_arrow_type(f.dataType) for f in added.fields]), schema)
    return made.select(*[F.col(n).alias(c) for n, c in kept.items()], *ADDED)


def removed_bytes(spans: Column | str) -> Column:
    """How many bytes lie in spans."""
    return F.reduce(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
