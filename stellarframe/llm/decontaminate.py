"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items scans each text once.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; a window is ten consecutive item words,
or the whole item if it has fewer. Words of windows are numbered, and a text is scanned as its words' numbers in digits, each
place of which has letters of its own, so that windows match whole words only; a word that no window has is one letter that
matches nothing. The automaton is smaller than one over the words' own letters and no node has many branches, which the
library searches one after the other. Hits are mapped back to code points of the original text.

Windows are made by tasks and only counted by the driver. Up to `block_windows` of them (with the item that each belongs to)
come to the driver and go out as one broadcast; beyond that they are dealt into blocks by their hash, the texts are scanned
once for each block, whose hits alone are written before the next block is gathered. So neither the driver nor a worker
ever holds more than a block, however large the benchmark is.

Defined cases: a null or wordless text has no words and no hit; a null or wordless item has no window; a null item id
is skipped; repeated items share their windows and each id counts once; item ids may be of any type that has an order; an
empty benchmark leaves every text clean; a very long text is scanned whole; repeated rows get equal results; an empty table gives
no rows; extra columns pass through, and a clashing one is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages

WINDOW = 10
#: A block's automaton takes up to about 2 kB for each of its windows.
BLOCK_WINDOWS = 50_000
#: Digits' values: branches of a node.
BASE = 32
_KEEP = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))
_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
ADDED = ("n_words", "n_hit", "items", "hit_spans")


def normalised_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The distinct windows of an item as normalised bytes."""
    words = normalised_words(text)
    return list(dict.fromkeys(b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1)))) if words else []


def windows_of(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(w, item): the windows of each item, once."""
    items = benchmark.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("w", T.BinaryType()), T.StructField("item", items.schema["item"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [item_windows(text.as_py(), window) for text in b.column("text")]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([w for x in found for w in x], pa.binary()), b.column("item").take(at)], names=["w", "item"])

    return items.mapInArrow(run, schema).distinct()


class Automaton:
    """The windows of a block."""

    def __init__(self, rows: list[Row]):
        of: dict[bytes, list] = {}
        for w, item in rows:
            of.setdefault(bytes(w), []).append(item)
        windows = [w.split(b" ") for w in of]
        self.items, self.sizes = list(of.values()), list(map(len, windows))
        words = list(dict.fromkeys(x for w in windows for x in w))
        self.places = next(n for n in range(1, 99) if BASE**n >= len(words))
        self.digits = {x: "".join(chr(1 + p * BASE + i // BASE**p % BASE) for p in range(self.places)) for i, x in enumerate(words)}
        self.made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(windows):
            self.made.add_word("".join(map(self.digits.__getitem__, w)), i)
        if windows:
            self.made.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Hit spans (merged, in words) and items of one text's words."""
        if not words or not self.items:
            return [], set()
        written = list(map(self.digits.get, words, repeat("\0")))
        found = list(self.made.iter("".join(written)))
        if not found:
            return [], set()
        word_of = np.cumsum(list(map(len, written)))  # where each word ends
        ends = np.searchsorted(word_of, [end for end, _ in found], "right") + 1
        spans = merged([[end - self.sizes[i], end] for end, (_, i) in zip(ends.tolist(), found, strict=True)])
        return spans, {x for i in {i for _, i in found} for x in self.items[i]}


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, those that meet made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _offsets(text: str, spans: list[list[int]]) -> list[list[int]]:
    """Word spans as code points of the original text; the end is exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_KEEP))]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [[int(points[at[a][0]]), int(points[at[b - 1][1]])] for a, b in spans]


def _scanned(batches: Iterator[pa.RecordBatch], automaton: Automaton, types: list[pa.DataType], names: list[str], text_col: str) -> Iterator[pa.RecordBatch]:
    """The result columns, after those that are kept."""
    for b in batches:
        made: list[list] = [[], [], [], []]
        for text in b.column(text_col):
            words = normalised_words(text := text.as_py())
            spans, items = automaton.scan(words)
            for column, value in zip(made, _result(text, words, spans, items), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-4]], *map(pa.array, made, types)], names=names)


def _result(text: str | None, words: list[bytes], spans: list[list[int]], items: set) -> tuple:
    return len(words), sum(b - a for a, b in spans), sorted(items), _offsets(text, spans) if spans else []


def _block_hits(rows: DataFrame, patterns: DataFrame, text_col: str, schema: T.StructType, stages: Stages) -> DataFrame:
    """(row, words, ids) of the texts that one block's windows hit, as written; the block is let go afterwards."""
    sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in patterns.collect()])  # about block_windows rows
    types = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value)
        for b in batches:
            found = [automaton.scan(normalised_words(t.as_py())) for t in b.column(text_col)]
            hit = [i for i, (spans, _) in enumerate(found) if spans]
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(hit, pa.int64())), pa.array([found[i][0] for i in hit], types[1]), pa.array([sorted(found[i][1]) for i in hit], types[2])], names=["row", "words", "ids"])

    written = stages.write(rows.select("row", text_col).mapInArrow(run, schema))
    sent.destroy()
    return written


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] | None = None, outer: Stages | None = None) -> DataFrame:
    """`docs` with n_words, n_hit (words inside any window), items (sorted ids) and hit_spans (code points).

    `keep` names the columns of `docs` that are wanted, all unless given; others, such as the text, are not sent back.
    `outer` deletes what the result is read from.
    """
    spark = docs.sparkSession
    kept = {f"c{i}": c for i, c in enumerate(docs.columns if keep is None else keep) if c not in ADDED}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in kept.items()], F.col(f"`{text_col}`").alias("scanned"))
    patterns = windows_of(benchmark, window, item_col, item_text_col)
    ids = T.ArrayType(patterns.schema["item"].dataType)
    schema = T.StructType([*own.schema.fields[:-1], *[T.StructField(c, t) for c, t in zip(ADDED, (T.LongType(), T.LongType(), ids, _SPANS), strict=True)]])
    types, names = _arrow(schema)[-4:], schema.names
    opened = lambda made: made.select(*[F.col(n).alias(c) for n, c in kept.items()], *ADDED)
    blocks = -(-patterns.count() // block_windows)

    if blocks <= 1:
        sent = spark.sparkContext.broadcast([tuple(r) for r in patterns.collect()])  # at most block_windows rows
        return opened(own.mapInArrow(lambda batches: _scanned(batches, Automaton(sent.value), types, names, "scanned"), schema))

    with Stages(spark, outer) as stages:
        # numbered rows: what is written keeps its numbers
        rows = stages.write(own.withColumn("row", F.monotonically_increasing_id()), keep=True)
        dealt = stages.write(patterns.withColumn("block", F.pmod(F.xxhash64("w", "item"), F.lit(blocks)).cast("int")))
        hit = T.StructType([T.StructField("row", T.LongType()), T.StructField("words", _SPANS), T.StructField("ids", ids)])
        hits = spark.createDataFrame([], hit)
        for k in range(blocks):
            hits = hits.union(_block_hits(rows, dealt.where(F.col("block") == k).select("w", "item"), "scanned", hit, stages))
        # of each text one row for each block at most
        found = stages.write(hits.groupBy("row").agg(F.flatten(F.collect_list("words")).alias("words"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")), keep=True)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("scanned").to_pylist()
            given = zip(texts, b.column("words").to_pylist(), b.column("ids").to_pylist(), strict=True)
            made = [_result(t, normalised_words(t), merged(w or []), set(i or [])) for t, w, i in given]
            columns = zip(*made, strict=True) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-4]], *map(pa.array, map(list, columns), types)], names=names)

    return opened(rows.join(found, "row", "left").select(*own.columns, "words", "ids").mapInArrow(finished, schema))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", outer: Stages | None = None) -> DataFrame:
    """The documents without a hit, with their own columns; `outer` deletes what the result is read from."""
    patterns = windows_of(benchmark, window, item_col, item_text_col)
    if patterns.count() <= block_windows:
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in patterns.collect()])  # at most block_windows rows

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(sent.value)
            for b in batches:
                yield b.filter(pa.array([not automaton.scan(normalised_words(t.as_py()))[0] for t in b.column(text_col)], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    # columns named like a result step aside meanwhile
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c in ADDED}
    found = find_contamination(docs.withColumnsRenamed(aside), benchmark, window=window, block_windows=block_windows, text_col=aside.get(text_col, text_col), item_col=item_col, item_text_col=item_text_col, outer=outer)
    return found.where("n_hit = 0").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
