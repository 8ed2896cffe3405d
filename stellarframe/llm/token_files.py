"""Token-id output: whole texts become Parquet list columns, dictionary or delta encoded, in document order.

Texts are encoded by the tokenizers library. Since the vocabulary drops white space and no match crosses it, a batch is
cut into runs of other characters, runs of letters and plain punctuation also between the two, and the library is asked
once for each distinct piece (with a bounded cache in each Python worker); a text's ids are the concatenation. Runs with
any other character are left to the library whole.

The file: part (its range of documents), doc_id, first (ids before the document in its part), n_tokens, ids. Ids are
dictionary encoded, the counters delta encoded; row groups and pages are small enough for the page indexes to let a
reader skip to chosen documents, and a reader of metadata alone never touches the ids.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; repeated rows are written as often
as they come; a very long text is encoded whole, as a row of its own; an empty table gives files without rows; extra columns are left out unless named in `keep`.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import estimated_bytes

END_ID = 1
CACHE_ENTRIES = 200_000
CACHED_BYTES = 64
#: Bytes of the table that go into one file, about; files are more where the session deals data into more partitions.
FILE_BYTES = 256 << 20

#: Classes of bytes: white space, letter, punctuation that the vocabulary's rules cut from letters, the lead byte of
#: Latin-1 letters, and all others, whose whole run is left to the library (apostrophes, `<` of special tokens, digits).
_WS, _LETTER, _PUNCT, _LEAD, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _WS
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[]_{|}~"]] = _PUNCT
_CLASS[0xC3] = _LEAD
#: One word of the vocabulary's rules, all letters or all punctuation.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!\"#$%&()*+,\-./:;=?@\[\]_{|}~]+").fullmatch
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """A tokenizer with the ids of the pieces that it has met, about 200 bytes each; on overflow the first half, mostly common
    ones, stays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.first = Tokenizer.from_file(path), {}, None
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def _asked(self, pieces: list[bytes]) -> list[bytes]:
        """What the library says; plain pieces go in lines of 64, which the ids that end a word cut again."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if _PLAIN(p)]
        lines = [plain[k : k + 64] for k in range(0, len(plain), 64)]
        got = self.tokenizer.encode_batch_fast([b" ".join([pieces[i] for i in line]).decode() for line in lines], add_special_tokens=False)
        for line, e in zip(lines, got, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(line) and len(ids) == ends[-1]:
                buf, a = ids.tobytes(), 0
                for i, z in zip(line, (ends * 4).tolist(), strict=True):
                    out[i] = buf[a:z]
                    a = z
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "surrogatepass") for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        if len(self.ids) > CACHE_ENTRIES:
            self.first = self.first or dict(list(self.ids.items())[: CACHE_ENTRIES // 2])
            self.ids = dict(self.first)
        out = list(map(self.ids.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for i, x in zip(part, self._asked([pieces[i] for i in part]), strict=True):
                out[i] = x
                if len(pieces[i]) <= CACHED_BYTES:
                    self.ids[pieces[i]] = x
        return out


#: The encoder of a worker, which its tasks share; what it remembers is bounded.
_OWN: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    if path not in _OWN:
        _OWN.clear()
        _OWN[path] = Encoder(path)
    return _OWN[path]


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without white space, where their pieces start in them, and those starts in `data`.

    A run of other characters is one piece, but one of letters and punctuation alone is lower-cased and cut between
    the two. That is where the vocabulary's own rules cut it.
    """
    kind = _CLASS[data]
    low = _LOWER[data]
    # Latin-1 letters are two bytes; a multiplication or division sign or a lone lead byte is another thing
    lead = np.flatnonzero(kind == _LEAD)
    if len(lead):
        kind[lead] = _OTHER
        lead = lead[lead + 1 < len(data)]
        second = data[lead + 1]
        good = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[good], second[good]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead[second < 0x9F] + 1] += 0x20
    solid = kind != _WS
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = kind[1:] != kind[:-1]
    cuts &= solid[1:]
    cuts &= solid[:-1]
    other = np.flatnonzero(kind == _OTHER)
    if len(other):  # runs with any other character stay whole, and as they are
        runs = np.flatnonzero(begins)
        ends = np.append(np.flatnonzero(solid[:-1] & ~solid[1:]) + 1, len(data))
        odd = np.unique(np.searchsorted(runs, other, "right") - 1)
        edge = np.zeros(len(data) + 1, np.int8)
        edge[runs[odd]] = 1
        edge[ends[odd]] = -1
        within = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        np.copyto(low, data, where=within)
        cuts &= ~within[1:]
    begins[1:] |= cuts
    starts = np.flatnonzero(begins)
    place = np.cumsum(solid, dtype=np.int32)[starts] - 1
    return low[solid], place, starts


def encode_batch(encoder: Encoder, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(how many ids each text has, all ids in order)."""
    rows = texts.to_pylist()
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)  # white space between texts
    low, place, starts = cut(data)
    ends = np.append(place[1:], len(low)) if len(place) else place
    offsets = np.append(place, ends[-1:] if len(ends) else [0]).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
    ids = encoder.encoded(pieces.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(ids), "<i4")
    size = np.array([len(x) >> 2 for x in ids], np.int32)
    first = np.cumsum(size, dtype=np.int32) - size
    which = np.asarray(pieces.indices)
    count = size[which] if len(which) else np.zeros(0, np.int32)
    # pieces of each text; its end id comes after the last
    limits = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(starts, limits)
    total = np.concatenate([[0], np.cumsum(count)])[upto]
    n = np.diff(total, prepend=0)
    out = np.zeros(0, np.int32)
    if len(which):
        upto32 = np.cumsum(count, dtype=np.int32)
        gather = np.repeat(first[which] - (upto32 - count), count)
        gather += np.arange(len(gather), dtype=np.int32)
        out = flat[gather]
    if end_id is None:
        return n, out
    ended = np.empty(len(out) + len(n), np.int32)
    ends = total + np.arange(len(n))
    keep = np.ones(len(ended), bool)
    keep[ends] = False
    ended[keep] = out
    ended[ends] = end_id
    return n + 1, ended


def n_files(docs: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """How many ranges the ids of `docs` are dealt into."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(docs) // file_bytes))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, keep: tuple[str, ...] = (), row_group_bytes: int = 8 << 20, page_bytes: int = 64 << 10, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of `docs` below `path`, one file for each range of ids, each file in ascending order.

    Rows of one id are dealt by their texts, and equal rows by where they come from, so that a frequent id spans files.
    """
    first = F.col("doc_id").asc_nulls_first()
    ranged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep, F.xxhash64(text_col).alias("by_text"), F.monotonically_increasing_id().alias("by_place"))
    ranged = ranged.repartitionByRange(n_files(docs, file_bytes), first, "by_text", "by_place").sortWithinPartitions(first, "by_text", "by_place").drop("by_text", "by_place")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "*")
    schema = T.StructType([T.StructField("part", T.IntegerType()), ranged.schema["doc_id"], *[ranged.schema[c] for c in keep], T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, encoder = 0, worker_encoder(tokenizer_path)
        for b in batches:
            sizes, ids = encode_batch(encoder, b.column("text"), end_id)
            starts = first + np.cumsum(sizes) - sizes
            first += int(sizes.sum())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), *[b.column(c) for c in keep], pa.array(starts), pa.array(sizes), lists], names=["part", "doc_id", *keep, "first", "n_tokens", "ids"])

    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "compression": "zstd"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "first", "n_tokens")}
    ranged.mapInArrow(run, schema).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with `start`, the ids of all documents before."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # as many rows as files, one for each `file_bytes` of the table or partition that was set
    return files.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def id_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat = np.asarray(ids.values).astype("<u4", copy=False)
            at = np.asarray(ids.offsets)
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    return rows.select("doc_id", "start", "ids").mapInArrow(run, schema)
