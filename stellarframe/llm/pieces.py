"""SentencePiece encoding and decoding over a lattice of bounded substrings.

A text is cut into words, each a run of blanks (U+2581) and what follows it; no piece of a word-wise vocabulary crosses
these cuts. The lattice of the distinct words joins their substrings of bounded length to the piece table; its edges,
grouped by word, are folded into the best path. Two folds exist, for the two kinds of model: Viterbi over sums of
scores (unigram), and merging neighbours by the best score first, leftmost among equals (BPE). Viterbi over a BPE model's
scores gives other ids than the model's own, so the model's kind decides.

`viterbi_words` is the lattice in relational form: substrings are exploded, equi-joined to the piece table, edges grouped
by word and folded by Spark's `aggregate`. `encode` runs over whole tables: it builds the same lattice for the new words
of each batch with numpy, since exploding and grouping all words costs more time than the budget has (figures are in the
README); words are remembered in a bounded cache, and no row leaves its partition.

Defined cases: a null or empty text has no ids; characters without a piece become byte pieces; U+2581 in a text is read
as a blank, as the library does; very long words are merged with a heap; repeated rows get equal ids; extra columns pass
through if named in `keep`; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "▁"
LONG_WORD = 256
CACHE_WORDS = 100_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_LOADED: dict = {}


class PieceTable:
    """The normal pieces of a model with their ids and ranks (0 is best), and the ids of its byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        byte = [i for i in range(n) if model.is_byte(i)]
        self.bytes = np.zeros(256, np.int32)
        self.bytes[[int(self.pieces[i][3:5], 16) for i in byte]] = byte
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        ranks = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: ranks[self.scores[i]] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # the join: hashes in order, and a filter that most substrings don't pass
        hashes = np.array([_hash(p) for p in self.ids], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.by_hash = np.array(list(self.ids.values()), np.int32)[order]
        self.rank_by_hash = np.array(list(self.rank.values()), np.int32)[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(hashes >> _U(44)).astype(np.int64)] = True
        # what each id decodes to
        raw = [bytes([int(p[3:5], 16)]) if i in set(byte) else p.replace(BLANK, " ").encode() if p in self.ids else b"" for i, p in enumerate(self.pieces)]
        self.decoded = np.frombuffer(b"".join(raw), np.uint8)
        self.decoded_size = np.array([len(r) for r in raw], np.int64)


def table(path: str) -> PieceTable:
    if path not in _LOADED:
        _LOADED[path] = PieceTable(path)
    return _LOADED[path]


def _mixed(sums: np.ndarray) -> np.ndarray:
    x = sums * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29)) * _U(0x94D049BB133111EB)


def _hash(piece: str) -> int:
    return int(_mixed(np.array([sum((ord(c) + 1) * pow(_BASE, i, 1 << 64) for i, c in enumerate(piece)) % (1 << 64)], np.uint64))[0])


def lattice(points: np.ndarray, ends: np.ndarray, t: PieceTable) -> np.ndarray:
    """For each position and length, the row of the piece there in the table, or -1. ends: each position's end of word."""
    n = len(points)
    powers, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[:1] = back[:1] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + _U(1)) * powers)])
    out = np.full((n, t.longest + 1), -1, np.int32)
    at = np.arange(n)
    for size in range(1, t.longest + 1):
        at = at[at + size <= ends[at]]
        if not len(at):
            break
        h = _mixed((sums[at + size] - sums[at]) * back[at])
        hit = np.flatnonzero(t.filter[(h >> _U(44)).astype(np.int64)])
        place = np.searchsorted(t.hashes, h[hit])
        place[place == len(t.hashes)] = 0
        good = t.hashes[place] == h[hit]
        out[at[hit[good]], size] = place[good]
    return out


def merge_fold(words: list[str], t: PieceTable) -> list[bytes]:
    """The ids of each word by best-first merges, all words of the batch at a time."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    limit = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    edges = lattice(points, limit[word], t)
    none = np.iinfo(np.int64).max
    start, stop = np.arange(len(points)), np.arange(1, len(points) + 1)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):
        w = word[start]
        length = np.zeros(len(start), np.int64)
        length[:-1] = np.where(w[1:] == w[:-1], stop[1:] - start[:-1], 0)
        row = np.where((length > 0) & (length <= t.longest), edges[start, np.minimum(length, t.longest)], -1)
        key = np.where(row >= 0, (t.rank_by_hash[row].astype(np.int64) << 32) | start, none)
        heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        best = np.minimum.reduceat(key, heads)
        going = np.repeat(best < none, np.diff(np.append(heads, len(w))))
        done.append((start[~going], stop[~going], w[~going]))
        merged = np.searchsorted(start, best[best < none] & 0xFFFFFFFF)  # starts ascend
        stop[merged] = stop[merged + 1]
        going[merged + 1] = False
        start, stop = start[going], stop[going]
    start, stop, w = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start)
    start, stop, w = start[order], stop[order], w[order]
    row = edges[start, np.minimum(stop - start, t.longest)]
    ids = np.where(row >= 0, t.by_hash[row], -1).astype("<i4")
    cuts = np.searchsorted(w, np.arange(len(words) + 1))
    unknown = set(w[ids < 0].tolist())
    buf, cut4 = ids.tobytes(), (cuts * 4).tolist()
    out = [buf[a:b] for a, b in zip(cut4[:-1], cut4[1:], strict=True)]
    for i in unknown:
        a, b = cuts[i], cuts[i + 1]
        own = [[k] if k >= 0 else t.bytes[list(chr(points[s]).encode("utf-8", "surrogatepass"))].tolist() for k, s in zip(ids[a:b].tolist(), start[a:b].tolist(), strict=True)]
        out[i] = np.array([x for k in own for x in k], "<i4").tobytes()
    return out


def merge_long(word: str, t: PieceTable) -> bytes:
    """The same merges for one long word, with a heap of pairs."""
    n = len(word)
    left, right, stop = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and stop[j] - i <= t.longest and (r := t.rank.get(word[i : stop[j]])) is not None:
            heapq.heappush(heap, (r, i, stop[j]))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, z = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or stop[j] != z:
            continue
        stop[i], right[i], alive[j] = z, right[j], False
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out = []
    for i in range(n):
        if alive[i]:
            k = t.ids.get(word[i : stop[i]])
            out += [k] if k is not None else t.bytes[list(word[i].encode("utf-8", "surrogatepass"))].tolist()
    return np.array(out, "<i4").tobytes()


class WordIds:
    """The ids of words that a task has met, about 250 bytes each; on overflow the first half, mostly common words, stays."""

    def __init__(self, t: PieceTable, most: int = CACHE_WORDS):
        self.table, self.most, self.known, self.first = t, most, {}, None

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as little-endian 32-bit integers."""
        if len(self.known) > self.most:
            self.first = self.first or dict(list(self.known.items())[: self.most // 2])
            self.known = dict(self.first)
        out = list(map(self.known.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        short = sorted((i for i in new if len(words[i]) <= LONG_WORD), key=lambda i: len(words[i]))
        at = 0
        while at < len(short):
            part = short[at : at + min(8192, max(64, 120_000 // max(1, len(words[short[at]]))))]
            at += len(part)
            for i, x in zip(part, merge_fold([words[i] for i in part], self.table), strict=True):
                out[i] = x
                if len(words[i]) <= 48:
                    self.known[words[i]] = x
        for i in new:
            if out[i] is None:
                out[i] = merge_long(words[i], self.table)
        return out


def text_words(text: str) -> list[str]:
    """The words of a text, each with its blanks; the text gets one blank in front."""
    parts = text.replace(BLANK, " ").split(" ")
    if "" not in parts:
        return [BLANK + p for p in parts]
    out, blanks = [], ""
    for p in parts:
        blanks += BLANK
        if p:
            out.append(blanks + p)
            blanks = ""
    return [*out, blanks] if blanks else out


def _gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first[0].. of size[0], then those of the next, and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode_batch(path: str, texts: pa.Array, word_ids: WordIds | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(how many ids each text has, all ids in order); `word_ids` remembers words between batches."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.split_pattern(texts, " ")
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    odd = np.asarray(pc.match_substring(texts, "  ")) | np.asarray(pc.match_substring(texts, BLANK)) | np.asarray(pc.starts_with(texts, " ")) | np.asarray(pc.ends_with(texts, " "))
    if (odd | empty).any():  # those with several blanks, one by one
        rows = [[] if e else text_words(x.as_py()) if o else None for x, o, e in zip(texts, odd, empty, strict=True)]
        flat = split.flatten().to_pylist()
        offsets = np.asarray(split.offsets).tolist()
        rows = [r if r is not None else [BLANK + p for p in flat[a:b]] for r, a, b in zip(rows, offsets[:-1], offsets[1:], strict=True)]
        counts = np.array([len(r) for r in rows], np.int64)
        words = pa.array([x for r in rows for x in r], pa.large_string()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
    else:
        counts = np.diff(np.asarray(split.offsets))
        words = split.flatten().dictionary_encode()
        distinct = [BLANK + p for p in words.dictionary.to_pylist()]
    ids = (word_ids or WordIds(table(path)))(distinct)
    which = np.asarray(words.indices)
    size = np.array([len(x) >> 2 for x in ids], np.int64)
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(ids), "<i4")
    own = size[which] if len(which) else np.zeros(0, np.int64)
    out = flat[_gather(first[which], own)] if len(which) else np.zeros(0, np.int32)
    total = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(counts)])]
    return np.diff(total), out


def decode_batch(path: str, sizes: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The texts of consecutive runs of ids, as the library decodes them, as bytes."""
    t = table(path)
    size = t.decoded_size[ids]
    first = (np.cumsum(t.decoded_size) - t.decoded_size)[ids]
    data = t.decoded[_gather(first, size)] if len(ids) else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(sizes)] if len(sizes) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], ends])
    # the blank in front is not of the text
    keep = np.ones(len(data), bool)
    begin = offsets[:-1][np.diff(offsets) > 0]
    keep[begin[data[begin] == 32]] = False
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))])


def encode(docs: DataFrame, path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens and ids of every row of `docs`."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = WordIds(table(path))
        for b in batches:
            n, ids = encode_batch(path, b.column(text_col), word_ids)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n), lists], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers) and whether decoding gives the text back."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = WordIds(table(path))
        for b in batches:
            n, ids = encode_batch(path, b.column(text_col), word_ids)
            raw, at = np.ascontiguousarray(ids, "<i4").tobytes(), (np.concatenate([[0], np.cumsum(n)]) * 4).tolist()
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            given = pc.replace_substring(pc.fill_null(b.column(text_col).cast(pa.large_string()), ""), BLANK, " ").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(crc, pa.int64()), pc.equal(decode_batch(path, n, ids), given)], names=schema.names)

    return docs.select("doc_id", text_col).mapInArrow(run, schema)


def viterbi_words(words: DataFrame, pieces: DataFrame, longest: int, unknown: float = -100.0) -> DataFrame:
    """(word, path): the best path of each distinct word over `pieces` (piece, score), in relational form.

    Substrings of at most `longest` characters are exploded and equi-joined to the pieces; a single character without a
    piece gets the score `unknown`. Among equal sums the path with the longest last piece wins.
    """
    own = words.select("word").where("length(word) > 0").distinct()
    cuts = own.select("word", F.explode(F.expr(f"flatten(transform(sequence(1, length(word)), s -> transform(sequence(1, least({longest}, length(word) - s + 1)), n -> struct(s AS at, n AS n, substring(word, s, n) AS piece))))")).alias("c"))
    met = cuts.select("word", "c.*").join(pieces.select("piece", F.col("score").cast("double").alias("score")), "piece", "left").where("score IS NOT NULL OR n = 1")
    edge = F.struct((F.col("at") + F.col("n")).alias("stop"), F.col("at"), F.coalesce("score", F.lit(unknown)).alias("score"), "piece")
    grouped = met.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # best[i]: score and path up to character i; edges come by their end, so that what they start from is final
    seed = "transform(sequence(0, length(word)), i -> struct(if(i = 0, 0D, NULL) AS score, cast(array() AS array<string>) AS path))"
    better = "a[x.at - 1].score IS NOT NULL AND (a[x.stop - 1].score IS NULL OR a[x.at - 1].score + x.score > a[x.stop - 1].score)"
    step = f"if({better}, transform(a, (b, i) -> if(i = x.stop - 1, struct(a[x.at - 1].score + x.score AS score, concat(a[x.at - 1].path, array(x.piece)) AS path), b)), a)"
    return grouped.select("word", F.expr(f"element_at(aggregate(edges, {seed}, (a, x) -> {step}), -1).path").alias("path"))
