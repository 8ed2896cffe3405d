"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every token belongs to one of `buckets` by its hash, and every bucket has a sparse random index vector. A token's word vector
is the sum of the index vectors of its neighbours, over all documents of the table: tasks add up their own documents, and
these sums of fixed size are added up by a second step. What tells tokens of one bucket apart is the index vector of a second hash,
which is added: two tokens share both with a chance of 1 to `buckets` squared. A document pools its vectors once over tokens and once over distinct
tokens, beside its length and its shares of distinct tokens and pairs. A network of one hidden layer, trained with numpy,
gives a logit; a temperature fitted on held-back training rows and the prior of all training labels turn it into a probability.

Only the network's training is bounded: `fit_rows` labelled ids of each class at most, those with the smallest hash. Texts
never come to the driver, only the bucket vectors (4 MB) and the pooled rows of the sample. Scoring reads every whole text.

Defined cases: null and empty texts pool to zeros and get a score; a null label, or one that is neither 0 nor 1, is not
learned from, nor is an id with both labels; labels repeated alike count once, and so do repeated ids (their smallest text);
with no label, or one class alone, the score is that class's share (0.5 without labels); repeated rows get equal scores;
tokens equal in both hashes share a vector; a very long text is pooled whole, in steps; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64
NONZERO = 8
NEIGHBOURS = 2
#: Length of what is a token's own, beside its bucket's vector of length 1.
MARK = 0.25
BUCKETS = 1 << 14
#: Buckets whose sums travel as one row; tokens whose contexts are added up at a time.
CHUNK = 512
STEP = 32_768
FIT_ROWS = 2500
HIDDEN = 32
EPOCHS = 60
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_CACHE_TOKENS = 60_000


def is_held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Buckets(dict):
    """Token to its number, its bucket plus `n` times its mark, kept for those seen of late. The mark is a second hash, so that tokens
    of one bucket differ."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, token: str) -> int:
        h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        i = (h >> 32) % self.n * self.n + h % self.n
        if len(token) <= 48:
            self[token] = i
        return i

    def ids(self, text: str | None) -> np.ndarray:
        """The buckets of a text's tokens, in order."""
        return self.words(text) % self.n

    def words(self, text: str | None) -> np.ndarray:
        """The numbers of a text's tokens, in order."""
        if len(self) > _CACHE_TOKENS:
            self.clear()
        return np.array(list(map(self.__getitem__, _TOKEN.findall(text or ""))), np.int64)


def index_vectors(n: int) -> np.ndarray:
    """Sparse random vectors, the same everywhere: NONZERO entries of 1 or -1; one more of zeros stands for no token."""
    draw = np.random.Generator(np.random.PCG64(11))
    out = np.zeros((n + 1, DIM), np.int8)
    places = np.argsort(draw.random((n, DIM), np.float32), axis=1)[:, :NONZERO]
    np.put_along_axis(out[:n], places, draw.integers(0, 2, (n, NONZERO), np.int8) * 2 - 1, axis=1)
    return out


@lru_cache(1)
def mark_vectors(n: int) -> np.ndarray:
    """The index vectors, of length MARK: what tells a token from others of its bucket."""
    return index_vectors(n)[:n] * np.float32(MARK / NONZERO**0.5)


def add_contexts(rows: list[np.ndarray], index: np.ndarray, into: np.ndarray) -> None:
    """Add to each bucket's row of `into` the index vectors of its tokens' neighbours within their documents."""
    gap = np.full(NEIGHBOURS, len(index) - 1, np.int64)
    ids = np.concatenate([gap, *[x for r in rows for x in (r, gap)]])
    for at in range(NEIGHBOURS, len(ids) - NEIGHBOURS, STEP):
        own = ids[at : min(at + STEP, len(ids) - NEIGHBOURS)]
        near = index[ids[at - NEIGHBOURS : at + len(own) + NEIGHBOURS]]
        sums = np.zeros((len(own), DIM), np.int8)
        for k in range(2 * NEIGHBOURS + 1):
            if k != NEIGHBOURS:
                sums += near[k : k + len(own)]
        order = np.argsort(own, kind="stable")
        kinds, starts = np.unique(own[order], return_index=True)
        total = np.add.reduceat(sums[order], starts, axis=0, dtype=np.int32)
        known = kinds < len(index) - 1
        into[kinds[known]] += total[known]


def word_vectors(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The vector of each bucket, of length 1 or 0, from all texts of `docs` (text)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index, into = Buckets(buckets), index_vectors(buckets), np.zeros((buckets, DIM), np.int32)
        for b in batches:
            add_contexts([known.ids(t.as_py()) for t in b.column("text")], index, into)
        parts = range(0, buckets, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([into[i : i + CHUNK].tobytes() for i in parts], pa.binary())], names=["at", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, own in zip(b.column("at").to_pylist(), b.column("sums"), strict=True):
                own = np.frombuffer(own.as_py(), np.int32).reshape(-1, DIM)
                sums[at] = sums[at] + own if at in sums else own.astype(np.int64)
        for at, v in sums.items():
            unit = (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-6)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([unit.tobytes()], pa.binary())], names=["at", "sums"])

    out = np.zeros((buckets, DIM), np.float32)
    parts = docs.select("text").mapInArrow(summed, "at int, sums binary").repartition(-(-buckets // CHUNK), "at")
    for at, unit in parts.mapInArrow(merged, "at int, sums binary").collect():  # as many bytes as `out`
        out[at : at + CHUNK] = np.frombuffer(bytes(unit), np.float32).reshape(-1, DIM)
    return out


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The features of one document, from its tokens' numbers; a token has the vector of its bucket and that of its mark."""
    out = np.zeros(2 * DIM + 3, np.float32)
    n, size = len(words), len(vectors)
    if n:
        kinds, counts = np.unique(words, return_counts=True)
        own = vectors[kinds % size] + mark_vectors(size)[kinds // size]
        out[:DIM] = counts @ own / n
        out[DIM : 2 * DIM] = own.mean(axis=0)
        pairs = len(np.unique(words[1:] * size**2 + words[:-1])) if n > 1 else 1
        out[2 * DIM :] = np.log1p(n), len(kinds) / n, pairs / max(1, n - 1)
    return out


class Network:
    """Two layers: tanh units and a logit; trained by Adam on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self.standard(x)
        self.p = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for at in range(0, len(x), 128):
                rows = order[at : at + 128]
                h = np.tanh(x[rows] @ self.p[0] + self.p[1])
                error = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(error, self.p[2]) * (1 - h**2)
                grads = [x[rows].T @ back + 1e-3 * self.p[0], back.sum(axis=0), h.T @ error + 1e-3 * self.p[2], error.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What the logits are divided by for the least logistic loss, from a grid."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, -(2 * y - 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    """What scoring needs; a few MB whatever the size of the tables."""

    def __init__(self, vectors: np.ndarray, network: Network | None, t: float, shift: float, prior: float):
        self.vectors, self.network, self.t, self.shift, self.prior = vectors, network, t, shift, prior

    def scores(self, texts: pa.Array, known: Buckets) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        x = np.stack([pooled(known.words(t.as_py()), self.vectors) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.network.logits(x) / self.t + self.shift, -30, 30)))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y): each id that may be learned from and has one label, once."""
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    return good.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("most")).where("y = most").select("doc_id", "y")


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """A model of `labels` (doc_id, quality) by the texts of `docs` (doc_id, text); held-out rows are left out."""
    spark = docs.sparkSession
    known = training_labels(labels)
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    prior = n.get(1, 0) / sum(n.values()) if n else 0.5
    if len(n) < 2:
        return Model(np.zeros((0, DIM), np.float32), None, 1, 0, prior)
    vectors = word_vectors(docs, buckets)
    sent = spark.sparkContext.broadcast(vectors)  # of fixed size
    chosen = [known.where(F.col("y") == y).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(fit_rows) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])  # at most 2 * fit_rows rows of two numbers
    # one text of each id, the smallest; repeated rows are combined before the shuffle
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for b in batches:
            rows = [pooled(known.words(t.as_py()), sent.value).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(rows, pa.binary())], names=["h", "y", "x"])

    rows = sorted((h, y, bytes(x)) for h, y, x in sample.select("h", "y", "text").mapInArrow(features, "h long, y int, x binary").collect())  # at most 2 * fit_rows rows
    if len({y for _, y, _ in rows}) < 2:
        return Model(vectors, None, 1, 0, prior)
    x = np.stack([np.frombuffer(r, np.float32) for _, _, r in rows])
    y = np.array([r[1] for r in rows], float)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    network = Network(x[~held], y[~held])
    t = temperature(network.logits(x[held]), y[held]) if held.any() else 1.0
    # the sample is balanced; all training labels are not
    shift = np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return Model(vectors, network, t, float(shift), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known = Buckets(max(1, len(own.vectors)))
        for b in batches:
            if not b.num_rows:
                continue
            s = own.scores(b.column("text"), known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)
