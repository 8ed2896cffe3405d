"""Gradient-boosted regression trees of several folds, grown side by side: a pass over the pairs serves all folds.

The trees are those of Spark's GBTRegressor with squared error (first tree at full weight, residuals doubled, at most BINS bins a
feature, one-hot groups, the first of equal gains), but a task holds its rows as blocks of columns: a byte for each bin instead of
an object for each row and fold. The driver sees the histograms of a level, the size of which does not depend on the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BINS = 32
BLOCK_ROWS = 10_000
#: A lost executor costs its blocks these rounds at most (all of them where no folder for checkpoints is set).
CHECKPOINT_ROUNDS = 40


def thresholds(rows: DataFrame, features: tuple[str, ...], folds: int) -> list[list[np.ndarray]]:
    """For each fold and feature, ascending upper bounds of the bins (but the last), from the rows of the other folds."""
    shares = [i / BINS for i in range(1, BINS)]
    wanted = [F.percentile_approx(F.when(F.col("fold") != k, F.col(c)), shares, 10_000).alias(f"{c}_{k}") for k in range(folds) for c in features]
    found = rows.agg(*wanted).first()  # one row
    return [[np.unique(np.array(found[f"{c}_{k}"] or [], dtype=float)) for c in features] for k in range(folds)]


def _binned(values: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, v, side="left").astype(np.uint8) for v, b in zip(values, bounds, strict=True)])


def _codes(groups: list[str], column: pa.Array) -> np.ndarray:
    return pa.compute.index_in(column, pa.array(groups, pa.string())).to_numpy(zero_copy_only=False).astype(np.int32)


def _columns(batch: pa.RecordBatch, names: Iterable[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _packed(features, groups, bounds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of bins by fold, codes of groups, targets, folds and predictions, with a number of their own."""
    part = TaskContext.get().partitionId()
    held, n, number = [], 0, 0

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        values = _columns(rows, features)
        target, fold = _columns(rows, ("target", "fold"))
        made = {"id": (part, number), "bins": np.stack([_binned(values, b) for b in bounds]), "group": _codes(groups, rows.column("source_group")), "target": target, "fold": fold.astype(np.int8), "made": np.zeros((len(bounds), len(target)))}
        return pa.RecordBatch.from_pydict({"block": [pickle.dumps(made, 5)]})

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield block()
            held, n, number = [], 0, number + 1
    if n:
        yield block()


def _right(bins: np.ndarray, group: np.ndarray, node: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Which rows go to the right child of their node; a node without a split (-1) keeps all on the left."""
    right = np.zeros(len(node), bool)
    numeric = len(bins) * BINS
    for k, c in enumerate(splits):
        if c >= 0:
            right |= (node == k) & (bins[c // BINS] > c % BINS if c < numeric else group == c - numeric)
    return right


def _node(bins: np.ndarray, group: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    node = np.zeros(len(group), np.uint8)
    for splits in levels:
        node = 2 * node + _right(bins, group, node, splits)
    return node


def _sampled(block: dict, first: int, rate: float, seed: int) -> dict:
    """The block with the rows that each fold's next tree is grown on."""
    own = np.arange(len(block["made"]))[:, None] == block["fold"][None, :]
    drawn = np.random.default_rng([seed, first, *block["id"]]).random(own.shape, dtype=np.float32) < rate
    return block | {"taken": drawn & ~own}


def _grown(tree: list, weight: float, number: int, rate: float, seed: int, block: dict) -> dict:
    """The block with the predictions of one more tree, and the next one's rows."""
    made = np.stack([p + weight * values[_node(b, block["group"], levels)] for p, b, (levels, values) in zip(block["made"], block["bins"], tree, strict=True)])
    return _sampled(block | {"made": made}, number, rate, seed)


def _histogram(levels: list[list[np.ndarray]], width: int, first: bool, block: dict) -> np.ndarray:
    """Counts and sums of residuals of each fold by node, feature and bin."""
    cells = (1 << len(levels[0])) * width
    out = np.zeros((2, len(block["made"]), cells))
    for k, taken in enumerate(block["taken"]):
        at = np.flatnonzero(taken)
        bins, group = block["bins"][k][:, at], block["group"][at]
        rest = block["target"][at] if first else 2.0 * (block["target"][at] - block["made"][k][at])
        start = _node(bins, group, levels[k]).astype(np.int64) * width
        for j, feature in enumerate([*bins, group]):
            cell = start + (feature + np.int64(j * BINS))
            out[0, k] += np.bincount(cell, minlength=cells)
            out[1, k] += np.bincount(cell, rest, minlength=cells)
    return out


def _best(counts: np.ndarray, sums: np.ndarray, features: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The best split of each node, or -1, and the means of its two children; from histograms (node, cell)."""
    numeric = features * BINS
    by_bin = lambda x: x[:, :numeric].reshape(len(x), features, BINS)
    all_n, all_s = by_bin(counts)[:, :1].sum(axis=2), by_bin(sums)[:, :1].sum(axis=2)
    left = lambda x, total: np.concatenate([by_bin(x).cumsum(axis=2).reshape(len(x), numeric), total - x[:, numeric:]], axis=1)
    n, s = left(counts, all_n), left(sums, all_s)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((n >= least) & (all_n - n >= least), s * s / n + (all_s - s) ** 2 / (all_n - n) - all_s**2 / all_n, -np.inf)
        at = gain.argmax(axis=1)
        rows = np.arange(len(at))
        found = gain[rows, at] > 1e-12 * np.maximum(all_s[:, 0] ** 2 / np.maximum(all_n[:, 0], 1), 1e-12)
        ln, ls = np.where(found, n[rows, at], all_n[:, 0]), np.where(found, s[rows, at], all_s[:, 0])
        means = np.nan_to_num(np.stack([ls / ln, (all_s[:, 0] - ls) / (all_n[:, 0] - ln)], axis=1), nan=0.0, posinf=0.0, neginf=0.0)
    return np.where(found, at, -1), means.reshape(-1)


def predictions(rows: DataFrame, features: tuple[str, ...], folds: int, partitions: int, *, maxIter: int, maxDepth: int, minInstancesPerNode: int, stepSize: float, subsamplingRate: float, seed: int) -> DataFrame:
    """`rows` (with `target`, `source_group` and `fold`) and the `prediction` of trees of the other folds' rows."""
    bounds = thresholds(rows, features, folds)
    groups = sorted(r[0] for r in rows.select("source_group").distinct().collect())  # one row for each group
    width = len(features) * BINS + len(groups)
    blocks = rows.select("target", "fold", "source_group", *features).repartition(partitions).mapInArrow(partial(_packed, features, groups, bounds), "block binary")
    loaded = blocks.rdd.map(lambda r: pickle.loads(r[0]))
    state = loaded.map(lambda b: _sampled(b, 0, subsamplingRate, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    trees = []
    try:
        for m in range(maxIter):
            levels, values = [[] for _ in range(folds)], None
            for _ in range(maxDepth):
                found = state.map(partial(_histogram, levels, width, m == 0)).reduce(np.add)
                found = found.reshape(2, folds, -1, width)
                best = [_best(found[0, k], found[1, k], len(features), minInstancesPerNode) for k in range(folds)]
                levels, values = [[*old, split] for old, (split, _) in zip(levels, best, strict=True)], [v for _, v in best]
            weight = stepSize if m else 1.0
            trees.append((weight, list(zip(levels, values, strict=True))))
            if m + 1 < maxIter:
                before, state = state, state.map(partial(_grown, trees[-1][1], weight, m + 1, subsamplingRate, seed)).persist(StorageLevel.MEMORY_AND_DISK)
                if m % CHECKPOINT_ROUNDS == CHECKPOINT_ROUNDS - 1:
                    state.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else state.localCheckpoint()
                state.foreach(lambda _: None)
                before.unpersist()
    finally:
        state.unpersist()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _columns(batch, features)
            (fold,) = _columns(batch, ("fold",))
            group, out = _codes(groups, batch.column("source_group")), np.zeros(batch.num_rows)
            for k in np.unique(fold):
                at = np.flatnonzero(fold == k)
                bins, mine = _binned([v[at] for v in values], bounds[k]), group[at]
                out[at] = sum(weight * tree[k][1][_node(bins, mine, tree[k][0])] for weight, tree in trees)
            yield batch.append_column("prediction", pa.array(out))

    return rows.mapInArrow(predicted, StructType([*rows.schema.fields, StructField("prediction", DoubleType())]))
