"""Connected components of a link table, by alternating large and small stars.

Defined cases: links with a null end are ignored, and so are those from a node to itself; repeated links and links in both
directions count once; an empty table gives no rows; other columns are not read. Nodes may be of any type that has an
order; whole numbers are aggregated by hash, others by sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, remove


#: Links up to which a round is one task, which then needs no exchange; a few MB. Beyond, rounds are dealt out by node.
IN_ONE_TASK = 250_000


def _pairs(rows: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """(u, v) of each pair of columns of each row; unlike a union this leaves the partitions as they are."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in columns])))


def _min_hop(edges: DataFrame, key: str, value: str, few: bool) -> DataFrame:
    """Each row's smallest neighbour `m` of `key`, the key itself included; hot keys are combined before the shuffle."""
    least = edges.groupBy(key).agg(F.min(value).alias("m")).select(key, F.least(F.col(key), F.col("m")).alias("m"))
    return edges.join(least.hint("shuffle_hash") if few else least, key)


def components(links: DataFrame, a: str = "a", b: str = "b", *, stages: Stages | None = None, files: int | None = None) -> DataFrame:
    """(node, root) for every node that has a link; the root is the component's smallest node.

    With `stages` its tables are deleted with theirs; each is written into `files` files at most.

    Each round is two joins and two aggregates, written to the shared folder, where the round before is deleted; the rounds
    grow with the logarithm of a component's diameter. Beyond `IN_ONE_TASK` links no component or node's links are gathered
    in one task.
    """
    stages = stages or Stages(links.sparkSession)
    signed = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = stages.write(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), files=files)
    sign = signed(edges)
    while True:
        few = sign[0] <= IN_ONE_TASK
        one = lambda rows: rows.coalesce(1) if few else rows  # noqa: B023, E731
        both = _pairs(one(edges), ("u", "v"), ("v", "u"))
        large = one(_min_hop(both, "u", "v", few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"))
        small = one(_pairs(_min_hop(large, "u", "v", few), ("v", "m"), ("u", "m")).where("u != v"))
        edges = stages.write(small.distinct(), files=None if few else files)
        remove(stages.spark, stages.paths.pop(-2))
        now = signed(edges)
        if now == sign:
            break
        sign = now
    return _pairs(edges, ("u", "v"), ("v", "v")).distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))
