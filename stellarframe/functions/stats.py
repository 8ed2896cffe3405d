"""Ranks and quantiles as DataFrame plans; none puts all rows, or all distinct values of a group, into one task.

Values are counted, dealt into ranges and summed up within and before their ranges. The range of a value is a function of the
value and of its group's least and largest one, so that it is the same wherever a plan computes it, and ascends with the value:
first by the logarithm of its distance from zero, then by its place between the two. A group has at most 4 * RANGES + 3 ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024
#: Decades below the largest value that the logarithm tells apart.
DECADES = 9


def _range(v: str, low: str, high: str) -> Column:
    """The number of the range of `v`; infinities and NaN, which is above all, have their own."""
    x, a, b = (F.col(c) / F.lit(2.0) for c in (v, low, high))
    top = F.greatest(F.abs(a), F.abs(b))
    scale = RANGES / math.log1p(10.0**DECADES)
    by_log = F.when(top > 0, F.signum(x) * F.floor(F.log1p(F.abs(x) / top * F.lit(10.0**DECADES)) * F.lit(scale))).otherwise(F.lit(0.0))
    by_place = F.when(b > a, F.floor((x - a) / (b - a) * F.lit(float(RANGES)))).otherwise(F.lit(0))
    number = by_log.cast("long") * F.lit(2 * RANGES) + by_place.cast("long")
    edge, inf = 1 << 40, float("inf")
    return F.when(F.isnan(v), F.lit(edge + 1)).when(F.col(v) == inf, F.lit(edge)).when(F.col(v) == -inf, F.lit(-edge)).otherwise(number)


def _summed(counts: DataFrame) -> DataFrame:
    """(_g, _v, _n, _upto, _all) from counts (_g, _v, _n): rows of the group up to and with the value, and all of them.

    `_g` is a struct, null fields of which are values like others.
    """
    finite = ~F.isnan("_x") & (F.abs("_x") != float("inf"))
    counts = counts.withColumn("_x", F.col("_v").cast("double"))
    limits = counts.where(finite).groupBy("_g").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    ranged = counts.join(limits, "_g", "left").withColumn("_b", _range("_x", "_low", "_high")).drop("_low", "_high", "_x")
    # one row for each range: what a group's window sees is bounded
    totals = ranged.groupBy("_g", "_b").agg(F.sum("_n").alias("_t"))
    w = Window.partitionBy("_g")
    before = totals.select("_g", "_b", (F.sum("_t").over(w.orderBy("_b")) - F.col("_t")).alias("_before"), F.sum("_t").over(w).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy("_g", "_b").orderBy("_v"))
    return ranged.withColumn("_in", upto).join(before, ["_g", "_b"]).select("_g", "_v", "_n", (F.col("_before") + F.col("_in")).alias("_upto"), "_all")


def average_ranks(df: DataFrame, column: str, name: str, by: str | None = None) -> DataFrame:
    """`df` with the 1-based rank of `column` (a number) among all rows (of equal `by`), ties sharing their mean; null has no rank."""
    group = F.struct((F.lit(0) if by is None else F.col(by)).alias("g"))
    counts = df.where(F.col(column).isNotNull()).groupBy(group.alias("_g"), F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = _summed(counts).select(F.col("_g.g").alias("_g"), "_v", (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(name))
    same = (df[column] == ranks["_v"]) if by is None else (df[by] == ranks["_g"]) & (df[column] == ranks["_v"])
    return df.join(ranks, same, "left").drop("_g", "_v")


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation of the rows where both are present; 0 below two rows or without variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    flat = (F.count(a) < 2) | (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str, name: str = "rho") -> DataFrame:
    """One row: the rank correlation of the rows where both are present, 0.0 below two."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(average_ranks(both, "_x", "_rx"), "_y", "_ry")
    return ranked.agg(pearson("_rx", "_ry").alias(name))


def spearman_many(df: DataFrame, series: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(metric, rho) of several series (x, y, condition), all ranked in one pass; a series without rows has none."""
    each = F.array(*[F.when(F.expr(f"({where}) AND {x} IS NOT NULL AND {y} IS NOT NULL"), F.struct(F.lit(m).alias("metric"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))) for m, (x, y, where) in series.items()])
    rows = df.select(F.explode(each).alias("s")).where("s IS NOT NULL").select("s.*")
    ranked = average_ranks(average_ranks(rows, "_x", "_rx", "metric"), "_y", "_ry", "metric")
    return ranked.groupBy("metric").agg(pearson("_rx", "_ry").alias("rho"))


#: How a quantile falls between two values: on the line between them, or at index min(n - 1, floor(p * n)).
LINEAR, NEAREST = "linear", "nearest"


def quantiles(df: DataFrame, groups: list[str], wanted: dict[str, tuple]) -> DataFrame:
    """The quantiles of each group: `wanted` maps a result to (column, share) or (column, share, NEAREST).

    A group without a value has a null; with no groups there is one row, whatever the rows.
    """
    columns = list(dict.fromkeys(c for c, *_ in wanted.values()))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    rows = df.select(*groups, each.alias("_s"))
    # values that are null are counted too, so that their group has a row
    counts = rows.groupBy(F.struct(*groups, F.col("_s.i").alias("_i")).alias("_g"), F.col("_s.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    found = _summed(counts.where("_v IS NOT NULL"))
    last = (F.col("_all") - 1).cast("double")
    holds = lambda at: (F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))
    parts = []
    for name, (column, share, *kind) in wanted.items():
        mine = F.col("_g._i") == columns.index(column)
        if kind == [NEAREST]:
            part = F.when(mine & holds(F.least(last, F.floor(F.lit(float(share)) * F.col("_all")))), F.col("_v"))
        else:
            at = last * F.lit(float(share))
            low, high = F.floor(at), F.ceil(at)
            weight = F.when(holds(low), F.when(low == high, F.lit(1.0)).otherwise(high - at)).otherwise(F.lit(0.0)) + F.when((low != high) & holds(high), at - low).otherwise(F.lit(0.0))
            part = F.when(mine & (holds(low) | holds(high)), F.col("_v") * weight)
        parts.append((name, part))
    picked = found.select("_g", *[p.alias(n) for n, p in parts]).where(" OR ".join(f"`{n}` IS NOT NULL" for n in wanted))
    all_groups = counts.select("_g", *[F.lit(None).cast("double").alias(n) for n in wanted]) if groups else picked.limit(0)
    return picked.unionByName(all_groups.distinct()).groupBy(*[F.col(f"_g.{g}").alias(g) for g in groups]).agg(*[F.sum(n).alias(n) for n in wanted])


def summary(df: DataFrame, groups: list[str], plain: list[Column], wanted: dict[str, tuple]) -> DataFrame:
    """The aggregates `plain` of each group beside its quantiles."""
    found = quantiles(df, groups, wanted)
    if not groups:
        return df.agg(*plain).crossJoin(F.broadcast(found))  # one row each
    found = found.withColumnsRenamed({g: f"_{g}" for g in groups})
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return df.groupBy(*groups).agg(*plain).join(found, same, "left").drop(*[f"_{g}" for g in groups])


def nearest_p90_by(df: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """The value at index min(n - 1, floor(0.9 n)) of each group's sorted values; groups without any are left out."""
    return quantiles(df.where(F.col(column).isNotNull()), groups, {name: (column, 0.9, NEAREST)})
