"""Exact ranks and quantiles of groups that need not fit in one task.

Equal values of a group are counted first, before anything is shuffled. Values are dealt into
ranges that follow their order (STEPS to a doubling), values are ordered within a range only, and
running sums over the ranges' counts make that an order of the whole group. Any quantile is then
the value that holds its place.

Defined results: nulls and not-a-numbers are left out; a group without values gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges to a doubling of the value.
STEPS = 64
_FAR = 1_000_000


def _range(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    size = F.floor(F.log2(F.abs(value)) * STEPS)
    return F.when(value > 0, size + _FAR).when(value < 0, -size - _FAR).otherwise(0)


def melted(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys..., metric, value) of all values that are known."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return rows.select(*keys, F.inline(pairs)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def ranked_values(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by..., value, upto, times, total): how many of a group's values lie up to each distinct one, how often it occurs, and how many there are."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("times")).withColumn("_r", _range(F.col(value)))
    inside = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    #: One row a group and range.
    ranges = counts.groupBy(*by, "_r").agg(F.sum("times").alias("_n"))
    ranges = ranges.withColumns({"_before": F.coalesce(F.sum("_n").over(along), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*by))}).drop("_n")
    placed = counts.withColumn("_upto", F.sum("times").over(inside)).join(ranges, [*by, "_r"])
    return placed.select(*by, value, (F.col("_before") + F.col("_upto")).alias("upto"), "times", "total")


def quantiles(ranked: DataFrame, by: list[str], fractions: dict[str, float], value: str = "value") -> DataFrame:
    """(by..., one column a fraction): quantiles with linear interpolation between neighbours."""
    holds = lambda place: F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("times") < place), F.col(value)))
    out = []
    for name, fraction in fractions.items():
        at = (F.col("total") - 1) * F.lit(float(fraction))
        low, high = holds(F.floor(at) + 1), holds(F.ceil(at) + 1)
        out.append((low + F.max(at - F.floor(at)) * (high - low)).alias(name))
    return ranked.groupBy(*by).agg(*out)


def peer_positions(rows: DataFrame, keys: list[str], group: list[str], metrics: dict[str, str]) -> DataFrame:
    """(keys..., group..., and for each metric's name: its gap to the peers' median, the share of known peers not above it)."""
    values = melted(rows, [*keys, *(g for g in group if g not in keys)], list(metrics))
    by = [*group, "metric"]
    ranked = ranked_values(values, by)
    median = quantiles(ranked, by, {"median": 0.5})
    told = values.join(ranked.select(*by, "value", (F.col("upto") / F.col("total")).alias("share")), [*by, "value"]).join(median, by)
    columns = [F.max(F.when(F.col("metric") == m, c)).alias(f"{name}_{kind}") for m, name in metrics.items() for kind, c in (("gap", F.col("value") - F.col("median")), ("pctile", F.col("share")))]
    found = told.groupBy(*keys).agg(*columns)
    own = rows.select(*keys, *(g for g in group if g not in keys)).distinct()
    return own.join(found, keys, "left")


def wide(quantile_rows: DataFrame, metrics: list[str], name: str) -> DataFrame:
    """One row, `<metric>_<name>` of each metric, of quantiles by metric only."""
    return quantile_rows.agg(*(F.max(F.when(F.col("metric") == m, F.col(name))).alias(f"{m}_{name}") for m in metrics))

