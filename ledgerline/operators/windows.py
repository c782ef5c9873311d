"""Features over the last periods of a company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_features(window: DataFrame, by: list[str], metrics: list[str], date: str) -> DataFrame:
    """Per event: the newest value, avg3y, std3y, slope3y, delta1y and delta2y of each metric, depth and span.

    `window` holds `recency` (1 newest). Deltas look at non-null values only; averages,
    deviations and slopes at the last three rows. An event's periods are packed into one array, and
    all metrics are read from it.
    """
    packed = F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("o"), *(F.col(m) for m in metrics))))
    rows = window.groupBy(*by).agg(F.count("*").alias("depth"), F.datediff(F.max(date), F.min(date)).alias("span_days"), F.max(date).alias("matched_period"), packed.alias("_history"))
    kept = [F.col(c) for c in (*by, "depth", "span_days", "matched_period")]
    return rows.select(*kept, *(c for m in metrics for c in _metric("_history", m)))


def _metric(history: str, m: str) -> list[Column]:
    """The columns of one metric from an array of periods, the oldest first, with `o` at -1 for the newest."""
    known = F.filter(F.transform(history, lambda x: x[m]), lambda v: v.isNotNull())
    recent = F.filter(F.transform(F.filter(history, lambda x: x["o"] >= -3), lambda x: x[m]), lambda v: v.isNotNull())
    n = F.size(recent)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    mean = total(recent) / n
    spread = F.transform(F.array(mean), lambda a: F.sqrt(total(F.transform(recent, lambda v: (v - a) * (v - a))) / n))[0]
    last = F.try_element_at(known, F.lit(-1))
    return [
        F.get(F.filter(history, lambda x: x["o"] == -1), 0)[m].alias(m), F.when(n > 0, mean).alias(m + "_avg3y"), F.when(n >= 2, spread).alias(m + "_std3y"),
        F.when(n >= 2, _slope(recent)).alias(m + "_slope3y"),
        (last - F.try_element_at(known, F.lit(-2))).alias(m + "_delta1y"), (last - F.try_element_at(known, F.lit(-3))).alias(m + "_delta2y"),
    ]


def _slope(values: Column) -> Column:
    """Least-squares slope over places 1, 2, 3 and so on, with means that follow the values, as regr_slope sums it."""

    def step(s: Column, y: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (y - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["c"] + n / 2 * (y - mean)).alias("c"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("c"))
    return F.aggregate(values, start, step, lambda s: s["c"] / (s["n"] * (s["n"] * s["n"] - 1) / 12))


def growth_pct(current: Column, previous: Column) -> Column:
    return F.try_divide(current - previous, F.abs(previous)) * 100


def forward_episodes(rows: DataFrame, key: str, date: str, metric: str, ahead: int = 3, least_years: float = 1.75) -> DataFrame:
    """Each start row (not among the last two) with the row `ahead` places on, or the last; forward CAGR in per cent."""
    order = Window.partitionBy(key).orderBy(date)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(F.col(date).alias("d"), F.col(metric).alias("v"))
    ended = rows.withColumns({"_n": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy(key)), "_end": F.coalesce(F.lead(row, ahead).over(order), F.last(row).over(whole))})
    years = F.datediff(F.col("_end.d"), F.col(date)) / 365.25
    start, end = F.col(metric), F.col("_end.v")
    cagr = F.when((start > 0) & (end > 0), (F.pow(end / start, F.lit(1.0) / years) - 1) * 100)
    out = ended.withColumn("years", years).filter((F.col("_n") <= F.col("_all") - 2) & (F.col("years") >= least_years))
    return out.select(key, F.col(date).alias("start_date"), F.col("_end.d").alias("end_date"), start.alias("start_value"), end.alias("end_value"), "years", cagr.alias("forward_cagr_pct"))
