"""Aggregations: coverage, metrics, calibration, strength, mention scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(columns: list[str]) -> tuple[Column, Column]:
    """Share of the columns that hold a value, and the names of those that don't."""
    held = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return held / float(len(columns)), F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))


def readiness(share: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(share >= high, "high").when(share >= medium, "medium").otherwise("low")


def prediction_metrics(rows: DataFrame, by: list[str], predicted: str, actual: str, confidence: str, company: str) -> DataFrame:
    d = F.abs(F.col(predicted) - F.col(actual))
    return rows.groupBy(*by).agg(F.avg((d == 0).cast("double")).alias("exact"), F.avg((d <= 1).cast("double")).alias("within_one"), F.avg(d.cast("double")).alias("mean_error"), F.avg(confidence).alias("mean_confidence"), F.count("*").alias("n_rows"), F.countDistinct(company).alias("n_companies"))


def coverage_curve(rows: DataFrame, by: str, deviation: str, widest: int) -> DataFrame:
    """Share of rows with |deviation| <= h for each h; null deviations are misses. One pass over the rows."""
    histogram = rows.groupBy(by, F.abs(F.col(deviation)).alias("d")).agg(F.count("*").alias("n"))
    total = histogram.groupBy(by).agg(F.sum("n").alias("total"))
    grid = total.select(by, "total", F.explode(F.sequence(F.lit(0), F.lit(widest))).alias("h"))
    joined = grid.join(histogram.filter("d is not null").withColumnRenamed("d", "h"), [by, "h"], "left")
    return joined.select(by, "h", (F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(by).orderBy("h")) / F.col("total")).alias("coverage"))


def smallest_halfwidth(curve: DataFrame, by: str, target: float, widest: int) -> DataFrame:
    h = F.coalesce(F.min(F.when(F.col("coverage") >= target, F.col("h"))), F.lit(widest))
    return curve.groupBy(by).agg(h.alias("halfwidth"), (F.max("coverage") >= target).alias("target_met"))


def strength(metrics: DataFrame) -> DataFrame:
    """0.4 within one + 0.2 exact + 0.3 rows / most rows + 0.1, within [0, 1]."""
    most = metrics.agg(F.max("n_rows").alias("most"))
    score = 0.4 * F.col("within_one") + 0.2 * F.col("exact") + 0.3 * F.col("n_rows") / F.col("most") + 0.1
    return metrics.crossJoin(F.broadcast(most)).withColumn("strength", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("most")


def mention_scores(mentions: DataFrame, by: str, text: str, groups: dict[str, tuple[list[str], float]], cap: float) -> DataFrame:
    """Distinct keyword hits per mention and group, weighted and summed up to a cap."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = {g: reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words]) for g, (words, _) in groups.items()}
    rows = mentions.withColumns(hits)
    any_hit = reduce(lambda a, b: a + b, [F.col(g) for g in groups]) > 0
    total = reduce(lambda a, b: a + b, [F.sum(g) * w for g, (_, w) in groups.items()])
    return rows.groupBy(by).agg(*[F.sum(g).alias(g) for g in groups], F.count_if(any_hit).alias("n_mentions"), F.least(F.lit(cap), total).alias("score"))
