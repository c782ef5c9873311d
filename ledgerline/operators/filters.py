"""Predicates and status columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligibility() -> Column:
    """First failing test of a rating event, else `eligible`."""
    return (
        F.when(F.col("scale_type") != "long_term", "non_long_term_rating").when(F.col("rating_rank").isNull(), "missing_rating_label")
        .when(F.coalesce("withdrawn", F.lit(False)), "withdrawn").when(F.coalesce("not_cooperating", F.lit(False)), "issuer_not_cooperating")
        .when(F.col("rating_date").isNull(), "missing_rating_date").otherwise("eligible")
    )


def eligible(events: DataFrame) -> DataFrame:
    return events.withColumn("status", eligibility()).filter("status = 'eligible'")


def keep_or_first(rows: DataFrame, group: str, keep: Column, order: list[str], n: int) -> DataFrame:
    """Rows that pass; of a group where none does, the first n."""
    own = Window.partitionBy(group)
    marked = rows.withColumns({"_keep": keep.cast("int"), "_rank": F.row_number().over(own.orderBy(*order))}).withColumn("_any", F.max("_keep").over(own))
    return marked.filter((F.col("_keep") == 1) | ((F.col("_any") == 0) & (F.col("_rank") <= n))).drop("_keep", "_rank", "_any")


def label_choice(*candidates: str, generic: tuple[str, ...] = ()) -> Column:
    """First label that is neither blank nor one of the generic ones; the last needs only not be blank."""
    picked = [F.when(~F.lower(F.trim(c)).isin(*generic), F.nullif(F.trim(c), F.lit(""))) if generic else F.nullif(F.trim(c), F.lit("")) for c in candidates[:-1]]
    return F.coalesce(*picked, F.nullif(F.trim(candidates[-1]), F.lit("")))
