"""Unions, keyed upserts and differences, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import one_per_key


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union by name, missing columns null, each frame under its tag."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def upsert(target: DataFrame, source: DataFrame, key: list[str], *newest: Column) -> DataFrame:
    """Target rows of other keys, and the newest source row of each key."""
    source = one_per_key(source, key, *newest) if newest else source
    return target.join(source.select(*key).distinct(), key, "left_anti").unionByName(source, allowMissingColumns=True)


def replace_rows(target: DataFrame, new: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Drop the target rows of the given keys (null keys count as blank) and append the new ones."""
    blank = lambda df: df.withColumns({"_" + c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in on})
    gone = blank(keys).select(*("_" + c for c in on)).distinct()
    return blank(target).join(gone, ["_" + c for c in on], "left_anti").drop(*("_" + c for c in on)).unionByName(new, allowMissingColumns=True)


def conform(df: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """The declared columns in order; absent ones are null."""
    have = set(df.columns)
    return df.select(*[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in schema])


def long_series(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per id and metric that holds a value."""
    return df.unpivot(ids, metrics, "metric_name", "value").filter("value is not null")
