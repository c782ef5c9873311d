"""Outputs: files per group, packages of named tables, routed decisions and error records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import slug


def write_by_group(rows: DataFrame, group: str, path: str) -> None:
    """One folder per group (named by its slug) under `path`; the whole table is the folders together."""
    rows.withColumn(group + "_slug", slug(F.col(group))).write.mode("overwrite").partitionBy(group + "_slug").parquet(path)


def write_package(tables: dict[str, DataFrame], chosen: DataFrame, key: str, path: str) -> list[str]:
    """Named tables side by side, each held to the chosen keys; returns the paths written."""
    ids, paths = chosen.select(key).distinct(), []
    for name, rows in tables.items():
        target = f"{path}/{name}"
        (rows.join(ids, key, "left_semi") if key in rows.columns else rows).write.mode("overwrite").parquet(target)
        paths.append(target)
    return paths


def route(decided: DataFrame, old_failures: DataFrame, key: str) -> dict[str, DataFrame]:
    """Decisions split by outcome: a status row for all, a review or failure row for some; a success ends an old failure."""
    review = decided.filter("status = 'ambiguous'")
    failed = decided.filter("status = 'no_results'")
    still = old_failures.join(decided.filter("status = 'matched'").select(key), key, "left_anti").join(failed.select(key), key, "left_anti")
    return {"status": decided, "review": review, "failures": still.unionByName(failed.select(*old_failures.columns))}


def error_records(rows: DataFrame, key: str, checks: dict[str, tuple[str, Column]], version: str) -> DataFrame:
    """One row per failed check: stage, type of error, message, parser version."""
    found = [F.when(failed, F.struct(F.lit(stage.split(":")[0]).alias("stage"), F.lit(stage).alias("error_type"), F.lit(message).alias("message"))) for stage, (message, failed) in checks.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("e")).select(key, "e.*", F.lit(version).alias("parser_version"))
