"""Incremental ingest as a Structured Streaming job: every file once, the latest row per key kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    kept = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_row")).select(key, "_row.*")


#: Batches after which the latest rows of all keys are written as one table.
COMPACT = 16


def _compacted(spark: SparkSession, target: str, below: int | None = None) -> int:
    """The last batch of the newest whole table of all keys, one of a batch under `below`; -1 without any."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{target}/current/through=*/_SUCCESS")
    found = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(mark) or []
    numbers = [int(f.getPath().getParent().getName().split("=")[1]) for f in found]
    return max((n for n in numbers if below is None or n < below), default=-1)


def ingest_latest(spark: SparkSession, source: str, schema, key: str, order: list[str], target: str, valid: str = "true", files: int = 1000, compact: int = COMPACT) -> None:
    """Read new files of `source`, `files` a batch, and append the latest valid row of each key; the rest go to failures.

    A repeated batch overwrites its own folder, so a restart after a lost driver changes nothing.
    Every `compact` batches the keys' latest rows are written as one table, so that `latest` reads
    that and the batches since, however many there were.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def save(batch: DataFrame, number: int) -> None:
        good = F.coalesce(F.expr(valid), F.lit(False))
        _latest(batch.filter(good), key, order).write.mode("overwrite").parquet(f"{target}/latest/batch={number}")
        batch.filter(~good).write.mode("overwrite").parquet(f"{target}/failures/batch={number}")
        if number % compact == compact - 1:
            _since(batch.sparkSession, target, key, order, _compacted(batch.sparkSession, target, number)).write.mode("overwrite").parquet(f"{target}/current/through={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, target: str, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key over all batches: the last table of all keys and the batches after it."""
    return _since(spark, target, key, order, _compacted(spark, target))


def _since(spark: SparkSession, target: str, key: str, order: list[str], through: int) -> DataFrame:
    rows = spark.read.parquet(f"{target}/latest").filter(F.col("batch") > through).drop("batch")
    if through >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{target}/current/through={through}"))
    return _latest(rows, key, order)


def failures(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/failures").drop("batch")


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per window and group of a stream; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).count()


def counted_once(stream: DataFrame, key: str, time: str, by: str, width: str, late: str) -> DataFrame:
    """(start, by, n): rows of a stream by window, a row that comes again counted once.

    A key is remembered for as long as a repetition may come (`late` behind the newest row seen in
    an earlier batch); a row older than that is left out, be it new or a repetition. A window is given
    once, when no row of it can come any more. State holds the keys of that span and the open windows.
    """
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_to_end(stream: DataFrame, target: str) -> DataFrame:
    """Work a stream off, batch by batch, into files that appear when their batch stands; what was written so far."""
    query = stream.writeStream.format("parquet").option("path", f"{target}/closed").option("checkpointLocation", f"{target}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{target}/closed")
