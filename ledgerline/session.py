"""Session helpers shared by jobs: package shipping and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that Python tasks can import it."""
    if getattr(spark, "_ledgerline_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "ledgerline_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, f"{top.name}/{source.relative_to(top)}")
    spark.sparkContext.addPyFile(str(target))
    spark._ledgerline_shipped = True


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, else one set here.

    A local session gets a temporary folder; on a cluster it is one in the warehouse, which all share.
    A warehouse on the local disk of each machine is refused there.
    """
    folder = spark.conf.get(_CHECKPOINT, None)
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not local and spark.conf.get("spark.sql.warehouse.dir").split(":/")[0] in ("file", ""):
            raise ValueError(f"set {_CHECKPOINT} to a folder that driver and executors share; the warehouse is local to each machine")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{spark.sparkContext.applicationId}"
        spark.conf.set(_CHECKPOINT, folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage, survives lost executors.

    Shuffle files of the write are of no use once the table stands, so Spark removes them with it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


#: Narrow rows of a task at most, where much work a row follows.
SPREAD_ROWS = 40_000


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows of a scan in tasks of like size, over all cores and as many as the rows need, where the table's files make fewer."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def executor_environment() -> None:
    """Numeric libraries must not start more threads than the task's one core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "TOKENIZERS_PARALLELISM"):
        os.environ.setdefault(name, "false" if name.startswith("TOK") else "1")
