"""Scans of CSV, JSON and text inputs by Spark's readers, with the tolerance that ingestion needs."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.scalars import normalise_code, surrogate_id
from ledgerline.operators.joins import one_per_key

CORRUPT = "_corrupt"


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file or folder with a header; an absent one is an empty table of the schema."""
    try:
        return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_records(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Records of JSON files that hold a list, one object, or an object with a list under `rows`."""
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", fields)]
    raw = spark.read.schema(f"{fields}, rows array<struct<{', '.join(_typed(f) for f in re.split(r',(?![^<]*>)', fields))}>>").json(path, multiLine=True)
    own = F.array(F.struct(*names))
    return raw.select(F.inline(F.coalesce("rows", own)))


def _typed(field: str) -> str:
    name, kind = field.strip().split(" ", 1)
    return f"{name}: {kind}"


def json_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a folder: unreadable files and `*.error.json` files are errors."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    bad = F.col("file").endswith(".error.json") | F.col(CORRUPT).isNotNull()
    fields = [c for c in raw.columns if c not in (CORRUPT, "file")]
    content = F.coalesce(CORRUPT, F.to_json(F.struct(*fields)))
    return raw.filter(~bad).drop(CORRUPT), raw.filter(bad).select("file", content.alias("content"))


def section(documents: DataFrame, key: str, records: str) -> DataFrame:
    """The records of one array of the documents, with the document's key."""
    return documents.select(key, F.inline(records))


def text_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per text file: file, text, hash and status; blank files stay as failed."""
    raw = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    status = F.when(F.col("value").rlike("\\S"), "parsed").otherwise("failed")
    return raw.select("file", F.col("value").alias("text"), F.sha2("value", 256).alias("hash"), status.alias("parsed_status"))


def manifest_status(manifest: DataFrame, documents: DataFrame, file: str = "file", status: str = "parsed_status") -> DataFrame:
    """Every row of the manifest as missing_file, parse_failed or parsed."""
    state = F.when(F.col("_state").isNull(), "missing_file").when(F.col("_state") == "failed", "parse_failed").otherwise("parsed")
    return manifest.join(documents.select(file, F.col(status).alias("_state")), file, "left").withColumn("status", state).drop("_state")


def rename_aliases(rows: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Columns under their canonical names; a canonical column that is there already wins."""
    key = lambda c: re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_")
    own = {key(c) for c in rows.columns}
    taken, out = set(), []
    for c in rows.columns:
        name = aliases.get(key(c), c) if key(c) not in aliases.values() else key(c)
        if (name != c and key(c) != name and name in own) or name in taken:
            continue
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return rows.select(*out)


def company_column(columns: list[str]) -> str:
    """The first column whose header speaks of a company or a name, else the first."""
    return next((c for c in columns if re.search("company|name", c, re.IGNORECASE)), columns[0])


def well_keyed(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a composite key; empty texts become null."""
    texts = {c: F.nullif(F.col(c), F.lit("")) for c, t in rows.dtypes if t == "string"}
    return rows.filter(F.col(key).contains("__")).withColumns(texts)


def company_master(rows: DataFrame, name: str, codes: list[str], order: str) -> DataFrame:
    """Named companies with normalised codes; the first row in `order` of each company_id."""
    named = rows.filter(F.trim(name) != "").withColumns({c: normalise_code(F.col(c)) for c in codes})
    named = named.withColumn("company_id", surrogate_id(F.col(name), *(F.col(c) for c in codes)))
    return one_per_key(named, "company_id", order)
