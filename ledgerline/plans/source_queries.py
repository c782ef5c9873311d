"""Queries through files: tables are written to the shared folder in an ingest's formats and scanned or routed back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import ratings, sinks
from ledgerline.plans import panel
from ledgerline.plans.panel import sql
from ledgerline.session import scratch, table
from ledgerline.sources import scans


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def q_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, SRC-9: companies from CSV under aliased headers; an absent file adds nothing."""
    path = _folder(spark, "csv")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("Supplier Key"), F.concat(F.lit('He said "'), F.col("s_name"), F.lit('", twice\nor so')).alias("Company Name"), F.round("s_acctbal", 2).alias("Balance")).write.csv(path, header=True, escape='"')
    schema = "`Supplier Key` long, `Company Name` string, Balance double"
    both = scans.csv_or_empty(spark, path, schema).unionByName(scans.csv_or_empty(spark, path + "-absent", schema))
    return scans.rename_aliases(both, {"supplier_key": "company_id", "company_name": "name"})


CSV_SCAN_SQL = """SELECT s_suppkey AS company_id, 'He said "' || s_name || '", twice' || chr(10) || 'or so' AS name, round(s_acctbal, 2) AS "Balance" FROM supplier"""


def q_company_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SRC-7: one company per id from a master list with repeats and blank names; rows without a whole key go."""
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 10 == 3, " ").otherwise(F.concat(F.lit("Firm "), (F.col("s_suppkey") % 40).cast("string"))).alias("name"), F.when(F.col("s_suppkey") % 4 != 0, F.concat((F.col("s_suppkey") % 40 + 500).cast("string"), F.lit(".0"))).alias("code"), F.col("s_suppkey").alias("row"))
    return scans.well_keyed(scans.company_master(s, "name", ["code"], "row"), "company_id")


COMPANY_MASTER_SQL = """
SELECT 'Firm ' || (s_suppkey % 40) AS name, (s_suppkey % 40 + 500)::VARCHAR AS code, min(s_suppkey) AS "row", 'Firm_' || (s_suppkey % 40) || '__' || (s_suppkey % 40 + 500) AS company_id FROM supplier
WHERE s_suppkey % 10 <> 3 AND s_suppkey % 4 <> 0 GROUP BY s_suppkey % 40"""


def q_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3, SRC-4: yearly records fanned out from JSON documents, and context records under `rows`."""
    path = _folder(spark, "json")
    docs = panel.statements(spark, sf_dir).groupBy("company_id").agg(F.collect_list(F.struct("year", F.round("interest_crore", 6).alias("v"))).alias("records"))
    docs.select(F.col("company_id").cast("string").alias("id"), "records").write.json(path)
    read = spark.read.schema("id string, records array<struct<year: int, v: double>>").json(path)
    rows_path = _folder(spark, "rows")
    table(spark, sf_dir, "nation").select(F.array(F.struct(F.col("n_name").alias("a"), F.col("n_nationkey").cast("double").alias("v"))).alias("rows"), F.col("n_nationkey").alias("part")).write.partitionBy("part").json(rows_path)
    #: One object a line is one object a file where the writer makes a file a row.
    context = scans.json_records(spark, rows_path, "a string, v double")
    return scans.section(read, "id", "records").unionByName(context.select(F.col("a").alias("id"), F.lit(None).cast("int").alias("year"), "v"))


JSON_SCAN_SQL = sql("SELECT company_id::VARCHAR AS id, year, round(interest_crore, 6) AS v FROM statements UNION ALL SELECT n_name, NULL, n_nationkey::DOUBLE FROM nation")


def q_manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5, SRC-6, SRC-8: text documents of a folder against the manifest that lists them."""
    path = _folder(spark, "texts")
    n = table(spark, sf_dir, "nation")
    body = F.when(F.col("n_nationkey") % 5 == 0, "  ").otherwise(F.concat(F.lit("about "), "n_name"))
    n.filter("n_nationkey % 7 <> 3").select(body.alias("value"), F.col("n_nationkey").cast("string").alias("part")).write.partitionBy("part").text(path)
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    status = F.when(F.col("value").rlike("\\S"), "parsed").otherwise("failed")
    found = read.select(F.regexp_extract(F.col("_metadata.file_path"), "part=(\\d+)", 1).alias("file"), status.alias("parsed_status"))
    manifest = n.select(F.col("n_nationkey").cast("string").alias("file"), "n_name")
    return scans.manifest_status(manifest, found)


MANIFEST_SCAN_SQL = """SELECT n_nationkey::VARCHAR AS file, n_name, CASE WHEN n_nationkey % 7 = 3 THEN 'missing_file' WHEN n_nationkey % 5 = 0 THEN 'parse_failed' ELSE 'parsed' END AS status FROM nation"""


def q_group_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: companies written as one folder per industry, and read back from the folders."""
    path = _folder(spark, "groups")
    sinks.write_by_group(panel.companies(spark, sf_dir).select("company_id", "sub_industry"), "sub_industry", path)
    return spark.read.parquet(path).select("sub_industry_slug", "sub_industry", "company_id")


GROUP_FILES_SQL = sql("SELECT lower(replace(sub_industry, ' ', '_')) AS sub_industry_slug, sub_industry, company_id FROM companies")


def q_result_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6: a package of tables held to the companies with a rating; rows of each table read back."""
    path = _folder(spark, "package")
    chosen = panel.rating_events(spark, sf_dir).filter("withdrawn").select("company_id")
    tables = {"companies": panel.companies(spark, sf_dir), "statements": panel.statements(spark, sf_dir), "nations": table(spark, sf_dir, "nation")}
    paths = sinks.write_package(tables, chosen, "company_id", path)
    counts = [spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, p in zip(tables, paths, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


RESULT_PACKAGE_SQL = sql("""SELECT 'companies' AS name, count(*) AS n FROM companies WHERE company_id IN (SELECT company_id FROM rating_events WHERE withdrawn)
UNION ALL SELECT 'statements', count(*) FROM statements WHERE company_id IN (SELECT company_id FROM rating_events WHERE withdrawn) UNION ALL SELECT 'nations', count(*) FROM nation""")


def q_routed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8: decisions to their tables; a success ends an old failure, a new failure adds one."""
    k = F.col("event_id")
    decided = panel.rating_events(spark, sf_dir).select("event_id", F.when(k % 5 == 0, "no_results").when(k % 5 == 1, "ambiguous").otherwise("matched").alias("status"))
    old = panel.rating_events(spark, sf_dir).filter("withdrawn").select("event_id")
    parts = [t.select(F.lit(name).alias("target"), "event_id") for name, t in sinks.route(decided, old, "event_id").items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ROUTED_DECISIONS_SQL = sql("""SELECT 'status' AS target, event_id FROM rating_events UNION ALL SELECT 'review', event_id FROM rating_events WHERE event_id % 5 = 1
UNION ALL SELECT 'failures', event_id FROM rating_events WHERE event_id % 5 = 0 OR event_id % 5 = 1 AND withdrawn""")


def q_error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-9: one row per failed check of each event."""
    checks = {"dates:missing": ("no date", F.col("rating_date").isNull()), "ranks:missing": ("no rank", F.col("rating_rank").isNull()), "ranks:withdrawn": ("rating withdrawn", F.col("withdrawn"))}
    return sinks.error_records(panel.rating_events(spark, sf_dir), "event_id", checks, "v1")


ERROR_RECORDS_SQL = sql("""SELECT event_id, 'dates' AS stage, 'dates:missing' AS error_type, 'no date' AS message, 'v1' AS parser_version FROM rating_events WHERE rating_date IS NULL
UNION ALL SELECT event_id, 'ranks', 'ranks:missing', 'no rank', 'v1' FROM rating_events WHERE rating_rank IS NULL UNION ALL SELECT event_id, 'ranks', 'ranks:withdrawn', 'rating withdrawn', 'v1' FROM rating_events WHERE withdrawn""")


def q_liquidity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-5: the liquidity label of free texts, the first in order whose words occur."""
    text = F.concat(F.lit("The liquidity"), F.element_at(F.array(*map(F.lit, (": Strong", " adequate", " remains stretched", " position is adequate", " is unknown", ": WEAK"))), (F.col("event_id") % 6 + 1).cast("int")), F.lit(" by now"))
    return panel.rating_events(spark, sf_dir).select("event_id", ratings.first_pattern([text], ratings.LIQUIDITY).alias("label"))


LIQUIDITY_LABELS_SQL = sql("SELECT event_id, (['Strong', 'Adequate', 'Stretched', 'Adequate', NULL, 'Weak'])[event_id % 6 + 1] AS label FROM rating_events")

QUERIES = {
    "csv_scan": (q_csv_scan, CSV_SCAN_SQL), "company_master": (q_company_master, COMPANY_MASTER_SQL), "json_scan": (q_json_scan, JSON_SCAN_SQL), "manifest_scan": (q_manifest_scan, MANIFEST_SCAN_SQL), "group_files": (q_group_files, GROUP_FILES_SQL),
    "result_package": (q_result_package, RESULT_PACKAGE_SQL), "routed_decisions": (q_routed_decisions, ROUTED_DECISIONS_SQL), "error_records": (q_error_records, ERROR_RECORDS_SQL), "liquidity_labels": (q_liquidity_labels, LIQUIDITY_LABELS_SQL),
}
