"""Queries that apply the scalar functions and filters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import filters
from ledgerline.plans import panel
from ledgerline.plans.panel import sql
from ledgerline.session import table

_STOP = ", ".join(f"'{x}'" for x in S.LEGAL_SUFFIXES)
_NULLS = ", ".join(f"'{x}'" for x in S.NULL_TEXTS)
_NAME = "c_name || ' & Söns ' || CASE WHEN c_custkey % 2 = 0 THEN 'Pvt. Ltd' ELSE 'Company-Inc' END"


def q_name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1..6, STR-8, STR-9, STR-12 on customer names."""
    tail = F.when(F.col("c_custkey") % 2 == 0, "Pvt. Ltd").otherwise("Company-Inc")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" & Söns "), tail).alias("name"), (F.col("c_custkey") % 9).cast("double").cast("string").alias("code"), "c_mktsegment")
    norm = S.normalise_name(F.col("name"))
    code = S.normalise_code(F.when(F.col("c_custkey") % 4 != 0, F.col("code")).otherwise("NaN"))
    return c.select(
        "c_custkey", norm.alias("normalised"), F.array_join(S.name_tokens(norm), "|").alias("tokens"), F.array_join(S.name_variants(norm), "|").alias("variants"), S.slug(F.col("name")).alias("slug"), code.alias("code"),
        S.surrogate_id(F.col("name"), code, F.col("c_custkey").cast("string")).alias("surrogate"), F.substring(F.sha1(F.col("name").cast("binary")), 1, 12).alias("event_hash"),
        S.metric_key(F.concat("c_mktsegment", F.lit(" % & Sales [1] +"))).alias("metric_key"), S.clean_text(F.when(F.col("c_custkey") % 3 == 0, " N/A ").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit("  x ")))).alias("cell"), F.initcap(F.lower("c_mktsegment")).alias("pretty"),
    )


NAME_FUNCTIONS_SQL = f"""
WITH n AS (SELECT c_custkey, c_mktsegment, {_NAME} AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 9)::VARCHAR END AS code FROM customer),
m AS (SELECT *, trim(regexp_replace(lower(replace(strip_accents(name), '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) AS normalised FROM n),
t AS (SELECT *, list_filter(string_split(normalised, ' '), lambda x: x NOT IN ('', {_STOP})) AS tokens FROM m)
SELECT c_custkey, normalised, array_to_string(tokens, '|') AS tokens,
  array_to_string(list_filter([normalised, CASE WHEN array_to_string(tokens, ' ') <> normalised THEN array_to_string(tokens, ' ') END,
    CASE WHEN array_to_string(tokens[1:3], ' ') NOT IN (normalised, array_to_string(tokens, ' ')) THEN array_to_string(tokens[1:3], ' ') END], lambda x: x IS NOT NULL), '|') AS variants,
  trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g')), '_') AS slug, code, regexp_replace(trim(name), '[^A-Za-z0-9]+', '_', 'g') || '__' || coalesce(code, c_custkey::VARCHAR) AS surrogate,
  sha1(name)[1:12] AS event_hash, lower(c_mktsegment) || '_pct_and_sales' AS metric_key, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ' x' END AS cell, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS pretty
FROM t"""


def q_url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11 on page addresses."""
    u = F.col("url")
    path = F.regexp_extract(u, "^[a-z]+://[^/?#]+([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", S.host(u).alias("host"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("leaf"), F.regexp_extract(u, "[?&]page=([^&#]*)", 1).alias("page"), F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "^http:", "https:").alias("canonical"))


URL_FUNCTIONS_SQL = """
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
  string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')[-1] AS leaf, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page,
  regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'https:') AS canonical FROM pages"""


def q_number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-1..4, 6..8, 10 on amounts written as text."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    amount = F.format_number(F.col("o_totalprice"), 2)
    cell = F.when(k % 4 == 0, F.concat(F.lit("₹ "), amount, F.lit(" Cr."))).when(k % 4 == 1, F.concat(F.lit("("), amount, F.lit(")"))).when(k % 4 == 2, F.concat((k % 100).cast("string"), F.lit("%"))).otherwise("-")
    share = F.when(k % 3 == 0, "0.25").when(k % 3 == 1, "0.5%").otherwise("40")
    truth = F.element_at(F.array(*map(F.lit, ("Yes", "1.0", "no", "maybe", " TRUE "))), (k % 5 + 1).cast("int"))
    a, b = F.when(k % 2 == 0, F.col("o_totalprice")), F.when(k % 3 == 0, F.lit(1.5))
    years = F.lit(3.0)
    return o.select(
        "o_orderkey", S.parse_number(cell).alias("number"), S.percent(S.parse_number(share), share).alias("pct"), S.to_crore(F.col("o_totalprice"), F.when(k % 2 == 0, "Rs million").otherwise("crore")).alias("crore"),
        S.to_bool(truth).alias("flag"), S.to_bool3(truth).alias("flag3"), S.safe_sum(a, b).alias("total"), F.round(S.cagr_pct(F.lit(100.0), F.col("o_totalprice"), years), 6).alias("cagr_pct"), F.coalesce(b, a, F.lit(0.0)).alias("picked"),
        F.round(S.months_between_days(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), 6).alias("months"),
    )


NUMBER_FUNCTIONS_SQL = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN (o_orderkey % 100)::DOUBLE END AS number,
  CASE o_orderkey % 3 WHEN 0 THEN 25.0 WHEN 1 THEN 0.5 ELSE 40.0 END::DOUBLE AS pct, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 10 ELSE o_totalprice END AS crore,
  o_orderkey % 5 IN (0, 1, 4) AS flag, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN true WHEN o_orderkey % 5 = 2 THEN false END AS flag3,
  CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1.5 ELSE 0 END END AS total,
  CASE WHEN o_totalprice > 0 THEN round((pow(o_totalprice / 100.0, 1.0 / 3.0) - 1) * 100, 6) END AS cagr_pct,
  CASE WHEN o_orderkey % 3 = 0 THEN 1.5 WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END::DOUBLE AS picked, round(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 30.4375, 6) AS months
FROM orders"""


def q_date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-1, DAT-3, DAT-4 on dates written in five ways."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    text = F.when(k % 5 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 1, F.date_format(d, "ddMMMyyyy")).when(k % 5 == 2, F.date_format(d, "MMMM d , yyyy")).when(k % 5 == 3, F.date_format(d, "MMM yyyy")).otherwise("soon")
    label = F.when(k % 3 == 0, F.date_format(d, "MMM yyyy")).when(k % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise("TTM")
    years = F.concat(F.year(d).cast("string"), F.lit("-"), (F.year(d) + 1).cast("string"))
    return o.select("o_orderkey", S.parse_date(text).alias("parsed"), S.month_end(label).alias("period"), F.when(label == "TTM", "ttm").otherwise("annual").alias("period_type"), S.fiscal_period(F.when(k % 2 == 0, d), years).alias("fiscal"))


DATE_FUNCTIONS_SQL = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN o_orderdate::DATE WHEN 3 THEN date_trunc('month', o_orderdate)::DATE END AS parsed,
  CASE o_orderkey % 3 WHEN 0 THEN last_day(o_orderdate::DATE) WHEN 1 THEN o_orderdate::DATE END AS period, CASE WHEN o_orderkey % 3 = 2 THEN 'ttm' ELSE 'annual' END AS period_type,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE ELSE make_date(year(o_orderdate) + 1, 3, 31) END AS fiscal FROM orders"""


def q_text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6, STR-5, STR-7 on documents: whole-text hash, trimmed lines, counts."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t]+(\\n|$)", "$1"), "\\n{3,}", "\n\n")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("doc_hash"), F.char_length(text).cast("long").alias("n_clean"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.md5(text.cast("binary")).alias("clean_hash"))


TEXT_CLEANUP_SQL = r"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)
SELECT doc_id, sha256(raw) AS doc_hash, length(t)::BIGINT AS n_clean, len(string_split(t, chr(10)))::BIGINT AS n_lines, md5(t) AS clean_hash FROM c"""


def q_screening_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2, FLT-3, FLT-4, FLT-8 on the latest statements."""
    f = panel.financials(spark, sf_dir).join(panel.companies(spark, sf_dir), "company_id")
    profit = F.col("revenue_crore") - F.col("interest_crore")
    gate = F.when(F.coalesce("revenue_crore", F.lit(0.0)) < 450, "below_threshold").otherwise("full_path")
    label = filters.label_choice("sub_industry", "industry_group", generic=("nation_0", "nation_1", "nation_2"))
    pending = F.col("revenue_crore").isNull() & (F.col("balance") > 0)
    return f.select("company_id", "year", (F.coalesce(F.col("revenue_crore") > 450, F.lit(False)) & F.coalesce(profit > 0, F.lit(False)) & (F.col("balance") > 0)).alias("screened"), gate.alias("gate"), label.alias("label"), pending.alias("pending"))


SCREENING_FILTERS_SQL = sql("""
SELECT company_id, year, coalesce(revenue_crore > 450 AND revenue_crore - interest_crore > 0 AND balance > 0, false) AS screened, CASE WHEN coalesce(revenue_crore, 0) < 450 THEN 'below_threshold' ELSE 'full_path' END AS gate,
  CASE WHEN lower(sub_industry) IN ('nation_0', 'nation_1', 'nation_2') THEN industry_group ELSE sub_industry END AS label, revenue_crore IS NULL AND balance > 0 AS pending
FROM financials JOIN companies USING (company_id)""")


def q_relevance_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6: large orders of a customer, or its first three if it has none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return filters.keep_or_first(o, "o_custkey", F.col("o_totalprice") > 400000, ["o_orderkey"], 3)


RELEVANCE_FALLBACK_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, bool_or(o_totalprice > 400000) OVER (PARTITION BY o_custkey) AS found FROM orders)
WHERE o_totalprice > 400000 OR (NOT found AND n <= 3)"""


def q_array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-1..4: probability maps from orders, list parsing, JSON snapshot."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    m = F.from_json(F.concat(F.lit('{"AA":'), (k % 5).cast("string"), F.lit(',"A":'), (k % 3).cast("string"), F.lit(',"BBB":1}')), "map<string,double>")
    rank = F.create_map(F.lit("AA"), F.lit(1), F.lit("A"), F.lit(2), F.lit("BBB"), F.lit(3))
    norm = S.normalised_map(m)
    listed = S.list_of(F.when(k % 2 == 0, "['x', 'y', '']").otherwise("single"))
    snapshot = F.to_json(F.struct("o_orderkey", F.lit(None).cast("string").alias("missing")), {"ignoreNullFields": "false"})
    return o.select("o_orderkey", S.best_of_map(m, rank).alias("best"), F.round(norm["AA"], 6).alias("p_aa"), F.round(norm["BBB"], 6).alias("p_bbb"), F.size(listed).cast("long").alias("n_list"), F.array_join(listed, ",").alias("items"), snapshot.alias("snapshot"))


ARRAY_FUNCTIONS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 >= greatest(o_orderkey % 3, 1) THEN 'AA' WHEN o_orderkey % 3 >= 1 THEN 'A' ELSE 'BBB' END AS best,
  round((o_orderkey % 5)::DOUBLE / (o_orderkey % 5 + o_orderkey % 3 + 1), 6) AS p_aa, round(1.0::DOUBLE / (o_orderkey % 5 + o_orderkey % 3 + 1), 6) AS p_bbb,
  CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_list, CASE WHEN o_orderkey % 2 = 0 THEN 'x,y' ELSE 'single' END AS items, '{"o_orderkey":' || o_orderkey || ',"missing":null}' AS snapshot
FROM orders"""

QUERIES = {"name_functions": (q_name_functions, NAME_FUNCTIONS_SQL), "url_functions": (q_url_functions, URL_FUNCTIONS_SQL), "number_functions": (q_number_functions, NUMBER_FUNCTIONS_SQL), "date_functions": (q_date_functions, DATE_FUNCTIONS_SQL), "text_cleanup": (q_text_cleanup, TEXT_CLEANUP_SQL), "screening_filters": (q_screening_filters, SCREENING_FILTERS_SQL), "relevance_fallback": (q_relevance_fallback, RELEVANCE_FALLBACK_SQL), "array_functions": (q_array_functions, ARRAY_FUNCTIONS_SQL)}
