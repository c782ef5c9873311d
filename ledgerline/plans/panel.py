"""The credit panel derived from the star-schema tables: Spark builders, and the same as SQL CTEs.

Amounts are summed as decimals, so that both engines get the same doubles from them.
A statement value is null where (company + year) is divisible by 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import table

SCALE = 10_000.0

METRICS = ("revenue_crore", "interest_crore", "borrowings_crore", "receivables_crore", "inventory_crore", "ebitda_margin_pct", "debt_to_equity", "interest_coverage", "working_capital_days")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company_name"), F.col("n_name").alias("sub_industry"), F.col("r_name").alias("industry_group"), F.col("s_acctbal").alias("balance"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (company, year): profit and loss and balance sheet from one pass over the lines."""
    price, discount, tax = (F.col(c).cast(t) for c, t in (("l_extendedprice", "decimal(12,2)"), ("l_discount", "decimal(4,2)"), ("l_tax", "decimal(4,2)")))
    flag = F.col("l_returnflag")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("year"))
    sums = lines.agg(
        F.sum(price * (1 - discount)).alias("sales"), F.sum(price * tax).alias("interest"), F.sum(price * discount).alias("other_income"),
        F.sum(F.when(flag == "R", price)).alias("receivables"), F.sum(F.when(flag == "N", price)).alias("inventory"), F.sum(F.when(flag == "A", price)).alias("borrowings"),
    )
    hole = (F.col("company_id") + F.col("year")) % 7 == 0
    crore = lambda c: (F.col(c).cast("double") / SCALE)
    out = sums.select("company_id", "year", F.make_date("year", F.lit(12), F.lit(31)).alias("period_date"), F.when(~hole, crore("sales")).alias("revenue_crore"), crore("interest").alias("interest_crore"), crore("other_income").alias("other_income_crore"), crore("receivables").alias("receivables_crore"), crore("inventory").alias("inventory_crore"), crore("borrowings").alias("borrowings_crore"))
    return out


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly features: margins, leverage, coverage and working-capital days (null-safe ratios)."""
    f = statements(spark, sf_dir)
    days = lambda c: F.try_divide(F.col(c), F.col("revenue_crore")) * 365
    ebitda = F.col("revenue_crore") - F.col("interest_crore") - F.col("other_income_crore")
    f = f.withColumns({"ebitda_margin_pct": F.try_divide(ebitda, F.col("revenue_crore")) * 100, "debt_to_equity": F.try_divide("borrowings_crore", F.coalesce("receivables_crore", F.lit(0.0)) + F.coalesce("inventory_crore", F.lit(0.0))), "interest_coverage": F.try_divide(ebitda, F.col("interest_crore")), "receivables_days": days("receivables_crore"), "inventory_days": days("inventory_crore")})
    either = F.coalesce("receivables_days", "inventory_days").isNotNull()
    return f.withColumn("working_capital_days", F.when(either, F.coalesce("receivables_days", F.lit(0.0)) + F.coalesce("inventory_days", F.lit(0.0))))


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with raw flags; the company is the customer key modulo the number of suppliers."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    key = F.col("o_orderkey")
    return o.select(
        key.alias("event_id"), (F.col("o_custkey") % F.col("n")).alias("company_id"), F.concat(F.lit("agency_"), (key % 7).cast("string")).alias("agency"),
        F.when(key % 29 != 0, F.to_date("o_orderdate")).alias("rating_date"), F.when(key % 17 != 0, 1 + key % 19).cast("int").alias("rating_rank"),
        F.when(key % 13 == 0, "short_term").otherwise("long_term").alias("scale_type"), (F.col("o_orderstatus") == "P").alias("withdrawn"), (key % 23 == 0).alias("not_cooperating"),
    )


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context snapshots: user events shifted by 26 years into the panel's time."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))
    return e.select("event_id", (F.col("user_id") % F.col("n")).alias("company_id"), F.date_sub(F.to_date("ts"), 9496).alias("as_of"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("score"), (F.col("event_type") == "error").alias("flag"), F.col("event_type").alias("kind"))


SQL = f"""
companies AS (
  SELECT s_suppkey AS company_id, s_name AS company_name, n_name AS sub_industry, r_name AS industry_group, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), sums AS (
  SELECT l_suppkey AS company_id, year(l_shipdate)::INT AS year,
    sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))) AS sales, sum(l_extendedprice::DECIMAL(12,2) * l_tax::DECIMAL(4,2)) AS interest,
    sum(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2)) AS other_income,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(12,2) END) AS receivables, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice::DECIMAL(12,2) END) AS inventory,
    sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice::DECIMAL(12,2) END) AS borrowings
  FROM lineitem GROUP BY 1, 2
), statements AS (
  SELECT company_id, year, make_date(year, 12, 31) AS period_date, CASE WHEN (company_id + year) % 7 <> 0 THEN sales::DOUBLE / {SCALE} END AS revenue_crore,
    interest::DOUBLE / {SCALE} AS interest_crore, other_income::DOUBLE / {SCALE} AS other_income_crore, receivables::DOUBLE / {SCALE} AS receivables_crore,
    inventory::DOUBLE / {SCALE} AS inventory_crore, borrowings::DOUBLE / {SCALE} AS borrowings_crore
  FROM sums
), ratios AS (
  SELECT *, (revenue_crore - interest_crore - other_income_crore) / nullif(revenue_crore, 0) * 100 AS ebitda_margin_pct,
    borrowings_crore / nullif(coalesce(receivables_crore, 0) + coalesce(inventory_crore, 0), 0) AS debt_to_equity,
    (revenue_crore - interest_crore - other_income_crore) / nullif(interest_crore, 0) AS interest_coverage,
    receivables_crore / nullif(revenue_crore, 0) * 365 AS receivables_days, inventory_crore / nullif(revenue_crore, 0) * 365 AS inventory_days
  FROM statements
), financials AS (
  SELECT *, CASE WHEN coalesce(receivables_days, inventory_days) IS NOT NULL THEN coalesce(receivables_days, 0) + coalesce(inventory_days, 0) END AS working_capital_days FROM ratios
), suppliers AS (SELECT count(*) AS n FROM supplier),
rating_events AS (
  SELECT o_orderkey AS event_id, o_custkey % n AS company_id, 'agency_' || (o_orderkey % 7) AS agency, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderdate::DATE END AS rating_date,
    CASE WHEN o_orderkey % 17 <> 0 THEN 1 + o_orderkey % 19 END::INT AS rating_rank, CASE WHEN o_orderkey % 13 = 0 THEN 'short_term' ELSE 'long_term' END AS scale_type,
    o_orderstatus = 'P' AS withdrawn, o_orderkey % 23 = 0 AS not_cooperating
  FROM orders, suppliers
), context AS (
  SELECT event_id, user_id % n AS company_id, ts::DATE - 9496 AS as_of, CASE WHEN event_id % 5 <> 0 THEN value END AS score, event_type = 'error' AS flag, event_type AS kind FROM events, suppliers
)"""


def sql(body: str, *ctes: str) -> str:
    """Oracle SQL over the panel."""
    return "WITH " + ", ".join([SQL.strip(), *ctes]) + "\n" + body
