"""Queries on alignment in time: as-of windows, prior ratings, peers, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import filters, joins, order_stats, windows
from ledgerline.plans import panel
from ledgerline.plans.panel import sql
from ledgerline.session import materialise

LAG_DAYS, PERIODS, PEERS = 90, 4, 25


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def q_financial_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = panel.financials(spark, sf_dir)
    order = Window.partitionBy("company_id").orderBy("year")
    f = f.withColumn("revenue_growth_pct", windows.growth_pct(F.col("revenue_crore"), F.lag("revenue_crore").over(order)))
    return r6(f.select("company_id", "year", *panel.METRICS, "revenue_growth_pct"), *panel.METRICS, "revenue_growth_pct")


FINANCIAL_PANEL_SQL = sql(f"""
SELECT company_id, year, {", ".join(f"round({m}, 6) AS {m}" for m in panel.METRICS)},
  round((revenue_crore - lag(revenue_crore) OVER w) / nullif(abs(lag(revenue_crore) OVER w), 0) * 100, 6) AS revenue_growth_pct
FROM financials WINDOW w AS (PARTITION BY company_id ORDER BY year)""")


def eligible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.eligible(panel.rating_events(spark, sf_dir)).select("event_id", "company_id", "agency", "rating_date", "rating_rank")


def aligned(spark: SparkSession, sf_dir: str, lag_days: int = LAG_DAYS, financials: DataFrame | None = None) -> DataFrame:
    """Eligible events with their window of periods. financials: the panel's statements, where the caller has them written."""
    events = eligible_events(spark, sf_dir)
    periods = (panel.financials(spark, sf_dir) if financials is None else financials).select("company_id", "period_date", *panel.METRICS)
    return joins.asof_window(events, periods, "company_id", "event_id", "rating_date", "period_date", lag_days, PERIODS)


def q_rating_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: window features, peer position and prior ranks of every eligible event."""
    by = ["event_id", "company_id", "agency", "rating_date", "rating_rank"]
    financials = materialise(panel.financials(spark, sf_dir), "financials")
    feats = windows.history_features(aligned(spark, sf_dir, financials=financials), by, ["revenue_crore", "debt_to_equity"], "period_date")
    peers = order_stats.peer_positions(financials.join(panel.companies(spark, sf_dir).select("company_id", "sub_industry"), "company_id"), ["company_id", "period_date"], ["sub_industry", "period_date"], {"revenue_crore": "peer_revenue"})
    feats = feats.join(peers.select("company_id", F.col("period_date").alias("matched_period"), "peer_revenue_gap", "peer_revenue_pctile"), ["company_id", "matched_period"], "left")
    feats = joins.prior_value(feats, ["company_id"], "rating_date", "event_id", "rating_rank", "prior_rank")
    feats = joins.prior_value(feats, ["company_id", "agency"], "rating_date", "event_id", "rating_rank", "prior_agency_rank")
    feats = feats.withColumn("months_since_prior", F.datediff("rating_date", "prior_rank_date") / 30.4375).drop("prior_rank_date", "prior_agency_rank_date")
    doubles = [c for c, t in feats.dtypes if t == "double"]
    return r6(feats, *doubles)


WINDOW = """
eligible AS (
  SELECT * FROM rating_events WHERE scale_type = 'long_term' AND rating_rank IS NOT NULL AND NOT withdrawn AND NOT not_cooperating AND rating_date IS NOT NULL
), near AS (
  SELECT e.event_id, e.agency, e.rating_date, e.rating_rank, f.*, row_number() OVER (PARTITION BY e.event_id ORDER BY f.period_date DESC) AS recency
  FROM eligible e JOIN financials f ON e.company_id = f.company_id AND f.period_date <= e.rating_date - 90
), history AS (SELECT * FROM near WHERE recency <= 4)"""


def metric_sql(m: str) -> str:
    series = f"list({m} ORDER BY recency DESC) FILTER (WHERE {m} IS NOT NULL)"
    three = f"CASE WHEN recency <= 3 THEN {m} END"
    return f"""max(CASE WHEN recency = 1 THEN {m} END) AS {m}, avg({three}) AS {m}_avg3y,
  CASE WHEN count({three}) >= 2 THEN stddev_pop({three}) END AS {m}_std3y, CASE WHEN count({three}) >= 2 THEN regr_slope({three}, i_{m}) END AS {m}_slope3y,
  ({series})[-1] - ({series})[-2] AS {m}_delta1y, ({series})[-1] - ({series})[-3] AS {m}_delta2y"""


_FEATURE_NAMES = [f"{m}{s}" for m in ("revenue_crore", "debt_to_equity") for s in ("", "_avg3y", "_std3y", "_slope3y", "_delta1y", "_delta2y")]
RATING_FEATURES_SQL = sql(
    f"""
SELECT g.event_id, g.company_id, g.agency, g.rating_date, g.rating_rank, depth, span_days, matched_period, {", ".join(f"round({n}, 6) AS {n}" for n in _FEATURE_NAMES)},
  round(peer_revenue_gap, 6) AS peer_revenue_gap, round(peer_revenue_pctile, 6) AS peer_revenue_pctile, prior_rank, prior_agency_rank,
  round(date_diff('day', prior_date, g.rating_date) / 30.4375, 6) AS months_since_prior
FROM grouped g LEFT JOIN peers p ON g.company_id = p.company_id AND g.matched_period = p.period_date
JOIN priors q ON g.event_id = q.event_id""",
    WINDOW,
    """indexed AS (
  SELECT *, """
    + ", ".join(f"CASE WHEN recency <= 3 AND {m} IS NOT NULL THEN count(CASE WHEN recency <= 3 THEN {m} END) OVER (PARTITION BY event_id ORDER BY recency DESC ROWS UNBOUNDED PRECEDING) END AS i_{m}" for m in ("revenue_crore", "debt_to_equity"))
    + """ FROM history)""",
    f"""grouped AS (
  SELECT event_id, company_id, agency, rating_date, rating_rank, count(*) AS depth, date_diff('day', min(period_date), max(period_date))::INT AS span_days, max(period_date) AS matched_period,
  {metric_sql("revenue_crore")}, {metric_sql("debt_to_equity")}
  FROM indexed GROUP BY 1, 2, 3, 4, 5)""",
    """peers AS (
  SELECT company_id, period_date, revenue_crore - median(revenue_crore) OVER (PARTITION BY sub_industry, period_date) AS peer_revenue_gap,
    CASE WHEN revenue_crore IS NOT NULL THEN cume_dist() OVER (PARTITION BY sub_industry, period_date, revenue_crore IS NOT NULL ORDER BY revenue_crore) END AS peer_revenue_pctile
  FROM financials JOIN companies USING (company_id))""",
    """priors AS (
  SELECT a.event_id, arg_max(b.rating_rank, (b.rating_date, b.event_id)) AS prior_rank, max(b.rating_date) AS prior_date,
    arg_max(b.rating_rank, (b.rating_date, b.event_id)) FILTER (WHERE a.agency = b.agency) AS prior_agency_rank
  FROM grouped a LEFT JOIN grouped b ON a.company_id = b.company_id AND b.rating_date < a.rating_date GROUP BY 1)""",
)


def q_training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible and excluded events by agency and status, events without a window included (FLT-1, AGG-3)."""
    events = panel.rating_events(spark, sf_dir).withColumn("status", filters.eligibility())
    seen = aligned(spark, sf_dir).select("event_id").distinct().withColumn("has_window", F.lit(True))
    events = events.join(seen, "event_id", "left")
    status = F.when((F.col("status") == "eligible") & F.col("has_window").isNull(), "missing_90d_financial_alignment").otherwise(F.col("status"))
    return events.groupBy("agency", status.alias("status")).agg(F.count("*").alias("n_events"))


TRAINING_SUMMARY_SQL = sql(
    """
SELECT agency, CASE WHEN scale_type <> 'long_term' THEN 'non_long_term_rating' WHEN rating_rank IS NULL THEN 'missing_rating_label' WHEN withdrawn THEN 'withdrawn'
  WHEN not_cooperating THEN 'issuer_not_cooperating' WHEN rating_date IS NULL THEN 'missing_rating_date'
  WHEN event_id NOT IN (SELECT event_id FROM history) THEN 'missing_90d_financial_alignment' ELSE 'eligible' END AS status, count(*) AS n_events
FROM rating_events GROUP BY 1, 2""",
    WINDOW,
)


def q_latest_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest period per company with the last eligible rating before it (AGG-1, JOIN-6, ML-12)."""
    latest = panel.financials(spark, sf_dir).groupBy("company_id").agg(F.max_by(F.struct("period_date", "revenue_crore"), "period_date").alias("r")).select("company_id", "r.*")
    events = filters.eligible(panel.rating_events(spark, sf_dir))
    out = joins.asof_latest(latest, ["company_id", "revenue_crore"], "period_date", events, "company_id", "rating_date", "event_id", ["agency", "rating_rank"])
    return r6(out.withColumnsRenamed({"agency": "prior_agency", "rating_rank": "prior_rank"}), "revenue_crore")


LATEST_POPULATION_SQL = sql(
    """
SELECT l.company_id, round(l.revenue_crore, 6) AS revenue_crore, l.period_date, arg_max(e.agency, (e.rating_date, e.event_id)) AS prior_agency, arg_max(e.rating_rank, (e.rating_date, e.event_id)) AS prior_rank
FROM (SELECT * FROM financials QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period_date DESC) = 1) l
LEFT JOIN eligible e ON l.company_id = e.company_id AND e.rating_date < l.period_date GROUP BY 1, 2, 3""",
    WINDOW.split("), near")[0] + ")",
)


def q_context_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context as of a cutoff, falling back to all rows of a company without any (JOIN-7)."""
    cutoff = F.to_date(F.lit("1998-01-08"))
    c = panel.context(spark, sf_dir).withColumn("known", F.col("as_of") <= cutoff)
    c = c.withColumn("any_known", F.max(F.col("known").cast("int")).over(Window.partitionBy("company_id"))).filter("known or any_known = 0")
    latest = F.max(F.when(F.col("score").isNotNull(), F.struct("as_of", "event_id", "score")))["score"]
    return c.groupBy("company_id").agg(latest.alias("score"), F.bool_or("flag").alias("flag"), F.max("as_of").alias("as_of"), F.count("*").alias("n_rows"))


CONTEXT_ASOF_SQL = sql(
    """
SELECT company_id, arg_max(score, (as_of, event_id)) FILTER (WHERE score IS NOT NULL) AS score, bool_or(flag) AS flag, max(as_of) AS as_of, count(*) AS n_rows
FROM known WHERE known OR NOT any_known GROUP BY 1""",
    "known AS (SELECT *, as_of <= DATE '1998-01-08' AS known, bool_or(as_of <= DATE '1998-01-08') OVER (PARTITION BY company_id) AS any_known FROM context)",
)


def _episodes(spark: SparkSession, sf_dir: str, financials: DataFrame | None = None) -> DataFrame:
    episodes = windows.forward_episodes(panel.financials(spark, sf_dir) if financials is None else financials, "company_id", "period_date", "revenue_crore")
    return episodes.join(panel.companies(spark, sf_dir).select("company_id", "sub_industry"), "company_id")


def q_forward_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_episodes(spark, sf_dir), "start_value", "end_value", "years", "forward_cagr_pct")


EPISODES = """ended AS (
  SELECT company_id, period_date AS start_date, revenue_crore AS start_value, row_number() OVER w AS n, count(*) OVER (PARTITION BY company_id) AS total,
    CASE WHEN lead(period_date, 3) OVER w IS NULL THEN last_value(period_date) OVER f ELSE lead(period_date, 3) OVER w END AS end_date,
    CASE WHEN lead(period_date, 3) OVER w IS NULL THEN last_value(revenue_crore) OVER f ELSE lead(revenue_crore, 3) OVER w END AS end_value
  FROM financials WINDOW w AS (PARTITION BY company_id ORDER BY period_date), f AS (PARTITION BY company_id ORDER BY period_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), spans AS (SELECT *, date_diff('day', start_date, end_date) / 365.25 AS years FROM ended), episodes AS (
  SELECT company_id, sub_industry, start_date, end_date, start_value, end_value, years,
    CASE WHEN start_value > 0 AND end_value > 0 THEN (pow(end_value / start_value, 1.0 / years) - 1) * 100 END AS forward_cagr_pct
  FROM spans JOIN companies USING (company_id) WHERE n <= total - 2 AND years >= 1.75)"""
FORWARD_EPISODES_SQL = sql("SELECT company_id, sub_industry, start_date, end_date, round(start_value, 6) AS start_value, round(end_value, 6) AS end_value, round(years, 6) AS years, round(forward_cagr_pct, 6) AS forward_cagr_pct FROM episodes", EPISODES)


def q_scale_peers(spark: SparkSession, sf_dir: str, financials: DataFrame | None = None) -> DataFrame:
    """Trajectory of the 25 peers nearest in scale (JOIN-10, TOP-3): medians over their episodes."""
    financials = materialise(panel.financials(spark, sf_dir), "financials") if financials is None else financials
    targets = financials.groupBy("company_id").agg(F.max_by("revenue_crore", F.when(F.col("revenue_crore").isNotNull(), F.col("period_date"))).alias("start_value"))
    targets = targets.join(panel.companies(spark, sf_dir).select("company_id", "sub_industry"), "company_id").withColumn("target", F.col("company_id"))
    near = joins.nearest_by_ratio(targets, _episodes(spark, sf_dir, financials), "sub_industry", "company_id", "start_value", ["start_date", "forward_cagr_pct"], PEERS)
    out = near.groupBy("target").agg(F.count("*").alias("n_peers"), F.max("in_band").alias("in_band"), F.percentile("forward_cagr_pct", F.lit(0.5)).alias("median_cagr"), F.max("distance").alias("farthest"))
    return r6(out, "median_cagr", "farthest")


SCALE_BODY = """SELECT target, count(*) AS n_peers, max(in_band) AS in_band, round(median(forward_cagr_pct), 6) AS median_cagr, round(max(distance), 6) AS farthest FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, company_id, start_date) AS k FROM pairs WHERE in_band OR NOT any_band) WHERE k <= 25 GROUP BY 1"""
SCALE_PAIRS = """targets AS (SELECT company_id AS target, sub_industry, arg_max(revenue_crore, period_date) FILTER (WHERE revenue_crore IS NOT NULL) AS v FROM financials JOIN companies USING (company_id) GROUP BY 1, 2),
pairs AS (SELECT t.target, e.company_id, e.start_date, e.forward_cagr_pct, abs(ln(e.start_value / t.v)) AS distance, e.start_value BETWEEN t.v / 2.0 AND t.v * 2.0 AS in_band,
  bool_or(e.start_value BETWEEN t.v / 2.0 AND t.v * 2.0) OVER (PARTITION BY t.target) AS any_band
  FROM targets t JOIN episodes e ON t.sub_industry = e.sub_industry AND t.target <> e.company_id WHERE t.v > 0 AND e.start_value > 0)"""
SCALE_PEERS_SQL = sql(SCALE_BODY, EPISODES, SCALE_PAIRS)

QUERIES = {"rating_features": (q_rating_features, RATING_FEATURES_SQL), "financial_panel": (q_financial_panel, FINANCIAL_PANEL_SQL), "training_summary": (q_training_summary, TRAINING_SUMMARY_SQL), "latest_population": (q_latest_population, LATEST_POPULATION_SQL), "context_asof": (q_context_asof, CONTEXT_ASOF_SQL), "forward_episodes": (q_forward_episodes, FORWARD_EPISODES_SQL), "scale_peers": (q_scale_peers, SCALE_PEERS_SQL)}
