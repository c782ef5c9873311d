"""Queries on joins, aggregates, sets and reshaping over the credit panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import aggregates, filters, joins, order_stats, sets, windows
from ledgerline.plans import panel
from ledgerline.plans.features import r6
from ledgerline.plans.panel import sql
from ledgerline.session import table

LABELS = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "C+", "C", "D")
_LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and actual ranks per event by fixed arithmetic."""
    k = F.col("event_id")
    e = panel.rating_events(spark, sf_dir).filter("rating_rank is not null")
    shift = F.element_at(F.array(*map(F.lit, (0, 0, 1, -1, 2, 0, -3, 1))), (k % 8 + 1).cast("int"))
    return e.select("event_id", "company_id", "agency", F.col("rating_rank").alias("actual"), F.when(k % 31 != 0, F.greatest(F.lit(1), F.least(F.lit(19), F.col("rating_rank") + shift))).alias("predicted"), ((k % 100) / 100.0).alias("confidence"), ((k % 37) / 37.0).alias("top_probability"))


PRED = """predictions AS (SELECT event_id, company_id, agency, rating_rank AS actual,
  CASE WHEN event_id % 31 <> 0 THEN greatest(1, least(19, rating_rank + [0, 0, 1, -1, 2, 0, -3, 1][event_id % 8 + 1])) END::INT AS predicted, (event_id % 100) / 100.0::DOUBLE AS confidence, (event_id % 37) / 37.0::DOUBLE AS top_probability
  FROM rating_events WHERE rating_rank IS NOT NULL)"""


def q_agency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8, AGG-15."""
    m = aggregates.prediction_metrics(predictions(spark, sf_dir), ["agency"], "predicted", "actual", "confidence", "company_id")
    return r6(aggregates.strength(m), "exact", "within_one", "mean_error", "mean_confidence", "strength")


AGENCY_METRICS_SQL = sql(
    """
SELECT agency, round(exact, 6) AS exact, round(within_one, 6) AS within_one, round(mean_error, 6) AS mean_error, round(mean_confidence, 6) AS mean_confidence, n_rows, n_companies,
  round(greatest(0, least(1, 0.4 * within_one + 0.2 * exact + 0.3 * n_rows / max(n_rows) OVER () + 0.1)), 6) AS strength
FROM (SELECT agency, avg((predicted = actual)::INT) AS exact, avg((abs(predicted - actual) <= 1)::INT) AS within_one, avg(abs(predicted - actual)) AS mean_error, avg(confidence) AS mean_confidence, count(*) AS n_rows, count(DISTINCT company_id) AS n_companies FROM predictions GROUP BY 1)""",
    PRED,
)


def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9, labels in scale order."""
    p = predictions(spark, sf_dir).filter("predicted is not null")
    ranks = list(range(1, 20))
    out = p.groupBy("actual").pivot("predicted", ranks).count().na.fill(0)
    return out.withColumnsRenamed({str(r): f"p{r}" for r in ranks})


CONFUSION_MATRIX_SQL = sql("SELECT actual, " + ", ".join(f"count(*) FILTER (WHERE predicted = {r}) AS p{r}" for r in range(1, 20)) + " FROM predictions WHERE predicted IS NOT NULL GROUP BY 1", PRED)


def q_range_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: the smallest half-width that covers 75 % per agency."""
    p = predictions(spark, sf_dir).withColumn("deviation", F.col("predicted") - F.col("actual"))
    curve = aggregates.coverage_curve(p, "agency", "deviation", 18)
    policy = aggregates.smallest_halfwidth(curve, "agency", 0.75, 18)
    return r6(curve.join(F.broadcast(policy), "agency"), "coverage")


RANGE_POLICY_SQL = sql(
    """
SELECT agency, h::INT AS h, round(coverage, 6) AS coverage, coalesce(min(h) FILTER (WHERE coverage >= 0.75) OVER (PARTITION BY agency), 18)::INT AS halfwidth, max(coverage) OVER (PARTITION BY agency) >= 0.75 AS target_met
FROM (SELECT agency, h, count(*) FILTER (WHERE abs(predicted - actual) <= h) / count(*) AS coverage FROM predictions, range(19) AS g(h) GROUP BY 1, 2)""",
    PRED,
)


def q_prediction_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12, JOIN-17, TOP-4, MRT-9: one prediction per company, its own agency first, then strong agencies."""
    p = predictions(spark, sf_dir)
    strong = p.groupBy("agency").agg(F.count("*").alias("n")).select("agency", (F.col("n") >= 1500).alias("strong"))
    own = F.col("agency") == F.concat(F.lit("agency_"), (F.col("company_id") % 9).cast("string"))
    p = p.join(F.broadcast(strong), "agency", "left").withColumns({"own": own, "strong": F.coalesce("strong", F.lit(False))})
    best = joins.one_per_key(p, "company_id", F.col("own").desc(), F.col("strong").desc(), F.col("confidence").desc_nulls_last(), F.col("top_probability").desc_nulls_last(), "event_id")
    d = F.col("predicted") - F.col("actual")
    return best.select("company_id", "event_id", "agency", F.when(F.col("own"), "matched_historical_agency").when(F.col("strong"), "strong_agency").otherwise("best_available").alias("reason"), (d == 0).alias("exact"), (F.abs(d) <= 1).alias("within_one"), d.alias("deviation"))


PREDICTION_CHOICE_SQL = sql(
    """
SELECT company_id, event_id, agency, CASE WHEN own THEN 'matched_historical_agency' WHEN strong THEN 'strong_agency' ELSE 'best_available' END AS reason, predicted = actual AS exact, abs(predicted - actual) <= 1 AS within_one, predicted - actual AS deviation
FROM (SELECT *, agency = 'agency_' || (company_id % 9) AS own, count(*) OVER (PARTITION BY agency) >= 1500 AS strong FROM predictions)
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY own DESC, strong DESC, confidence DESC NULLS LAST, top_probability DESC NULLS LAST, event_id) = 1""",
    PRED,
)


def q_row_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6: feature coverage, missing names, readiness."""
    share, missing = aggregates.coverage(list(panel.METRICS))
    f = panel.financials(spark, sf_dir)
    return f.select("company_id", "year", F.round(share, 6).alias("coverage"), F.array_join(missing, ",").alias("missing"), aggregates.readiness(share).alias("readiness"))


_HELD = " + ".join(f"({m} IS NOT NULL)::INT" for m in panel.METRICS)
ROW_COVERAGE_SQL = sql(f"""
SELECT company_id, year, round(({_HELD}) / {len(panel.METRICS)}.0::DOUBLE, 6) AS coverage, concat_ws(',', {", ".join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in panel.METRICS)}) AS missing,
  CASE WHEN ({_HELD}) / {len(panel.METRICS)}.0 >= 0.8 THEN 'high' WHEN ({_HELD}) / {len(panel.METRICS)}.0 >= 0.5 THEN 'medium' ELSE 'low' END AS readiness FROM financials""")


def q_industry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, AGG-2, AGG-7, AGG-10, AGG-11, MRT-8: counts per group with an overall row."""
    f = panel.financials(spark, sf_dir)
    best = joins.one_per_key(f, "company_id", F.col("revenue_crore").desc_nulls_last(), F.col("period_date").desc())
    depth = f.groupBy("company_id").agg(F.countDistinct("period_date").alias("periods"))
    rated = filters.eligible(panel.rating_events(spark, sf_dir)).select("company_id").distinct().withColumn("rated", F.lit(True))
    c = panel.companies(spark, sf_dir).join(best.select("company_id", "revenue_crore"), "company_id", "left").join(depth, "company_id", "left").join(rated, "company_id", "left")
    out = c.rollup("industry_group").agg(F.count("*").alias("n_companies"), F.count_if(F.coalesce("rated", F.lit(False))).alias("n_rated"), F.count_if(F.col("rated").isNull()).alias("n_unrated"), F.count_if(F.col("periods") >= 7).alias("n_full_history"), F.round(F.max("revenue_crore"), 6).alias("top_revenue"), F.grouping("industry_group").alias("_g"))
    return out.withColumn("industry_group", F.when(F.col("_g") == 1, "overall").otherwise(F.col("industry_group"))).drop("_g")


INDUSTRY_SUMMARY_SQL = sql("""
SELECT CASE WHEN grouping(industry_group) = 1 THEN 'overall' ELSE industry_group END AS industry_group, count(*) AS n_companies, count(*) FILTER (WHERE rated) AS n_rated, count(*) FILTER (WHERE NOT rated) AS n_unrated,
  count(*) FILTER (WHERE periods >= 7) AS n_full_history, round(max(revenue), 6) AS top_revenue
FROM (SELECT c.company_id, industry_group, (SELECT max(revenue_crore) FROM financials f WHERE f.company_id = c.company_id) AS revenue, (SELECT count(DISTINCT period_date) FROM financials f WHERE f.company_id = c.company_id) AS periods,
  c.company_id IN (SELECT company_id FROM rating_events WHERE scale_type = 'long_term' AND rating_rank IS NOT NULL AND NOT withdrawn AND NOT not_cooperating AND rating_date IS NOT NULL) AS rated FROM companies c)
GROUP BY ROLLUP (industry_group)""")


def q_unrated_by_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5, JOIN-9, JOIN-16: every unrated company under every agency."""
    events = panel.rating_events(spark, sf_dir)
    rated = events.filter("scale_type = 'long_term' and rating_rank = 19 and rating_date < date'1996-01-01' and not withdrawn and not not_cooperating").select("company_id").distinct()
    agencies = spark.createDataFrame([(f"agency_{i}",) for i in range(7)], "agency string")
    return panel.companies(spark, sf_dir).join(rated, "company_id", "left_anti").select("company_id", "company_name").crossJoin(F.broadcast(agencies))


UNRATED_SQL = sql("""
SELECT company_id, company_name, 'agency_' || i AS agency FROM companies, range(7) AS g(i)
WHERE company_id NOT IN (SELECT company_id FROM rating_events WHERE scale_type = 'long_term' AND rating_rank = 19 AND rating_date < DATE '1996-01-01' AND NOT withdrawn AND NOT not_cooperating)""")


def q_feature_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, RSH-1: exact quartiles of every metric."""
    long = sets.long_series(panel.financials(spark, sf_dir), ["company_id", "year"], list(panel.METRICS))
    ranked = order_stats.ranked_values(long.filter("value is not null"), ["metric_name"])
    found = order_stats.quantiles(ranked, ["metric_name"], {"q25": 0.25, "q75": 0.75})
    return r6(found.join(ranked.groupBy("metric_name").agg(F.max("total").alias("n")), "metric_name"), "q25", "q75")


FEATURE_QUARTILES_SQL = sql(f"SELECT metric_name, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, count(*) AS n FROM (UNPIVOT (SELECT {', '.join(panel.METRICS)} FROM financials) ON {', '.join(panel.METRICS)} INTO NAME metric_name VALUE value) GROUP BY 1")


def q_period_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-2, RSH-3: arrays of (metric, values) exploded by place and pivoted back to period rows."""
    f = panel.financials(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("year")) - 1
    long = f.withColumn("pos", place).unpivot(["company_id", "pos"], ["revenue_crore", "interest_crore"], "label", "value")
    matrix = long.groupBy("company_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("cells"))
    cells = matrix.select("company_id", "label", F.posexplode_outer("cells").alias("pos", "cell"))
    return r6(cells.groupBy("company_id", "pos").pivot("label", ["revenue_crore", "interest_crore"]).agg(F.first("cell")), "revenue_crore", "interest_crore")


PERIOD_MATRIX_SQL = sql("SELECT company_id, (row_number() OVER (PARTITION BY company_id ORDER BY year) - 1)::INT AS pos, round(revenue_crore, 6) AS revenue_crore, round(interest_crore, 6) AS interest_crore FROM financials")


def q_company_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-4, WIN-9, WIN-10, MRT-10: one row per company with its newest ratings and trend points as arrays."""
    events = filters.eligible(panel.rating_events(spark, sf_dir))
    order = Window.partitionBy("company_id").orderBy(F.col("rating_date").desc_nulls_last(), F.col("event_id").desc())
    recent = events.withColumns({"n": F.row_number().over(order), "n_events": F.count("*").over(Window.partitionBy("company_id"))}).filter("n <= 10")
    history = recent.groupBy("company_id", "n_events").agg(F.array_sort(F.collect_list(F.struct("n", "rating_rank"))).alias("h"))
    trend = panel.financials(spark, sf_dir).filter("revenue_crore is not null").groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("year", F.round("revenue_crore", 2).alias("v")))).alias("t"))
    c = panel.companies(spark, sf_dir).join(history, "company_id", "left").join(trend, "company_id", "left")
    return c.select("company_id", "company_name", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.array_join(F.transform("h", lambda x: x["rating_rank"].cast("string")), ",").alias("ranks"), F.array_join(F.transform("t", lambda x: x["year"].cast("string")), ",").alias("years"))


PROFILES_SQL = sql("""
SELECT company_id, company_name, coalesce(n_events, 0) AS n_events, ranks, years FROM companies
LEFT JOIN (SELECT company_id, n_events, string_agg(rating_rank::VARCHAR, ',' ORDER BY n) AS ranks FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY rating_date DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY company_id) AS n_events
  FROM rating_events WHERE scale_type = 'long_term' AND rating_rank IS NOT NULL AND NOT withdrawn AND NOT not_cooperating AND rating_date IS NOT NULL) WHERE n <= 10 GROUP BY 1, 2) USING (company_id)
LEFT JOIN (SELECT company_id, string_agg(year::VARCHAR, ',' ORDER BY year) AS years FROM financials WHERE revenue_crore IS NOT NULL GROUP BY 1) USING (company_id)""")


def q_status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SNK-3, SNK-4, SNK-7, SET-2, SET-5: bootstrap statuses, upsert by events, replace one key set."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "matched_ready_for_download").otherwise("missing_company_code").alias("status"), F.lit(-1).cast("long").alias("seq"))
    news = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    merged = sets.upsert(base, news, ["id"], F.col("seq").desc())
    gone = merged.filter("status = 'error'").select("id")
    return sets.replace_rows(merged, gone.select("id", F.lit("retry").alias("status"), F.lit(0).cast("long").alias("seq")), gone, ["id"])


STATUS_UPSERT_SQL = """
WITH news AS (SELECT user_id AS id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1),
merged AS (SELECT * FROM news UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'matched_ready_for_download' ELSE 'missing_company_code' END, -1 FROM customer WHERE c_custkey NOT IN (SELECT id FROM news))
SELECT id, CASE WHEN status = 'error' THEN 'retry' ELSE status END AS status, CASE WHEN status = 'error' THEN 0 ELSE seq END::BIGINT AS seq FROM merged"""


def q_population_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1, SET-4, SNK-1: three populations stacked by name, with declared columns."""
    e = panel.rating_events(spark, sf_dir).withColumn("status", filters.eligibility())
    kept = e.filter("status = 'eligible'").select("event_id", "company_id", "rating_rank")
    out = e.filter("status <> 'eligible'").select("event_id", "company_id", "status")
    unseen = panel.companies(spark, sf_dir).select("company_id", "company_name")
    stacked = sets.union_tagged({"validation": kept, "excluded": out, "simulation": unseen}, "population")
    return sets.conform(stacked, [("population", "string"), ("event_id", "bigint"), ("company_id", "bigint"), ("rating_rank", "int"), ("status", "string"), ("company_name", "string")])


POPULATION_UNION_SQL = sql("""
SELECT CASE WHEN status = 'eligible' THEN 'validation' ELSE 'excluded' END AS population, event_id, company_id, CASE WHEN status = 'eligible' THEN rating_rank END AS rating_rank, nullif(status, 'eligible') AS status, NULL::VARCHAR AS company_name
FROM (SELECT *, CASE WHEN scale_type <> 'long_term' THEN 'non_long_term_rating' WHEN rating_rank IS NULL THEN 'missing_rating_label' WHEN withdrawn THEN 'withdrawn' WHEN not_cooperating THEN 'issuer_not_cooperating' WHEN rating_date IS NULL THEN 'missing_rating_date' ELSE 'eligible' END AS status FROM rating_events)
UNION ALL SELECT 'simulation', NULL, company_id, NULL, NULL, company_name FROM companies""")


def q_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-19, JOIN-20, JOIN-21: ratings of the first source that knows the company, crosswalk labels, overrides."""
    e = panel.rating_events(spark, sf_dir).select("company_id", "event_id", "agency", "rating_rank")
    found = joins.first_source([("cache", e.filter("agency = 'agency_0' and company_id % 3 = 0")), ("discovered", e.filter("agency = 'agency_1' and company_id % 3 <> 2")), ("hint", e.filter("agency = 'agency_2'"))], "company_id")
    scale = F.broadcast(spark.createDataFrame([(i + 1, x) for i, x in enumerate(LABELS)], "rating_rank int, label string"))
    labelled = found.join(scale, "rating_rank", "left")
    overrides = panel.companies(spark, sf_dir).filter("company_id % 10 = 0").select("company_id", F.lit("NR").alias("label"))
    return joins.overlay(labelled, overrides, "company_id", ["label"]).select("company_id", "event_id", "agency", "source", "label")


SOURCE_PRIORITY_SQL = sql(f"""
SELECT company_id, event_id, agency, source, CASE WHEN company_id % 10 = 0 AND company_id IN (SELECT company_id FROM companies) THEN 'NR' ELSE {_LABEL_SQL}[rating_rank] END AS label FROM (
  SELECT *, min(p) OVER (PARTITION BY company_id) AS best FROM (
    SELECT *, CASE WHEN agency = 'agency_0' THEN 'cache' WHEN agency = 'agency_1' THEN 'discovered' ELSE 'hint' END AS source, CASE WHEN agency = 'agency_0' THEN 0 WHEN agency = 'agency_1' THEN 1 ELSE 2 END AS p
    FROM rating_events WHERE (agency = 'agency_0' AND company_id % 3 = 0) OR (agency = 'agency_1' AND company_id % 3 <> 2) OR agency = 'agency_2')) WHERE p = best""")


def q_source_priority_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-19, JOIN-20, JOIN-21 on all events: each belongs to one source by its agency; companies with a withdrawn rating are overridden."""
    events = panel.rating_events(spark, sf_dir)
    e = events.select("company_id", "event_id", "agency", "rating_rank")
    known = {"cache": ["agency_0", "agency_1"], "discovered": ["agency_2", "agency_3", "agency_4"]}
    rest = F.coalesce(~F.col("agency").isin(*sum(known.values(), [])), F.lit(True))
    found = joins.first_source([(name, e.filter(F.col("agency").isin(*own))) for name, own in known.items()] + [("hint", e.filter(rest))], "company_id")
    scale = F.broadcast(spark.createDataFrame([(i + 1, x) for i, x in enumerate(LABELS)], "rating_rank int, label string"))
    overrides = events.filter("withdrawn").select("company_id", F.lit("NR").alias("label")).distinct()
    return joins.overlay(found.join(scale, "rating_rank", "left"), overrides, "company_id", ["label"]).select("company_id", "event_id", "agency", "source", "label")


SOURCE_PRIORITY_ALL_SQL = sql(f"""
SELECT company_id, event_id, agency, ['cache', 'discovered', 'hint'][p] AS source, CASE WHEN company_id IN (SELECT company_id FROM rating_events WHERE withdrawn) THEN 'NR' ELSE {_LABEL_SQL}[rating_rank] END AS label FROM (
  SELECT *, min(p) OVER (PARTITION BY company_id) AS best FROM (
    SELECT *, CASE WHEN agency IN ('agency_0', 'agency_1') THEN 1 WHEN agency IN ('agency_2', 'agency_3', 'agency_4') THEN 2 ELSE 3 END AS p FROM rating_events)) WHERE p = best""")


def mass(lo: Column, hi: Column, centre: Column) -> Column:
    """Share of a three-notch distribution (0.2, 0.6, 0.2 around the centre) that lies in [lo, hi]."""
    parts = [(centre - 1, 0.2), (centre, 0.6), (centre + 1, 0.2)]
    return sum((F.when((c >= lo) & (c <= hi), p).otherwise(0.0) for c, p in parts), F.lit(0.0))


# Floors of mass, confidence and top probability, and the trust, per half-width.
FLOORS = ((0, 0.46, 0.68, 0.42, 1.0), (1, 0.62, 0.63, 0.32, 0.8), (2, 0.76, 0.58, 0.24, 0.6))


def q_published_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG-1..4, RNG-6 in part: the first half-width that meets its floors, else the best one blanked for review."""
    p = predictions(spark, sf_dir).filter("predicted is not null")
    floors = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("h", "mass", "confidence", "top", "trust"), row, strict=True)]) for row in FLOORS])
    r = p.withColumn("f", F.explode(floors)).withColumns({"lo": F.greatest(F.lit(1), F.col("predicted") - F.col("f.h").cast("int")), "hi": F.least(F.lit(19), F.col("predicted") + F.col("f.h").cast("int"))})
    r = r.withColumn("mass", mass(F.col("lo"), F.col("hi"), F.col("predicted")))
    r = r.withColumn("score", 0.23 * F.col("confidence") + 0.18 * F.col("mass") + 0.08 + 0.045 + 0.23 * F.col("f.trust") + 0.1 * F.col("top_probability"))
    ok = (F.col("mass") >= F.col("f.mass")) & (F.col("score") >= F.col("f.confidence")) & (F.col("top_probability") >= F.col("f.top"))
    r = r.withColumn("row", F.struct((~ok).alias("bad"), F.when(ok, F.col("f.h")).otherwise(-(0.58 * F.col("score") + 0.42 * F.col("mass"))).alias("o"), F.col("f.h").cast("int").alias("h"), "lo", "hi", "score"))
    out = r.groupBy("event_id", "agency", "actual").agg(F.min("row").alias("b"))
    label = lambda c: F.element_at(F.array(*map(F.lit, LABELS)), F.col(c))
    text = F.when(F.col("b.lo") == F.col("b.hi"), label("b.lo")).otherwise(F.concat(label("b.lo"), F.lit(" to "), label("b.hi")))
    review = F.col("b.bad")
    usability = F.when(review, "manual_review").when(F.col("b.h") == 0, "focused").when(F.col("b.h") == 1, "usable").otherwise("broad")
    return out.select("event_id", "agency", F.when(~review, text).alias("published"), F.when(~review, F.col("actual").between(F.col("b.lo"), F.col("b.hi"))).alias("hit"), review.alias("review"), usability.alias("usability"), F.round("b.score", 6).alias("score"))


PUBLISHED_RANGES_SQL = sql(
    f"""
SELECT event_id, agency, CASE WHEN ok THEN CASE WHEN lo = hi THEN {_LABEL_SQL}[lo] ELSE {_LABEL_SQL}[lo] || ' to ' || {_LABEL_SQL}[hi] END END AS published, CASE WHEN ok THEN actual BETWEEN lo AND hi END AS hit, NOT ok AS review,
  CASE WHEN NOT ok THEN 'manual_review' WHEN h = 0 THEN 'focused' WHEN h = 1 THEN 'usable' ELSE 'broad' END AS usability, round(score, 6) AS score
FROM (SELECT *, mass >= fm AND score >= fc AND top_probability >= ft AS ok FROM scored)
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ok DESC, CASE WHEN ok THEN h ELSE -(0.58 * score + 0.42 * mass) END, h) = 1""",
    PRED,
    f"""floors(h, fm, fc, ft, trust) AS (VALUES {", ".join("(" + ", ".join(map(str, row)) + ")" for row in FLOORS)}),
bounds AS (SELECT p.*, f.h, fm::DOUBLE AS fm, fc::DOUBLE AS fc, ft::DOUBLE AS ft, trust::DOUBLE AS trust, greatest(1, predicted - h) AS lo, least(19, predicted + h) AS hi FROM predictions p, floors f WHERE predicted IS NOT NULL),
masses AS (SELECT *, 0.0::DOUBLE + CASE WHEN predicted - 1 BETWEEN lo AND hi THEN 0.2::DOUBLE ELSE 0 END + 0.6::DOUBLE + CASE WHEN predicted + 1 BETWEEN lo AND hi THEN 0.2::DOUBLE ELSE 0 END AS mass FROM bounds),
scored AS (SELECT *, 0.23::DOUBLE * confidence + 0.18::DOUBLE * mass + 0.08::DOUBLE + 0.045::DOUBLE + 0.23::DOUBLE * trust + 0.1::DOUBLE * top_probability AS score FROM masses)""",
)


def q_decision_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRT-1, MRT-3, MRT-6, MRT-11, RNG-7, NUM-8, and MRT-2 and MRT-7 in part, on the latest statements."""
    f = joins.one_per_key(panel.financials(spark, sf_dir), "company_id", F.col("period_date").desc())
    rated = filters.eligible(panel.rating_events(spark, sf_dir)).groupBy("company_id").agg(F.max_by("rating_rank", F.struct("rating_date", "event_id")).alias("last_rank"), F.max("rating_date").alias("last_date"))
    c = panel.companies(spark, sf_dir).join(f, "company_id", "left").join(rated, "company_id", "left")
    use = 0.45 + F.when(F.col("receivables_days") > 120, 0.05).when(F.col("receivables_days") < 60, -0.05).otherwise(0.0) + F.when(F.col("last_rank") <= 4, 0.05).when(F.col("last_rank") >= 8, -0.05).otherwise(0.0)
    limit = F.col("revenue_crore") * F.col("receivables_days") / 365 * F.greatest(F.lit(0.3), F.least(F.lit(0.6), use))
    notes = F.array_compact(F.array(F.when(F.col("debt_to_equity") > 0.6, "high leverage"), F.when(F.col("interest_coverage") < 15, "weak coverage"), F.when(F.coalesce("ebitda_margin_pct", F.lit(0.0)) < 80, "thin margins"), F.when(F.col("working_capital_days") > 250, "long cycle")))
    risk = F.when(F.coalesce("revenue_crore", F.lit(0.0)) < 400, "below_threshold").when(F.size(notes) >= 3, "watch").when(F.col("last_rank").isNull(), "needs_simulation").otherwise("rated")
    history = F.coalesce(F.format_string("rank %d on %s", "last_rank", F.col("last_date").cast("string")), F.lit("no rating history"))
    return c.select("company_id", F.round(limit, 4).alias("limit_crore"), F.array_join(notes, "; ").alias("notes"), risk.alias("risk"), F.when(F.col("last_rank").isNotNull(), history).otherwise("no rating history").alias("history"), F.when(F.col("last_rank").isNull(), "required").otherwise("not required").alias("simulation"), F.round(F.col("revenue_crore") * F.col("ebitda_margin_pct") / 100, 4).alias("ebitda_crore"))


DECISION_MARTS_SQL = sql(
    """
SELECT company_id, round(revenue_crore * receivables_days / 365 * greatest(0.3, least(0.6, 0.45::DOUBLE + CASE WHEN receivables_days > 120 THEN 0.05 WHEN receivables_days < 60 THEN -0.05 ELSE 0 END::DOUBLE + CASE WHEN last_rank <= 4 THEN 0.05 WHEN last_rank >= 8 THEN -0.05 ELSE 0 END::DOUBLE)), 4) AS limit_crore,
  concat_ws('; ', n1, n2, n3, n4) AS notes, CASE WHEN coalesce(revenue_crore, 0) < 400 THEN 'below_threshold' WHEN (n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT + (n4 IS NOT NULL)::INT >= 3 THEN 'watch' WHEN last_rank IS NULL THEN 'needs_simulation' ELSE 'rated' END AS risk,
  CASE WHEN last_rank IS NULL THEN 'no rating history' ELSE 'rank ' || last_rank || ' on ' || last_date END AS history, CASE WHEN last_rank IS NULL THEN 'required' ELSE 'not required' END AS simulation, round(revenue_crore * ebitda_margin_pct / 100, 4) AS ebitda_crore
FROM (SELECT c.company_id AS cid, f.*, last_rank, last_date, CASE WHEN debt_to_equity > 0.6 THEN 'high leverage' END AS n1, CASE WHEN interest_coverage < 15 THEN 'weak coverage' END AS n2, CASE WHEN coalesce(ebitda_margin_pct, 0) < 80 THEN 'thin margins' END AS n3, CASE WHEN working_capital_days > 250 THEN 'long cycle' END AS n4
  FROM companies c LEFT JOIN (SELECT * FROM financials QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period_date DESC) = 1) f ON c.company_id = f.company_id
  LEFT JOIN (SELECT company_id, arg_max(rating_rank, (rating_date, event_id)) AS last_rank, max(rating_date) AS last_date FROM rating_events
    WHERE scale_type = 'long_term' AND rating_rank IS NOT NULL AND NOT withdrawn AND NOT not_cooperating AND rating_date IS NOT NULL GROUP BY 1) r ON c.company_id = r.company_id)""")


def q_top_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-1, TOP-2, AGG-19: the twenty largest latest turnovers over a threshold."""
    f = joins.one_per_key(panel.financials(spark, sf_dir), "company_id", F.col("period_date").desc())
    return r6(f.filter("revenue_crore > 250").orderBy(F.col("revenue_crore").desc_nulls_last(), "company_id").limit(20).select("company_id", "year", "revenue_crore"), "revenue_crore")


TOP_TURNOVER_SQL = sql("SELECT company_id, year, round(revenue_crore, 6) AS revenue_crore FROM (SELECT * FROM financials QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period_date DESC) = 1) WHERE revenue_crore > 250 ORDER BY revenue_crore DESC, company_id LIMIT 20")

QUERIES = {"agency_metrics": (q_agency_metrics, AGENCY_METRICS_SQL), "confusion_matrix": (q_confusion_matrix, CONFUSION_MATRIX_SQL), "range_policy": (q_range_policy, RANGE_POLICY_SQL), "prediction_choice": (q_prediction_choice, PREDICTION_CHOICE_SQL), "row_coverage": (q_row_coverage, ROW_COVERAGE_SQL), "industry_summary": (q_industry_summary, INDUSTRY_SUMMARY_SQL), "unrated_by_agency": (q_unrated_by_agency, UNRATED_SQL), "feature_quartiles": (q_feature_quartiles, FEATURE_QUARTILES_SQL), "period_matrix": (q_period_matrix, PERIOD_MATRIX_SQL), "company_profiles": (q_company_profiles, PROFILES_SQL), "status_upsert": (q_status_upsert, STATUS_UPSERT_SQL), "population_union": (q_population_union, POPULATION_UNION_SQL), "source_priority": (q_source_priority, SOURCE_PRIORITY_SQL), "source_priority_all": (q_source_priority_all, SOURCE_PRIORITY_ALL_SQL), "published_ranges": (q_published_ranges, PUBLISHED_RANGES_SQL), "decision_marts": (q_decision_marts, DECISION_MARTS_SQL), "top_turnover": (q_top_turnover, TOP_TURNOVER_SQL)}
