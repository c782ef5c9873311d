"""Queries on advice, observations, calibrated ranges and the changes since a prior rating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import advice, aggregates, joins, windows
from ledgerline.plans import features, panel
from ledgerline.plans.features import r6
from ledgerline.plans.mart_queries import LABELS, PRED, predictions
from ledgerline.plans.panel import sql
from ledgerline.plans.training_queries import CTES, training_set

CHANGES = ("ebitda_margin_pct", "debt_to_equity", "interest_coverage", "working_capital_days")
WIDEST = 18


def _case(rules) -> str:
    return "[" + ", ".join(f"CASE WHEN {rule} THEN '{text}' END" for rule, text in rules) + "]"


def q_advisory_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRT-2: the five advisory notes on each company's latest year."""
    f = joins.one_per_key(panel.financials(spark, sf_dir), "company_id", F.col("period_date").desc())
    rated = panel.rating_events(spark, sf_dir).filter("rating_rank is not null").select("company_id").distinct().withColumn("rated", F.lit(True))
    rows = panel.companies(spark, sf_dir).select("company_id").join(f, "company_id", "left").join(rated, "company_id", "left")
    rows = rows.withColumns({"rated": F.coalesce("rated", F.lit(False)), "method": F.when(F.col("receivables_days").isNotNull(), "model").otherwise("none"), "receivables_days": F.col("receivables_days") * 10, "debt_to_equity": F.col("debt_to_equity") * 4})
    return rows.select("company_id", F.array_join(advice.told(advice.ADVICE), " ").alias("notes"))


ADVISORY_NOTES_SQL = sql(
    f"SELECT company_id, array_to_string(list_filter({_case(advice.ADVICE)}, lambda x: x IS NOT NULL), ' ') AS notes FROM latest",
    """latest AS (SELECT c.company_id, f.receivables_days * 10 AS receivables_days, f.debt_to_equity * 4 AS debt_to_equity, f.ebitda_margin_pct, c.company_id IN (SELECT company_id FROM rating_events WHERE rating_rank IS NOT NULL) AS rated, CASE WHEN f.receivables_days IS NOT NULL THEN 'model' ELSE 'none' END AS method
  FROM companies c LEFT JOIN (SELECT * FROM financials QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period_date DESC) = 1) f ON c.company_id = f.company_id)""",
)

#: Context that the panel doesn't hold comes from the event's number.
_MADE = {"regulatory_risk_score": "event_id % 11 * 1.0", "plan_progress_score": "event_id % 13 * 1.0"}


def q_rationale_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRT-4: observations, improvement actions and the rationale of every training row."""
    rows = training_set(spark, sf_dir).withColumns({n: F.expr(e) for n, e in _MADE.items()} | {"debt_to_equity": F.col("debt_to_equity") * 3, "interest_coverage": F.col("interest_coverage") / 8})
    seen = advice.told(advice.OBSERVATIONS, advice.NO_OBSERVATION)
    rows = rows.withColumn("observations", seen)
    sentence = advice.rationale(F.concat(F.lit("Company "), F.col("company_id").cast("string")), F.get(F.array(*map(F.lit, LABELS)), F.col("rating_rank") - 1), F.col("agency"), F.col("observations"))
    return rows.select("event_id", sentence.alias("rationale"), F.array_join("observations", "; ").alias("observations"), F.array_join(advice.told(advice.ACTIONS, advice.NO_ACTION), " ").alias("actions"))


_SEEN = f"list_filter({_case(advice.OBSERVATIONS)}, lambda x: x IS NOT NULL)"
_DONE = f"list_filter({_case(advice.ACTIONS)}, lambda x: x IS NOT NULL)"
RATIONALE_REPORTS_SQL = sql(
    f"""SELECT event_id, 'Company ' || company_id || ' is simulated at ' || {"[" + ", ".join(f"'{x}'" for x in LABELS) + "]"}[rating_rank] || ' under the ' || agency || ' lens. The result is driven by ' || array_to_string(o[1:3], ', ') || '.' AS rationale,
  array_to_string(o, '; ') AS observations, array_to_string(a, ' ') AS actions
FROM (SELECT *, CASE WHEN len({_SEEN}) = 0 THEN ['{advice.NO_OBSERVATION}'] ELSE {_SEEN} END AS o, CASE WHEN len({_DONE}) = 0 THEN ['{advice.NO_ACTION}'] ELSE {_DONE} END AS a FROM made)""",
    *CTES,
    "made AS (SELECT * REPLACE (debt_to_equity * 3 AS debt_to_equity, interest_coverage / 8 AS interest_coverage), " + ", ".join(f"{e} AS {n}" for n, e in _MADE.items()) + " FROM training)",
)


def q_agency_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG-5, RNG-6: ranges of the agency's calibrated half-width, held against the actual rank, with their labels."""
    p = predictions(spark, sf_dir)
    curve = aggregates.coverage_curve(p.withColumn("deviation", F.col("predicted") - F.col("actual")), "agency", "deviation", WIDEST)
    policy = aggregates.smallest_halfwidth(curve, "agency", 0.75, WIDEST).select("agency", "halfwidth")
    power = aggregates.strength(aggregates.prediction_metrics(p, ["agency"], "predicted", "actual", "confidence", "company_id")).select("agency", "strength")
    earlier = F.count("*").over(Window.partitionBy("company_id")) > 1
    rows = p.withColumn("history", earlier).filter("predicted is not null").join(policy, "agency").join(power, "agency")
    lo, hi = F.greatest(F.lit(1), F.col("predicted") - F.col("halfwidth")), F.least(F.lit(19), F.col("predicted") + F.col("halfwidth"))
    rows = rows.withColumns({"lo": lo.cast("int"), "hi": hi.cast("int")}).withColumn("width", F.col("hi") - F.col("lo"))
    rows = rows.withColumn("usability", advice.usability(F.col("width"), F.col("confidence")))
    name = lambda c: F.get(F.array(*map(F.lit, LABELS)), F.col(c) - 1)
    same = F.col("event_id") % 5 != 0
    usable, sure, known = F.col("usability"), F.col("confidence"), F.col("history")
    out = rows.select(
        "event_id", "agency", F.when(F.col("lo") == F.col("hi"), name("lo")).otherwise(F.concat(name("lo"), F.lit(" to "), name("hi"))).alias("calibrated"), F.when(same, F.col("actual").between(F.col("lo"), F.col("hi"))).alias("hit"),
        usable.alias("usability"), advice.actionability(usable, sure, known).alias("actionability"), advice.review_priority(usable, sure, known).alias("review_priority"),
        advice.selection_priority(sure, advice.width_trust(F.col("width")), F.col("strength"), known).alias("selection_score"),
    )
    return r6(out, "selection_score")


_TRUST = "CASE " + " ".join(f"WHEN width <= {w} THEN {t}::DOUBLE" for w, t in advice.WIDTH_TRUST) + f" ELSE {advice.WIDEST_TRUST}::DOUBLE END"
_NAMES = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
AGENCY_RANGES_SQL = sql(
    f"""SELECT event_id, agency, CASE WHEN lo = hi THEN {_NAMES}[lo] ELSE {_NAMES}[lo] || ' to ' || {_NAMES}[hi] END AS calibrated, CASE WHEN event_id % 5 <> 0 THEN actual BETWEEN lo AND hi END AS hit, usability,
  CASE WHEN usability = 'focused' AND confidence >= 0.6 AND history THEN 'high' WHEN usability IN ('focused', 'workable') AND confidence >= 0.45 THEN 'medium' ELSE 'low' END AS actionability,
  CASE WHEN usability = 'directional_only' OR confidence < 0.4 THEN 'high' WHEN NOT history OR confidence < 0.55 THEN 'medium' ELSE 'low' END AS review_priority,
  round(least(1.0, greatest(0.0::DOUBLE, (confidence * 0.5::DOUBLE + {_TRUST} * 0.25::DOUBLE + strength * 0.25::DOUBLE) * CASE WHEN history THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)), 6) AS selection_score
FROM (SELECT *, hi - lo AS width, CASE WHEN hi - lo <= 5 AND confidence >= 0.55 THEN 'focused' WHEN hi - lo <= 11 AND confidence >= 0.4 THEN 'workable' ELSE 'directional_only' END AS usability
  FROM (SELECT p.*, greatest(1, predicted - halfwidth) AS lo, least(19, predicted + halfwidth) AS hi, strength FROM marked p JOIN policy USING (agency) JOIN power USING (agency) WHERE predicted IS NOT NULL))""",
    PRED,
    "marked AS (SELECT *, count(*) OVER (PARTITION BY company_id) > 1 AS history FROM predictions)",
    f"policy AS (SELECT agency, coalesce(min(h) FILTER (WHERE coverage >= 0.75), {WIDEST}) AS halfwidth FROM (SELECT agency, h, count(*) FILTER (WHERE abs(predicted - actual) <= h) / count(*) AS coverage FROM predictions, range({WIDEST + 1}) AS g(h) GROUP BY 1, 2) GROUP BY 1)",
    "power AS (SELECT agency, greatest(0.0::DOUBLE, least(1.0, 0.4::DOUBLE * w + 0.2::DOUBLE * e + 0.3::DOUBLE * n / max(n) OVER () + 0.1::DOUBLE)) AS strength FROM (SELECT agency, avg((predicted = actual)::INT) AS e, avg((abs(predicted - actual) <= 1)::INT) AS w, count(*) AS n FROM predictions GROUP BY 1))",
)


def q_rating_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-5: five financial changes since the company's prior rating, and since its agency's."""
    near = features.aligned(spark, sf_dir).filter("recency = 1").select("event_id", "company_id", "agency", "rating_date", "revenue_crore", *CHANGES)
    rows = near.withColumn("now", F.struct("revenue_crore", *CHANGES))
    for by, name in ((["company_id"], "any"), (["company_id", "agency"], "agency")):
        rows = joins.prior_value(rows, by, "rating_date", "event_id", "now", name)
    made = {}
    for name in ("any", "agency"):
        made[f"since_{name}_revenue_growth_pct"] = windows.growth_pct(F.col("revenue_crore"), F.col(f"{name}.revenue_crore"))
        made |= {f"since_{name}_{m}_change": F.col(m) - F.col(f"{name}.{m}") for m in CHANGES}
    return r6(rows.select("event_id", *(c.alias(n) for n, c in made.items())), *made)


def _changes_sql(side: str) -> str:
    growth = f"round((n.revenue_crore - {side}.revenue_crore) / nullif(abs({side}.revenue_crore), 0) * 100, 6) AS since_{side}_revenue_growth_pct"
    return ", ".join([growth, *(f"round(n.{m} - {side}.{m}, 6) AS since_{side}_{m}_change" for m in CHANGES)])


RATING_CHANGES_SQL = sql(
    f"""SELECT n.event_id, {_changes_sql("p").replace("since_p_", "since_any_")}, {_changes_sql("a").replace("since_a_", "since_agency_")} FROM linked l JOIN newest n ON l.event_id = n.event_id LEFT JOIN newest p ON l.any_id = p.event_id LEFT JOIN newest a ON l.agency_id = a.event_id""",
    features.WINDOW,
    "newest AS (SELECT * FROM history WHERE recency = 1)",
    """linked AS (SELECT x.event_id, arg_max(y.event_id, (y.rating_date, y.event_id)) AS any_id, arg_max(y.event_id, (y.rating_date, y.event_id)) FILTER (WHERE x.agency = y.agency) AS agency_id
  FROM newest x LEFT JOIN newest y ON x.company_id = y.company_id AND y.rating_date < x.rating_date GROUP BY 1)""",
)

QUERIES = {"advisory_notes": (q_advisory_notes, ADVISORY_NOTES_SQL), "rationale_reports": (q_rationale_reports, RATIONALE_REPORTS_SQL), "agency_ranges": (q_agency_ranges, AGENCY_RANGES_SQL), "rating_changes": (q_rating_changes, RATING_CHANGES_SQL)}
