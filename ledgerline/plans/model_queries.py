"""Queries that train rating models on the credit panel; trained, so without SQL, but for the rows that no model can use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import filters, models, order_stats, ratings
from ledgerline.operators.ratings import LONG_TERM
from ledgerline.plans import features, panel
from ledgerline.plans.features import q_rating_features
from ledgerline.plans.panel import sql
from ledgerline.session import materialise, scratch

_KEYS = ("event_id", "company_id", "agency", "rating_date", "matched_period", "rating_rank")
_LABEL = "rating_rank"
CATEGORICAL = ["sub_industry"]
#: Trees of a fold's model; the published models have models.TREES.
FOLD_TREES = 100
#: Parts of the rows below the edges of the label's bands.
EDGES = (0.15, 0.3, 0.45, 0.6, 0.75, 0.9)
#: Columns that the label is made from: they are no features.
HIDDEN = "debt_to_equity"


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Training rows and their numeric features. The label is `learnable`."""
    wide = q_rating_features(spark, sf_dir)
    wide = wide.withColumns({c: F.col(c).cast("double") for c in ("prior_rank", "prior_agency_rank")})
    numeric = [c for c, t in wide.dtypes if t == "double" and not c.startswith(HIDDEN)]
    industry = panel.companies(spark, sf_dir).select("company_id", *CATEGORICAL)
    rows = materialise(wide.select(*_KEYS, "depth", *numeric, HIDDEN, f"{HIDDEN}_delta1y").join(industry, "company_id", "left"), "model-rows")
    return learnable(rows).drop(HIDDEN, f"{HIDDEN}_delta1y"), numeric


def learnable(rows: DataFrame) -> DataFrame:
    """The rows with a label that features can tell in part: the band of a debt to equity that the features don't hold, with seeded noise.

    The panel's own ranks are arithmetic in the key: nothing can be learned from them. The bands'
    edges are those of the rows that the hold-out leaves for training by their own ranks, each the
    value that holds its exact place among all of them.
    """
    seen = ratings.hold_out(rows, "agency", _LABEL, "event_id").filter(~F.col("held_out"))
    ranked = order_stats.ranked_values(order_stats.melted(seen, [], [HIDDEN]), ["metric"])
    place = lambda q: F.ceil(F.col("total") * F.lit(q))
    found = ranked.agg(*(F.min(F.when(F.col("upto") >= place(q), F.col("value"))) for q in EDGES)).first()
    cuts = [c for c in found if c is not None]
    band = sum(((F.col(HIDDEN) > c).cast("int") for c in cuts), F.lit(5))
    #: One row in eight is a notch off.
    noise = F.when(F.pmod(F.xxhash64("event_id"), F.lit(8)) == 0, 1).otherwise(0)
    worse = F.coalesce((F.col(f"{HIDDEN}_delta1y") > 0).cast("int"), F.lit(0))
    return rows.filter(F.col(HIDDEN).isNotNull()).withColumn(_LABEL, (band + worse + noise).cast("int"))


_done: dict[tuple, tuple] = {}


def _once(spark: SparkSession, rows: DataFrame, what: str, make) -> tuple:
    """What `make` gives for these rows, kept for the session under a digest of the rows, so that changed tables are fitted anew."""
    digest = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, what, *digest)
    if key not in _done:
        _done[key] = make()
    return _done[key]


_Rows = tuple[DataFrame, list[str]]


def _fitted(spark: SparkSession, sf_dir: str, given: _Rows | None = None) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """Where the models of a folder are saved, its rows with those held out marked, the models and their importances: one fit serves the queries.

    given: what `_rows` returned, where the caller has it.
    """
    rows, numeric = given or _rows(spark, sf_dir)

    def make():
        path = f"{scratch(spark)}/models-{uuid.uuid4().hex}"
        marked, fitted = models.fit_agencies(rows, "agency", numeric, CATEGORICAL, _LABEL, "event_id", models.TREES, path)
        return path, marked, fitted, materialise(models.importances(fitted, "agency", numeric, CATEGORICAL), "importances")

    return _once(spark, rows, "models", make)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all rows; only the query that shows them scores any."""
    rows, numeric = _rows(spark, sf_dir)
    _, marked, fitted, _ = _fitted(spark, sf_dir, (rows, numeric))
    return _once(spark, rows, "scores", lambda: (materialise(models.score(marked, fitted, "agency", numeric, CATEGORICAL), "scores"),))[0]


def _validated(spark: SparkSession, sf_dir: str, given: _Rows | None = None) -> DataFrame:
    rows, numeric = given or _rows(spark, sf_dir)

    def make():
        found = models.grouped_validation(rows, "agency", "company_id", numeric, CATEGORICAL, _LABEL, "event_id", FOLD_TREES)
        return (materialise(models.event_results(found, _LABEL, numeric, F.col("depth")), "validated"),)

    return _once(spark, rows, "validation", make)[0]


def q_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-2..7, ML-9: every eligible event scored by its agency's model: the range of its two likeliest labels, its error, confidence and a snapshot of features."""
    scores = _scored(spark, sf_dir)
    numeric = [c for c, t in scores.dtypes if t == "double" and c != "share"]
    name = lambda c: F.get(F.array(*map(F.lit, LONG_TERM)), c - 1)
    lo, hi = F.least("predicted_rank", "second_rank"), F.greatest("predicted_rank", "second_rank")
    known = sum((F.col(c).isNotNull().cast("int") for c in numeric), F.lit(0)) / len(numeric)
    sure = ratings.blended_confidence(F.col("share"), known, F.lit(0.0), F.least(F.col("depth") / 4.0, F.lit(1.0)), F.lit(0.0))
    return scores.select(
        *(k for k in _KEYS if k not in ("rating_date", "matched_period")), "held_out", "predicted_rank", F.round("share", 6).alias("share"), F.concat(name(lo), F.lit(" to "), name(hi)).alias("top_two"), (F.col("predicted_rank") - F.col(_LABEL)).alias("deviation"),
        F.round(sure, 6).alias("confidence"), ratings.confidence_label(sure).alias("confidence_label"), F.to_json(F.struct("depth", "matched_period", "revenue_crore", "revenue_crore_slope3y", "peer_revenue_pctile", "prior_rank")).alias("snapshot"),
    )


def q_model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: the largest importances of each agency's model, by base feature."""
    return _fitted(spark, sf_dir)[3].withColumn("importance", F.round("importance", 6))


def q_model_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-13: the saved models with their rows and classes."""
    index = models.load_index(spark, _fitted(spark, sf_dir)[0])
    return index.select("agency", "n_rows", "n_classes", F.col("path").endswith(F.concat(F.lit("="), F.col("agency"))).alias("saved"))


def q_grouped_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-8, ML-15: every agency's hits on companies that its model has not seen, for a label that can be learned."""
    return models.diagnostics(_validated(spark, sf_dir), "agency", "company_id", "rating_date")[0]


def q_validation_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-15: the same by company."""
    return models.diagnostics(_validated(spark, sf_dir), "agency", "company_id", "rating_date")[1]


def q_validation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-15: the same by event, with range, deviation and confidence."""
    found = _validated(spark, sf_dir).withColumn("days_from_period", F.datediff("rating_date", "matched_period"))
    columns = ("event_id", "company_id", "agency", "fold", "mode", "rating_date", "matched_period", "days_from_period", "actual_rating", "predicted_rating", "rating_range", "deviation", "exact_match", "within_one_notch", "confidence", "confidence_label")
    return found.select(*columns, F.round("share", 4).alias("top_probability"), F.round("data_completeness", 4).alias("data_completeness"))


def exclusions(spark: SparkSession, sf_dir: str, lag_days: int = features.LAG_DAYS) -> DataFrame:
    """(event_id, company_id, agency, reason) of the events that give no training row."""
    events = panel.rating_events(spark, sf_dir).withColumn("status", filters.eligibility())
    used = features.aligned(spark, sf_dir, lag_days).select("event_id").distinct().withColumn("used", F.lit(True))
    found = events.join(used, "event_id", "left").filter("used is null")
    reason = F.when(F.col("status") != "eligible", F.col("status")).otherwise(f"missing_{lag_days}d_financial_alignment")
    return found.select("event_id", "company_id", "agency", reason.alias("reason"))


def q_training_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-15: events that the lagged training set leaves out, and why."""
    return exclusions(spark, sf_dir)


TRAINING_EXCLUSIONS_SQL = sql(
    f"""SELECT event_id, company_id, agency, CASE WHEN scale_type <> 'long_term' THEN 'non_long_term_rating' WHEN rating_rank IS NULL THEN 'missing_rating_label' WHEN withdrawn THEN 'withdrawn'
  WHEN not_cooperating THEN 'issuer_not_cooperating' WHEN rating_date IS NULL THEN 'missing_rating_date' ELSE 'missing_{features.LAG_DAYS}d_financial_alignment' END AS reason
FROM rating_events WHERE event_id NOT IN (SELECT event_id FROM history)""",
    features.WINDOW,
)


def q_learning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-15: each agency's report on the validation, the exclusions and what its model looks at."""
    given = _rows(spark, sf_dir)
    hits = models.diagnostics(_validated(spark, sf_dir, given), "agency", "company_id", "rating_date")[0]
    return models.learning_report(hits, _fitted(spark, sf_dir, given)[3], exclusions(spark, sf_dir), "agency", features.LAG_DAYS)


QUERIES = {
    "model_scores": (q_model_scores, None), "model_importances": (q_model_importances, None), "model_index": (q_model_index, None), "grouped_validation": (q_grouped_validation, None),
    "validation_events": (q_validation_events, None), "validation_companies": (q_validation_companies, None), "training_exclusions": (q_training_exclusions, TRAINING_EXCLUSIONS_SQL), "learning_report": (q_learning_report, None),
}
