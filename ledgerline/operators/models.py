"""Rating models per agency on extremely randomised trees: fits, scores, saved models with an index, importances, grouped validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import forests, ratings
from ledgerline.operators.forests import SEED, TREES
from ledgerline.session import materialise

TOP = 12
#: Companies of an agency up to which each is left out alone; with more they are dealt into FOLDS.
LEFT_OUT_ALONE, FOLDS = 12, 5
#: Training rows below which no rank regressor is trained in a validation.
REGRESSOR_ROWS = 8
_CLASSES = len(ratings.LONG_TERM)


def fit(rows: DataFrame, by: str, numeric: list[str], categorical: list[str], label: str, key: str, trees: int = TREES) -> DataFrame:
    """A table of models, one for each value of `by`, of all rows; `label` is a rank from 1."""
    samples = rows.select(F.col(by).cast("string").alias("model"), F.col(key).cast("string").alias("row_key"), F.col(label).cast("int").alias("label"), *forests.inputs(numeric, categorical))
    return materialise(forests.train(samples, len(numeric), _CLASSES, trees), "forest")


def score(rows: DataFrame, models: DataFrame, by: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """`rows` with the blended distribution, its likeliest rank and share, and the second likeliest rank (null without a model)."""
    out = forests.score(rows, models, by, numeric, categorical, _CLASSES)
    out = out.withColumn("shares", ratings.blended_distribution(F.col("shares"), F.col("rank_prediction")))
    ranked = F.transform(F.array_sort(F.transform("shares", lambda s, i: F.struct((-s).alias("s"), (i + 1).alias("rank")))), lambda x: x["rank"])
    out = out.withColumn("ranked", F.when(F.array_max("shares") > 0, ranked))
    return out.select(*rows.columns, F.col("ranked")[0].cast("int").alias("predicted_rank"), F.array_max("shares").alias("share"), F.col("ranked")[1].cast("int").alias("second_rank"))


def importances(models: DataFrame, by: str, numeric: list[str], categorical: list[str], top: int = TOP) -> DataFrame:
    """The classifier's largest importances of each model, by base feature; there is one row a feature."""
    order = Window.partitionBy("model").orderBy(F.col("importance").desc(), "base_feature")
    found = forests.importances(models, numeric, categorical).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return found.select(F.col("model").alias(by), "base_feature", "importance")


def save(models: DataFrame, path: str, marked: DataFrame, by: str, label: str) -> None:
    """Write models under a folder, one folder a model, and an index of them beside."""
    models.write.mode("overwrite").partitionBy("model").parquet(f"{path}/models")
    sizes = marked.groupBy(F.col(by).cast("string").alias(by)).agg(F.count("*").alias("n_rows"), F.countDistinct(label).alias("n_classes"))
    known = models.select(F.col("model").alias(by)).distinct()
    sizes.join(known, by).withColumn("path", F.concat(F.lit(f"{path}/models/model="), F.col(by))).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """(agency, n_rows, n_classes, path) of the models saved under a folder."""
    return spark.read.parquet(f"{path}/index")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table of the models saved under a folder."""
    return spark.read.parquet(f"{path}/models")


def fit_agencies(rows: DataFrame, by: str, numeric: list[str], categorical: list[str], label: str, key: str, trees: int = TREES, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows, those held out from their agency's model marked, and the models; with a path, models are saved."""
    marked = materialise(ratings.hold_out(rows, by, label, key), "marked")
    seen = marked.filter(~F.col("held_out"))
    models = fit(seen, by, numeric, categorical, label, key, trees)
    if path:
        save(models, path, seen, by, label)
    return marked, models


def per_agency(rows: DataFrame, by: str, numeric: list[str], categorical: list[str], label: str, key: str, trees: int = TREES, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of all rows, those held out from their agency's model marked, and importances by agency; with a path, models are saved."""
    marked, models = fit_agencies(rows, by, numeric, categorical, label, key, trees, path)
    return score(marked, models, by, numeric, categorical), importances(models, by, numeric, categorical)


def folded(rows: DataFrame, by: str, group: str) -> DataFrame:
    """Rows with `fold` and `mode`: which companies a model leaves out together.

    Up to LEFT_OUT_ALONE companies of an agency are folds of their own; more are dealt by a hash. An
    agency of one company is scored in sample, and says so.
    """
    companies = rows.select(by, group).distinct()
    sizes = companies.groupBy(by).agg(F.count("*").alias("_groups"))
    few = F.col("_groups") <= LEFT_OUT_ALONE
    #: Only the companies of small agencies are put in order.
    order = Window.partitionBy(by).orderBy(group)
    known = companies.join(F.broadcast(sizes), by)
    alone = known.filter(few).withColumn("fold", (F.row_number().over(order) - 1).cast("int"))
    dealt = known.filter(~few).withColumn("fold", F.pmod(F.xxhash64(group, F.lit(SEED)), F.lit(FOLDS)).cast("int"))
    mode = F.when(F.col("_groups") < 2, "in_sample_fallback_single_company").when(few, "leave_one_company_out").otherwise("grouped_folds")
    return rows.join(alone.unionByName(dealt).withColumn("mode", mode).drop("_groups"), [by, group])


def grouped_validation(rows: DataFrame, by: str, group: str, numeric: list[str], categorical: list[str], label: str, key: str, trees: int) -> DataFrame:
    """Every row predicted by a model of its agency that saw no row of its company: `fold`, `mode` and the scores.

    The folds' models are masks over all rows of each agency: every row goes to the models of all
    folds but its own in one shuffle, and all trees of all folds are grown in one job.
    """
    held = materialise(folded(rows, by, group), "folds")
    folds = held.groupBy(by).agg(F.array_sort(F.collect_set("fold")).alias("_folds"))
    known = held.join(F.broadcast(folds), by)
    others = F.filter("_folds", lambda f: (f != F.col("fold")) | F.col("mode").startswith("in_sample"))
    model = lambda fold: F.concat_ws("/", F.col(by), fold.cast("string"))
    samples = known.select("*", F.explode(others).alias("_fold")).select(model(F.col("_fold")).alias("model"), F.col(key).cast("string").alias("row_key"), F.col(label).cast("int").alias("label"), *forests.inputs(numeric, categorical))
    trained = materialise(forests.train(samples, len(numeric), _CLASSES, trees, REGRESSOR_ROWS), "fold-forest")
    return score(held.withColumn("_model", model(F.col("fold"))), trained, "_model", numeric, categorical).drop("_model")


def event_results(validated: DataFrame, label: str, numeric: list[str], depth: Column) -> DataFrame:
    """Each validated row with its deviation, hits, confidence and the range of its two likeliest labels."""
    name = lambda c: F.get(F.array(*map(F.lit, ratings.LONG_TERM)), c - 1)
    deviation = F.col("predicted_rank") - F.col(label)
    known = sum((F.col(c).isNotNull().cast("int") for c in numeric), F.lit(0)) / F.lit(max(1, len(numeric)))
    confidence = ratings.blended_confidence(F.col("share"), known, F.lit(0.0), F.least(depth / 4.0, F.lit(1.0)), F.lit(0.0))
    return validated.select(
        "*", name(F.col(label)).alias("actual_rating"), name(F.col("predicted_rank")).alias("predicted_rating"), F.concat_ws(" / ", name(F.col("predicted_rank")), name(F.col("second_rank"))).alias("rating_range"),
        deviation.alias("deviation"), F.coalesce(deviation == 0, F.lit(False)).alias("exact_match"), F.coalesce(F.abs(deviation) <= 1, F.lit(False)).alias("within_one_notch"),
        known.alias("data_completeness"), confidence.alias("confidence"), ratings.confidence_label(confidence).alias("confidence_label"),
    )


def diagnostics(results: DataFrame, by: str, group: str, date: str) -> tuple[DataFrame, DataFrame]:
    """Hits, mean error and mean confidence of event results: per agency with its mode, and per agency and company."""
    measures = [F.avg(F.col("exact_match").cast("int")).alias("exact_match_accuracy"), F.avg(F.col("within_one_notch").cast("int")).alias("within_one_notch_accuracy"), F.avg(F.abs("deviation")).alias("mean_abs_notch_error"), F.avg("confidence").alias("mean_confidence")]
    agencies = results.groupBy(by, "mode").agg(F.count("*").alias("rows_evaluated"), F.countDistinct(group).alias("companies_evaluated"), *measures)
    return agencies, results.groupBy(by, group).agg(F.count("*").alias("rows_evaluated"), *measures, F.max(date).alias("latest_rating_date"))


def learning_report(summary: DataFrame, weights: DataFrame, exclusions: DataFrame, by: str, lag_days: int) -> DataFrame:
    """(agency, line_no, line): a report of what each agency's model was tested on, how well, and what it looks at."""
    percent = lambda c: F.format_string("%.1f%%", 100 * F.col(c))
    first = F.array(
        F.format_string("Statements at least %d days before the rating.", F.lit(lag_days)),
        F.concat(F.lit("Evaluated by "), F.regexp_replace("mode", "_", " "), F.lit(": "), F.col("rows_evaluated").cast("string"), F.lit(" events of "), F.col("companies_evaluated").cast("string"), F.lit(" companies.")),
        F.concat(F.lit("Exact "), percent("exact_match_accuracy"), F.lit(", within one notch "), percent("within_one_notch_accuracy"), F.lit(".")),
    )
    reasons = exclusions.groupBy(by, "reason").agg(F.count("*").alias("n")).groupBy(by).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "reason", F.col("n").cast("string")))).alias("reasons"))
    looks = weights.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "base_feature"))).alias("looks"))
    joined = summary.join(reasons, by, "left").join(looks, by, "left")
    lines = F.concat(first, F.transform(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: F.concat(F.lit("Excluded, "), r, F.lit("."))), F.array(F.concat(F.lit("Looks most at "), F.array_join(F.transform(F.slice("looks", 1, 5), lambda x: x["base_feature"]), ", "), F.lit("."))))
    return joined.select(by, F.posexplode(lines).alias("line_no", "line"))
