"""Queries on rating texts, document kinds, validation summaries and score blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import ratings
from ledgerline.operators.ratings import LONG_TERM, SHORT_TERM, SHORT_TERM_ALIASES
from ledgerline.plans import panel
from ledgerline.plans.features import r6
from ledgerline.plans.mart_queries import PRED, predictions
from ledgerline.plans.panel import sql
from ledgerline.session import table

_SHORT_FORMS = (*SHORT_TERM, *SHORT_TERM_ALIASES)
_MOODS = ("Stable", "positive", "Negative", "developing", "", "rating watch")
_DONE = ("reaffirmed", "Upgraded", "downgraded", "assigned", "")


def _pick(words: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def rating_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating events with the text a rationale would state, and the event's predecessor's text."""
    e, k = panel.rating_events(spark, sf_dir), F.col("event_id")
    label = F.when(F.col("scale_type") == "short_term", _pick(_SHORT_FORMS, k)).otherwise(F.get(F.array(*map(F.lit, LONG_TERM)), F.col("rating_rank") - 1))
    state = F.when(F.col("withdrawn"), " ; withdrawn").when(F.col("not_cooperating"), " issuer not  cooperating").when(k % 11 == 0, " best available information").otherwise("")
    text = F.concat(F.lit("["), F.upper("agency"), F.lit("] "), F.coalesce(label, F.lit("")), F.lit(" ("), _pick(_MOODS, k), F.lit(") "), _pick(_DONE, k), state)
    order = [F.col("rating_date").asc_nulls_first(), F.col("event_id")]
    before = F.lag("rating_text").over(Window.partitionBy("company_id", "agency").orderBy(*order))
    return e.select("event_id", "company_id", "agency", "rating_date", "scale_type", text.alias("rating_text")).withColumn("previous_text", before)


def _rating_sql(c: str) -> dict[str, str]:
    clean = f"trim(regexp_replace(upper(coalesce({c}, '')), '[\\[\\]();,\\s]+', ' ', 'g'))"
    token = lambda words: f"nullif(regexp_extract({clean}, '(?:^|[^A-Z0-9])({ratings.alternatives(words)})(?:[^A-Z0-9]|$)', 1), '')"
    word = lambda words: f"nullif(regexp_extract({clean}, '\\b({'|'.join(words)})\\b', 1), '')"
    title = lambda x: f"upper({x}[1]) || lower({x}[2:])"
    long, raw = token(LONG_TERM), token(_SHORT_FORMS)
    short = "CASE " + raw + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SHORT_TERM_ALIASES.items()) + f" ELSE {raw} END"
    return {
        "scale": f"CASE WHEN {long} IS NOT NULL THEN 'long_term' WHEN {raw} IS NOT NULL THEN 'short_term' END", "label": f"coalesce({long}, {short})",
        "rank": f"coalesce(list_position({_list(LONG_TERM)}, {long}), list_position({_list(SHORT_TERM)}, {short}))", "outlook": title(word(ratings.OUTLOOKS)), "watch": title(word(ratings.WATCHES)),
        **{s: f"regexp_matches({clean}, '\\b{w}\\b')" for s, w in ratings.STATES.items()},
    }


TEXTS = f"""texts AS (SELECT event_id, company_id, agency, rating_date, scale_type, '[' || upper(agency) || '] ' || coalesce(CASE WHEN scale_type = 'short_term' THEN {_list(_SHORT_FORMS)}[event_id % {len(_SHORT_FORMS)} + 1] ELSE {_list(LONG_TERM)}[rating_rank] END, '')
  || ' (' || {_list(_MOODS)}[event_id % {len(_MOODS)} + 1] || ') ' || {_list(_DONE)}[event_id % {len(_DONE)} + 1] || CASE WHEN withdrawn THEN ' ; withdrawn' WHEN not_cooperating THEN ' issuer not  cooperating' WHEN event_id % 11 = 0 THEN ' best available information' ELSE '' END AS rating_text FROM rating_events),
chained AS (SELECT *, lag(rating_text) OVER w AS previous_text, row_number() OVER w AS number FROM texts WINDOW w AS (PARTITION BY company_id, agency ORDER BY rating_date NULLS FIRST, event_id))"""


def q_rating_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-9, TXT-13: scale, label, rank, outlook, watch and states of each rating text."""
    return rating_texts(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in ratings.rating_columns(F.col("rating_text")).items()))


RATING_LABELS_SQL = sql("SELECT event_id, " + ", ".join(f"{c} AS {n}" for n, c in _rating_sql("rating_text").items()) + " FROM texts", TEXTS)


def q_rating_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-12: one record per rating text, with its number under company and agency and the rank's fallback."""
    out = ratings.rating_records(rating_texts(spark, sf_dir), ["company_id", "agency"], ["rating_date", "event_id"], "rating_text", "previous_text", "scale_type")
    return out.drop("rating_date", "scale_type")


_NOW, _BEFORE = _rating_sql("rating_text"), _rating_sql("previous_text")
RATING_RECORDS_SQL = sql(
    f"""SELECT event_id, company_id, agency, rating_text, previous_text, concat_ws('__', company_id::VARCHAR, agency, scale_type, printf('%02d', number)) AS record_id, {_NOW["scale"]} AS scale, {_NOW["label"]} AS label, {_NOW["outlook"]} AS outlook,
  coalesce({_NOW["rank"]}, {_BEFORE["rank"]}) AS rank, CASE WHEN withdrawn_text AND done = '' THEN 'Withdrawn' WHEN done <> '' THEN upper(done[1]) || lower(done[2:]) END AS action, {_NOW["is_withdrawn"]} AS is_withdrawn,
  {_NOW["is_issuer_not_cooperating"]} OR {_NOW["is_best_available_information"]} AS is_not_cooperating
FROM (SELECT *, {_list(_DONE)}[event_id % {len(_DONE)} + 1] AS done, contains(rating_text, 'withdrawn') AS withdrawn_text FROM chained)""",
    TEXTS,
)

#: Words that occur in the supplied texts stand in for the lexicons of rating documents.
_AGENCY_WORDS = {"first": ("schen", "ungs"), "second": ("the ", "and "), "third": ("que ", " la ")}
_KIND_WORDS = {"press_release": ("@",), "rating_rationale": ("http",)}
_PLATFORM_WORDS = {"Mail": ("@",), "Web": ("http", "www"), "Licence": ("license",)}


def q_document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-1, TXT-2, TXT-18: agency and kind by a document's head, platforms by all of it."""
    head = F.concat_ws(" ", "source", F.substring("text", 1, ratings.HEAD))
    platforms = ratings.all_labels(F.col("text"), _PLATFORM_WORDS)
    strength = F.when(F.size(platforms) > 0, "high").when(F.lower("text").contains("copyright"), "medium").otherwise("low")
    return table(spark, sf_dir, "documents").select("doc_id", ratings.first_label(head, _AGENCY_WORDS).alias("agency"), ratings.first_label(F.substring("text", 1, ratings.HEAD), _KIND_WORDS, ratings.OTHER_KIND).alias("kind"), F.array_join(platforms, ",").alias("platforms"), strength.alias("strength"))


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _first_sql(c: str, words: dict, default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {_any(c, some)} THEN '{label}'" for label, some in words.items()) + (f" ELSE '{default}' END" if default else " END")


DOCUMENT_KINDS_SQL = f"""
WITH lowered AS (SELECT doc_id, lower(concat_ws(' ', source, substring(text, 1, {ratings.HEAD}))) AS head, lower(substring(coalesce(text, ''), 1, {ratings.HEAD})) AS top, lower(coalesce(text, '')) AS body FROM documents),
found AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {_any('body', some)} THEN '{label}' END" for label, some in _PLATFORM_WORDS.items())}) AS platforms FROM lowered)
SELECT doc_id, {_first_sql("head", _AGENCY_WORDS, None)} AS agency, {_first_sql("top", _KIND_WORDS, ratings.OTHER_KIND)} AS kind, platforms, CASE WHEN platforms <> '' THEN 'high' WHEN contains(body, 'copyright') THEN 'medium' ELSE 'low' END AS strength FROM found"""


def q_parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-19: what each document lacks, one row a message."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return ratings.parse_messages(table(spark, sf_dir, "documents"), "doc_id", {"Missing text.": blank, "Missing language.": F.col("lang").isNull(), "No number extracted from the document.": ~blank & ~F.col("text").rlike("[0-9]")})


PARSE_MESSAGES_SQL = """
WITH d AS (SELECT doc_id, lang, text, coalesce(trim(text, ' '), '') = '' AS blank FROM documents)
SELECT doc_id, 'Missing text.' AS message FROM d WHERE blank UNION ALL SELECT doc_id, 'Missing language.' FROM d WHERE lang IS NULL
UNION ALL SELECT doc_id, 'No number extracted from the document.' FROM d WHERE NOT blank AND NOT regexp_matches(text, '[0-9]')"""


def q_company_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: validation summary of each agency's companies."""
    dates = panel.rating_events(spark, sf_dir).select("event_id", "rating_date")
    return ratings.company_validation(predictions(spark, sf_dir).join(dates, "event_id"), ["agency", "company_id"])


#: The small addend makes halves round up by their decimal digits, as Spark's round does.
COMPANY_VALIDATION_SQL = sql(
    """SELECT agency, company_id, count(event_id) AS events_evaluated, round(avg((error = 0)::INT) + 1e-12, 4) AS exact_match_rate, round(avg((error <= 1)::INT) + 1e-12, 4) AS within_one_notch_rate, round(avg(error) + 1e-12, 4) AS mean_abs_notch_error,
  round(sum(confidence::DECIMAL(18,9))::DOUBLE / count(confidence) + 1e-12, 4) AS average_confidence, max(rating_date) AS latest_rating_date
FROM (SELECT p.*, abs(predicted - actual) AS error, e.rating_date FROM predictions p JOIN rating_events e ON p.event_id = e.event_id) GROUP BY 1, 2""",
    PRED,
)


def q_extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: extraction status and first messages of each company."""
    e = panel.rating_events(spark, sf_dir)
    message = F.when(F.col("rating_rank").isNull(), F.concat(F.lit("no rating in event "), F.col("event_id").cast("string")))
    return ratings.extraction_status(e, "company_id", F.col("rating_rank").isNotNull(), message, "event_id")


EXTRACTION_STATUS_SQL = sql("""
SELECT company_id, count(*) AS n_found, count(rating_rank) AS n_resolved, coalesce(string_agg('no rating in event ' || event_id, ' | ' ORDER BY event_id) FILTER (WHERE rating_rank IS NULL AND n <= 5), '') AS notes,
  CASE WHEN count(rating_rank) = 0 THEN 'rating_extraction_failed' WHEN count(rating_rank) < count(*) THEN 'rating_history_partial' ELSE 'rating_history_extracted' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, rating_rank IS NULL ORDER BY event_id) AS n FROM rating_events) GROUP BY 1""")


def q_score_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-6, ML-10: blended distribution's likeliest rank, and the blended confidence with its label."""
    p = predictions(spark, sf_dir)
    sure = F.transform(F.sequence(F.lit(1), F.lit(len(LONG_TERM))), lambda r: F.when(r == F.col("actual"), F.col("top_probability")).otherwise((1 - F.col("top_probability")) / (len(LONG_TERM) - 1)))
    shares = ratings.blended_distribution(sure, F.col("predicted").cast("double"))
    score = ratings.blended_confidence(F.col("top_probability"), F.col("confidence"), (F.col("event_id") % 3) / 2.0, (F.col("event_id") % 5) / 4.0, (F.col("event_id") % 2).cast("double"))
    p = p.select("event_id", score.alias("score"), shares.alias("shares"))
    p = p.select("event_id", "score", "shares", F.array_max("shares").alias("share"))
    out = p.select("event_id", F.array_position(F.transform("shares", lambda s: F.round(s, 4)), F.round("share", 4)).cast("int").alias("likeliest"), "share", "score")
    return r6(out, "share", "score").withColumn("sureness", ratings.confidence_label(F.col("score")))


_N = len(LONG_TERM)
_BELL = f"list_transform(range(1, {_N + 1}), lambda r: exp(-((predicted - r) * (predicted - r)) / {2 * ratings.RANK_SPREAD**2}::DOUBLE))"
SCORE_BLENDS_SQL = sql(
    "SELECT event_id, list_position(list_transform(shares, lambda s: round(s, 4)), round(list_max(shares), 4))::INT AS likeliest, round(list_max(shares), 6) AS share, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS sureness FROM mixed",
    PRED,
    f"""parts AS (SELECT *, list_transform(range(1, {_N + 1}), lambda r: CASE WHEN r = actual THEN top_probability ELSE (1 - top_probability) / {_N - 1} END) AS sure, {_BELL} AS bell FROM predictions),
mixed AS (SELECT *, CASE WHEN predicted IS NULL THEN sure ELSE list_transform(range(1, {_N + 1}), lambda i: {ratings.CLASSIFIER_SHARE}::DOUBLE * sure[i] + {1 - ratings.CLASSIFIER_SHARE}::DOUBLE * bell[i] / list_sum(bell)) END AS shares,
  greatest(0.05, least(0.99, round(0.42::DOUBLE * top_probability + 0.2::DOUBLE * confidence + 0.1::DOUBLE * ((event_id % 3) / 2.0::DOUBLE) + 0.13::DOUBLE * ((event_id % 5) / 4.0::DOUBLE) + 0.15::DOUBLE * (event_id % 2), 6)))::DOUBLE AS score FROM parts)""",
)


def q_evaluation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-7: sizes of the stratified hold-out of each agency and label."""
    rows = predictions(spark, sf_dir).select("event_id", "agency", "actual")
    out = ratings.hold_out(rows, "agency", "actual", "event_id")
    return out.groupBy("agency", "actual").agg(F.count("*").alias("n_rows"), F.sum(F.col("held_out").cast("int")).alias("n_held_out"))


EVALUATION_SPLIT_SQL = sql(
    """SELECT agency, actual, n_rows, CASE WHEN sum(n_rows) OVER w >= 10 AND min(n_rows) OVER w >= 2 THEN ceil(n_rows / 4)::BIGINT ELSE 0 END AS n_held_out
FROM (SELECT agency, actual, count(*) AS n_rows FROM predictions GROUP BY 1, 2) WINDOW w AS (PARTITION BY agency)""",
    PRED,
)


def q_simulation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG-8: the notes of each simulated rating."""
    k, rank = F.col("event_id"), F.col("predicted").cast("string")
    notes = ratings.simulation_notes(F.col("agency"), F.when(k % 3 != 0, rank), F.when(k % 5 != 0, "usable"), F.when(F.col("confidence") < 0.5, "high"), F.when(k % 4 == 0, F.concat(F.lit("actual "), F.col("actual").cast("string"))), k % 3 == 0, F.when(k % 2 == 0, "Low confidence."), rank)
    return predictions(spark, sf_dir).select("event_id", F.array_join(notes, " ").alias("notes"))


SIMULATION_NOTES_SQL = sql(
    """SELECT event_id, concat_ws(' ', 'Selected agency: ' || agency || '.', 'Published range: ' || coalesce(CASE WHEN event_id % 3 <> 0 THEN predicted::VARCHAR END, 'manual review required') || '.', 'Range usability: ' || CASE WHEN event_id % 5 <> 0 THEN 'usable' ELSE 'unknown' END || '.',
  'CA review priority: ' || CASE WHEN confidence < 0.5 THEN 'high' ELSE 'unknown' END || '.', CASE WHEN event_id % 4 = 0 THEN 'Rating history context: actual ' || actual || '.' END,
  CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'Low confidence.' ELSE 'Narrow publishable range could not be supported confidently.' END END, CASE WHEN event_id % 3 = 0 THEN 'Internal benchmark-only calibrated band: ' || predicted::VARCHAR || '.' END) AS notes FROM predictions""",
    PRED,
)

QUERIES = {
    "rating_labels": (q_rating_labels, RATING_LABELS_SQL), "rating_records": (q_rating_records, RATING_RECORDS_SQL), "document_kinds": (q_document_kinds, DOCUMENT_KINDS_SQL), "parse_messages": (q_parse_messages, PARSE_MESSAGES_SQL),
    "company_validation": (q_company_validation, COMPANY_VALIDATION_SQL), "extraction_status": (q_extraction_status, EXTRACTION_STATUS_SQL), "score_blends": (q_score_blends, SCORE_BLENDS_SQL), "evaluation_split": (q_evaluation_split, EVALUATION_SPLIT_SQL), "simulation_notes": (q_simulation_notes, SIMULATION_NOTES_SQL),
}
