"""Queries on text tables, name matching and the incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import names, texts
from ledgerline.plans.features import r6
from ledgerline.session import materialise, scratch, table
from ledgerline.streaming import ingest

# Keywords of a good and of a bad outlook.
POSITIVE = ("growth", "demand", "tailwind", "expansion", "capacity addition", "opportunity", "recovery", "supportive", "favorable", "export demand")
NEGATIVE = ("slowdown", "pressure", "regulatory risk", "volatility", "oversupply", "decline", "weak demand", "disruption", "ban", "inflation")


def _hits_sql(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in words) + ")"


def q_adverse_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: adverse hits and risk score of each conversation, a turn being a mention."""
    return r6(texts.adverse_scores(table(spark, sf_dir, "conversations"), "conv_id", F.col("text")), "public_risk_score")


ADVERSE_MENTIONS_SQL = f"""
WITH hits AS (SELECT conv_id, {", ".join(f"{_hits_sql(w)} AS {g}" for g, w in texts.ADVERSE.items())}, {_hits_sql(texts.PEOPLE)} > 0 AS people FROM conversations),
marked AS (SELECT *, {" + ".join(texts.ADVERSE)} > 0 AS bad FROM hits),
sums AS (SELECT conv_id, {", ".join(f"sum({g})::BIGINT AS {g}" for g in texts.ADVERSE)}, sum((bad AND people)::INT)::BIGINT AS promoter_adverse_hits, sum(bad::INT)::BIGINT AS public_negative_news_hits FROM marked GROUP BY 1),
scored AS (SELECT *, least(10.0::DOUBLE, {" + ".join(f"{c} * {w}::DOUBLE" for c, w in texts.ADVERSE_WEIGHTS.items())}) AS score FROM sums)
SELECT * EXCLUDE (score), round(score, 6) AS public_risk_score, score >= 4 AS public_risk_flag FROM scored"""


def q_outlook_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: outlook of each source and its first five documents."""
    out = texts.outlook_scores(table(spark, sf_dir, "documents"), "source", "doc_id", "text", POSITIVE, NEGATIVE)
    return out.withColumn("mentions", F.array_join(F.col("mentions").cast("array<string>"), ","))


OUTLOOK_SCORES_SQL = f"""
WITH hits AS (SELECT source, doc_id, {_hits_sql(POSITIVE)} - {_hits_sql(NEGATIVE)} AS hit, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source, greatest(-5, least(5, sum(hit)))::DOUBLE AS outlook, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE n <= 5) AS mentions FROM hits GROUP BY 1"""

_FLAGS = {"has_address": texts.EMAIL, "has_number": "[0-9]{3,}", "has_markup": "<[a-z]+>", "has_link": "https?://"}


def q_signal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4, TXT-4: how often each signal occurs in each language's documents."""
    d = table(spark, sf_dir, "documents")
    flags = d.select("lang", *(F.coalesce(F.col("text").rlike(p), F.lit(False)).alias(f) for f, p in _FLAGS.items()))
    return r6(texts.signal_rates(flags, "lang", list(_FLAGS)), "rate")


SIGNAL_RATES_SQL = " UNION ALL ".join(f"SELECT lang, '{f}' AS signal, sum(s)::BIGINT AS mentions, round(avg(s), 6) AS rate FROM (SELECT lang, coalesce(regexp_matches(text, '{p}'), false)::INT AS s FROM documents) GROUP BY 1 HAVING sum(s) > 0" for f, p in _FLAGS.items())


def q_top_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5, TXT-6: the ten commonest longer words of each language."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{5,}"), F.lit(0))
    return texts.top_phrases(table(spark, sf_dir, "documents"), "lang", words)


TOP_PHRASES_SQL = """
SELECT lang, phrase, count(*) AS mentions, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, phrase)::INT AS place
FROM (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}')) AS phrase FROM documents) GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, phrase) <= 10"""

_START, _END = "^[AEIOU]", "^[SZ]"


def q_line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11, TXT-3, TXT-11: lines grouped into records by start and end markers."""
    out = texts.line_groups(table(spark, sf_dir, "documents"), "doc_id", "text", _START, _END)
    return out.select("doc_id", "record", "n_lines", F.md5(F.col("body").cast("binary")).alias("body_md5"))


LINE_RECORDS_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM cut),
marks AS (SELECT *, regexp_matches(line, '{_START}') AS s, regexp_matches(line, '{_END}') AND NOT regexp_matches(line, '{_START}') AS e FROM lines),
runs AS (SELECT *, sum(s::INT) OVER w AS record, sum(e::INT) OVER w AS closed FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
inside AS (SELECT * FROM runs WHERE record > 0 QUALIFY closed = min(closed) OVER (PARTITION BY doc_id, record))
SELECT doc_id, record::BIGINT AS record, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS body_md5 FROM inside GROUP BY 1, 2"""


def q_contact_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-15: at most two e-mail addresses of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(texts.emails(F.col("text")), ";").alias("emails"))


CONTACT_POINTS_SQL = f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{texts.EMAIL}') AS l FROM documents),
found AS (SELECT doc_id, lower(unnest(l)) AS e, unnest(range(len(l))) AS pos FROM cut),
ranked AS (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS n FROM found GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(e, ';' ORDER BY n) FILTER (WHERE n <= 2), '') AS emails FROM documents d LEFT JOIN ranked r ON d.doc_id = r.doc_id GROUP BY 1"""


def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-16: the first twenty distinct links of each page."""
    return texts.links(table(spark, sf_dir, "pages"), "page_id", "url", "html")


PAGE_LINKS_SQL = f"""
WITH cut AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host, regexp_extract_all(coalesce(html, ''), '{texts.LINK}', 1) AS l FROM pages),
found AS (SELECT page_id, host, unnest(l) AS x, unnest(range(len(l))) AS pos FROM cut),
ranked AS (SELECT page_id, CASE WHEN starts_with(x, '/') THEN host || x ELSE x END AS link, min(pos) AS pos FROM found GROUP BY 1, 2)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS place, link FROM ranked QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 20"""


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct()


def q_name_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15: the best part name for each name with its type, and how sure it is."""
    known = _part_names(spark, sf_dir)
    asked = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("asked")).distinct()
    pairs = names.token_pairs(asked, "asked", "asked", known, "p_name", "p_name")
    out = names.decide(asked, "asked", pairs.withColumn("score", names.name_score()), 0.75, 0.05)
    return r6(out, "score", "second")


NAME_DECISIONS_SQL = """
WITH known AS (SELECT DISTINCT p_name AS k_id FROM part), asked AS (SELECT DISTINCT concat_ws(' ', p_name, p_type) AS q_id FROM part),
prepared AS (SELECT 'q' AS side, q_id AS id, trim(regexp_replace(lower(replace(q_id, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) AS name FROM asked
  UNION ALL SELECT 'k', k_id, trim(regexp_replace(lower(replace(k_id, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) FROM known),
worded AS (SELECT *, list_distinct(list_filter(string_split(name, ' '), lambda x: x <> '' AND x NOT IN ('limited', 'ltd', 'private', 'pvt', 'company', 'co', 'corporation', 'corp', 'incorporated', 'inc', 'llp', 'plc', 'the'))) AS words FROM prepared),
pairs AS (SELECT q.id AS q_id, k.id AS k_id, q.name AS qn, k.name AS kn, len(q.words) AS nq, len(k.words) AS nk, len(list_intersect(q.words, k.words)) AS shared
  FROM worded q JOIN worded k ON q.side = 'q' AND k.side = 'k' AND list_has_any(q.words, k.words)),
scored AS (SELECT *, CASE WHEN qn = kn THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 0.7::DOUBLE * shared / nq + 0.3::DOUBLE * shared / nk + CASE WHEN starts_with(kn, qn) OR starts_with(qn, kn) THEN 0.1::DOUBLE ELSE 0 END), 4) END AS score FROM pairs),
ranked AS (SELECT q_id, k_id, score, lead(score, 1, 0) OVER w AS second, row_number() OVER w AS n FROM scored WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, k_id))
SELECT a.q_id, k_id, round(score, 6) AS score, round(second, 6) AS second, CASE WHEN score IS NULL THEN 'no_results' WHEN score >= 0.75 AND round(score - second, 6) >= 0.05 THEN 'matched' ELSE 'ambiguous' END AS status
FROM asked a LEFT JOIN ranked r ON a.q_id = r.q_id AND n = 1"""


def q_candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14: part names with a common word, in the order of JOIN-15's score, decided for each name with its type."""
    known = _part_names(spark, sf_dir)
    asked = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("asked")).distinct()
    pairs = names.token_pairs(asked, "asked", "asked", known, "p_name", "p_name")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(names.name_score().desc(), "k_id"))
    scored = names.candidate_scores(pairs.select(F.col("q_id").alias("asked"), F.col("k_id").alias("p_name"), place.alias("rank")), "asked", "p_name", "rank")
    return names.decide_candidates(asked, "asked", scored, "p_name", "rank", 0.86, 0.08)


def q_code_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14: search results for each part name and brand, decided by exchange codes, names and places.

    Brands are the codes in the results' addresses; a one-digit brand is known as an NSE code, a
    brand that ends in less than 5 as a BSE code. Results bear the name itself or the name with a legal suffix.
    """
    found = table(spark, sf_dir, "part").select("p_name", F.col("p_brand").alias("slug"), "p_type").distinct()
    plain = F.col("slug").endswith("7") & (F.col("p_type") == "ECONOMY")
    found = found.withColumns({"found": F.when(plain, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" Ltd"))), "rank": F.row_number().over(Window.partitionBy("p_name").orderBy("p_type", "slug"))})
    asked = found.select("p_name", F.col("slug").alias("brand")).distinct().withColumns({"asked": F.concat_ws(" / ", "p_name", "brand"), "nse": F.when(F.length("brand") == 7, F.col("brand")), "bse": F.when((F.length("brand") > 7) & (F.substring("brand", -1, 1) < "5"), F.col("brand"))})
    scored = names.candidate_scores(asked.join(found, "p_name"), "p_name", "found", "rank", "nse", "bse", "slug")
    return names.decide_candidates(asked, "asked", scored, "found", "rank", 0.86, 0.08)


CODE_DECISIONS_SQL = """
WITH listed AS (SELECT DISTINCT p_name, p_brand AS slug, p_type FROM part),
found AS (SELECT *, CASE WHEN slug LIKE '%7' AND p_type = 'ECONOMY' THEN p_name ELSE p_name || ' Ltd' END AS found, row_number() OVER (PARTITION BY p_name ORDER BY p_type, slug) AS rank FROM listed),
asked AS (SELECT DISTINCT p_name, slug AS brand, p_name || ' / ' || slug AS asked FROM listed),
bases AS (SELECT asked, found, rank, length(brand) = 7 AND brand = slug AS nse, length(brand) > 7 AND right(brand, 1) < '5' AND brand = slug AS bse, found = a.p_name AS same, 2.0::DOUBLE * length(a.p_name) / (length(a.p_name) + length(found)) AS ratio FROM asked a JOIN found f ON a.p_name = f.p_name),
scored AS (SELECT *, round(least(1.0::DOUBLE, CASE WHEN nse THEN 1.0 WHEN bse THEN 0.95 ELSE CASE WHEN same THEN 0.84::DOUBLE ELSE 0 END + 0.18::DOUBLE + ratio * 0.18::DOUBLE + CASE WHEN rank = 1 THEN 0.03::DOUBLE ELSE 0 END END), 4) AS score FROM bases),
ranked AS (SELECT *, lead(score, 1, 0) OVER w AS second, row_number() OVER w AS n FROM scored WINDOW w AS (PARTITION BY asked ORDER BY score DESC, rank)),
decided AS (SELECT *, CASE WHEN nse OR bse AND round(score - second, 6) >= 0.03 OR score >= 0.86 AND round(score - second, 6) >= 0.08 THEN 'matched' ELSE 'ambiguous' END AS status FROM ranked WHERE n = 1)
SELECT asked, CASE WHEN status = 'matched' THEN found END AS matched, score AS confidence, second, status FROM decided"""


def q_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13: the best part name at or above the threshold; held against brute force in the tests."""
    #: Names are read in many branches, whose filters Spark would push below the distinct to every row of the table.
    known = materialise(_part_names(spark, sf_dir), "known-names")
    asked = materialise(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("asked")).distinct(), "asked-names")
    return names.fuzzy_matches(names.candidate_pairs(asked, "asked", "asked", known, "p_name", "p_name"))


def q_event_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STRM-1: the latest event of each user by an incremental stream; errors go to the failure table."""
    target = f"{scratch(spark)}/ingest-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    ingest.ingest_latest(spark, f"{sf_dir}/event[s].parquet", schema, "user_id", ["ts", "event_id"], target, "event_type <> 'error'")
    good, bad = ingest.latest(spark, target, "user_id", ["ts", "event_id"]), ingest.failures(spark, target)
    errors = bad.groupBy("user_id").agg(F.count("*").alias("n_errors"))
    return good.join(errors, "user_id", "full").select("user_id", "event_id", "event_type", "value", F.coalesce("n_errors", F.lit(0)).alias("n_errors"))


EVENT_INGEST_SQL = """
SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS event_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS event_type,
  arg_max(value, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS value, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events GROUP BY 1"""

#: Files of the stream, width of its windows and how late a row may come.
STREAM_FILES, STREAM_WIDTH, STREAM_LATE = 4, "1 day", "6 hours"


def q_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STRM-1: events by day and type from a stream of several files, in which rows come twice and far too late."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first, last = events.agg(F.min(F.col("ts").cast("double")), F.max(F.col("ts").cast("double"))).first()
    target = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    part = F.least(F.floor((F.col("ts").cast("double") - first) / ((last - first) / STREAM_FILES)), F.lit(STREAM_FILES - 1)) if last != first else F.lit(0)
    dealt = events.withColumn("part", part)
    for number in range(STREAM_FILES):
        #: A file repeats a part of what it holds, and the last one also rows of the first, which come too late.
        own, again = F.col("part") == number, (F.col("part") == (0 if number == STREAM_FILES - 1 else number)) & (F.col("event_id") % 3 == 0)
        dealt.filter(own).unionAll(dealt.filter(again)).drop("part").coalesce(1).write.mode("append").parquet(f"{target}/source")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/source")
    return ingest.run_to_end(ingest.counted_once(stream, "event_id", "ts", "event_type", STREAM_WIDTH, STREAM_LATE), target)


EVENT_STREAM_SQL = """SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1, 2"""

QUERIES = {"adverse_mentions": (q_adverse_mentions, ADVERSE_MENTIONS_SQL), "outlook_scores": (q_outlook_scores, OUTLOOK_SCORES_SQL), "signal_rates": (q_signal_rates, SIGNAL_RATES_SQL), "top_phrases": (q_top_phrases, TOP_PHRASES_SQL), "line_records": (q_line_records, LINE_RECORDS_SQL), "contact_points": (q_contact_points, CONTACT_POINTS_SQL), "page_links": (q_page_links, PAGE_LINKS_SQL), "name_decisions": (q_name_decisions, NAME_DECISIONS_SQL), "candidate_decisions": (q_candidate_decisions, None), "code_decisions": (q_code_decisions, CODE_DECISIONS_SQL), "fuzzy_names": (q_fuzzy_names, None), "event_ingest": (q_event_ingest, EVENT_INGEST_SQL), "event_stream": (q_event_stream, EVENT_STREAM_SQL)}
