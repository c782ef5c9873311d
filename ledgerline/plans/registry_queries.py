"""Queries of the company registry: keys, captions, history, lookups, context tables, narratives and page records."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import documents, joins, pages, registry, texts
from ledgerline.plans import panel
from ledgerline.plans.document_queries import DOCS, rating_documents
from ledgerline.plans.features import r6
from ledgerline.plans.panel import sql
from ledgerline.plans.parts import cat, either, lit, number, pick
from ledgerline.plans.rating_queries import TEXTS, rating_texts
from ledgerline.plans.text_queries import NEGATIVE, POSITIVE, _hits_sql
from ledgerline.session import table

YEAR = 2025


def _events(spark: SparkSession, sf_dir: str, *columns: str, **made) -> DataFrame:
    return panel.rating_events(spark, sf_dir).select("event_id", *columns, *(F.expr(p.spark).alias(n) for n, p in made.items()))


_SPELT = (" Acuité Ratings", "CARE Edge", "careedge analytics", "India Ratings & Research", "Fitch Group", "SMERA Ltd", "Crisil", "[ICRA]", "New Rater", "India Rating Co", "IND")
_KEYS = ("acuité_ratings", "care", "care", "india_ratings", "india_ratings", "acuite", "crisil", "icra", "new_rater", "india_ratings", "india_ratings")


def q_agency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: the agency key of every spelling."""
    return _events(spark, sf_dir, spelt=pick(_SPELT)).select("event_id", "spelt", registry.agency_key(F.col("spelt")).alias("agency_key"))


AGENCY_KEYS_SQL = sql(f"SELECT event_id, {pick(_SPELT).sql} AS spelt, {pick(_KEYS).sql} AS agency_key FROM rating_events")

_scope, _unit = pick(("Consolidated", "Standalone", "Other")), pick(("Rs. Crores", "USD million"), 3)
_caption = cat(_scope, " Figures in ", _unit, either(2, lit(" / View"), lit("")))
_found = cat(number(500, 0), " results found: Showing page ", number(7, 1), " of ", number(9, 10))


def q_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: scope and unit of captions, and the counts of result pages."""
    rows = _events(spark, sf_dir, caption=_caption, found=_found)
    return rows.select("event_id", registry.caption_scope(F.col("caption")).alias("scope"), registry.caption_unit(F.col("caption")).alias("unit"), *(c.alias(n) for n, c in registry.page_counts(F.col("found")).items()))


CAPTIONS_SQL = sql(f"""SELECT event_id, nullif(lower({_scope.sql}), 'other') AS scope, {_unit.sql} AS unit, (event_id % 500)::INT AS total, (event_id % 7 + 1)::INT AS current, (event_id % 9 + 10)::INT AS pages FROM rating_events""")

_day, _month = number(28, 1), pick(("Jul", "January", "Sep", "Xyz"), 2)
_label = cat("Rating update ", _day, " ", _month, either(3, lit(" 2021"), lit("")), either(4, lit(""), cat(" from ", pick(("CRISIL", "Care", "fitch")))))


def q_update_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-5: date, agency and note of update labels, the year a parameter."""
    rows = _events(spark, sf_dir, label=either(17, lit("Rating update "), _label))
    return rows.select("event_id", *(c.alias(n) for n, c in registry.update_label(F.col("label"), YEAR).items()))


UPDATE_LABELS_SQL = sql(
    f"""SELECT event_id, CASE WHEN event_id % 17 <> 0 AND month <> 'Xyz' THEN strptime(day || ' ' || month[1:3] || ' ' || year, '%d %b %Y')::DATE END AS rating_date, CASE WHEN event_id % 17 <> 0 THEN shown END AS shown,
  CASE WHEN event_id % 17 <> 0 AND event_id % 4 <> 0 THEN lower({pick(("CRISIL", "Care", "fitch")).sql}) END AS agency,
  CASE WHEN event_id % 17 = 0 THEN 'Rating update label was empty.' ELSE nullif(concat_ws(' ', CASE WHEN event_id % 3 <> 0 THEN 'Year inferred as {YEAR}.' END, CASE WHEN month = 'Xyz' THEN 'Could not parse rating date from ''' || shown || '''.' END), '') END AS notes FROM labels""",
    f"""labels AS (SELECT event_id, {_day.sql} AS day, {_month.sql} AS month, CASE WHEN event_id % 3 = 0 THEN '2021' ELSE '{YEAR}' END AS year, {_day.sql} || ' ' || {_month.sql} || CASE WHEN event_id % 3 = 0 THEN ' 2021' ELSE '' END AS shown FROM rating_events)""",
)


def q_rating_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-3: every company's history once per date, agency, rating and text, newest first, after each event was met twice."""
    rows = rating_texts(spark, sf_dir).select("company_id", "rating_date", "agency", F.nullif(F.regexp_extract("rating_text", "\\] (\\S+) \\(", 1), F.lit("")).alias("rating"), "rating_text", "event_id")
    again = rows.withColumns({"agency": F.upper("agency"), "rating_text": F.regexp_replace("rating_text", " ", "  "), "event_id": F.col("event_id") + 1})
    return registry.deduped_history(rows.unionByName(again), ["company_id"], "rating_date", "agency", "rating", "rating_text", "event_id").drop("rating_text", "agency")


RATING_HISTORY_SQL = sql(
    """SELECT company_id, rating_date, rating, event_id, (row_number() OVER (PARTITION BY company_id ORDER BY rating_date DESC NULLS LAST, rating DESC, event_id))::INT AS place FROM (
  SELECT company_id, rating_date, rating, min(event_id) AS event_id FROM entries WHERE rating <> '' GROUP BY company_id, rating_date, agency, rating, norm)""",
    TEXTS,
    """entries AS (SELECT company_id, rating_date, agency, event_id, regexp_extract(rating_text, '\\] (\\S+) \\(', 1) AS rating, trim(regexp_replace(lower(rating_text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM texts)""",
)

_asked = cat(pick(("Alpha", "Bright", "Coral"), 2), " ", pick(("Foods", "Textiles", "Metals", "Pharma"), 3), pick((" Limited", "", " Pvt Ltd"), 5))
_heard = cat(pick(("Shares of Alpha Foods rise", "Bright ideas for winter", "Coral Metals Limited reports", "Nothing", "the co", "Pharma")), " ", pick(("today", "in Mumbai", "")))


def q_mention_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7: found texts that speak of the company asked for."""
    rows = _events(spark, sf_dir, asked=_asked, heard=_heard)
    return rows.filter(registry.mentions_company(F.col("asked"), F.col("heard")))


_STOP = "('limited', 'ltd', 'private', 'pvt', 'company', 'co', 'corporation', 'corp', 'incorporated', 'inc', 'llp', 'plc', 'the')"
MENTION_MATCHES_SQL = sql(
    """SELECT event_id, asked, heard FROM worded WHERE len(a) > 0 AND len(b) > 0 AND (len(list_intersect(a, b)) >= greatest(1, least(2, len(a))) OR len(list_intersect(a, b)) > 0 AND
  round(0.7::DOUBLE * len(list_intersect(a, b)) / len(a) + 0.3::DOUBLE * len(list_intersect(a, b)) / len(b) + CASE WHEN starts_with(x, y) OR starts_with(y, x) THEN 0.1::DOUBLE ELSE 0 END, 4) >= 0.35)""",
    f"named AS (SELECT event_id, {_asked.sql} AS asked, {_heard.sql} AS heard FROM rating_events)",
    f"""worded AS (SELECT *, trim(lower(asked)) AS x, trim(lower(heard)) AS y, list_distinct(list_filter(string_split(lower(asked), ' '), lambda w: w <> '' AND w NOT IN {_STOP})) AS a, list_distinct(list_filter(string_split(lower(heard), ' '), lambda w: w <> '' AND w NOT IN {_STOP})) AS b FROM named)""",
)

_BASE = "https://registry.example"


def q_resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10: companies by slug in any case, by URL, or made up for an unknown slug."""
    known = panel.companies(spark, sf_dir).select(F.concat(F.lit("Slug-"), F.col("company_id").cast("string")).alias("company_slug"), "company_name", F.concat(F.lit(f"{_BASE}/c/"), F.col("company_id").cast("string")).alias("company_page_url"))
    events = panel.rating_events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://other.example/company/x-"), F.col("company_id").cast("string"), F.lit("/?a=1"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" sLUG-"), F.col("company_id").cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("odd"), F.col("company_id").cast("string"))).alias("identifier"))
    return registry.resolved(events, "identifier", known, "company_slug", _BASE)


RESOLVED_TARGETS_SQL = sql(f"""
SELECT event_id, 'https://other.example/company/x-' || company_id || '/?a=1' AS identifier, NULL AS company_name, 'x-' || company_id AS company_slug, 'https://other.example/company/x-' || company_id || '/?a=1' AS company_page_url, 'url' AS found_by FROM rating_events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, ' sLUG-' || e.company_id || ' ', company_name, CASE WHEN c.company_id IS NULL THEN ' SLUG-' || e.company_id || ' ' ELSE 'Slug-' || e.company_id END, CASE WHEN c.company_id IS NULL THEN '{_BASE}/company/ SLUG-' || e.company_id || ' /' ELSE '{_BASE}/c/' || e.company_id END,
  CASE WHEN c.company_id IS NULL THEN 'made_up' ELSE 'known' END FROM rating_events e LEFT JOIN companies c ON e.company_id = c.company_id WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'odd' || company_id, NULL, 'ODD' || company_id, '{_BASE}/company/ODD' || company_id || '/', 'made_up' FROM rating_events WHERE event_id % 3 = 2""")


def q_event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-2, JOIN-11: signals of each event's document, joined by text keys; events without a document have none."""
    flags = list(documents.SIGNALS)
    docs = rating_documents(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("event_id").cast("string")).alias("doc"), "text")
    features = documents.signal_table(docs, ["doc"], "text")
    events = panel.rating_events(spark, sf_dir).select("event_id", F.when(F.col("rating_date").isNotNull(), F.concat(F.lit("doc_"), F.col("event_id").cast("string"))).alias("doc"))
    return registry.document_features(events.withColumn("doc", joins.text_key("doc")), features.withColumn("doc", joins.text_key("doc")), "doc", flags)


_SIGNAL = {n: f"regexp_matches(text, '{'|'.join(documents.SIGNALS[n])}', 'i')" for n in documents.SIGNALS}
_flags_sql = ", ".join(f"rating_date IS NOT NULL AND {c} AS {n}" for n, c in _SIGNAL.items())
EVENT_DOCUMENTS_SQL = sql(f"SELECT e.event_id, CASE WHEN rating_date IS NOT NULL THEN 'doc_' || e.event_id ELSE '' END AS doc, {_flags_sql} FROM rating_events e JOIN docs d ON e.event_id = d.event_id", DOCS)


def q_pending_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-18: companies whose newest dated rating stands and whose newest context is no error."""
    newest = lambda rows, flag, *order: rows.groupBy("company_id").agg(F.max_by(flag, F.struct(*order)).alias("done")).filter("done")
    withdrawn = newest(panel.rating_events(spark, sf_dir).filter("rating_date is not null"), "withdrawn", "rating_date", "event_id")
    errors = newest(panel.context(spark, sf_dir), "flag", "as_of", "event_id")
    return registry.pending(panel.companies(spark, sf_dir).select("company_id", "company_name"), "company_id", withdrawn, errors)


PENDING_COMPANIES_SQL = sql("""SELECT company_id, company_name FROM companies WHERE company_id NOT IN (SELECT company_id FROM (SELECT * FROM rating_events WHERE rating_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY rating_date DESC, event_id DESC) = 1) WHERE withdrawn)
  AND company_id NOT IN (SELECT company_id FROM (SELECT * FROM context QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY as_of DESC, event_id DESC) = 1) WHERE flag)""")

#: Kinds of text that count as mentions of an industry.
MENTION_KINDS = ("en", "fr", "es")


def q_industry_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-22, FLT-9: an industry's outlook, computed once from its companies' kept kinds of mention, on each of its companies.

    Texts name no company, so a text belongs to the company of its number modulo the number of companies, as ratings do.
    """
    companies = panel.companies(spark, sf_dir)
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    mentions = table(spark, sf_dir, "documents").filter(F.col("lang").isin(*MENTION_KINDS)).crossJoin(F.broadcast(n)).select("doc_id", "text", (F.col("doc_id") % F.col("n")).alias("company_id"))
    of = mentions.join(companies.select("company_id", "sub_industry"), "company_id")
    scored = lambda keys: keys.join(texts.outlook_scores(of, "sub_industry", "doc_id", "text", POSITIVE, NEGATIVE), "sub_industry", "left").select("sub_industry", F.coalesce("outlook", F.lit(0.0)).alias("industry_score"), F.array_join(F.col("mentions").cast("array<string>"), ",").alias("mentions"))
    return registry.once_per(companies, "sub_industry", scored).select("company_id", "sub_industry", "industry_score", "mentions")


INDUSTRY_SCORES_SQL = sql(
    "SELECT company_id, sub_industry, coalesce(outlook, 0.0)::DOUBLE AS industry_score, mentions FROM companies LEFT JOIN outlooks USING (sub_industry)",
    f"mentions AS (SELECT sub_industry, doc_id, {_hits_sql(POSITIVE)} - {_hits_sql(NEGATIVE)} AS hit, row_number() OVER (PARTITION BY sub_industry ORDER BY doc_id) AS n FROM documents, suppliers JOIN companies ON doc_id % n = company_id WHERE lang IN {MENTION_KINDS})",
    "outlooks AS (SELECT sub_industry, greatest(-5, least(5, sum(hit)))::DOUBLE AS outlook, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE n <= 5) AS mentions FROM mentions GROUP BY 1)",
)


def _raw_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.cast("string").alias("company_name"), F.lit("  ").alias("company_id"), F.when(k % 4 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("as_of_date"), F.when(k % 3 == 0, "n/a").otherwise(F.round("value", 2).cast("string")).alias("promoter_bureau_score"),
        F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "maybe").alias("criminal_case_flag"), F.when(k % 2 == 0, " probe ").alias("source_type"),
    )


def q_context_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: a raw context table in its canonical form."""
    out = registry.normalised_context(_raw_context(spark, sf_dir))
    return r6(out.select("company_id", "company_name", "as_of_date", "source_type", "promoter_bureau_score", "governance_risk_score", "criminal_case_flag", "public_risk_flag", "notes"), "promoter_bureau_score")


CONTEXT_RECORDS_SQL = """
SELECT event_id::VARCHAR AS company_id, event_id::VARCHAR AS company_name, CASE WHEN event_id % 4 <> 0 THEN ts::DATE END AS as_of_date, CASE WHEN event_id % 2 = 0 THEN 'probe' ELSE 'manual_context' END AS source_type,
  CASE WHEN event_id % 3 <> 0 THEN round(value, 2) END AS promoter_bureau_score, NULL::DOUBLE AS governance_risk_score, event_id % 5 = 0 AS criminal_case_flag, false AS public_risk_flag, '' AS notes FROM events"""


def q_context_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: the one status row of a context table."""
    return registry.context_status(registry.normalised_context(_raw_context(spark, sf_dir)))


CONTEXT_STATUS_SQL = "SELECT count(*) AS rows_loaded, count(*) AS company_rows, CASE WHEN count(*) > 0 THEN 'parsed' ELSE 'empty' END AS status FROM events"


def q_inherited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-5: yearly records that take industry and scope from their company where they have none."""
    child = F.struct(F.when(F.col("year") % 2 == 0, "standalone").alias("scope"), F.when(F.col("year") % 3 == 0, "own").alias("sub_industry"), "year", F.round("interest_crore", 6).alias("interest_crore"))
    nested = panel.statements(spark, sf_dir).groupBy("company_id").agg(F.collect_list(child).alias("records"))
    parents = panel.companies(spark, sf_dir).join(nested, "company_id").withColumn("scope", F.lit("consolidated"))
    return registry.inherited(parents, "records", ["company_id", "company_name", "sub_industry", "scope"])


INHERITED_RECORDS_SQL = sql("""SELECT c.company_id, company_name, CASE WHEN year % 3 = 0 THEN 'own' ELSE sub_industry END AS sub_industry, CASE WHEN year % 2 = 0 THEN 'standalone' ELSE 'consolidated' END AS scope, year, round(interest_crore, 6) AS interest_crore FROM statements s JOIN companies c ON s.company_id = c.company_id""")


_FIGURES = ("revenue_crore", "ebitda_margin_pct", "pat_margin_pct", "debt_to_equity", "interest_coverage", "working_capital_days", "receivables_days", "inventory_days", "borrowings_crore")


def q_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRT-5: the six sections on every company's latest year and rating; figures that a year lacks are left out."""
    f = panel.financials(spark, sf_dir)
    f = f.withColumn("pat_margin_pct", F.try_divide(F.col("revenue_crore") - 2 * F.col("interest_crore"), F.col("revenue_crore")) * 100)
    latest = f.groupBy("company_id").agg(F.max_by(F.struct("year", *_FIGURES), "year").alias("f")).select("company_id", "f.*")
    events = panel.rating_events(spark, sf_dir).filter("rating_rank is not null and rating_date is not null").groupBy("company_id").agg(F.max_by(F.struct("agency", "rating_rank", "rating_date", "scale_type", "withdrawn"), F.struct("rating_date", "event_id")).alias("e"), F.count("*").alias("n"))
    rows = panel.companies(spark, sf_dir).join(latest, "company_id", "left").join(events, "company_id", "left")
    turnover = F.coalesce("revenue_crore", F.lit(0.0))
    c = {m: F.col(m) for m in _FIGURES} | {
        "company_name": F.col("company_name"), "listed_status": F.when(F.col("balance") > 0, "listed").otherwise("unlisted"), "turnover_crore": F.col("revenue_crore"), "industry": F.col("sub_industry"), "city": F.col("sub_industry"), "state": F.col("industry_group"), "source": F.when(F.col("year").isNotNull(), "panel"),
        "business_type": F.when(F.col("inventory_days") > F.col("receivables_days"), "manufacturing"), "threshold_reason": F.when(turnover < 400, "Turnover is below the threshold of the screen."),
        "statement_period": F.col("year"), "rated": F.col("n").isNotNull(), "agency": F.col("e.agency"), "rating": F.col("e.rating_rank"), "rating_date": F.col("e.rating_date"), "history_count": F.col("n"), "outlook": F.when(F.col("e.scale_type") == "long_term", "stable"), "rating_action": F.when(F.col("e.withdrawn"), "withdrawn"), "simulated": F.lit(True),
        "signal_strength": F.when(F.col("receivables_days") > 120, "medium").otherwise("low"), "method": F.when(F.col("receivables_days").isNotNull(), "model").otherwise("none"), "platforms": F.when(F.col("company_id") % 3 == 0, "RXIL, M1xchange"), "limit_crore": F.col("revenue_crore") * F.col("receivables_days") / 365,
        "confidence": F.lit("medium"), "advice": F.array_compact(F.array(F.when(F.col("debt_to_equity") > 0.5, "Borrow less."), F.when(F.col("receivables_days") > 120, "Collect sooner."))), "listed_source": F.lit("panel"),
        "workbook": F.when(F.col("year").isNotNull(), F.concat(F.lit("panel/"), F.col("company_id").cast("string"), F.lit(".xlsx"))), "notes": F.array(F.lit("Made from tables.")),
    }
    return rows.select("company_id", registry.narrative(c).alias("narrative"))


def _amount(before: str, value: str, after: str) -> str:
    return f"'{before} ' || format('{{:,.2f}}', {value}) || '{after}'"


NARRATIVES_SQL = sql(
    f"""SELECT c.company_id, concat_ws(chr(10) || chr(10),
  'Company Snapshot' || chr(10) || concat_ws(' ', company_name || ' is currently classified as ' || CASE WHEN balance > 0 THEN 'listed' ELSE 'unlisted' END || '.', {_amount("The latest turnover considered by the platform is", "revenue_crore", " crore.")}, 'The company is mapped to the industry bucket ''' || sub_industry || '''.',
    CASE WHEN inventory_days > receivables_days THEN 'Business type is identified as manufacturing.' END, 'Operating location in the reference dataset is ' || sub_industry || ', ' || industry_group || '.', CASE WHEN coalesce(revenue_crore, 0) < 400 THEN 'Turnover is below the threshold of the screen.' END),
  'Financial Assessment' || chr(10) || CASE WHEN f.year IS NULL THEN 'A complete financial snapshot was not available for this run.' ELSE concat_ws(' ', {_amount("Revenue available for assessment is", "revenue_crore", " crore.")}, {_amount("EBITDA margin is", "ebitda_margin_pct", "%.")},
    {_amount("PAT margin is", "(revenue_crore - 2 * interest_crore) / nullif(revenue_crore, 0) * 100", "%.")}, {_amount("Debt to equity is", "debt_to_equity", "x.")}, {_amount("Interest coverage is", "interest_coverage", "x.")}, {_amount("Working capital days are", "working_capital_days", " days.")}, {_amount("Receivables days are", "receivables_days", " days.")},
    {_amount("Inventory days are", "inventory_days", " days.")}, {_amount("Borrowings captured in the current view are", "borrowings_crore", " crore.")}, 'The primary financial source in this run is ''panel''.', 'The latest statement period referenced is ' || f.year || '.') END,
  'Credit Rating Position' || chr(10) || CASE WHEN r.n IS NULL THEN 'No external rating was confirmed in the current run. The platform has flagged this case for simulated internal credit assessment in a later phase.' ELSE
    concat_ws(' ', 'An external rating is available from ' || agency || '.', 'The latest rating considered is ' || rating || '.', CASE WHEN scale_type = 'long_term' THEN 'The outlook is stable.' END, 'The rating date used is ' || rating_date || '.', CASE WHEN withdrawn THEN 'The latest rating action is ''withdrawn''.' END, 'The platform has preserved ' || r.n || ' rating event(s) for context.') END,
  'TReDS View' || chr(10) || concat_ws(' ', 'TReDS signal strength is assessed as ' || CASE WHEN receivables_days > 120 THEN 'medium' ELSE 'low' END || '.', 'The workflow used the ''' || CASE WHEN receivables_days IS NULL THEN 'none' ELSE 'model' END || ''' method.',
    CASE WHEN c.company_id % 3 = 0 THEN 'Detected platforms include RXIL, M1xchange.' ELSE 'No direct TReDS platform mention was detected in the public search layer.' END, {_amount("The estimated TReDS limit is", "revenue_crore * receivables_days / 365", " crore.")}, 'Estimation confidence is medium.'),
  'Advisory View' || chr(10) || CASE WHEN debt_to_equity > 0.5 AND receivables_days > 120 THEN 'Advisory 1: Borrow less. Advisory 2: Collect sooner.' WHEN debt_to_equity > 0.5 THEN 'Advisory 1: Borrow less.' WHEN receivables_days > 120 THEN 'Advisory 1: Collect sooner.' ELSE 'No rule-based advisory trigger was generated from the currently available data.' END,
  'Data Provenance' || chr(10) || 'Listed/unlisted resolution source: panel. ' || CASE WHEN f.year IS NULL THEN 'No Screener workbook was attached to this run.' ELSE 'Screener workbook was available at panel/' || c.company_id || '.xlsx.' END || ' Made from tables.') AS narrative
FROM companies c LEFT JOIN (SELECT * FROM financials QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY year DESC) = 1) f ON c.company_id = f.company_id LEFT JOIN rated r ON c.company_id = r.company_id""",
    """rated AS (SELECT company_id, count(*) AS n, arg_max(agency, (rating_date, event_id)) AS agency, arg_max(rating_rank, (rating_date, event_id)) AS rating, arg_max(scale_type, (rating_date, event_id)) AS scale_type, arg_max(withdrawn, (rating_date, event_id)) AS withdrawn, max(rating_date) AS rating_date
  FROM rating_events WHERE rating_rank IS NOT NULL AND rating_date IS NOT NULL GROUP BY 1)""",
)


def _company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per company: title, heading, and its interest and borrowings by year as a table; every ninth page has no table."""
    f = panel.statements(spark, sf_dir).select("company_id", "year", F.round("interest_crore", 2).cast("string").alias("i"), F.coalesce(F.round("borrowings_crore", 2).cast("string"), F.lit("")).alias("b"))
    line = lambda c, tag: F.concat_ws("", F.transform("y", lambda x: F.concat(F.lit(f"<{tag}>"), x[c].cast("string"), F.lit(f"</{tag}>"))))
    years = f.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("year", "i", "b"))).alias("y"))
    rows = panel.companies(spark, sf_dir).join(years, "company_id")
    grid = F.concat(F.lit("<table><thead><tr><th></th>"), line("year", "th"), F.lit("</tr></thead><tr><td>Interest &amp; costs</td>"), line("i", "td"), F.lit("<tr><td> Borrowings\n</td>"), line("b", "td"), F.lit("</table>"))
    html = F.concat(F.lit("<html><head><title>"), F.col("company_name"), F.lit(" &amp; more</title></head><body><h1>"), F.col("company_name"), F.lit("</h1>"), F.when(F.col("company_id") % 9 == 0, "").otherwise(grid), F.lit("</body>"))
    return rows.select("company_id", html.alias("html"))


def q_page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17: the statement matrices of company pages as records."""
    found = pages.cells(_company_pages(spark, sf_dir), "company_id", "html")
    return pages.matrices(found, "company_id").filter("value <> ''")


#: Amounts have at most eight decimals; rounded as such, an exact half goes up, where the binary number may lie below it.
_CENTS = "round({}::DECIMAL(38, 8), 2)::DOUBLE::VARCHAR"
PAGE_RECORDS_SQL = sql(f"""
SELECT company_id, 0 AS grid, 'Interest & costs' AS metric, year::VARCHAR AS period, {_CENTS.format("interest_crore")} AS value FROM statements WHERE company_id % 9 <> 0
UNION ALL SELECT company_id, 0, 'Borrowings', year::VARCHAR, {_CENTS.format("borrowings_crore")} FROM statements WHERE company_id % 9 <> 0 AND borrowings_crore IS NOT NULL""")


def q_page_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17: title, heading and status of company pages; a page without its table is kept as partial."""
    made = _company_pages(spark, sf_dir)
    found = pages.cells(made, "company_id", "html")
    who = pages.identity(found, "company_id")
    return pages.page_status(made, "company_id", {"identity": who, "statements": pages.matrices(found, "company_id")}).join(who, "company_id")


PAGE_IDENTITIES_SQL = sql("""SELECT company_id, company_name || ' & more' AS title, company_name AS heading, CASE WHEN company_id % 9 = 0 THEN 'partial' ELSE 'parsed' END AS status, CASE WHEN company_id % 9 = 0 THEN 'statements' ELSE '' END AS missing
FROM companies WHERE company_id IN (SELECT company_id FROM statements)""")


def q_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17: titles and headings of the crawled pages."""
    return pages.identity(pages.cells(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


def _mapped(pairs) -> str:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'" if str(x).isprintable() else "||".join(f"chr({ord(c)})" for c in str(x))
    return "MAP {" + ", ".join(f"{quoted(k) if isinstance(k, str) else k}: {quoted(v)}" for k, v in pairs) + "}"


#: Character references as HTML defines them: by number (Windows' own for the C1 controls), by whole name, else by the longest name that a name begins with.
_C1 = [(n, bytes([n]).decode("cp1252", "replace")) for n in range(0x80, 0xA0)]
_CODES = _mapped([(0, "\ufffd"), (13, "\r"), *((n, c if c != "\ufffd" else chr(n)) for n, c in _C1)])
_SILENT = "n BETWEEN 1 AND 8 OR n BETWEEN 14 AND 31 OR n IN (11, 127) OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534"
_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
_SPACES = "[\\x09-\\x0d\\x1c-\\x1f\\x{85}\\p{Z}]+"


def _found_sql(tag: str) -> str:
    """The first element of a tag that says something: its text without markup, references decoded, white space folded."""
    pieces = f"regexp_extract_all(regexp_replace(t, '<[^>]*>', '', 'g'), '{_REFERENCE}|[^&]+|&')"
    folded = f"trim(regexp_replace(array_to_string(list_transform({pieces}, lambda x: decoded(x)), ''), '{_SPACES}', ' ', 'g'))"
    folded = folded.replace("decoded(x)", "CASE WHEN x[1:1] <> '&' OR len(x) = 1 THEN x WHEN x[2:2] = '#' THEN by_number(x) ELSE by_name(x) END")
    folded = folded.replace("by_name(x)", "coalesce(list_transform(list_filter(range(len(x), 1, -1), lambda n: map_contains(names, x[2:n])), lambda n: names[x[2:n]] || x[n + 1:])[1], x)")
    number = "list_transform([CASE WHEN lower(x[3:3]) = 'x' THEN ('0x' || rtrim(x[4:], ';'))::BIGINT ELSE rtrim(x[3:], ';')::BIGINT END], lambda n: CASE WHEN map_contains(codes, n) THEN codes[n] WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) "
    folded = folded.replace("by_number(x)", f"{number} WHEN {_SILENT} THEN '' ELSE chr(n::INT) END)[1]")
    return f"list_filter(list_transform(regexp_extract_all(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1), lambda t: {folded}), lambda t: t <> '')[1]"


PAGE_TITLES_SQL = f"""WITH known AS (SELECT {_mapped(html5.items())} AS names, {_CODES} AS codes)
SELECT page_id, {_found_sql("title")} AS title, {_found_sql("h1")} AS heading FROM pages, known WHERE regexp_matches(html, '(?i)<title|<h1')"""


def q_ranked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-16: anchors and bare addresses of each page, those with a hint first."""
    return pages.ranked_links(table(spark, sf_dir, "pages"), "page_id", "url", "html", (".pdf", "rating", "about", "page"))


RANKED_LINKS_SQL = """
WITH cut AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*?href=["'']([^"'']+)["'']', 1) || regexp_extract_all(coalesce(html, ''), 'https?://[^\\s"''<>]+') AS l FROM pages),
found AS (SELECT page_id, url, unnest(l) AS x, unnest(range(len(l))) AS pos FROM cut),
whole AS (SELECT page_id, pos, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x WHEN starts_with(x, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || x WHEN starts_with(x, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || x
  ELSE CASE WHEN regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) = '' THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) END || x END AS link FROM found WHERE NOT contains(x, '${') AND NOT contains(lower(x), '%7b')),
firsts AS (SELECT page_id, link, min(pos) AS pos, regexp_matches(lower(link), '\\.pdf|rating|about|page') AS hinted FROM whole GROUP BY 1, 2)
SELECT page_id, (row_number() OVER w)::INT AS place, link, hinted FROM firsts WINDOW w AS (PARTITION BY page_id ORDER BY hinted DESC, pos) QUALIFY row_number() OVER w <= 20"""

def q_filled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12: section headers of document lines carried down to the lines under them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    headed = lines.select("doc_id", "at", F.when(F.col("line").rlike("^[A-M]"), F.substring("line", 1, 12)).otherwise("").alias("header"))
    return texts.fill_down(headed, ["doc_id"], "at", "header")


FILLED_HEADERS_SQL = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS "at" FROM cut)
SELECT doc_id, "at", last_value(CASE WHEN regexp_matches(line, '^[A-M]') THEN nullif(line[1:12], '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS header FROM lines"""

QUERIES = {
    "agency_keys": (q_agency_keys, AGENCY_KEYS_SQL), "captions": (q_captions, CAPTIONS_SQL), "update_labels": (q_update_labels, UPDATE_LABELS_SQL), "rating_history": (q_rating_history, RATING_HISTORY_SQL), "mention_matches": (q_mention_matches, MENTION_MATCHES_SQL),
    "resolved_targets": (q_resolved_targets, RESOLVED_TARGETS_SQL), "event_documents": (q_event_documents, EVENT_DOCUMENTS_SQL), "pending_companies": (q_pending_companies, PENDING_COMPANIES_SQL), "industry_scores": (q_industry_scores, INDUSTRY_SCORES_SQL),
    "context_records": (q_context_records, CONTEXT_RECORDS_SQL), "context_status": (q_context_status, CONTEXT_STATUS_SQL), "inherited_records": (q_inherited_records, INHERITED_RECORDS_SQL), "narratives": (q_narratives, NARRATIVES_SQL), "page_records": (q_page_records, PAGE_RECORDS_SQL),
    "page_identities": (q_page_identities, PAGE_IDENTITIES_SQL), "page_titles": (q_page_titles, PAGE_TITLES_SQL), "ranked_links": (q_ranked_links, RANKED_LINKS_SQL), "filled_headers": (q_filled_headers, FILLED_HEADERS_SQL),
}
