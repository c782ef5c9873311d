"""Company registry jobs: keys, captions, history, lookups, inheritance of fields and narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import name_tokens, normalise_name, to_bool

# Other spellings of agency keys, and the columns of a context table.
AGENCY_KEYS = {
    "acuite": "acuite", "acuite_ratings": "acuite", "brickwork": "brickwork", "brickwork_ratings": "brickwork", "care": "care", "care_edge": "care", "careedge": "care", "care_ratings": "care", "crisil": "crisil",
    "fitch": "india_ratings", "fitch_ratings": "india_ratings", "icra": "icra", "ind": "india_ratings", "india_ratings": "india_ratings", "india_ratings_and_research": "india_ratings",
    "india_ratings_research": "india_ratings", "indiaratings": "india_ratings", "infomerics": "infomerics", "smera": "acuite", "smera_ratings": "acuite",
}
CONTEXT_NUMBERS = (
    "promoter_bureau_score", "promoter_delinquency_count", "promoter_overdue_accounts", "promoter_overdue_amount_lakh", "criminal_case_count", "regulatory_risk_score", "governance_risk_score", "projected_revenue_cagr_5y",
    "projected_ebitda_margin_pct_5y", "projected_debt_to_equity_5y", "projected_interest_coverage_5y", "industry_expected_revenue_cagr_5y", "industry_expected_ebitda_margin_pct_5y", "execution_track_record_score",
    "plan_progress_score", "promoter_adverse_hits", "public_negative_news_hits", "fraud_signal_hits", "regulatory_action_hits", "insolvency_signal_hits", "litigation_signal_hits", "public_risk_score", "industry_outlook_score",
)
CONTEXT_FLAGS = ("criminal_case_flag", "plan_submission_available", "plan_on_track_flag", "public_risk_flag")


def agency_key(c: Column) -> Column:
    """One key per agency: known spellings first, then words that give an agency away; null stays null."""
    words = F.replace(F.lower(F.trim(c.cast("string"))), F.lit("&"), F.lit("and"))
    key = F.regexp_replace(F.regexp_replace(words, "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")
    known = F.create_map(*(F.lit(x) for pair in AGENCY_KEYS.items() for x in pair))
    guess = F.when(key.contains("fitch") | (key.contains("india") & key.contains("rating")), "india_ratings").when(key.startswith("care"), "care").when(key.startswith("smera") | key.startswith("acuite"), "acuite")
    return F.coalesce(known[key], guess, key)


def caption_scope(c: Column) -> Column:
    low = F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    return F.when(low.contains("consolidated figures"), "consolidated").when(low.contains("standalone figures"), "standalone")


def caption_unit(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.regexp_replace(c, "\\s+", " "), "(?i)Figures in (.+?)(?:/|$)", 1)), F.lit(""))


def page_counts(c: Column) -> dict[str, Column]:
    """total, current and pages of `N results found: Showing page x of y`; null where the text says nothing of it."""
    found = lambda i: F.regexp_extract(c, "(?i)(\\d+)\\s+results\\s+found:\\s+Showing\\s+page\\s+(\\d+)\\s+of\\s+(\\d+)", i).try_cast("int")
    return {"total": found(1), "current": found(2), "pages": found(3)}


def update_label(c: Column, year: int) -> dict[str, Column]:
    """`Rating update 4 Jul from crisil`: date (its year given where the label has none), what it shows, agency and notes."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")), "(?i)^Rating update\\s*", ""))
    parts = F.split(clean, "(?i)\\s+from\\s+", 2)
    shown, empty = F.trim(parts[0]), clean == ""
    dated = shown.rlike("\\b\\d{4}\\b")
    full = F.when(dated, shown).otherwise(F.concat_ws(" ", shown, F.lit(str(year))))
    date = F.to_date(F.try_to_timestamp(F.regexp_replace(full, "^(\\d{1,2} )([A-Za-z]{3})[A-Za-z]* (\\d{4})$", "$1$2 $3"), F.lit("d MMM yyyy")))
    inferred = F.when(~dated & (shown != ""), F.lit(f"Year inferred as {year}."))
    unread = F.when(date.isNull(), F.concat(F.lit("Could not parse rating date from '"), shown, F.lit("'.")))
    return {
        "rating_date": F.when(~empty, date), "shown": F.when(~empty, F.nullif(shown, F.lit(""))), "agency": F.when(~empty, F.nullif(F.lower(F.trim(F.get(parts, 1))), F.lit(""))),
        "notes": F.when(empty, "Rating update label was empty.").otherwise(F.nullif(F.concat_ws(" ", inferred, unread), F.lit(""))),
    }


def deduped_history(entries: DataFrame, by: list[str], date: str, agency: str, rating: str, text: str, *ties: str) -> DataFrame:
    """Rated entries, one per date, agency, rating and text (both normalised), numbered from the newest."""
    keyed = entries.filter(F.coalesce(F.col(rating), F.lit("")) != "").withColumns({"_agency": normalise_name(F.coalesce(F.col(agency), F.lit(""))), "_text": normalise_name(F.coalesce(F.col(text), F.lit("")))})
    same = Window.partitionBy(*by, date, "_agency", rating, "_text").orderBy(*ties)
    once = keyed.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    newest = Window.partitionBy(*by).orderBy(F.col(date).desc_nulls_last(), F.col(rating).desc(), *ties)
    return once.withColumn("place", F.row_number().over(newest)).drop("_n", "_agency", "_text")


def mentions_company(name: Column, text: Column, least: float = 0.35) -> Column:
    """Whether a found text speaks of the company: enough of a name score, or two shared words (one of a one-word name)."""
    asked, said = normalise_name(F.coalesce(name, F.lit(""))), normalise_name(F.coalesce(text, F.lit("")))
    a, b = F.array_distinct(name_tokens(asked)), F.array_distinct(name_tokens(said))
    shared = F.size(F.array_intersect(a, b))
    score = 0.7 * shared / F.size(a) + 0.3 * shared / F.size(b) + F.when(asked.startswith(said) | said.startswith(asked), 0.1).otherwise(0.0)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return both & ((shared > 0) & (F.round(score, 4) >= least) | (shared >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(a)))))


def resolved(asked: DataFrame, identifier: str, known: DataFrame, slug: str, base: str) -> DataFrame:
    """Every identifier with its company: a URL is its own, a known slug gives the known row (case ignored), others a made-up row.

    `known` holds slug, company_name and company_page_url; a slug known twice gives its least row.
    """
    web = F.col(identifier).rlike("^https?://")
    rows = known.groupBy(F.lower(slug).alias("_slug")).agg(F.min(F.struct(F.col(slug).alias("company_slug"), "company_name", "company_page_url")).alias("_row"))
    joined = asked.join(rows, F.when(~web, F.lower(F.trim(F.col(identifier)))) == F.col("_slug"), "left")
    from_url = F.nullif(F.regexp_extract(identifier, "/company/([^/?#]+)", 1), F.lit(""))
    return joined.select(
        *asked.columns, F.col("_row.company_name").alias("company_name"), F.when(web, from_url).otherwise(F.coalesce(F.col("_row.company_slug"), F.upper(identifier))).alias("company_slug"),
        F.when(web, F.col(identifier)).otherwise(F.coalesce(F.col("_row.company_page_url"), F.concat(F.lit(f"{base}/company/"), F.upper(identifier), F.lit("/")))).alias("company_page_url"),
        F.when(web, "url").when(F.col("_row").isNotNull(), "known").otherwise("made_up").alias("found_by"),
    )


def document_features(rows: DataFrame, features: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Left join of a document's features; without a document every flag is false."""
    joined = rows.join(features.select(key, *flags), key, "left")
    return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def pending(work: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Work whose key none of the finished tables holds."""
    for finished in done:
        work = work.join(finished.select(key).distinct(), key, "left_anti")
    return work


def once_per(rows: DataFrame, key: str, compute) -> DataFrame:
    """compute(distinct keys) -> (key, values), joined back to every row; a null key gets no values."""
    return rows.join(compute(rows.select(key).filter(F.col(key).isNotNull()).distinct()), key, "left")


def normalised_context(rows: DataFrame) -> DataFrame:
    """The canonical context columns: numbers and dates that can't be read are null, flags false, ids from names only if every id is blank."""
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    text = lambda c, other="": F.trim(F.coalesce(given(c), F.lit(other)))
    out = rows.select(
        text("company_id").alias("company_id"), text("company_name").alias("company_name"), F.to_date(F.try_to_timestamp(given("as_of_date"), F.lit("yyyy-MM-dd"))).alias("as_of_date"), text("source_type", "manual_context").alias("source_type"),
        *(given(c).try_cast("double").alias(c) for c in CONTEXT_NUMBERS), *(F.coalesce(to_bool(given(c)), F.lit(False)).alias(c) for c in CONTEXT_FLAGS), text("notes").alias("notes"),
    )
    blank = out.agg((F.coalesce(F.max("company_id"), F.lit("")) == "").alias("_blank"))
    made = F.regexp_replace(F.regexp_replace("company_name", "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return out.crossJoin(F.broadcast(blank)).withColumn("company_id", F.when(F.col("_blank"), made).otherwise(F.col("company_id"))).drop("_blank")


def context_status(context: DataFrame) -> DataFrame:
    named = F.count(F.when(F.col("company_id") != "", 1))
    return context.agg(F.count("*").alias("rows_loaded"), named.alias("company_rows"), F.when(F.count("*") > 0, "parsed").otherwise("empty").alias("status"))


def inherited(parents: DataFrame, children: str, fields: list[str]) -> DataFrame:
    """Child records of an array column; a field that a child leaves null comes from its parent."""
    own = [f for f in parents.schema[children].dataType.elementType.fieldNames()]
    exploded = parents.select(*fields, F.explode(children).alias("_child"))
    merged = [F.coalesce(F.col(f"_child.{f}"), F.col(f)).alias(f) if f in own else F.col(f) for f in fields]
    return exploded.select(*merged, *(F.col(f"_child.{f}").alias(f) for f in own if f not in fields))


def _said(prefix: str, value: Column, suffix: str) -> Column:
    """A sentence on a number; null without one."""
    text = F.concat(F.lit(prefix + " "), F.format_number(value, 2), F.lit(" " + suffix))
    return F.replace(F.replace(text, F.lit(" %."), F.lit("%.")), F.lit(" x."), F.lit("x."))


def _told(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), F.nullif(value.cast("string"), F.lit("")), F.lit(after))


def narrative(c: dict[str, Column]) -> Column:
    """Six sections under their headings, two line ends apart. `c` holds the profile's columns, `advice` and `notes` being lists."""
    place = F.nullif(F.concat_ws(", ", F.nullif(c["city"], F.lit("")), F.nullif(c["state"], F.lit(""))), F.lit(""))
    metrics = [
        ("Revenue available for assessment is", "revenue_crore", "crore."), ("EBITDA margin is", "ebitda_margin_pct", "%."), ("PAT margin is", "pat_margin_pct", "%."), ("Debt to equity is", "debt_to_equity", "x."),
        ("Interest coverage is", "interest_coverage", "x."), ("Working capital days are", "working_capital_days", "days."), ("Receivables days are", "receivables_days", "days."), ("Inventory days are", "inventory_days", "days."),
        ("Borrowings captured in the current view are", "borrowings_crore", "crore."),
    ]
    rated = [
        F.concat(F.lit("An external rating is available from "), F.coalesce(c["agency"], F.lit("a recognized agency")), F.lit(".")), _told("The latest rating considered is {}.", c["rating"]), _told("The outlook is {}.", c["outlook"]),
        _told("The rating date used is {}.", c["rating_date"]), _told("The latest rating action is '{}'.", c["rating_action"]), _told("The platform has preserved {} rating event(s) for context.", F.greatest(F.coalesce(c["history_count"], F.lit(0)), F.lit(1))),
    ]
    unrated = ["No external rating was confirmed in the current run.", "The platform has flagged this case for simulated internal credit assessment in a later phase."]
    platforms = F.nullif(c["platforms"], F.lit(""))
    advice = F.array_join(F.transform(c["advice"], lambda x, i: F.concat(F.lit("Advisory "), (i + 1).cast("string"), F.lit(": "), x)), " ")
    body = {
        "Company Snapshot": F.concat_ws(" ", F.concat(c["company_name"], F.lit(" is currently classified as "), c["listed_status"], F.lit(".")), _said("The latest turnover considered by the platform is", c["turnover_crore"], "crore."), _told("The company is mapped to the industry bucket '{}'.", c["industry"]), _told("Business type is identified as {}.", c["business_type"]), _told("Operating location in the reference dataset is {}.", place), c["threshold_reason"]),
        "Financial Assessment": F.coalesce(F.nullif(F.concat_ws(" ", *(_said(p, c[m], s) for p, m, s in metrics), _told("The primary financial source in this run is '{}'.", c["source"]), _told("The latest statement period referenced is {}.", c["statement_period"])), F.lit("")), F.lit("A complete financial snapshot was not available for this run.")),
        "Credit Rating Position": F.when(c["rated"], F.concat_ws(" ", *rated)).otherwise(F.concat_ws(" ", F.lit(unrated[0]), F.when(c["simulated"], unrated[1]))),
        "TReDS View": F.concat_ws(" ", _told("TReDS signal strength is assessed as {}.", c["signal_strength"]), _told("The workflow used the '{}' method.", c["method"]), F.coalesce(_told("Detected platforms include {}.", platforms), F.lit("No direct TReDS platform mention was detected in the public search layer.")), F.when(c["method"] == "model", _said("The estimated TReDS limit is", c["limit_crore"], "crore.")), _told("Estimation confidence is {}.", c["confidence"])),
        "Advisory View": F.coalesce(F.nullif(advice, F.lit("")), F.lit("No rule-based advisory trigger was generated from the currently available data.")),
        "Data Provenance": F.coalesce(F.nullif(F.concat_ws(" ", _told("Listed/unlisted resolution source: {}.", c["listed_source"]), F.when(c["listed_source"].isNotNull(), F.coalesce(_told("Screener workbook was available at {}.", c["workbook"]), F.lit("No Screener workbook was attached to this run."))), F.array_join(c["notes"], " ")), F.lit("")), F.lit("No additional provenance note was recorded.")),
    }
    return F.concat_ws("\n\n", *(F.concat(F.lit(heading + "\n"), text) for heading, text in body.items()))
