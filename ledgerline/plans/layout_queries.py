"""TXT-11 on documents whose facts are spread over lines: seven layouts made from the panel's events.

The SQL reads the same texts in its own way: lines are numbered, markers of starts and ends are
summed over them, and each agency's rows are taken apart by expressions written for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import grammars
from ledgerline.plans import panel
from ledgerline.plans.document_queries import _action, _agency, _amount, _before, _long, _mood, _name, _short
from ledgerline.plans.panel import sql
from ledgerline.plans.parts import Part, cat, either, lit, number, pick
from ledgerline.session import spread

_lender = pick(("First Bank", "The Second and Third\nBanking Corporation", "Fourth Bank"), 5)
_million = cat(number(9, 1), ",", number(90, 100), ".5")
_small = cat(number(61, 2), ".25")
_lowered = pick(("reaffirmed", "upgraded", "downgraded", "assigned"), 2)
_texts = (
    cat("Credit Bulletin\nAnnexure - Details of Bank Lenders & Facilities\nFacility\nAmount (Rs.Crore)\nName of Lender\nRating\nCash Credit\n", _amount, "\n", _lender, "\nCrisil ", _long, "/", _mood, "\nNon-Fund Based\nLimit\n7\nFourth Bank\nCrisil ", _short,
        "\nCash Credit\n", _small, "\nFifth Bank\nCrisil ", _long, "/", _mood, "\nCriteria Details\nTerm Loan\n1\nSixth Bank\nCrisil D"),
    cat("Press Release\n", _name, " Limited\nFacilities/Instruments Amount (Rs crore) Rating1 Rating Action\nLong-term bank facilities ", _amount, " (Reduced from 999.00) CARE ", _long, "; ", _mood, " ", _action, " from\nCARE ", _before, "; outlook kept\nShort-term bank facilities ", _small,
        " CARE ", _short, " Assigned", either(5, lit("\nFixed deposit - - Withdrawn"), lit("")), "\nDetails of instruments/facilities in Annexure-1."),
    cat("Details of Instruments\nInstrument Type\nMaturity Date\nSize of Issue (million)\nRating Action\nTerm\nloan\n-\n31 March 2029\nINR", _million, " (reduced from INR99,999)\nIND ", _long, "/", _mood, "\nAffirmed\nLong-term issuer rating\n-\n-\nIND ", _before, "/Stable\n", _action,
        either(4, cat("\nBank loan facilities - INR", _small, " IND ", _short, " Assigned"), lit("")), "\nAnalytical Approach\nTerm loan\nIND B\nAffirmed"),
    cat("Product Quantum (Rs. Cr) Long Term Rating Short Term Rating\nBank Loan Ratings ", _amount, " ACUITE ", _long, " | ", _mood, "\n| ", _action, "\nBank Loan Ratings ", _small, " - ACUITE ", _short, " | Assigned", either(3, lit("\nBank Loan Ratings 1.5\nNot Applicable | Withdrawn"), lit("")),
        "\nTotal Outstanding Quantum (Rs. Cr) 31.00"),
    cat("Facility\nRating*\nPrevious\nPresent\nCC\nTerm Loans\n800.00\n", _amount, "\nLong\nTerm\nBWR ", _before, "/Stable\nBWR ", _long, "/", _mood, "\n(Upgrade)\nShort term Loan\n95.25\nShort\nTerm\nBWR ", _short, either(3, lit("\nRating Withdrawn**"), lit("\nReaffirmed")), "\nNon Fund Based\nTotal\nRATING ACTION"),
    cat("Ratings\nInstrument / Facility\nAmount\nCurrent Ratings\nPrevious Ratings\nLong Term Bank\nFacilities - Term Loan\n", _amount, "\nIVR ", _long, "/\nStable\n", either(2, cat("IVR ", _before, "; Stable\nRating ", _action), _action), "\nSimple\nShort Term Bank Facilities\n", _small, "\nIVR ", _short,
        "\nAssigned\nSimple\nTotal 51.50\nDetailed Rationale"),
    cat("Summary of rating action\nInstrument* Previous Rated Amount Current Rated Amount\n(in crore)\nLong-term - Fund based -\nCash credit 8.00 ", _amount, " [ICRA]", _long, " (", _mood, "); ", _lowered, "\nShort-term - Non-fund based limits (sublimit) 13.76 ", _small, " [ICRA]", _short, "; reaffirmed\nTotal 21\nRationale"),
)
TEXT = Part(*("(CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {p[k]}" for i, p in enumerate(_texts)) + " END)" for k in range(2)))


def layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, agency_key, company, text) of every rating event, in its agency's layout."""
    return spread(panel.rating_events(spark, sf_dir).select("event_id")).select("event_id", F.expr(_agency.spark).alias("agency_key"), F.expr(_name.spark).alias("company"), F.expr(TEXT.spark).alias("text"))


def q_agency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-11: the rated instruments of every document, by its agency's own grammar."""
    found = grammars.event_rows(layout_documents(spark, sf_dir), "event_id", "text", "agency_key", "company")
    return found.withColumn("amount_crore", F.round("amount_crore", 4))


def _by(**cases: str) -> str:
    return "CASE agency_key " + " ".join(f"WHEN '{a}' THEN {c}" for a, c in cases.items()) + " END"


_STARTED = _by(crisil="line LIKE 'Annexure - Details%'", care="line LIKE 'Facilities/Instruments Amount%'", india_ratings="line = 'Details of Instruments'", acuite="line LIKE 'Product Quantum%'", infomerics="line = 'Ratings'", icra="line LIKE 'Instrument*%'")
_STOPPED = _by(crisil="line = 'Criteria Details'", care="line LIKE 'Details of instruments%'", india_ratings="line = 'Analytical Approach'", acuite="line LIKE 'Total Outstanding%'", infomerics="line LIKE 'Total %'", icra="line LIKE 'Total %'")
_START = _by(care="regexp_matches(line, '^(Long-term|Short-term|Fixed deposit)')", acuite="line LIKE 'Bank Loan Ratings%'")
_END = _by(crisil="line LIKE 'Crisil %'", india_ratings="regexp_matches(line, '^(Affirmed|Reaffirmed|Upgraded|Downgraded|Assigned)$|^[^-]+ - INR')", infomerics="line = 'Simple'", icra="line LIKE '%[ICRA]%'")
_HEADS = "'Facility', 'Amount (Rs.Crore)', 'Name of Lender', 'Rating', 'Instrument Type', 'Maturity Date', 'Size of Issue (million)', 'Rating Action', 'Instrument / Facility', 'Amount', 'Current Ratings', 'Previous Ratings', '(in crore)'"
_hit = lambda p, k=0: f"nullif(regexp_extract(t, '{p}', {k}), '')"
_INSTRUMENT = _by(
    crisil=_hit("^(.*?) \\d", 1), care=_hit("^([A-Za-z-]+ (?:bank facilities|deposit))", 1).replace("[A-Za-z-]+ ", "(?:Long-term|Short-term|Fixed) "), india_ratings="coalesce(" + _hit("^([^-]+ -) INR", 1) + ", " + _hit("^(.*?) - ", 1) + ")", acuite="'Bank Loan Ratings'", infomerics=_hit("^(.*?) \\d", 1),
    icra="trim(regexp_replace(" + _hit("^(.*?) \\d", 1) + ", ' \\(.*\\)', ''))",
)
_number = lambda text: f"replace({text}, ',', '')::DOUBLE"
_AMOUNT = _by(
    crisil=_number(_hit(" (\\d[\\d.]*) ", 1)), care=_number(_hit("^[A-Za-z -]*? (\\d[\\d.]*)", 1)), india_ratings="round(" + _number(_hit("INR([\\d,.]+)", 1)) + " / 10, 4)", acuite=_number(_hit("Ratings (\\d[\\d.]*)", 1)), infomerics=_number(_hit(" (\\d[\\d.]*) ", 1)),
    icra=_number(_hit(" (\\d[\\d.]*) \\[ICRA\\]", 1)),
)
_CURRENT = _by(
    crisil=_hit("Crisil [A-D][^ ]*$"), care="CASE WHEN t LIKE '%- Withdrawn' THEN 'Withdrawn' ELSE " + _hit("(CARE .*?) (?:Reaffirmed|Upgraded|Downgraded|Assigned)", 1) + " END", india_ratings=_hit("IND [A-D][^ ]*"),
    acuite="coalesce(trim(upper(" + _hit("ACUITE (?:A[1-4]\\+?|D)(?: |$)") + ")), upper(" + _hit("(ACUITE [^ ]+ \\| (?:Stable|Positive|Negative))", 1) + "), CASE WHEN t LIKE '%Withdrawn' THEN 'Withdrawn' END)",
    infomerics="replace(" + _hit("IVR [A-D][^ /]*(?:/ Stable)?") + ", '/ ', '/')", icra=_hit("\\[ICRA\\].*$"),
)
_PREVIOUS = _by(care=_hit("from (CARE [^ ;]+)", 1), infomerics=_hit("IVR .*(IVR [^ ;]+; Stable)", 1))
_ACTION = _by(
    care="CASE WHEN t LIKE '%- Withdrawn' THEN 'Withdrawn' ELSE " + _hit("(?:Reaffirmed|Upgraded|Downgraded|Assigned).*$") + " END", india_ratings=_hit("(?:Affirmed|Reaffirmed|Upgraded|Downgraded|Assigned)$"), acuite=_hit("(?:Reaffirmed|Upgraded|Downgraded|Assigned|Withdrawn)"),
    infomerics=_hit("(?:Reaffirmed|Upgraded|Downgraded|Assigned) Simple$"), icra=_hit("; (.*)$", 1),
)
AGENCY_ROWS_SQL = sql(
    """SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY nth))::INT AS place, instrument, round(amount_crore, 4) AS amount_crore, current_rating, previous_rating, action FROM (SELECT * FROM read UNION ALL SELECT * FROM bonds)""",
    f"docs AS (SELECT event_id, {_agency.sql} AS agency_key, {TEXT.sql} AS text FROM rating_events)",
    "lines AS (SELECT event_id, agency_key, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT event_id, agency_key, string_split(text, chr(10)) AS l FROM docs WHERE agency_key <> 'brickwork'))",
    f"bounds AS (SELECT *, coalesce(bool_or({_STARTED}) OVER (PARTITION BY event_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside, bool_or({_STOPPED}) OVER (PARTITION BY event_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS outside FROM lines)",
    f"kept AS (SELECT *, coalesce({_START}, false)::INT AS starts, coalesce({_END}, false)::INT AS ends FROM bounds WHERE inside AND NOT outside AND line NOT IN ({_HEADS}))",
    "grouped AS (SELECT *, sum(starts) OVER (PARTITION BY event_id ORDER BY pos ROWS UNBOUNDED PRECEDING) + coalesce(sum(ends) OVER (PARTITION BY event_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM kept)",
    "told AS (SELECT event_id, agency_key, grp, string_agg(line, ' ' ORDER BY pos) AS t FROM grouped GROUP BY 1, 2, 3)",
    f"fields AS (SELECT event_id, agency_key, grp, {_INSTRUMENT} AS instrument, {_AMOUNT} AS amount_crore, {_CURRENT} AS current_rating, {_PREVIOUS} AS previous_rating, {_ACTION} AS action FROM told)",
    "read AS (SELECT event_id, min(grp) AS nth, instrument, sum(amount_crore) AS amount_crore, current_rating, previous_rating, action FROM fields GROUP BY event_id, instrument, current_rating, previous_rating, action, CASE WHEN agency_key = 'crisil' THEN 0 ELSE grp END)",
    """columns AS (SELECT event_id, term.label AS instrument, term.nth AS nth, regexp_extract(replace(text, chr(10), ' '), term.label || ' (BWR .*?) (?:Short term|Non Fund)', 1) AS body FROM docs, (VALUES ('Long Term', 1), ('Short Term', 2)) AS term(label, nth) WHERE agency_key = 'brickwork')""",
    """tokens AS (SELECT *, regexp_extract_all(body, 'BWR [^ ]+') AS found FROM columns)""",
    """bonds AS (SELECT event_id, nth, instrument, NULL::DOUBLE AS amount_crore, CASE WHEN len(found) > 1 THEN found[2] WHEN body LIKE '%Withdrawn%' THEN 'Withdrawn' ELSE found[1] END AS current_rating, CASE WHEN len(found) > 1 THEN found[1] END AS previous_rating,
  nullif(regexp_extract(body, '(Upgrade|Withdrawn|Reaffirmed)', 1), '') AS action FROM tokens)""",
)

QUERIES = {"agency_rows": (q_agency_rows, AGENCY_ROWS_SQL)}
