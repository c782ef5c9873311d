"""Rating documents, registry fields and pages on hand-written cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import cues, documents, joins, pages, registry

CARE = """Press Release
Meadow Oils Limited
March 5, 2022
Facilities/Instruments Amount (Rs. crore) Ratings1 Rating Action
Long Term Bank Facilities 12.50 CARE BB+; Stable Reaffirmed
Long Term / Short Term
Bank Facilities 7.00 CARE BB+; Stable /
CARE A4+ Revised from CARE BBB-; Negative
Fixed deposits - Withdrawn
Total 19.50
Details of instruments/facilities in Annexure-1
Key strengths
• Experienced promoters
• Low gearing and
healthy cover
"""
ICRA = """June 12, 2021
Hill Mills Limited: Ratings upgraded
Summary of rating action
Instrument* Current rated amount Rating
Long-term - Fund based 40.00 [ICRA]A+ (Stable); upgraded from [ICRA]A (Positive)
Short-term - Non-fund based 10.00 [ICRA]A1+; reaffirmed
Total 50.00
*Instrument details are provided in Annexure-1
Rationale
The ratings consider association with a group company. Liquidity: Adequate
"""
QUOTE = "Rating Rationale\nJanuary 03, 2020 | Mumbai\nCRISIL has reaffirmed its rating on the bank facilities at 'CRISIL AA-/Stable'. Nothing else."
IND = "India Ratings and Research\nInstrument Type Size of Issue Rating\nTerm loan INR500 IND BBB/Positive Affirmed\nWorking capital INR1,200.5 IND BBB/IND A3+ Downgraded from IND A2\nKey Rating Drivers\nx"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "care", CARE), (2, "icra", ICRA), (3, "crisil", QUOTE), (4, "india_ratings", IND), (5, "acuite", None), (6, "unknown", CARE)], "id int, agency string, text string")


def test_rating_rows(docs):
    got = {(r["id"], r["place"]): (r["instrument"], r["amount_crore"], r["current_rating"], r["previous_rating"], r["action"], r["found_by"]) for r in documents.rating_rows(docs, "id", "text", "agency").collect()}
    assert got == {
        (1, 1): ("Long Term Bank Facilities", 12.5, "CARE BB+; Stable", None, "Reaffirmed", "table"),
        (1, 2): ("Long Term / Short Term Bank Facilities", 7.0, "CARE BB+; Stable / CARE A4+", "CARE BBB-; Negative", "Revised", "table"),
        (1, 3): ("Fixed deposits", None, "Withdrawn", None, "Withdrawn", "table"),
        (2, 1): ("Long-term - Fund based", 40.0, "[ICRA]A+ (Stable)", "[ICRA]A (Positive)", "Upgraded", "table"),
        (2, 2): ("Short-term - Non-fund based", 10.0, "[ICRA]A1+", None, "Reaffirmed", "table"),
        (3, 1): ("Credit update", None, "CRISIL AA-/Stable", None, "Credit Update", "prose"),
        (4, 1): ("Term loan", 50.0, "IND BBB/Positive", None, "Affirmed", "table"),
        (4, 2): ("Working capital", pytest.approx(120.05), "IND BBB/IND A3+", "IND A2", "Downgraded", "table"),
    }


def test_facts(docs):
    rows = {r["id"]: r for r in docs.select("id", documents.company_name(F.col("text"), F.col("agency"), F.lit("x/pdf_some-firm_ltd.txt")).alias("name"), documents.first_date(F.col("text")).alias("day"), *(c.alias(n) for n, c in documents.prose_rating(F.col("text")).items())).collect()}
    assert [rows[i]["name"] for i in range(1, 6)] == ["Meadow Oils Limited", "Hill Mills Limited", "some firm ltd", "some firm ltd", "some firm ltd"]
    assert [rows[i]["day"] for i in range(1, 6)] == [date(2022, 3, 5), date(2021, 6, 12), date(2020, 1, 3), None, None]
    assert (rows[3]["rating"], rows[3]["rating_scale"], rows[3]["extraction_method"]) == ("AA", "long_term", "headline_rating")
    assert rows[5]["rating"] is None


def test_sections_points_and_signals(docs):
    found = {(r["id"], r["section"]): r["body"] for r in documents.sections(docs, "id", "text").collect()}
    assert found[2, "rationale"].startswith("The ratings consider") and found[1, "strengths"].startswith("• Experienced")
    items = documents.bullets(documents.sections(docs, "id", "text").filter("section = 'strengths' and id = 1"), "id", "body")
    assert [r["item"] for r in items.orderBy("place").collect()] == ["Experienced promoters", "Low gearing and healthy cover"]
    flags = docs.select("id", *(c.alias(n) for n, c in documents.signals(F.col("text")).items())).filter("id = 2").first()
    assert {n for n in documents.SIGNALS if flags[n]} == {"has_group_support", "has_liquidity_adequate"} and len(documents.SIGNALS) == 22
    assert documents.sections(docs.limit(0), "id", "text").count() == 0


def test_first_date_skips_what_is_no_date(spark):
    rows = spark.createDataFrame([("on February 31, 2020 and 12Mar2021",), ("May 2019, then 3 June 2018",), ("45 March 2024",), ("",)], "t string")
    assert [r[0] for r in rows.select(documents.first_date(F.col("t"))).collect()] == [date(2021, 3, 12), date(2019, 5, 1), date(2024, 3, 1), None]


def test_contacts(spark):
    text = "Email: A.B@x.org or a.b@X.org\nTel: +91 22 6100 0000, 022-61000000\nMobile 98765 43210 and 9876543210\nCIN contact L12345678901\nEmail c@d.co e@f.co"
    mails, phones = spark.createDataFrame([(text,)], "t string").select(*(c.alias(n) for n, c in zip(("m", "p"), documents.contacts(F.col("t"))))).first()
    assert mails == ["A.B@x.org", "c@d.co"] and phones == ["+91 22 6100 0000", "022-61000000"]


def test_registry_fields(spark):
    labels = spark.createDataFrame([("Rating update 4 Jul from crisil",), ("Rating update 12 January 2021 from CARE",), ("Rating update soon",), (" Rating update ",), (None,)], "t string")
    got = [tuple(r) for r in labels.select(*registry.update_label(F.col("t"), 2025).values()).collect()]
    assert got[0] == (date(2025, 7, 4), "4 Jul", "crisil", "Year inferred as 2025.") and got[1] == (date(2021, 1, 12), "12 January 2021", "care", None)
    assert got[2][0] is None and "Could not parse" in got[2][3] and got[3][3] == got[4][3] == "Rating update label was empty."
    keys = spark.createDataFrame([("CARE Ratings",), ("india rating & co",), ("Smera x",), (None,), ("Odd & Even",)], "t string")
    assert [r[0] for r in keys.select(registry.agency_key(F.col("t"))).collect()] == ["care", "india_ratings", "acuite", None, "odd_and_even"]


def test_context_ids_come_from_names_only_if_all_are_blank(spark):
    rows = spark.createDataFrame([("", "Alpha Agro!", "2025-03-31", "712", "yes"), (None, "B", "x", "y", "z")], "company_id string, company_name string, as_of_date string, promoter_bureau_score string, criminal_case_flag string")
    got = registry.normalised_context(rows).collect()
    assert [(r["company_id"], r["as_of_date"], r["promoter_bureau_score"], r["criminal_case_flag"], r["source_type"]) for r in got] == [("Alpha_Agro", date(2025, 3, 31), 712.0, True, "manual_context"), ("B", None, None, False, "manual_context")]
    some = registry.normalised_context(rows.withColumn("company_id", F.when(F.col("company_name") == "B", "b1")))
    assert sorted(r["company_id"] for r in some.collect()) == ["", "b1"]
    assert registry.context_status(registry.normalised_context(rows.limit(0))).first()["status"] == "empty"


def test_page_cells(spark):
    html = "<title>T &amp; x</title><h1>Head</h1><table><tr><th>m<th>2020<th>2021<tr><td>Sales<td>1<td> 2\n0 </table><p><table><tr><td>lone</table>"
    found = pages.cells(spark.createDataFrame([(1, html), (2, None), (3, "<td>stray")], "k int, html string"), "k", "html")
    assert {(r["k"], r["metric"], r["period"], r["value"]) for r in pages.matrices(found, "k").collect()} == {(1, "Sales", "2020", "1"), (1, "Sales", "2021", "2 0")}
    assert [tuple(r) for r in pages.identity(found, "k").collect()] == [(1, "T & x", "Head")]


def test_asof_window_and_peers_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    day = lambda n: date.fromordinal(date(2020, 1, 1).toordinal() + n)
    events = [(i, rng.randint(0, 3), day(rng.randint(0, 400)) if i % 9 else None) for i in range(60)]
    periods = [(k, day(d), float(d)) for k in range(3) for d in rng.sample(range(400), 40)]
    got = joins.asof_window(spark.createDataFrame(events, "e int, k int, d date"), spark.createDataFrame(periods, "k int, p date, v double"), "k", "e", "d", "p", 30, 3)
    expected = set()
    for e, k, d in events:
        near = sorted((p for kk, p, _ in periods if d and kk == k and (d - p).days >= 30), reverse=True)[:3]
        expected |= {(e, p, i + 1) for i, p in enumerate(near)}
    assert {(r["e"], r["p"], r["recency"]) for r in got.collect()} == expected

    found = [(g, c, 2.0 ** rng.uniform(-6, 6) if rng.random() < 0.9 else 4.0, s) for g in "xy" for c in range(40) for s in range(3)] + [("z", 99, 1.0, 0)]
    targets = [(g, c, 2.0 ** rng.uniform(-6, 6) if c % 7 else 4.0) for g in "xyz" for c in range(40)]
    t = spark.createDataFrame([(g, c, v, f"{g}{c}") for g, c, v in targets], "g string, own int, v double, target string")
    near = joins.nearest_by_ratio(t, spark.createDataFrame(found, "g string, own int, v double, s int"), "g", "own", "v", ["s"], 5)
    import math

    expected = set()
    for g, c, v in targets:
        pairs = sorted((abs(math.log(w / v)), p, s, v / 2 <= w <= v * 2) for gg, p, w, s in found if gg == g and p != c)
        inside = [x for x in pairs if x[3]] or pairs
        expected |= {(f"{g}{c}", p, s, b) for _, p, s, b in inside[:5]}
    assert {(r["target"], r["_peer"], r["s"], r["in_band"]) for r in near.collect()} == expected


def test_cues(spark):
    rows = spark.createDataFrame([(1, 10.0, True, None), (2, 1.0, False, 1.0), (3, None, False, -1.0)], "id int, ebitda_margin_pct double, has_fx_risk boolean, plan_gap double")
    assert {r["id"]: r["key_features"] for r in cues.key_features(rows).collect()} == {1: ["healthy EBITDA margins", "foreign exchange risk"], 2: [cues.NO_CUE], 3: [cues.NO_CUE]}
