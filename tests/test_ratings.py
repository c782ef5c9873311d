"""Rating labels, records and splits against golden values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ratings


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CARE BBB", ("long_term", "BBB", 9, None, None)),
        ("[ICRA]AA- (Stable)", ("long_term", "AA-", 4, "Stable", None)),
        ("CRISIL P1+ ; on Watch", ("short_term", "A1+", 1, None, "Watch")),
        ("BWR A4/negative", ("short_term", "A4", 8, "Negative", None)),
        ("IVR P5", ("short_term", "D", 9, None, None)),
        ("AAAB", (None, None, None, None, None)),
        ("", (None, None, None, None, None)),
        (None, (None, None, None, None, None)),
    ],
)
def test_rating_columns(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(*(c.alias(n) for n, c in ratings.rating_columns(F.col("x")).items())).first()
    assert tuple(got[c] for c in ("scale", "label", "rank", "outlook", "watch")) == want


def test_states_and_actions(spark):
    rows = spark.createDataFrame([("B+ Issuer  Not Cooperating; reaffirmed",), ("continues to remain",), ("A withdrawn",), (None,)], "x string")
    states = ratings.rating_columns(F.col("x"))
    got = rows.select(*(states[s].alias(s) for s in ratings.STATES), ratings.rating_action(F.col("x")).alias("action")).collect()
    assert tuple(got[0]) == (False, True, True, False, "Reaffirmed")
    assert got[1]["action"] == "Continues to Remain"
    assert (got[2]["is_withdrawn"], got[2]["action"]) == (True, "Withdrawn")
    assert tuple(got[3]) == (False, False, False, False, None)


def test_record_takes_the_previous_rank(spark):
    rows = spark.createDataFrame([(1, date(2020, 1, 1), "BBB (Stable)", None, "Term Loan"), (1, date(2021, 1, 1), "withdrawn", "BBB (Stable)", None)], "c int, d date, now string, before string, kind string")
    got = ratings.rating_records(rows, ["c"], ["d"], "now", "before", "kind").orderBy("d").collect()
    assert [(r["record_id"], r["rank"], r["is_withdrawn"]) for r in got] == [("1__term_loan__01", 9, False), ("1__event_2__02", 9, True)]


def test_liquidity_and_kinds(spark):
    rows = spark.createDataFrame([("PRESS RELEASE: liquidity: strong",), ("rating rationale; Liquidity remains stretched",), (None,)], "x string")
    text = F.coalesce("x", F.lit(""))
    got = rows.select(ratings.first_label(F.col("x"), ratings.DOCUMENT_KINDS, ratings.OTHER_KIND), ratings.first_pattern([text], ratings.LIQUIDITY)).collect()
    assert [tuple(r) for r in got] == [("press_release", "Strong"), ("rating_rationale", "Stretched"), ("credit_rating_report", None)]
    got = rows.limit(1).select(ratings.first_label(F.lit("CareEdge Ratings and ICRA"), ratings.AGENCIES), ratings.all_labels(F.lit("RXIL on TReDS"), ratings.PLATFORMS)).first()
    assert tuple(got) == ("care", ["RXIL", "TReDS"])


def test_hold_out_is_stratified(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") < 30, "big").otherwise("small").alias("g"), F.when(F.col("id") < 30, F.col("id") % 2).otherwise(F.col("id")).alias("label"))
    got = {(r["g"], r["label"]): r["n"] for r in ratings.hold_out(rows, "g", "label", "id").filter("held_out").groupBy("g", "label").agg(F.count("*").alias("n")).collect()}
    assert got == {("big", 0): 4, ("big", 1): 4}
