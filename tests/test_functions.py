"""Golden values of the scalar functions and of the small operators."""

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import joins, sets


def values(spark, schema, data, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_numbers(spark):
    got = values(spark, "c string", [("₹ 1,234 Cr.",), ("15%",), ("(10)",), ("NaN",), ("-",), (None,)], S.parse_number(F.col("c")))
    assert got == [1234.0, 15.0, -10.0, None, None, None]


def test_names_and_codes(spark):
    assert values(spark, "c string", [("Sun Pharma. Inds Ltd.",), (None,)], S.normalise_name(F.col("c"))) == ["sun pharma inds ltd", None]
    assert values(spark, "c string", [("500087.0",), (" sunpharma ",), ("NaN",)], S.normalise_code(F.col("c"))) == ["500087", "SUNPHARMA", None]
    assert values(spark, "a string, b string, c string", [("Abbott India", None, "500488")], S.surrogate_id(F.col("a"), F.col("b"), F.col("c"))) == ["Abbott_India__500488"]


def test_dates(spark):
    got = values(spark, "c string", [("12Jan2024",), ("July 4 , 2024",), ("Mar 2025",), ("31/12/2023",), ("x",)], S.parse_date(F.col("c")).cast("string"))
    assert got == ["2024-01-12", "2024-07-04", "2025-03-01", "2023-12-31", None]


def test_lists_and_maps(spark):
    assert values(spark, "c string", [('["a", "b"]',), ("['a', '']",), ("x",), ("",)], S.list_of(F.col("c"))) == [["a", "b"], ["a"], ["x"], []]
    rank = F.create_map(F.lit("BBB"), F.lit(9), F.lit("A"), F.lit(6))
    assert values(spark, "m map<string,double>", [({"BBB": 0.5, "A": 0.5},)], S.best_of_map(F.col("m"), rank)) == ["A"]


def test_window_fixture(spark):
    rows = [("c", "2022-03-31", 100.0), ("c", "2023-03-31", 120.0), ("c", "2024-03-31", 150.0)]
    periods = spark.createDataFrame(rows, "company_id string, p string, revenue double").withColumn("p", F.to_date("p"))
    events = spark.createDataFrame([(1, "c", "2024-08-01")], "event_id long, company_id string, d string").withColumn("d", F.to_date("d"))
    near = joins.asof_window(events, periods, "company_id", "event_id", "d", "p", 90, 4)
    from ledgerline.operators.windows import history_features

    row = history_features(near, ["event_id"], ["revenue"], "p").first()
    assert row["depth"] == 3 and round(row["revenue_avg3y"], 4) == 123.3333 and row["revenue_delta1y"] == 30.0 and round(row["revenue_slope3y"], 9) == 25.0


def test_upsert_keeps_other_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3)], "id string, v int")
    assert sorted(map(tuple, sets.upsert(old, new, ["id"], F.col("v").desc()).collect())) == [("a", 1), ("b", 3)]
