"""Ranks, quantiles and as-of lookups of groups with very many rows, against numpy and hand-made loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import joins, order_stats


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.0, -1.5, 1e-9, -1e12, rng.uniform(-5, 5), float(rng.randint(0, 3))])) for _ in range(4000)] + [("small", x) for x in (2.0, 1.0, None, float("nan"))] + [("one", 7.0), ("none", None)]
    return rows, spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id int, g string, v double")


def known(rows, g):
    return np.array([v for k, v in rows if k == g and v is not None and v == v])


def test_quantiles_equal_numpy(values):
    rows, df = values
    ranked = order_stats.ranked_values(order_stats.melted(df, ["g"], ["v"]), ["g", "metric"])
    names = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    got = {r["g"]: r for r in order_stats.quantiles(ranked, ["g", "metric"], names).collect()}
    assert set(got) == {"hot", "small", "one"}
    for g, r in got.items():
        for name, q in names.items():
            assert r[name] == pytest.approx(np.quantile(known(rows, g), q), abs=1e-9)


def test_ranks_count_values_up_to_each(values):
    rows, df = values
    for r in order_stats.ranked_values(order_stats.melted(df, ["g"], ["v"]), ["g"]).collect():
        own = known(rows, r["g"])
        assert (r["upto"], r["times"], r["total"]) == ((own <= r["value"]).sum(), (own == r["value"]).sum(), len(own))


def test_peer_positions_by_hand(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, None), (2, "a", 2.0, 5.0), (3, "a", 2.0, None), (4, "a", None, None), (5, "b", 9.0, None)], "id int, g string, x double, y double")
    got = {r["id"]: tuple(r)[2:] for r in order_stats.peer_positions(rows, ["id"], ["g"], {"x": "x", "y": "other"}).orderBy("id").collect()}
    assert got == {1: (-1.0, 1 / 3, None, None), 2: (0.0, 1.0, 0.0, 1.0), 3: (0.0, 1.0, None, None), 4: (None,) * 4, 5: (0.0, 1.0, None, None)}


def test_no_window_holds_a_group(values):
    """Every window over rows is parted by a range of values as well; only those over ranges see a whole group."""
    plan = order_stats.ranked_values(values[1].select("g", F.col("v").alias("value")), ["g"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) >= 2 and all("_r#" in line or "_n#" in line for line in windows)


def test_asof_carries_over_buckets_and_a_hot_key(spark):
    rng = random.Random(6)
    day = dt.date(2000, 1, 1)
    left = [(i, rng.choice(["hot"] * 8 + ["cold", "absent"]), day + dt.timedelta(rng.randint(0, 900)) if i % 50 else None) for i in range(1500)]
    right = [(i, rng.choice(["hot"] * 9 + ["cold"]), day + dt.timedelta(rng.choice([rng.randint(0, 100), rng.randint(500, 900)])), rng.random()) for i in range(1200)] + [(9000, "hot", None, 1.0), (9001, None, day, 1.0)]
    want = {}
    for i, k, d in left:
        near = [(rd, t, v) for t, rk, rd, v in right if rk == k and rd is not None and d is not None and rd < d]
        want[i] = max(near)[2] if near else None
    a, b = spark.createDataFrame(left, "id int, k string, d date").repartition(5), spark.createDataFrame(right, "t int, k string, at date, v double").repartition(3)
    got = joins.asof_latest(a, ["id"], "d", b, "k", "at", "t", ["v"])
    assert {r["id"]: r["v"] for r in got.collect()} == want and len(want) == 1500
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
