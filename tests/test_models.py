"""Trees and agency models: exact small trees, learnable labels learned, categories, holes, folds, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import forests, models
from ledgerline.plans import model_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    return spark.range(80).select(k.alias("event_id"), F.lit("one").alias("agency"), (1 + k % 3).cast("int").alias("rank"), F.when(k % 10 != 0, (k % 3) * 10.0 + k % 2).alias("size"), F.lit(None).cast("double").alias("empty"), F.when(k % 3 == 0, "a").otherwise("b").alias("kind"), F.lit("x").alias("constant"))


def test_trees_are_grown_out_and_leaves_are_pure():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 6)).astype(np.float32), rng.integers(0, 5, 300)
    nodes, gained = forests.grow(x, y, np.ones(300), 4, rng, 2, 1, 5)
    found = forests.predict(nodes, 4, x) / 4
    assert (found.argmax(1) == y).all() and np.allclose(found.max(1), 1) and (gained >= 0).all()
    inner = nodes["feature"] >= 0
    assert inner.sum() + 4 == (~inner).sum() and len(nodes["value"]) == (~inner).sum()


def test_every_split_parts_its_rows_and_regressor_leaves_hold_two():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 4, (200, 3)).astype(np.float32), rng.normal(size=200)
    nodes, _ = forests.grow(x, y, np.ones(200), 3, rng, 3, 2, 0)
    for tree in range(3):
        at = np.full(200, tree)
        while (nodes["feature"][at] >= 0).any():
            f = nodes["feature"][at]
            at = np.where(f < 0, at, nodes["left"][at] + (x[np.arange(200), np.maximum(f, 0)] > nodes["threshold"][at]))
        leaves, sizes = np.unique(at, return_counts=True)
        assert sizes.min() >= 2
        for leaf in leaves:
            assert np.isclose(nodes["value"][nodes["slot"][leaf], 0], y[at == leaf].mean(), atol=1e-5)


def test_weights_balance_labels():
    """One row in fifty of a label that nothing tells apart: balanced leaves give it half."""
    x, y = np.zeros((50, 1), np.float32), np.array([1] + [0] * 49)
    weight = 50 / (2 * np.bincount(y)[y])
    nodes, _ = forests.grow(x, y, weight, 1, np.random.default_rng(0), 1, 1, 2)
    assert np.allclose(forests.predict(nodes, 1, x[:1]), 0.5)


def test_design_fills_holes_and_ignores_what_tells_nothing():
    design = forests.Design(np.array([[1.0, np.nan], [3.0, np.nan], [np.nan, np.nan]]), [["a", "x"], ["b", "x"], [None, "x"]])
    assert design.base.tolist() == [0, 2, 2, 2]
    assert design.matrix(np.array([[np.nan, 7.0]]), [["new", "y"]]).tolist() == [[2.0, 0, 0, 0]]
    assert design.matrix(np.array([[5.0, 7.0]]), [[None, "y"]]).tolist() == [[5.0, 1.0, 0, 0]]


def test_models_learn_and_score(rows):
    scores, weights = models.per_agency(rows, "agency", ["size", "empty"], ["kind", "constant"], "rank", "event_id", trees=30)
    got = scores.collect()
    assert len(got) == 80 and sum(r["held_out"] for r in got) == 21
    held = [r for r in got if r["held_out"]]
    assert sum(abs(r["predicted_rank"] - r["rank"]) <= 1 for r in held) / len(held) >= 0.9
    assert all(0 < r["share"] <= 1 and r["second_rank"] != r["predicted_rank"] for r in got)
    found = {r["base_feature"]: r["importance"] for r in weights.collect()}
    assert abs(sum(found.values()) - 1) < 1e-9 and found["empty"] == found["constant"] == 0


def test_a_model_s_sample_is_bounded_and_drawn_by_key(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") < 4900, "large").otherwise("small").alias("m"))
    once, again = (forests.sampled(rows.repartition(n), "m", "k", 300) for n in (2, 5))
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in again.collect()}
    assert {r["m"]: r["count"] for r in once.groupBy("m").count().collect()} == {"large": 300, "small": 100}


def test_rows_without_a_model_and_small_batches(spark, rows):
    trained = models.fit(rows.filter("event_id < 60"), "agency", ["size"], ["kind"], "rank", "event_id", 10)
    other = rows.withColumn("agency", F.when(F.col("event_id") % 4 == 0, "none").otherwise(F.col("agency")))
    got = models.score(other.repartition(7), trained, "agency", ["size"], ["kind"]).collect()
    assert len(got) == 80 and all((r["predicted_rank"] is None) == (r["agency"] == "none") for r in got)


def test_the_same_rows_give_the_same_trees(spark, rows):
    first, second = (forests.train(rows.repartition(n).select(F.col("agency").alias("model"), F.col("event_id").cast("string").alias("row_key"), F.col("rank").alias("label"), *forests.inputs(["size"], ["kind"])), 1, 19, 30) for n in (1, 4))
    blobs = lambda df: {(r["kind"], r["block"]): r["importances"] for r in df.collect()}
    assert blobs(first) == blobs(second) and len(blobs(first)) == 4


def test_models_are_saved_with_an_index(spark, rows, tmp_path):
    scores, _ = models.per_agency(rows, "agency", ["size"], ["kind"], "rank", "event_id", 10, f"file://{tmp_path}")
    (index,) = models.load_index(spark, f"file://{tmp_path}").collect()
    assert (index["agency"], index["n_rows"], index["n_classes"]) == ("one", 59, 3)
    again = models.score(rows, models.load(spark, f"file://{tmp_path}"), "agency", ["size"], ["kind"])
    assert {r["event_id"]: r["predicted_rank"] for r in again.collect()} == {r["event_id"]: r["predicted_rank"] for r in scores.collect()}


def test_grouped_validation_never_sees_a_company_of_its_fold(spark, monkeypatch):
    k = F.col("id")
    rows = spark.range(120).select(
        k.alias("event_id"), F.when(k < 80, "many").when(k < 100, "two").otherwise("single").alias("agency"), F.when(k < 80, k % 27).when(k < 100, k % 2).otherwise(0).alias("company"),
        (1 + k % 3).cast("int").alias("rank"), (k % 3).cast("double").alias("size"),
    )
    met = {}

    def train(samples, *args):
        for r in samples.select("model", "row_key").collect():
            met.setdefault(r["model"], set()).add(int(r["row_key"]))
        return real(samples, *args)

    real = forests.train
    monkeypatch.setattr(models.forests, "train", train)
    out = models.grouped_validation(rows, "agency", "company", ["size"], [], "rank", "event_id", 10).collect()
    assert len(out) == 120 and all(r["predicted_rank"] == r["rank"] for r in out if r["agency"] != "two")
    company = {r["event_id"]: (r["agency"], r["company"]) for r in out}
    for r in out:
        seen = {company[e] for e in met[f"{r['agency']}/{r['fold']}"]}
        assert ((r["agency"], r["company"]) in seen) == (r["agency"] == "single") and {a for a, _ in seen} == {r["agency"]}
    assert {(r["agency"], r["mode"]) for r in out} == {("many", "grouped_folds"), ("two", "leave_one_company_out"), ("single", "in_sample_fallback_single_company")}


def test_all_outputs_of_the_validation(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "FOLD_TREES", 5)
    monkeypatch.setattr(models, "TREES", 10)
    monkeypatch.setattr(model_queries, "_done", {})
    events, companies, agencies = (model_queries.QUERIES[n][0](spark, SF).collect() for n in ("validation_events", "validation_companies", "grouped_validation"))
    assert sum(r["rows_evaluated"] for r in agencies) == sum(r["rows_evaluated"] for r in companies) == len(events) > 0
    for r in agencies:
        own = [e for e in events if e["agency"] == r["agency"]]
        assert abs(r["exact_match_accuracy"] - sum(e["exact_match"] for e in own) / len(own)) < 1e-9 and r["companies_evaluated"] == len({e["company_id"] for e in own})
    report = model_queries.q_learning_report(spark, SF).collect()
    assert {r["agency"] for r in report} == {r["agency"] for r in agencies} and any(r["line"].startswith("Excluded, ") for r in report)
    scores = model_queries.q_model_scores(spark, SF)
    assert scores.count() == len(events) and not any(c.startswith("debt_to_equity") for c in model_queries._rows(spark, SF)[1])
    assert {r["saved"] for r in model_queries.q_model_index(spark, SF).collect()} == {True}


def test_rows_that_walk_together_reach_the_leaves_of_a_plain_walk(monkeypatch):
    """pairs that have come to a leaf walk no further; sums are the same to the last bit, with pure and mixed leaves."""
    rng = np.random.default_rng(5)
    x, asked = rng.integers(0, 5, (300, 4)).astype(np.float32), rng.normal(2, 3, (700, 4)).astype(np.float32)
    y = rng.integers(0, 6, 300)
    monkeypatch.setattr(forests, "WALKED", 256)
    for nodes in (forests.grow(x, y, rng.random(300), 7, rng, 2, 1, 6)[0], forests.grow(x, y.astype(float), np.ones(300), 7, rng, 4, 2, 0)[0]):
        at, steps = np.tile(np.arange(7), (700, 1)), 0
        while (nodes["feature"][at] >= 0).any():
            f = nodes["feature"][at]
            at, steps = np.where(f < 0, at, nodes["left"][at] + (asked[np.arange(700)[:, None], np.maximum(f, 0)] > nodes["threshold"][at])), steps + 1
        found = forests.walk(forests.walkable(nodes), 7, asked)
        assert steps > 5 and (found == nodes["value"][nodes["slot"][at]].sum(1, dtype=float)).all()


def test_index_importances_and_report_score_no_row_by_the_published_models(spark, monkeypatch):
    """only model_scores needs the scores."""
    monkeypatch.setattr(model_queries, "FOLD_TREES", 2)
    monkeypatch.setattr(models, "TREES", 3)
    monkeypatch.setattr(model_queries, "_done", {})
    asked, real = [], models.score
    monkeypatch.setattr(models, "score", lambda rows, trained, by, *more: asked.append(by) or real(rows, trained, by, *more))
    for name in ("model_index", "model_importances", "learning_report"):
        assert model_queries.QUERIES[name][0](spark, SF).count() > 0
    assert asked == ["_model"]
    assert model_queries.q_model_scores(spark, SF).count() > 0 and asked == ["_model", "agency"]


def _labelled(spark, n, agency, company):
    k = F.col("id")
    return spark.range(n).select(k.alias("event_id"), agency(k).alias("agency"), company(k).alias("company"), (1 + k % 3).cast("int").alias("rank"), (k % 3 + F.rand(1)).alias("size"), F.concat(F.lit("k"), (k % 4).cast("string")).alias("kind"))


def test_a_model_learns_from_all_of_its_rows(spark):
    """an agency's model saw 2,000 of its rows at most."""
    rows = _labelled(spark, 2_700, lambda k: F.when(k < 2_600, "large").otherwise("small"), lambda k: k)
    fitted = models.fit(rows, "agency", ["size"], ["kind"], "rank", "event_id", 2)
    assert {(r["model"], r["kind"], r["n_rows"]) for r in fitted.collect()} == {(m, k, n) for m, n in (("large", 2_600), ("small", 100)) for k in ("classifier", "regressor")}
    scored = models.score(rows, fitted, "agency", ["size"], ["kind"]).collect()
    assert len(scored) == 2_700 and all(r["predicted_rank"] == r["rank"] for r in scored)


def test_a_fold_s_model_learns_from_all_rows_of_the_other_folds(spark, monkeypatch):
    """the folds of an agency shared 2,000 of its rows at most."""
    rows, met = _labelled(spark, 2_400, lambda k: F.lit("one"), lambda k: k % 3), []
    real = forests.train
    monkeypatch.setattr(models.forests, "train", lambda samples, *args: met.extend(samples.groupBy("model").count().collect()) or real(samples, *args))
    out = models.grouped_validation(rows, "agency", "company", ["size"], ["kind"], "rank", "event_id", 2)
    assert {r["model"]: r["count"] for r in met} == {f"one/{f}": 1_600 for f in range(3)} and out.count() == 2_400


def test_bands_have_exact_edges(spark):
    """the edges came from a sketch, a tenth of a per cent of the rows off at most."""
    hidden = model_queries.HIDDEN
    k = F.col("id")
    rows = spark.range(6_000).select(k.alias("event_id"), F.lit("one").alias("agency"), F.lit(3).alias("rating_rank"), F.when(k % 7 != 0, F.pmod(F.xxhash64(k), F.lit(1 << 40)).cast("double")).alias(hidden), F.lit(0.0).alias(f"{hidden}_delta1y"))
    seen = sorted(r[0] for r in model_queries.ratings.hold_out(rows, "agency", "rating_rank", "event_id").filter(f"not held_out and {hidden} is not null").select(hidden).collect())
    edges = [seen[int(np.ceil(q * len(seen))) - 1] for q in model_queries.EDGES]
    noise = {r["event_id"]: r["n"] for r in rows.select("event_id", F.when(F.pmod(F.xxhash64("event_id"), F.lit(8)) == 0, 1).otherwise(0).alias("n")).collect()}
    got = model_queries.learnable(rows).select("event_id", "rating_rank", hidden).collect()
    assert len(got) == 5_142 and all(r["rating_rank"] == 5 + sum(r[hidden] > e for e in edges) + noise[r["event_id"]] for r in got)


def test_levels_and_portions_give_the_trees_of_plain_columns(monkeypatch):
    """Levels of a category grow the same trees as columns of zeros and ones; nodes split in portions grow whole trees; packed nodes are the same nodes."""
    rng = np.random.default_rng(7)
    x, code = rng.normal(size=(500, 3)).astype(np.float32), rng.integers(0, 5, 500).astype(np.int32)
    wide, y = np.concatenate([x, code[:, None] == np.arange(5)], 1).astype(np.float32), rng.integers(0, 6, 500)
    for label, candidates, least, classes in ((y, 2, 1, 6), (y.astype(float), 8, 2, 0)):
        plain, some = (forests.grow(a, label, np.ones(500), 5, np.random.default_rng(3), candidates, least, classes, c) for a, c in ((wide, []), (x, [(code, 5)])))
        assert all((plain[0][k] == some[0][k]).all() for k in plain[0]) and (plain[1] == some[1]).all()
        again = forests.unpacked(forests.packed(plain[0], 5))
        assert all((again[k] == plain[0][k]).all() for k in ("feature", "threshold", "left")) and (forests.predict(again, 5, wide) == forests.predict(plain[0], 5, wide)).all()
        monkeypatch.setattr(forests, "PORTION", 40)
        cut, _ = forests.grow(x, label, np.ones(500), 5, np.random.default_rng(3), candidates, least, classes, [(code, 5)])
        monkeypatch.undo()
        if classes:
            assert (forests.predict(cut, 5, wide).argmax(1) == y).all() and np.allclose(forests.predict(cut, 5, wide).max(1), 5)
        else:
            assert np.isclose(forests.predict(cut, 5, wide).mean(), 5 * y.mean(), atol=1e-3)


def test_many_blocks_and_copies_score_like_one(spark, rows, monkeypatch):
    monkeypatch.setattr(forests, "PAIRS", 160)
    fitted = models.fit(rows, "agency", ["size"], ["kind"], "rank", "event_id", 10)
    assert sorted((r["kind"], r["block"], r["trees"]) for r in fitted.collect())[:6] == [*(("classifier", b, 2) for b in range(5)), ("regressor", 0, 2)]
    shares = []
    for scored in (1_000, 9):
        monkeypatch.setattr(forests, "SCORED", scored)
        shares.append({r["event_id"]: (tuple(r["shares"]), r["rank_prediction"]) for r in forests.score(rows, fitted, "agency", ["size"], ["kind"], 19).collect()})
    assert len(shares[0]) == 80 and shares[0] == shares[1]
