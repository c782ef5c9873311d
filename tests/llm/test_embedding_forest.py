"""Recall and link counts of the random-projection forest against blocked brute force."""

import numpy as np
import pyarrow as pa

from ledgerline.llm import embedding_dedup


def _brute(vectors: np.ndarray, threshold: float = 0.95) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row and all pairs: single precision finds candidates, double precision decides."""
    unit = embedding_dedup._unit(vectors)
    rough = unit.astype(np.float32)
    counts, pairs = np.zeros(len(unit), np.int64), []
    for i in range(0, len(unit), 2000):
        x, y = np.nonzero(rough[i : i + 2000] @ rough.T >= threshold - 1e-4)
        x = x + i
        keep = x < y
        x, y = x[keep], y[keep]
        keep = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
        pairs += zip(x[keep].tolist(), y[keep].tolist(), strict=True)
    for ends in zip(*pairs, strict=True):
        counts += np.bincount(ends, minlength=len(unit))
    return counts, pairs


def _planted(rng: np.random.Generator, vectors: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """A partner of each vector at the given cosine."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    away = rng.normal(size=vectors.shape)
    away -= (away * unit).sum(axis=1, keepdims=True) * unit
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return cosines[:, None] * unit + np.sqrt(1 - cosines[:, None] ** 2) * away


def _links(spark, vectors, **settings) -> np.ndarray:
    n, d = vectors.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(vectors.ravel()))
    table = spark.createDataFrame(pa.table({"gid": np.arange(n), "m": np.ones(n, np.int64), "embedding": lists})).repartition(8)
    found = embedding_dedup.embedding_links(table, **settings).groupBy("gid").sum("links").collect()
    out = np.zeros(len(vectors), np.int64)
    for gid, n in found:
        out[gid] = n
    return out


def test_recall_of_borderline_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(800, 64))
    base = centres[rng.integers(len(centres), size=96_000)] + 0.9 * rng.normal(size=(96_000, 64))
    near = _planted(rng, base[:4000], rng.uniform(0.951, 0.97, 4000))
    vectors = np.concatenate((base, near)).astype(np.float32)
    expected, pairs = _brute(vectors)
    got = _links(spark, vectors)
    assert len(pairs) >= 4000 and (got <= expected).all()
    assert got.sum() >= 0.995 * expected.sum()


def test_over_full_leaves_are_refined(spark, monkeypatch):
    rounds = []
    refined = embedding_dedup._refined
    monkeypatch.setattr(embedding_dedup, "_refined", lambda *a: rounds.append(1) or refined(*a))
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12_000, 24))
    vectors = np.concatenate((base, _planted(rng, base[:1500], rng.uniform(0.951, 0.97, 1500)), base[0] + 1e-6 * rng.normal(size=(300, 24))))
    expected, _ = _brute(vectors)
    got = _links(spark, vectors, leaf=40, block=64, sample=256)
    assert rounds and (got <= expected).all() and got.sum() >= 0.99 * expected.sum()
    assert (got[13_500:] == expected[13_500:]).all()


def test_double_components_are_not_rounded(spark):
    a = np.zeros((2, 4))
    a[0, 0] = 1.0
    #: The cosine is just below the threshold in double precision and above it in single.
    a[1] = [0.95 - 1e-9, np.sqrt(1 - (0.95 - 1e-9) ** 2), 0, 0]
    assert _links(spark, a).tolist() == [0, 0]
    a[1] = [0.95 + 1e-9, np.sqrt(1 - (0.95 + 1e-9) ** 2), 0, 0]
    assert _links(spark, a).tolist() == [1, 1]


def test_trees_are_added_until_planted_pairs_meet():
    rng = np.random.default_rng(5)
    sample = embedding_dedup._unit(rng.normal(size=(16_384, 64)))
    shallow, deep, deepest = (embedding_dedup.Forest(sample, total, None, 1200, 0.95) for total in (1000, 10**6, 10**9))
    assert len(shallow.roots) == embedding_dedup.TREES[0] and not any(shallow.coarse)
    assert len(shallow.roots) <= len(deep.roots) <= len(deepest.roots) <= embedding_dedup.TREES[1]
