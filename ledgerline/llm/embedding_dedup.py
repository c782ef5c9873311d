"""Embedding near-dedup by a random-projection tree forest (operator 1).

Equal vectors are put together first. Trees are fitted on a bounded sample: a node is split
at the median of a random projection, and vectors within MARGIN of the cut go to both sides
(spill). Trees are added until pairs at the threshold, planted beside vectors of the sample,
and the widest links inside the sample meet in MET trees each; deeper tables get more in
proportion. Every vector is then routed through every
tree. A leaf that is over-full because the sample does not resolve it is refined: trees of
its own are fitted in a task each, on a bounded sample of the leaf, and its vectors are
routed on; this repeats until no leaf can be split. So leaves do not grow with the table.
Vectors that meet in a leaf are compared exactly, in double precision. A pair that meets in
several leaves counts in the first of them only: each vector carries the list of its leaves.
A leaf that stays beyond BLOCK vectors is compared block against block, so that no task holds
more than two blocks. A leaf emits a count for each vector and a spanning forest of its
links, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are their own component; vectors of different lengths do not link;
equal vectors in different rows link with each other; a null vec_id is never a component's
least id. Components of type float or double are compared as given, others as double.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textarrays
from ledgerline.llm.components import components
from ledgerline.llm.rows import hash_share
from ledgerline.session import materialise, table

THRESHOLD = 0.95
#: Vectors of the sample that pairs are planted beside, the links of each inside the sample that count as well (those of
#: least cosine), the trees that each of these pairs has to meet in before no more are added, and the least and most trees.
PLANTED = 2000
WIDEST = 8
MET = 3
TREES = (4, 48)
#: Vectors that a leaf is meant to hold, and that one block of a comparison may hold.
LEAF = 1200
BLOCK = 4096
#: Half-width of the spill, for unit vectors, times the square root of their length.
MARGIN = 0.1
#: A cut is taken if neither side gets more than this share; a leaf no direction of four cuts so stays whole.
_LARGEST = 0.75
#: Vectors that the trees are fitted on, and that the trees of one over-full leaf are.
SAMPLE = 16384
_LEAST = 24

_LEAVES = "array<struct<leaf: long, blocks: int, share: double, total: long>>"
_FOUND = "gid long, links long, root long"


class Forest:
    """Nodes of all trees in flat arrays; a node is a cut (left >= 0) or a leaf (its own number)."""

    def __init__(self, sample: np.ndarray, total: int, trees: int | None, leaf: int, threshold: float, seed: int = 11):
        """trees: how many (None: as many as planted pairs ask for)."""
        self.dimensions = sample.shape[1]
        self.margin = MARGIN / np.sqrt(self.dimensions)
        self.directions: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.expected: list[float] = []
        #: Leaves whose sample ran out before they were small.
        self.coarse: list[bool] = []
        self.roots: list[int] = []
        rng = np.random.default_rng(seed)
        scale = total / max(1, len(sample))
        grow = lambda: self.roots.append(self._grow(sample, np.arange(len(sample)), rng, scale, leaf))
        for _ in range(trees or TREES[0]):
            grow()
        if trees or len(sample) < 2:
            return
        one = sample[rng.permutation(len(sample))[:PLANTED]]
        away = rng.normal(size=one.shape)
        away -= (away * one).sum(axis=1, keepdims=True) * one
        two = threshold * one + np.sqrt(1 - threshold**2) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        ends = [(one, two)]
        for i in range(0, len(one), 100):
            part = one[i : i + 100]
            cosine = part @ sample.T
            cosine[cosine < threshold] = 2
            widest = np.argpartition(cosine, min(WIDEST, cosine.shape[1]) - 1, axis=1)[:, :WIDEST]
            row, column = np.nonzero(np.take_along_axis(cosine, widest, axis=1) <= 1)
            ends.append((part[row], sample[widest[row, column]]))
        one, two = (np.concatenate(x) for x in zip(*ends, strict=True))
        met, tried = np.zeros(len(one), np.int64), 0
        while True:
            for root in self.roots[tried:]:
                met += self._meet(one, two, root)
            tried = len(self.roots)
            #: Levels that the sample can't show divide pairs as the shown ones do.
            deeper = max(1.0, np.log(max(2.0, total / leaf)) / np.log(max(2.0, min(total / leaf, len(sample) / _LEAST))))
            together = np.clip(met.mean() / tried, 1e-3, 1.0) ** deeper
            if tried >= TREES[1] or met.min() >= MET and together * tried >= MET * met.mean() / max(1, met.min()):
                return
            grow()

    def _meet(self, one: np.ndarray, two: np.ndarray, root: int) -> np.ndarray:
        """Which pairs of rows share a leaf of the tree."""
        ends = [self.leaves(x, [root]) for x in (one, two)]
        keys = [rows * len(self.left) + node for rows, node in ends]
        out = np.zeros(len(one), bool)
        out[np.intersect1d(*keys) // len(self.left)] = True
        return out

    def _grow(self, sample, own, rng, scale, leaf) -> int:
        node = len(self.left)
        self.directions.append(None)
        for values, x in ((self.cuts, 0.0), (self.left, -1), (self.right, -1), (self.expected, len(own) * scale), (self.coarse, False)):
            values.append(x)
        if len(own) * scale <= leaf:
            return node
        if len(own) < _LEAST:
            self.coarse[node] = len(own) * scale > 2 * leaf
            return node
        for _ in range(4):
            direction = rng.normal(size=self.dimensions)
            direction /= np.linalg.norm(direction)
            at = sample[own] @ direction
            cut = float(np.median(at))
            low, high = own[at <= cut + self.margin], own[at >= cut - self.margin]
            if max(len(low), len(high)) <= _LARGEST * len(own):
                self.directions[node], self.cuts[node] = direction, cut
                self.left[node] = self._grow(sample, low, rng, scale, leaf)
                self.right[node] = self._grow(sample, high, rng, scale, leaf)
                break
        return node

    def leaves(self, vectors: np.ndarray, roots: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs over all trees, or those of the given roots."""
        rows, found = [], []
        stack = [(root, np.arange(len(vectors))) for root in roots or self.roots]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            if self.left[node] < 0:
                rows.append(own)
                found.append(np.full(len(own), node))
                continue
            at = vectors[own] @ self.directions[node]
            stack.append((self.left[node], own[at <= self.cuts[node] + self.margin]))
            stack.append((self.right[node], own[at >= self.cuts[node] - self.margin]))
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        return rows[order], found[order]


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    top = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / top
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _leaf_lists(trees: Forest, vectors: np.ndarray, parent: int | None, block: int, bound: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Number of leaves of each vector, and their ids, blocks, shares to sample (0: final) and expected sizes."""
    rows, node = trees.leaves(vectors)
    expected = np.array(trees.expected)[node]
    leaf = node.astype(np.int64)
    if parent is not None:
        leaf = (textarrays.mix(np.uint64(parent) ^ (node.astype(np.uint64) << np.uint64(40))) >> np.uint64(1)).astype(np.int64)
    share = np.where(np.array(trees.coarse)[node], np.minimum(1.0, bound / np.maximum(expected, 1.0)), 0.0)
    blocks = np.maximum(1, np.ceil(expected / block)).astype(np.int32)
    return np.bincount(rows, minlength=len(vectors)), {"leaf": leaf, "blocks": blocks, "share": share, "total": np.ceil(expected).astype(np.int64)}


def _leaf_column(counts: np.ndarray, lists: dict[str, np.ndarray]) -> pa.Array:
    inner = pa.StructArray.from_arrays([pa.array(x) for x in lists.values()], names=list(lists))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), inner)


def _router(trees: Forest, block: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                lists = _leaf_lists(trees, _unit(flat.reshape(part.num_rows, trees.dimensions)), None, block, bound)
                raw, size = flat.tobytes(), flat.itemsize * trees.dimensions
                packed = pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("gid"), part.column("m"), packed, _leaf_column(*lists)], names=["gid", "m", "vector", "leaves"])

    return run


def _vectors(column, kind: np.dtype, dimensions: int) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(column), kind).reshape(-1, dimensions))


def _planter(kind: np.dtype, dimensions: int, leaf: int, threshold: float):
    """Trees of one over-full leaf, from its sample."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        #: What the leaf holds shows in its own sample better than in its parents'.
        total = int(np.ceil(len(group) / group["share"].iloc[0]))
        grown = Forest(_vectors(group["vector"], kind, dimensions), total, 1, leaf, threshold, seed=key[0] & 0xFFFFFFFF)
        return pd.DataFrame({"leaf": [key[0]], "total": [int(group["total"].iloc[0])], "tree": [pickle.dumps(grown)]})

    return run


def _follower(kind: np.dtype, dimensions: int, block: int, bound: int):
    """Rows sorted by leaf, each leaf's tree before its vectors: (gid, leaves) of the vectors.

    A leaf of which nothing was sampled has no tree and stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, grown = None, None
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            planted = batch.column("tree")
            given = planted.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | given[:-1] | given[1:]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leaf)], strict=True):
                if given[a]:
                    tree, grown = int(leaf[a]), pickle.loads(planted[a].as_py())
                    a += 1
                elif tree != leaf[a]:
                    tree, grown = int(leaf[a]), None
                for i in range(a, b, 2048):
                    part = batch.slice(i, min(2048, b - i))
                    if grown is None:
                        n, total = part.num_rows, part.column("total").to_numpy()
                        lists = np.ones(n, np.int64), {"leaf": np.full(n, tree), "blocks": np.maximum(1, -(-total // block)).astype(np.int32), "share": np.zeros(n), "total": total}
                    else:
                        lists = _leaf_lists(grown, _vectors(part.column("vector").to_pylist(), kind, dimensions), tree, block, bound)
                    yield pa.RecordBatch.from_arrays([part.column("gid"), _leaf_column(*lists)], names=["gid", "leaves"])

    return run


def _refined(routed: DataFrame, kind: np.dtype, dimensions: int, threshold: float, leaf: int, block: int, bound: int) -> DataFrame:
    """routed (gid, m, vector, leaves) with every over-full leaf replaced by leaves of its own trees."""
    full = routed.select("gid", "vector", F.inline("leaves")).filter("share > 0")
    picked = full.filter(F.pmod(F.xxhash64("gid", "leaf"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    grown = materialise(picked.groupBy("leaf").applyInPandas(_planter(kind, dimensions, leaf, threshold), "leaf long, total long, tree binary"), "leaf-trees")
    salts = F.ceil(F.col("total") / (16 * block)).cast("int")
    trees = grown.select("leaf", "total", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "tree", F.lit(None).cast("long").alias("gid"), F.lit(None).cast("binary").alias("vector"))
    rows = full.select("leaf", "total", F.pmod(F.xxhash64("gid"), salts).cast("int").alias("salt"), F.lit(None).cast("binary").alias("tree"), "gid", "vector")
    #: A tree per leaf and salt comes first (its gid is null), so a task holds one tree and one batch at a time.
    dealt = trees.unionByName(rows).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", F.col("gid").asc_nulls_first())
    found = dealt.select("leaf", "total", "tree", "gid", "vector").mapInArrow(_follower(kind, dimensions, block, bound), f"gid long, leaves {_LEAVES}")
    found = found.groupBy("gid").agg(F.flatten(F.collect_list("leaves")).alias("finer"))
    whole = F.concat(F.filter("leaves", lambda x: x["share"] == 0), F.coalesce("finer", F.array().cast(_LEAVES)))
    return materialise(routed.join(found, "gid", "left").select("gid", "m", "vector", whole.alias("leaves")), "routed")


def _earlier(leaf: int, blocks: list[tuple]) -> list[np.ndarray]:
    """For each block, one bit row per vector: which of the leaves before this one it is in."""
    lists = [np.concatenate(own[3]) if len(own[3]) else np.zeros(0, np.int64) for own in blocks]
    known = np.unique(np.concatenate(lists))
    known = known[known < leaf]
    out = []
    for own, flat in zip(blocks, lists, strict=True):
        bits = np.zeros((len(own[3]), len(known) // 64 + 1), np.uint64)
        row = np.repeat(np.arange(len(own[3])), [len(x) for x in own[3]])
        row, flat = row[flat < leaf], flat[flat < leaf]
        at = np.searchsorted(known, flat)
        np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        out.append(bits)
    return out


def _merge(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Give the two ends of every pair, and all that already share a label with them, one label."""
    while len(p):
        x, y = label[p], label[q]
        apart = x != y
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def compare(leaf: int, a: tuple, b: tuple | None, threshold: float) -> tuple[np.ndarray, ...]:
    """Links of block a with block b (or within a). Blocks: gid, multiplicity, unit vectors, leaves."""
    same = b is None
    both = [a] if same else [a, b]
    bits = _earlier(leaf, both)
    b, bits_a, bits_b = both[-1], bits[0], bits[-1]
    shift = 0 if same else len(a[0])
    gid = np.concatenate([own[0] for own in both])
    links = np.zeros(len(gid), np.int64)
    label = np.arange(len(gid))
    for i in range(0, len(a[0]), 256):
        x, y = np.nonzero(a[2][i : i + 256] @ b[2].T >= threshold)
        x = x + i
        if same:
            x, y = x[y > x], y[y > x]
        met = np.zeros(len(x), bool)
        for k in range(bits_a.shape[1]):
            met |= (bits_a[x, k] & bits_b[y, k]) != 0
        x, y = x[~met], y[~met]
        links += np.bincount(x, b[1][y], len(gid)).astype(np.int64) + np.bincount(y + shift, a[1][x], len(gid)).astype(np.int64)
        _merge(label, x, y + shift)
    told = links > 0
    return gid[told], links[told], gid[label[told]]


def _comparer(kind: np.dtype, dimensions: int, threshold: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        def block(own: pd.DataFrame) -> tuple:
            return own["gid"].to_numpy(), own["m"].to_numpy(), _vectors(own["vector"], kind, dimensions), list(own["leaves"])

        leaf, low, high = key
        side = group["side"].to_numpy()
        if low == high:
            out = compare(leaf, block(group), None, threshold)
        elif side.all() or not side.any():
            out = (np.zeros(0, np.int64),) * 3
        else:
            out = compare(leaf, block(group[~side]), block(group[side]), threshold)
        return pd.DataFrame(dict(zip(("gid", "links", "root"), out, strict=True)))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is finite and not zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))


def embedding_links(distinct: DataFrame, threshold: float = THRESHOLD, trees: int | None = None, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(gid, links, root) of distinct vectors (gid, m, embedding): partial counts of links and forest links."""
    spark = distinct.sparkSession
    kind = np.dtype(np.float64 if dict(distinct.dtypes)["embedding"] == "array<double>" else np.float32)
    found = None
    sizes = {r[0]: r[1] for r in distinct.groupBy(F.size("embedding").alias("d")).count().collect()}
    for dimensions, total in sorted(sizes.items()):
        own = distinct.filter(F.size("embedding") == dimensions)
        bound = max(256, min(sample, (1 << 22) // dimensions))
        rows = own.select(F.xxhash64("embedding").alias("order"), "embedding").filter(hash_share(F.col("order"), bound, total)).orderBy("order").limit(bound).select("embedding").collect()
        grown = Forest(_unit(np.array([r[0] for r in rows], np.float64)), total, trees, leaf, threshold)
        routed = own.select("gid", "m", "embedding").mapInArrow(_router(grown, block, bound), f"gid long, m long, vector binary, leaves {_LEAVES}")
        if any(grown.coarse):
            routed = materialise(routed, "routed")
            while not routed.filter(F.exists("leaves", lambda x: x["share"] > 0)).isEmpty():
                routed = _refined(routed, kind, dimensions, threshold, leaf, block, bound)
        mine = F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")
        copies = routed.select("gid", "m", "vector", F.col("leaves.leaf").alias("leaves"), F.inline("leaves"))
        copies = copies.select("gid", "m", "vector", "leaves", "leaf", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        copies = copies.select("leaf", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("side"), "gid", "m", "vector", "leaves")
        part = copies.groupBy("leaf", "low", "high").applyInPandas(_comparer(kind, dimensions, threshold), _FOUND)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], _FOUND) if found is None else found


def embedding_groups(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    good = usable(vectors)
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    distinct = materialise(distinct.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    found = materialise(embedding_links(distinct), "found")
    roots = components(found.filter("root != gid").select(F.col("gid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("gid").agg(F.sum("links").alias("links"))
    whole = distinct.join(counts, "gid", "left").join(roots, F.col("gid") == F.col("id"), "left")
    whole = materialise(whole.select("embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "gid").alias("top")), "groups")
    names = whole.groupBy("top").agg(F.min("least").alias("component_id"))
    named = whole.join(names, "top").select("embedding", "n_links", "component_id")
    linked = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    alone = vectors.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(id, top) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT links.b, reach.top FROM reach JOIN links ON links.a = reach.id
), component AS (SELECT id, min(top) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component ON component.id = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""
