"""Extremely randomised trees by Spark: tasks grow whole trees on all rows of a model, rows are scored by streams of Arrow batches.

A model (say, one agency's, or one fold's) has a classifier and a regressor of the same labels,
1 to `classes`. Its trees are grown in blocks, each from all of the model's training rows: at
every node each candidate feature gets one random threshold and the best one splits; the
classifier draws the root of the number of features as candidates and weighs labels to balance,
the regressor takes all of them and leaves two rows in a leaf at least. All nodes of a level of
all trees of a block are split at once, in portions of PORTION rows. Nodes are flat arrays.

A model's rows are sent to a few tasks, each of which grows some of its blocks. There the rows'
features lie in temporary files that are mapped into memory, so that a task holds a few numbers a
row besides; a block has fewer trees where rows are many. Medians and categories are those of the
model's training rows, so a model of a fold knows nothing of what it leaves out. Models are a
table, and saving one is writing it.
"""

from __future__ import annotations

import io
import os
import tempfile
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, SEED = 600, 42
#: Trees of a block at most, and pairs of a row and a tree: a model of more than PAIRS / BLOCK rows has smaller blocks, of a tree at least.
BLOCK, PAIRS = 25, 200_000
#: Pairs of a row and a tree whose nodes are split together, a node at least.
PORTION = 65_536
#: Rows of a model that a task scores, on average.
SCORED = 200_000
CLASSIFIER, REGRESSOR = "classifier", "regressor"

_MODEL = "model string, kind string, block int, trees int, n_rows int, importances array<double>, data binary"


class _Features:
    """Features of training rows: columns of numbers, then for each category a column of zeros and ones a level.

    codes: for each category the level of each row and the number of levels.
    """

    def __init__(self, x: np.ndarray, codes: list[tuple[np.ndarray, int]]):
        self.rows, self.numbers = x.shape
        self.columns = np.ascontiguousarray(x.T)
        #: (first feature, level of each row, number of levels)
        self.kinds, self.count = [], self.numbers
        for code, levels in codes:
            self.kinds.append((self.count, code, levels))
            self.count += levels

    def above(self, feature: np.ndarray, cut: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether a feature's value in a row is above a cut, for features, cuts and rows that stand together."""
        if not self.kinds:
            return self.columns.ravel().take(feature * self.rows + row) > cut
        out = self.columns.ravel().take(np.minimum(feature, self.numbers - 1) * self.rows + row) > cut if self.numbers else np.zeros(len(row), bool)
        for first, code, levels in self.kinds:
            at = np.flatnonzero((feature >= first) & (feature < first + levels))
            out[at] = (code.take(row.take(at)) == feature.take(at) - first) > cut.take(at)
        return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int, rng: np.random.Generator, candidates: int, least: int, classes: int, codes: list[tuple[np.ndarray, int]] = ()) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Nodes of trees on rows x and the decrease of impurity by feature. classes: 0 for a regressor of y, else labels y are below it.

    codes: see _Features; a category's levels are features behind those of x.
    Nodes: feature (-1 in a leaf), threshold (up to it left), left (the right child follows it),
    slot (a leaf's place in `value`). The trees' roots are the first nodes.
    """
    features = _Features(x, codes)
    n, p = len(x), features.count
    row, node = np.tile(np.arange(n), trees), np.repeat(np.arange(trees), n)
    gained = np.zeros((trees, p))
    tree = np.arange(trees)
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("feature", "threshold", "left", "slot", "value")}
    base = slots = 0
    while len(row):
        count = len(tree)
        size = np.bincount(node, minlength=count)
        label = y[row]
        if classes:
            cell = node * classes + label
            whole = np.bincount(cell, weight[row], count * classes).reshape(count, classes)
            total = whole.sum(1)
            mixed = (whole > 0).sum(1) > 1
            stay = (whole**2).sum(1) / total
        else:
            heads = np.searchsorted(node, np.arange(count))
            whole, total = np.bincount(node, label, count)[:, None], size.astype(float)
            mixed = np.maximum.reduceat(label, heads) > np.minimum.reduceat(label, heads)
            stay = whole[:, 0] ** 2 / total
        #: Most nodes of the deeper levels are leaves already; the others are worked on.
        mixed &= size >= 2 * least
        split, feature, threshold = np.zeros(count, bool), np.full(count, -1, np.int32), np.zeros(count, np.float32)
        opened = np.flatnonzero(mixed)
        row, node = row[mixed[node]], node[mixed[node]]
        left = np.empty(len(row), bool)
        ends = np.cumsum(size[opened])
        first = start = 0
        while first < len(opened):
            last = max(first + 1, int(np.searchsorted(ends, start + PORTION, "right")))
            some, stop = opened[first:last], int(ends[last - 1])
            chosen, cut, score = _splits(features, row[start:stop], y, weight, whole[some], size[some], rng, candidates, least, classes)
            best, at = score.argmax(0), np.arange(len(some))
            good = np.isfinite(score[best, at])
            split[some], feature[some], threshold[some] = good, np.where(good, chosen[best, at], -1), np.where(good, cut[best, at], 0)
            np.add.at(gained, (tree[some[good]], feature[some[good]]), score[best, at][good] - stay[some[good]])
            left[start:stop] = ~features.above(np.maximum(feature[some], 0).repeat(size[some]), threshold[some].repeat(size[some]), row[start:stop])
            first, start = last, stop
        rank = np.cumsum(split) - 1
        leaf = ~split
        parts["feature"].append(feature)
        parts["threshold"].append(threshold)
        parts["left"].append(np.where(split, base + count + 2 * rank, 0).astype(np.int32))
        parts["slot"].append(np.where(leaf, slots + np.cumsum(leaf) - 1, 0).astype(np.int32))
        parts["value"].append((whole / total[:, None])[leaf].astype(np.float32))
        slots += int(leaf.sum())
        base += count
        tree = np.repeat(tree[split], 2)
        on = split[node]
        if not on.any():
            break
        child = (2 * rank[node] + ~left)[on]
        order = np.argsort(child, kind="stable")
        row, node = row[on][order], child[order]
    width = max(classes, 1)
    nodes = {k: np.concatenate([v.reshape(-1, width) if k == "value" else v for v in some]) for k, some in parts.items()}
    return nodes, gained


def _splits(features: _Features, row, y, weight, whole, size, rng, candidates, least, classes) -> tuple[np.ndarray, ...]:
    """Candidate features of each node, their random thresholds and the scores of the splits, by candidate and node.

    The rows of a node lie together. A feature is read at a time, so that the work needs a few
    numbers a row; all levels of a category are counted at once.
    """
    p, count = features.count, len(size)
    node, heads = np.repeat(np.arange(count), size), np.cumsum(size) - size
    low, high = np.empty((p, count), np.float32), np.empty((p, count), np.float32)
    for f, column in enumerate(features.columns):
        own = column.take(row)
        np.minimum.reduceat(own, heads, out=low[f])
        np.maximum.reduceat(own, heads, out=high[f])
    cells, times = [node * levels + code.take(row) for _, code, levels in features.kinds], []
    for cell, (first, _, levels) in zip(cells, features.kinds, strict=True):
        times.append(np.bincount(cell, minlength=count * levels).reshape(count, levels).T)
        low[first : first + levels], high[first : first + levels] = times[-1] == size, times[-1] > 0
    usable = high > low
    chosen = np.broadcast_to(np.arange(p)[:, None], (p, count))
    if candidates < p:
        order = np.where(usable, rng.random((p, count)), 2.0)
        chosen = np.argpartition(order, candidates - 1, 0)[:candidates]
        usable = np.take_along_axis(order, chosen, 0) < 2
        low, high = np.take_along_axis(low, chosen, 0), np.take_along_axis(high, chosen, 0)
    cut = (low + rng.random(low.shape, np.float32) * (high - low)).astype(np.float32)
    cut = np.where(cut < high, cut, low)
    #: Long nodes are summed one after the other, short ones by their numbers. A usable cut leaves a row on either side.
    counted = lambda goes: np.add.reduceat(goes, heads, dtype=np.int64) if len(row) > 8 * count else np.bincount(node, goes, count)
    label, number = y[row], None if least < 2 else np.empty(cut.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            cell, some, score = node * classes + label, weight[row], np.empty(cut.shape)
            for c in range(len(cut)):
                goes = ~features.above(chosen[c].repeat(size), cut[c].repeat(size), row)
                if number is not None:
                    number[c] = counted(goes)
                lefts = np.bincount(cell, goes * some, count * classes).reshape(count, classes)
                score[c] = (lefts**2).sum(1) / lefts.sum(1) + ((whole - lefts) ** 2).sum(1) / (whole - lefts).sum(1)
        else:
            lefts, number = np.empty(cut.shape), np.empty(cut.shape)
            for c, column in enumerate(features.columns):
                goes = column.take(row) <= cut[c].repeat(size)
                number[c], lefts[c] = counted(goes), np.bincount(node, goes * label, count)
            for cell, found, (first, _, levels) in zip(cells, times, features.kinds, strict=True):
                number[first : first + levels] = size - found
                lefts[first : first + levels] = whole[:, 0] - np.bincount(cell, label, count * levels).reshape(count, levels).T
            score = lefts**2 / number + (whole[:, 0] - lefts) ** 2 / (size - number)
    good = usable if number is None else usable & (number >= least) & (size - number >= least)
    return chosen, cut, np.where(good, score, -np.inf)


def packed(nodes: dict[str, np.ndarray], trees: int) -> dict[str, np.ndarray]:
    """Nodes as `grow` gives them in a few bytes each: children follow their parents' order, and few leaves' values differ."""
    leaf, value = nodes["feature"] < 0, nodes["value"]
    kind, known = _kinds(value)
    narrow = lambda a: a.astype(np.min_scalar_type(int(a.max(initial=0))))
    return {"leaf": np.packbits(leaf), "feature": narrow(nodes["feature"][~leaf]), "threshold": nodes["threshold"][~leaf], "slot": narrow(kind[nodes["slot"][leaf]]), "value": known, "roots": np.array(trees), "count": np.array(len(leaf))}


def unpacked(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The nodes that `packed` packed; leaves of like values share a slot."""
    leaf = np.unpackbits(held["leaf"], count=int(held["count"])).astype(bool)
    inner = np.flatnonzero(~leaf)
    out = {"feature": np.full(len(leaf), -1, np.int32), "threshold": np.zeros(len(leaf), np.float32), "left": np.zeros(len(leaf), np.int32), "slot": np.zeros(len(leaf), np.int32)}
    out["feature"][inner], out["threshold"][inner], out["left"][inner], out["slot"][leaf] = held["feature"], held["threshold"], int(held["roots"]) + 2 * np.arange(len(inner)), held["slot"]
    return out | {"value": held["value"]}


def _kinds(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value among distinct ones, and those: the pure labels first.

    Most leaves of a grown-out classifier hold one label, so there are few distinct values.
    """
    pure = (value == 1).any(1) & ((value != 0).sum(1) == 1)
    kind = value.argmax(1)
    mixed, kind[~pure] = np.unique(value[~pure], axis=0, return_inverse=True)
    kind[~pure] += value.shape[1]
    return kind, np.concatenate([np.eye(value.shape[1], dtype=value.dtype), mixed])


def walkable(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Nodes for `walk`: a leaf leads to itself, and leaves of like values share a row of `value`."""
    leaf = nodes["feature"] < 0
    kind, value = _kinds(nodes["value"])
    return {
        "feature": np.where(leaf, 0, nodes["feature"]).astype(np.intp), "threshold": np.where(leaf, np.float32(np.inf), nodes["threshold"]).astype(np.float32),
        "left": np.where(leaf, np.arange(len(leaf)), nodes["left"]).astype(np.intp), "leaf": leaf, "kind": np.where(leaf, kind[nodes["slot"]], 0), "value": value.astype(float),
    }


#: Rows that walk down the trees together: few enough for a core's cache.
WALKED = 2_048
#: Steps between looks at which rows have come to a leaf.
STEPS = 4


def walk(nodes: dict[str, np.ndarray], trees: int, x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the values of the leaves that each row falls into; nodes: `walkable`.

    Pairs of a row and a tree lie by tree, so that one tree's nodes are in the cache together;
    those that have come to a leaf walk no further.
    """
    feature, threshold, left, leaf, kind, value = (nodes[k] for k in ("feature", "threshold", "left", "leaf", "kind", "value"))
    flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
    out = np.empty((len(x), value.shape[1]))
    for first in range(0, len(x), WALKED):
        rows = min(WALKED, len(x) - first)
        at, base, place = np.repeat(np.arange(trees), rows), np.tile((first + np.arange(rows)) * width, trees), np.arange(rows * trees)
        found = np.empty(rows * trees, np.intp)
        while len(at):
            for _ in range(STEPS):
                at = left.take(at) + (flat.take(base + feature.take(at)) > threshold.take(at))
            done = leaf.take(at)
            found[place[done]] = kind.take(at[done])
            going = np.flatnonzero(~done)
            at, base, place = at.take(going), base.take(going), place.take(going)
        if len(value) <= 8 * trees:
            found += np.tile(np.arange(rows) * len(value), trees)
            out[first : first + rows] = np.bincount(found, minlength=rows * len(value)).reshape(rows, -1) @ value
        else:
            out[first : first + rows] = value.take(found, 0).reshape(trees, rows, -1).sum(0)
    return out


def predict(nodes: dict[str, np.ndarray], trees: int, x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the values of the leaves that each row falls into; nodes as `grow` gives them."""
    return walk(walkable(nodes), trees, x)


class Design:
    """Columns of a model: numbers with the medians of the training rows for holes, categories as columns of zeros and ones.

    Made from the training rows' numbers and their kinds, of which each need stand only once.
    """

    def __init__(self, numbers: np.ndarray, kinds: list[list[str | None]]):
        known = [] if not len(numbers) else [c for c in range(numbers.shape[1]) if not np.isnan(numbers[:, c]).all()]
        self.active = np.array(known, int)
        self.medians = np.array([np.nanmedian(numbers[:, c]) for c in known])
        named = [sorted({k or "Unknown" for k in column}) for column in zip(*kinds, strict=True)] if kinds else []
        #: A category that is always the same tells nothing.
        self.levels = [levels if len(levels) > 1 else [] for levels in named]
        self.base = np.concatenate([self.active, *(np.full(len(levels), numbers.shape[1] + c) for c, levels in enumerate(self.levels))]).astype(int)
        self.inputs = numbers.shape[1] + len(named)

    def filled(self, numbers: np.ndarray) -> np.ndarray:
        x = numbers[:, self.active]
        return np.where(np.isnan(x), self.medians, x).astype(np.float32)

    def codes(self, kinds: list[list[str | None]]) -> list[np.ndarray]:
        """The level of each of the training rows, for each category that tells something."""
        places = [(c, {v: i for i, v in enumerate(levels)}) for c, levels in enumerate(self.levels) if levels]
        return [np.fromiter((place[own[c] or "Unknown"] for own in kinds), np.int32, len(kinds)) for c, place in places]

    def matrix(self, numbers: np.ndarray, kinds: list[list[str | None]]) -> np.ndarray:
        parts = [self.filled(numbers)]
        for c, levels in enumerate(self.levels):
            place = {v: i for i, v in enumerate(levels)}
            hot = np.zeros((len(numbers), len(levels)), np.float32)
            for r, own in enumerate(kinds):
                if (i := place.get(own[c] or "Unknown")) is not None:
                    hot[r, i] = 1
            parts.append(hot)
        return np.concatenate(parts, 1)


def _numbers(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(float) if width else np.zeros((len(column), 0))


def _pieces(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with their common values of the named columns, whose rows lie together."""
    for batch in batches:
        ends = {batch.num_rows}
        for name in names if batch.num_rows else ():
            values = pc.run_end_encode(batch.column(name)) if batch.num_rows else None
            ends |= set(values.run_ends.to_pylist())
        start = 0
        for end in sorted(ends - {0}):
            yield tuple(batch.column(name)[start].as_py() for name in names), batch.slice(start, end - start)
            start = end


def _file():
    """A temporary file among Spark's own, gone when it is closed."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


#: Rows whose features are made at a time.
FILLED = 16_384


def _learned(pieces: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, list[tuple[np.ndarray, int]], np.ndarray, Design]:
    """A model's rows: numbers (columns lie together, in a mapped file), levels of categories, labels, and the design that they make."""
    labels, kinds, distinct = [], [], set()
    with _file() as raw, _file() as made:
        for piece in pieces:
            _numbers(piece.column("numbers"), width).tofile(raw)
            labels.append(piece.column("label").to_numpy(zero_copy_only=False).astype(int))
            kinds.append(piece.column("kinds"))
            distinct.update(map(tuple, kinds[-1].to_pylist()))
        raw.flush()
        label, kinds = np.concatenate(labels), pa.chunked_array(kinds)
        numbers = np.memmap(raw, float, "r", shape=(len(label), width)) if width else np.zeros((len(label), 0))
        design = Design(numbers, list(distinct))
        active, starts = len(design.active), range(0, len(label), FILLED)
        columns = np.memmap(made, np.float32, "w+", shape=(active, len(label))) if active else np.zeros((0, len(label)), np.float32)
        for a in starts if active else ():
            columns[:, a : a + FILLED] = design.filled(numbers[a : a + FILLED]).T
    parts = [design.codes(kinds.slice(a, FILLED).to_pylist()) for a in starts]
    codes = [(np.concatenate(c), len(levels)) for c, levels in zip(zip(*parts, strict=True), filter(None, design.levels), strict=True)]
    return columns.T if len(design.base) else np.zeros((len(label), 1), np.float32), codes, label, design


def _trainer(width: int, classes: int, trees: int, regressor_rows: int):
    pairs = PAIRS
    shape = pa.schema([("model", pa.string()), ("kind", pa.string()), ("block", pa.int32()), ("trees", pa.int32()), ("n_rows", pa.int32()), ("importances", pa.list_(pa.float64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (model, share, shares), pieces in groupby(_pieces(batches, "model", "share", "shares"), itemgetter(0)):
            rows = _learned((piece for _, piece in pieces), width)
            label = rows[2]
            size = max(1, min(BLOCK, pairs // len(label)))
            blocks = [(kind, b, min(size, trees - b * size)) for kind in (CLASSIFIER, REGRESSOR) for b in range(-(-trees // size))]
            for kind, block, n in blocks[share::shares]:
                if kind == CLASSIFIER or (len(label) >= regressor_rows and (label != label[0]).any()):
                    row = grown(*rows, model, kind, block, n)
                    yield pa.RecordBatch.from_pylist([row], shape)

    def grown(x: np.ndarray, codes: list[tuple[np.ndarray, int]], label: np.ndarray, design: Design, model: str, kind: str, block: int, trees: int) -> dict:
        rng, features = np.random.default_rng([SEED, zlib.crc32(f"{model}/{kind}".encode()), block]), max(1, len(design.base))
        if kind == CLASSIFIER:
            held = np.bincount(label, minlength=classes + 1)
            weight = len(label) / ((held > 0).sum() * held[label])
            nodes, gained = grow(x, label - 1, weight, trees, rng, max(1, int(np.sqrt(features))), 1, classes, codes)
        else:
            nodes, gained = grow(x, label.astype(float), np.ones(len(label)), trees, rng, features, 2, 0, codes)
        own = np.zeros((trees, design.inputs))
        if len(design.base):
            np.add.at(own.T, design.base, gained.T)
        share = own / np.maximum(own.sum(1, keepdims=True), 1e-300)
        file = io.BytesIO()
        levels = np.array([v for some in design.levels for v in some], dtype=str)
        np.savez(file, **packed(nodes, trees), active=design.active, medians=design.medians, sizes=np.array([len(v) for v in design.levels], int), levels=levels)
        return {"model": model, "kind": kind, "block": block, "trees": trees, "n_rows": len(label), "importances": share.sum(0).tolist(), "data": file.getvalue()}

    return run


def sampled(rows: DataFrame, model: str, key: str, most: int) -> DataFrame:
    """At most `most` rows of each model, for whoever wants fewer: no query does, models learn from all rows.

    Those of a hash of their key under a threshold, the rest of the few above by rank. The
    threshold leaves half as many again, so that the rank sorts a bounded number of rows a model.
    """
    order = F.xxhash64(F.col(key), F.lit(SEED))
    counts = rows.groupBy(model).agg(F.count("*").alias("_n"))
    share = F.lit(1.5 * most) / F.col("_n")
    near = rows.join(F.broadcast(counts), model).filter((F.col("_n") <= most) | (F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53)) <= share))
    place = F.row_number().over(Window.partitionBy(model).orderBy(order, key))
    return near.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place", "_n")


def inputs(numeric: list[str], categorical: list[str]) -> list[Column]:
    """The columns `numbers` and `kinds` that forests read."""
    numbers = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric)) if numeric else F.array().cast("array<double>")
    return [numbers.alias("numbers"), (F.array(*(F.col(c).cast("string") for c in categorical)) if categorical else F.array().cast("array<string>")).alias("kinds")]


def train(samples: DataFrame, width: int, classes: int, trees: int = TREES, regressor_rows: int = 1) -> DataFrame:
    """The table of models of samples (model, row_key, label 1..classes, numbers, kinds), a row a block of trees.

    A model of one label, or of fewer than regressor_rows rows, has no regressor. Rows without a
    model are left out. A model's rows go to as many tasks as its part of all rows, of four tasks a core.
    """
    rows = samples.select("model", "row_key", "label", "numbers", "kinds").filter(F.col("model").isNotNull())
    sizes = rows.groupBy("model").agg(F.count("*").alias("_n"))
    total, known = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    wanted = 4 * samples.sparkSession.sparkContext.defaultParallelism
    shares = F.least(F.ceil(F.lit(wanted) * F.col("_n") / F.lit(max(1, total))), F.lit(2 * trees)).cast("int")
    dealt = rows.join(F.broadcast(sizes.select("model", shares.alias("shares"))), "model").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    #: A stated number of tasks: adaptive execution goes by bytes and would put all of these few, costly rows into one. Hashes deal unevenly, so there are more than shares.
    dealt = dealt.repartition(2 * (wanted + known), "model", "share").sortWithinPartitions("model", "share", F.col("row_key").asc_nulls_last(), "label")
    return dealt.mapInArrow(_trainer(width, classes, trees, regressor_rows), _MODEL)


def _load(blob: bytes) -> tuple[dict[str, np.ndarray], Design]:
    held = dict(np.load(io.BytesIO(blob)))
    design = Design.__new__(Design)
    design.active, design.medians = held.pop("active"), held.pop("medians")
    sizes, levels = held.pop("sizes"), held.pop("levels").tolist()
    ends = np.cumsum(sizes)
    design.levels = [levels[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return walkable(unpacked(held)), design


def _scorer(width: int, classes: int, chunk: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(_pieces(batches, "model", "copy"), itemgetter(0)):
            rows, sums = [], None
            for _, piece in pieces:
                data = piece.column("data")
                start = data.null_count
                if start:
                    rows += [piece.slice(a, min(chunk, start - a)) for a in range(0, start, chunk)]
                if rows and start < piece.num_rows:
                    sums = sums or [_Sums(width, classes, batch) for batch in rows]
                    for i in range(start, piece.num_rows):
                        forest = piece.column("kind")[i].as_py(), piece.column("trees")[i].as_py(), *_load(data[i].as_py())
                        for own in sums:
                            own.add(*forest)
            yield from (own.told() for own in sums or [_Sums(width, classes, batch) for batch in rows])

    return run


class _Sums:
    """Rows of a batch and the sums of the values of the leaves that they fall into."""

    def __init__(self, width: int, classes: int, batch: pa.RecordBatch):
        self.row, self.width, self.held = batch.column("row"), width, batch
        self.shares, self.ranks, self.n_shares, self.n_ranks, self.x = np.zeros((batch.num_rows, classes)), np.zeros(batch.num_rows), 0, 0, None

    def add(self, kind: str, trees: int, nodes: dict[str, np.ndarray], design: Design) -> None:
        if self.x is None:
            self.x = design.matrix(_numbers(self.held.column("numbers"), self.width), self.held.column("kinds").to_pylist())
            self.x, self.held = self.x if self.x.shape[1] else np.zeros((len(self.ranks), 1), np.float32), None
        found = walk(nodes, trees, self.x)
        if kind == CLASSIFIER:
            self.shares, self.n_shares = self.shares + found, self.n_shares + trees
        else:
            self.ranks, self.n_ranks = self.ranks + found[:, 0], self.n_ranks + trees

    def told(self) -> pa.RecordBatch:
        shares, classes = self.shares / max(self.n_shares, 1), self.shares.shape[1]
        known = pa.array(self.ranks / self.n_ranks if self.n_ranks else [None] * len(self.ranks), pa.float64())
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, classes), pa.int32()), pa.array(shares.ravel()))
        return pa.RecordBatch.from_arrays([self.row, listed, known], names=["row", "shares", "rank_prediction"])


def score(rows: DataFrame, models: DataFrame, model: str, numeric: list[str], categorical: list[str], classes: int) -> DataFrame:
    """`rows` with the mean distribution `shares` and the mean `rank_prediction` of their model's trees.

    A model's rows are dealt into copies of SCORED rows, and a copy of the model goes through the
    shuffle behind each: a task holds its rows and a block of trees at a time; nothing is broadcast
    or collected. There are enough copies to use all cores, and a task for each on average. Rows
    whose model is absent get zeros and null.
    """
    cores, known = rows.sparkSession.sparkContext.defaultParallelism, max(1, models.select("model").distinct().count())
    most = rows.groupBy(model).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    copies = max(1, -(-most // SCORED), -(-cores // known))
    asked = rows.select(F.col(model).cast("string").alias("model"), F.pmod(F.xxhash64(*rows.columns), F.lit(copies)).cast("int").alias("copy"), F.struct(*rows.columns).alias("row"), *inputs(numeric, categorical))
    shape = asked.select("row").schema["row"].dataType.simpleString()
    held = models.select("model", "kind", "block", "trees", "data", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    #: Hashes deal unevenly: with more tasks than copies few tasks get two.
    tasks = max(4 * known * copies, 2 * cores)
    stream = held.unionByName(asked, allowMissingColumns=True).repartition(tasks, "model", "copy").sortWithinPartitions("model", "copy", F.col("data").isNotNull(), "kind", "block")
    out = stream.mapInArrow(_scorer(len(numeric), classes), f"row {shape}, shares array<double>, rank_prediction double")
    return out.select("row.*", "shares", "rank_prediction")


def importances(models: DataFrame, numeric: list[str], categorical: list[str], kind: str = CLASSIFIER) -> DataFrame:
    """(model, base_feature, importance): mean over the trees of the shares of the decrease, summed to the columns given."""
    names = F.array(*map(F.lit, [*numeric, *categorical]))
    total = models.filter(F.col("kind") == kind).select("model", "trees", F.posexplode("importances").alias("at", "part"))
    sums = total.groupBy("model", "at").agg((F.sum("part") / F.sum("trees")).alias("importance"))
    return sums.select("model", F.get(names, F.col("at")).alias("base_feature"), "importance")
