"""Connected components of a link table by alternating large and small stars.

Links are first contracted inside each partition (a spanning forest of its own links), then
stars are rewired with joins and minima until nothing changes. Each round is a table in the
shared folder; neither links nor labels come to the driver, only a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialise

_LINKS = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that span the given links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        both = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
        held = list(forest(*both))
        if len(held[0]) > 500_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["a", "b"])
            held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["a", "b"])


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links (a, b), root being the least id reachable. Self-links drop out."""
    links = materialise(links.filter("a != b").mapInArrow(_contract, _LINKS).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        links = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        lower = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialise(lower.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
