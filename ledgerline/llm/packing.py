"""Sum-of-squares packing of documents into training sequences (operator 4).

A document's ids get the end id appended and are cut into pieces of at most `capacity`
tokens. Pieces are dealt by a hash into groups of about `GROUP` pieces (the count decides
how many), and each group is packed on its own: every piece goes where the sum over residual
gaps of the squared count of open bins becomes smallest; ties take the smallest gap. Once
half of the bins that the tokens need at least are made, a new bin is made only for a piece
that fits no open one. Full pieces are sequences by themselves. A group holds lengths and
keys only, never ids.

Defined results: null text is one end id; a repeated row is packed once for each time it
occurs; an empty table gives no rows. Pieces are taken in descending length and, among
equals, in hash order, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textarrays, tokens
from ledgerline.llm.rows import doc_id, keyed
from ledgerline.session import materialise, table

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces in a group.
GROUP = 100_000
#: More than any growth of the sum.
_NEVER = 1 << 60
#: Sequence numbers that a group may use.
_SPAN = 1 << 32

_PIECES = "did long, th long, piece int, start long, length long, ids binary"


def _cutter(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokens.encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in textarrays.slices(whole, "text"):
                coded = [c + end for c in coder.encode(batch.column("text").to_pylist())]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                counts = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(coded)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                ids = [coded[o][4 * s : 4 * (s + n)] for o, s, n in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)]
                did, th = (batch.column(k).to_numpy(zero_copy_only=False)[owner] for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(th), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(ids, pa.binary())], names=["did", "th", "piece", "start", "length", "ids"])

    return run


def pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(did, th, piece, start, length, ids) of docs (doc_id, text); ids are little-endian uint32 bytes."""
    return keyed(docs).mapInArrow(_cutter(vocabulary, end_id, capacity), _PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int, choice: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, in the given order, and the number of bins.

    choice: the number of bins up to which a new bin is a choice like any other; from there on
    a new bin is made only if no open bin fits (None: always a choice).
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        #: Growth of the sum of squares by a new bin, by a bin that stays open, by one that closes.
        gap, growth = capacity, 2 * count[capacity - s] + 1 if s < capacity else 0
        if choice is not None and made >= choice:
            growth = _NEVER - 1
        inner = count[1 : capacity - s] - count[s + 1 : capacity]
        inner[count[s + 1 : capacity] == 0] = _NEVER
        if len(inner):
            at = int(inner.argmin())
            if 2 * inner[at] + 2 <= growth:
                gap, growth = s + 1 + at, 2 * inner[at] + 2
        if s < capacity and count[s] and 1 - 2 * count[s] <= growth:
            gap = s
        if gap == capacity:
            b = made
            made += 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, made


def _packer(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "order", "did", "th", "piece"], ascending=[False, True, True, True, True], kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets, _ = sum_of_squares(lengths, capacity, -(-int(lengths.sum()) // capacity) // 2)
        group["sequence_id"] = group["grp"].to_numpy() * _SPAN + bins
        group["offset"] = offsets
        return group.drop(columns=["order", "grp"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (did, th, piece, length, and what else it holds).

    Leave ids out of the table where they are not needed, and join them back by key.
    """
    count = cut.count()
    groups = max(1, -(-count // group))
    dealt = cut.withColumn("order", F.xxhash64("did", "th", "piece")).withColumn("grp", F.pmod(F.xxhash64("order"), F.lit(groups)))
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("grp").applyInPandas(_packer(capacity), schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents"), tokens.vocabulary(VOCABULARY))
    cut = materialise(cut.select("did", "th", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(cut).select(doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
