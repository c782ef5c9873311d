"""Packing by Karmarkar-Karp multiway differencing (operator 12).

A document's ids get the end id appended. Full stretches of `capacity` ids are windows by
themselves; what remains of each document, less than a window, is packed in groups of
GROUP consecutive documents of a task. A group of W windows starts with one partial partition
per remainder, all of it in one of W windows. Again and again the two partitions that are
farthest from balance merge, the fullest window of one with the emptiest of the other, until
one partition is left, whose windows are near-equal.

`windows_for` raises the window count whenever the fullest window exceeds the capacity; it
cuts nothing. Where documents may be cut, `level` follows instead: W is the number of windows
that the ids fill, what exceeds the capacity of a window is cut off its last piece and given to
windows that have room, and what is left over then (less than a window) raises the count by
windows of power-of-two lengths, which need no padding. So no sequence is padded.

One pass: groups are packed where the texts are encoded, so nothing is shuffled or stored, and a
task holds the remainders of one group. Sequence numbers carry the task's number. A task that
is run again packs its documents again as a whole.

Defined results: null text is one end id; a repeated row is packed once for each time it occurs;
an empty table gives no rows; of the table only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textarrays, tokens
from ledgerline.llm.rows import doc_id, keyed
from ledgerline.session import table

CAPACITY = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Remainders in a group.
GROUP = 1024
#: Windows that a task may number.
_SPAN = 1 << 32

_PACKED = "did long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Window of each length by multiway differencing into a number of windows.

    A partial partition is its window sums in descending order, less the least of them. A merge
    adds one partition to the other in reverse; the order it leaves is kept, and from the last
    partition on the windows are handed back down to the lengths.
    """
    if windows == 1 or not len(lengths):
        return np.zeros(len(lengths), np.int64)
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, n in enumerate(lengths.tolist()):
        sums[i] = np.zeros(windows, np.int64)
        sums[i][0] = n
        heap.append((-n, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heap[0]
        both = sums.pop(x) + sums.pop(y)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        z = len(lengths) + len(merges)
        merges.append((x, y, order.astype(np.int32)))
        sums[z] = both
        heapq.heapreplace(heap, (-int(both[0]), z))
    out = np.empty(len(lengths), np.int64)
    where = {len(lengths) + len(merges) - 1: np.arange(windows)}
    if not merges:
        return np.zeros(1, np.int64)
    for k in range(len(merges) - 1, -1, -1):
        x, y, order = merges[k]
        own = where.pop(len(lengths) + k)
        for child, places in ((x, order), (y, windows - 1 - order)):
            below = np.empty(windows, np.int64)
            below[places] = own
            if child < len(lengths):
                out[child] = below[0]
            else:
                where[child] = below
    return out


def windows_for(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of whole lengths (none above the capacity): their number rises until none exceeds the capacity."""
    count = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = difference(lengths, count)
        if not len(lengths) or np.bincount(window, lengths, count).max() <= capacity:
            return window, count
        count += 1


def level(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, window, offset) of lengths that may be cut; windows are full or a power of two long."""
    total = int(lengths.sum())
    count = total // capacity
    window = difference(lengths, count) if count else np.full(len(lengths), -1)
    pieces, spare = [], []  # spare: (item, start, length) without a window
    room = np.full(count, capacity, np.int64)
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        n, w = int(lengths[i]), int(window[i])
        fits = min(n, int(room[w])) if w >= 0 else 0
        if fits:
            pieces.append((i, 0, fits, w, capacity - int(room[w])))
            room[w] -= fits
        if fits < n:
            spare.append((i, fits, n - fits))
    #: Windows with room first, then new ones for each power of two of what is left.
    open_windows = [(w, int(room[w])) for w in np.flatnonzero(room).tolist()]
    rest, bit = total - count * capacity, 1
    for k in range(rest.bit_length() - 1, -1, -1):
        bit = 1 << k
        if rest & bit:
            open_windows.append((count, bit))
            count += 1
    at, used = 0, 0
    for i, start, n in spare:
        while n:
            w, free = open_windows[at]
            take = min(n, free - used)
            pieces.append((i, start, take, w, (capacity - int(room[w]) if w < len(room) else 0) + used))
            start, n, used = start + take, n - take, used + take
            if used == free:
                at, used = at + 1, 0
    return pieces


def _packer(vocabulary: str, end_id: int, capacity: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokens.encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() * _SPAN
        rest: list[tuple[int, int, bytes, int]] = []  # (did, start, ids, ids of the document)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())], names=["did", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, rest
            found, most = [], -1
            for i, start, n, window, offset in level(np.array([len(r[2]) // 4 for r in rest], np.int64), capacity):
                did, before, ids, whole = rest[i]
                found.append((did, before + start, n, whole, number + window, offset, ids[4 * start : 4 * (start + n)]))
                most = max(most, window)
            number, rest = number + most + 1, []
            if found:
                yield rows(found)

        for whole in batches:
            for batch in textarrays.slices(whole, "text"):
                full = []
                for did, coded in zip(batch.column("did").to_pylist(), coder.encode(batch.column("text").to_pylist()), strict=True):
                    ids = coded + end
                    size = len(ids) // 4
                    for start in range(0, size - capacity + 1, capacity):
                        full.append((did, start, capacity, size, number, 0, ids[4 * start : 4 * (start + capacity)]))
                        number += 1
                    if size % capacity:
                        start = size - size % capacity
                        rest.append((did, start, ids[4 * start :], size))
                        if len(rest) == group:
                            yield from flush()
                if full:
                    yield rows(full)
        yield from flush()

    return run


def pack_by_differencing(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(did, start, length, doc_tokens, sequence_id, offset, ids) of each piece of docs (doc_id, text).

    capacity: a power of two where sequences shall need no padding. ids are little-endian uint32 bytes.
    """
    return keyed(docs).select("did", "text").mapInArrow(_packer(vocabulary, end_id, capacity, group), _PACKED)


def op12_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_by_differencing(table(spark, sf_dir, "documents"), tokens.vocabulary(VOCABULARY))
    return packed.select(doc_id(), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
