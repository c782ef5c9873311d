"""Exact removal of byte strings that occur more than once (operator 10).

A distributed difference-cover comparison of suffixes, to the depth of `length` bytes that
the question needs. Every text is read as UTF-8 bytes and matches never cross texts.

1. sample: suffixes that start at places of a difference cover, counted from the text's start.
   Any two equal strings of `length` bytes hold such a place at a common distance;
2. sort sampled triples: each sampled suffix is named by three consecutive blocks, the samples
   are sorted by name, and neighbours are compared. A name met once is dropped;
3. recurse on names: samples of one name are sorted on the name of their whole surroundings.
   Neighbours that agree there match in every string they speak for, and are decided;
4. merge the remaining suffixes: where surroundings differ under one name, the stretch is
   sampled again by a finer cover, whose names are nearly `length` bytes long. What differs
   there too is opened: the strings that start at unsampled places are sorted by their own
   names and neighbours compared.

This is the algorithm with one part replaced: names are hashes of content, not ranks, so equal
prefixes are neighbours, but the order is that of names, not of bytes, and no rank is recursed
on. A match is decided by two hashes of different kinds (128 bits, polynomials modulo 2^64 and
modulo a prime, and xxh3 for single strings), never by one. A name that many texts share in
many surroundings is dealt by name and surroundings; one run a task stands in for it by name.

Defined results: null text is empty; texts under `length` bytes lose nothing; rows equal in
doc_id and text are occurrences of each other, so both lose every string. The kept bytes are
a binary column, since a removed run may begin or end inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import repeats, textarrays
from ledgerline.llm.rows import KEY, doc_id, keyed
from ledgerline.session import materialise, table

LENGTH = 400
PERIOD = 273
#: A perfect difference set modulo 273 (each distance is met exactly once).
_PERFECT_273 = (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256)
FINE_PERIOD = 57
#: A perfect difference set modulo 57.
_PERFECT_57 = (0, 1, 3, 13, 32, 36, 43, 52)

_DECIDED = "did long, th long, first int, last int, gone boolean, opened boolean"
_PLACES = "did long, th long, first int, last int"

_RESULT = "did long, th long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textarrays.slices(whole, "text"):
            offsets, data = textarrays.flat(batch.column("text"))
            bounds, first, end = repeats.span_arrays(batch.column("spans"))
            removed, spans, kept = [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                a, b = bounds[i], bounds[i + 1]
                if a == b:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text.tobytes())
                    continue
                gone = textarrays.covered(len(text), first[a:b], end[a:b])
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(text[~gone].tobytes())
            columns = [batch.column("did"), batch.column("th"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["did", "th", "n_bytes", "n_removed", "n_spans", "kept"])


def difference_cover(period: int) -> np.ndarray:
    """Mask of a set of places in a period such that every distance occurs between two of them."""
    mask = np.zeros(period, bool)
    if period in (PERIOD, FINE_PERIOD):
        mask[list(_PERFECT_273 if period == PERIOD else _PERFECT_57)] = True
        return mask
    step = int(np.ceil(np.sqrt(period)))
    mask[:step] = True
    mask[::step] = True
    return mask


def _neighbours(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[np.ndarray], list[np.ndarray]]]:
    """Sorted rows, and for each key prefix whether a row equals the one before and the one after it."""
    kept, started = None, False
    for batch in chain(batches, [None]):
        parts = [t for t in (kept, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
        if not parts:
            return
        rows = pa.concat_tables(parts)
        n = rows.num_rows
        start, stop = int(started), n if batch is None else n - 1
        if stop <= start:
            kept = rows
            continue
        same, before, after = np.ones(n - 1, bool), [], []
        for key in keys:
            value = rows.column(key).to_numpy()
            same = same & (value[1:] == value[:-1])
            before.append(np.append(False, same)[start:stop])
            after.append(np.append(same, False)[start:stop])
        yield rows.slice(start, stop - start), before, after
        kept, started = rows.slice(n - 2 if n > 1 else 0), n > 1


def _compare_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples sorted by name and surroundings: which are repeated as a whole, which have to be opened."""
    for rows, (name_before, name_after), (all_before, all_after) in (_split(x) for x in _neighbours(batches, ("seed", "around"))):
        flags, place = rows.column("flags").to_numpy(), rows.column("place").to_numpy()
        settled, twin, mixed = ((flags & bit) != 0 for bit in (repeats.SETTLED, repeats.TWIN, repeats.MIXED))
        gone = settled | twin | all_before | all_after
        #: Of equal neighbours a mixed one comes first, and one that is opened speaks for all.
        opened = ~settled & (((mixed | name_before) & ~all_before) | (name_after & ~all_after))
        out = rows.select(["did", "th"])
        for name, values in (("first", (place >> 32).astype(np.int32)), ("last", (place & 0xFFFFFFFF).astype(np.int32)), ("gone", gone), ("opened", opened)):
            out = out.append_column(name, pa.array(values))
        yield from out.filter(pa.array(gone | opened)).combine_chunks().to_batches()


def _split(found: tuple[pa.Table, list[np.ndarray], list[np.ndarray]]):
    rows, before, after = found
    return rows, (before[0], after[0]), (before[1], after[1])


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, (_, before), (_, after) in _neighbours(batches, ("key", "check")):
        out = rows.select(["did", "th", "first"]).append_column("last", rows.column("first"))
        gone = before | after | (rows.column("flags").to_numpy() != 0)
        yield from out.filter(pa.array(gone)).combine_chunks().to_batches()


def _decide(texts: DataFrame, period: int, length: int, label: str) -> DataFrame:
    """Runs of strings that are repeated as a whole (gone), and runs that finer steps must look at (opened)."""
    cover = difference_cover(period)
    sampler = partial(textarrays.cover_samples, cover=cover, window=length)
    samples = texts.mapInArrow(repeats.find_runs(repeats.byte_symbols, sampler, False), repeats.RUNS)
    place = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))
    samples = samples.select("seed", "around", *KEY, place.alias("place"), "flags")
    deal = F.when(repeats.flag(repeats.APART), F.xxhash64("seed", "around")).otherwise(F.col("seed"))
    samples = samples.repartition(deal).sortWithinPartitions("seed", "around", F.desc(F.col("flags").bitwiseAND(repeats.MIXED)))
    return materialise(samples.mapInArrow(_compare_samples, _DECIDED), label)


def _with_opened(text: DataFrame, decided: DataFrame) -> DataFrame:
    runs = decided.filter("opened").groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return text.hint("merge").join(runs, KEY).select(*KEY, "text", "runs")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, fine_period: int | None = None) -> DataFrame:
    """(did, th, n_bytes, n_removed, n_spans, kept) for each row of docs (doc_id, text)."""
    docs = keyed(docs)
    text = docs.repartition(*KEY)
    coarse = _decide(docs, period, length, "samples")
    fine = _decide(_with_opened(text, coarse), fine_period or min(FINE_PERIOD, period), length, "finer-samples")

    single = _with_opened(text, fine).mapInArrow(repeats.open_windows(repeats.byte_symbols, repeats.byte_contents, length, False), repeats.WINDOWS)
    single = single.repartition("key").sortWithinPartitions("key", "check").mapInArrow(_compare_windows, _PLACES)
    gone = coarse.filter("gone").unionByName(fine.filter("gone")).select(*KEY, "first", "last")
    spans = gone.unionByName(single).groupBy(*KEY).agg(F.collect_list(F.struct("first", (F.col("last") + length).alias("end"))).alias("spans"))
    return text.join(spans, KEY, "left").select(*KEY, "text", "spans").mapInArrow(_cut, _RESULT)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
