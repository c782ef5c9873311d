"""Anchored search for repeated windows, of the substring operator; its parts also serve operator 10.

Steps, each a Spark shuffle on a key that one text can't flood:

1. every text gives its winnowed anchors (textarrays.anchors): a sample of places that two
   equal windows always share. Anchors equal within one slice of texts are combined at once,
   so that a passage found in a third of all texts reaches the exchange once a slice;
2. anchors meet by seed. Runs with the same surroundings match to their full extent, so
   the whole run is decided; only where surroundings differ under one seed can matches
   end inside the run, and only those runs are opened into single windows (the extension);
3. opened windows meet by two hashes of different kinds, of 64 bits each (the names of runs are
   two hashes as well), and those equal within one slice are combined likewise;
4. the decided intervals are gathered by text.

No pair of occurrences is ever formed: work is linear in the occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import textarrays
from ledgerline.llm.rows import KEY
from ledgerline.session import materialise

RUNS = "seed long, around long, did long, th long, first int, last int, flags tinyint"
WINDOWS = "key long, check long, did long, th long, first int, flags tinyint"
#: Bits of flags: decided already; has an equal in its task; other surroundings are known under its name; dealt by these as well.
SETTLED, TWIN, MIXED, APART = 1, 2, 4, 8
#: Names that one task remembers, to send a frequent one once.
REMEMBERED = 1 << 20

Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
Contents = Callable[[pa.Array, np.ndarray, int], np.ndarray]
Sampler = Callable[..., dict[str, np.ndarray]]


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and each text's first word."""
    offsets, data = textarrays.flat(texts)
    starts, ends, bounds = textarrays.words(offsets, data)
    return textarrays.word_hashes(data, starts, ends), bounds


def byte_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = textarrays.flat(texts)
    return textarrays.byte_hashes(data), offsets


def word_contents(texts: pa.Array, at: np.ndarray, window: int) -> np.ndarray:
    """xxh3 of the window of words (joined by one space) that starts at each of the given words."""
    offsets, data = textarrays.flat(texts)
    starts, ends, _ = textarrays.words(offsets, data)
    lengths = ends - starts
    edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths + 1)))
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined = np.full(int(edges[-1]), 32, np.uint8)
    joined[place + np.repeat(edges[:-1], lengths)] = data[place + np.repeat(starts, lengths)]
    view, digest = memoryview(joined.tobytes()), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a:b]) for a, b in zip(edges[at].tolist(), (edges[at + window] - 1).tolist(), strict=True)], np.uint64)


def byte_contents(texts: pa.Array, at: np.ndarray, window: int) -> np.ndarray:
    view, digest = memoryview(textarrays.flat(texts)[1].tobytes()), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a : a + window]) for a in at.tolist()], np.uint64)


class Memory:
    """Names that this task has sent already, as a sorted array; it forgets all when full."""

    def __init__(self):
        self.names = np.zeros(0, np.uint64)

    def holds(self, names: np.ndarray) -> np.ndarray:
        return np.isin(names, self.names, assume_unique=False) if len(self.names) else np.zeros(len(names), bool)

    def add(self, names: np.ndarray) -> None:
        if len(names):
            kept = self.names if len(self.names) + len(names) <= REMEMBERED else self.names[:0]
            self.names = np.union1d(kept, names[:REMEMBERED])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textarrays.mix(a.view(np.uint64) ^ textarrays.mix(b.view(np.uint64) + np.uint64(1)))


def find_runs(symbols: Symbols, sampler: Sampler, keep_first: bool):
    """The sampled runs of all texts; runs equal within one slice of texts are combined.

    With a column `runs` the sampler gets the mask of the window starts in them as well.
    If every occurrence counts (not keep_first), a task sends runs of one name and surroundings
    twice at most. A run is mixed if its task knows other surroundings under its seed: then
    it is dealt by seed and surroundings, and one of its kind stands in for all by the seed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twins, varied = Memory(), Memory()
        for whole in batches:
            for batch in textarrays.slices(whole, "text"):
                h, bounds = symbols(batch.column("text"))
                a = sampler(h, bounds, wanted=_mask(batch.column("runs"), bounds)) if "runs" in batch.schema.names else sampler(h, bounds)
                n = len(a["text"])
                if not n:
                    continue
                did = batch.column("did").to_numpy(zero_copy_only=False)[a["text"]]
                th = batch.column("th").to_numpy(zero_copy_only=False)[a["text"]]
                order = np.lexsort((a["first"], th, did, a["around"], a["seed"]))
                seed, around, did, th, first, last = (x[order] for x in (a["seed"], a["around"], did, th, a["first"], a["last"]))
                new = np.ones(n, bool)
                new[1:] = (seed[1:] != seed[:-1]) | (around[1:] != around[:-1])
                size = np.diff(np.append(np.flatnonzero(new), n))
                twin = np.repeat(size > 1, size)
                #: The run that stands for its equals goes on; the others are decided here.
                settled = ~new
                flags = np.zeros(n, np.int8)
                if keep_first:
                    head = np.repeat(np.flatnonzero(new), size)
                    settled &= ~((did == did[head]) & (th == th[head]) & (first == first[head]))
                    emit = new | settled
                else:
                    emit = np.ones(n, bool)
                    name = _pair(seed, around)
                    known = twins.holds(name)
                    twins.add(name[new & twin & ~known])
                    settled = settled | known
                    flags = _mixed(seed, new, settled, varied)
                out_seed = np.where(settled, textarrays.mix((did ^ (th << 1)).view(np.uint64) + first.view(np.uint64)).view(np.int64), seed)
                flags = flags | (SETTLED * settled + TWIN * twin).astype(np.int8)
                columns = [out_seed, np.where(settled, 0, around), did, th, first.astype(np.int32), last.astype(np.int32), flags]
                #: In text order, so that neighbouring rows of a shuffled block share a document.
                merged = _join_settled(columns, settled, emit, order)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged], names=["seed", "around", "did", "th", "first", "last", "flags"])

    return run


def _mixed(seed: np.ndarray, new: np.ndarray, settled: np.ndarray, varied: Memory) -> np.ndarray:
    """Bits of the sorted runs: which are mixed, and which of them are dealt apart; `varied` holds seeds that have a stand-in."""
    edge = np.ones(len(seed), bool)
    edge[1:] = seed[1:] != seed[:-1]
    heads = np.flatnonzero(edge)
    sizes = np.diff(np.append(heads, len(seed)))
    kinds = np.add.reduceat(new.astype(np.int64), heads)
    told = varied.holds(seed[heads].view(np.uint64))
    mixed = np.repeat((kinds > 1) | told, sizes) & ~settled
    #: The first run of a seed that goes on stands in for all, if none of this task has yet.
    going = np.flatnonzero(mixed)
    lead = np.zeros(len(seed), bool)
    if len(going):
        first = np.ones(len(going), bool)
        first[1:] = seed[going][1:] != seed[going][:-1]
        lead[going[first]] = True
        lead &= ~np.repeat(told, sizes)
        varied.add(np.unique(seed[lead].view(np.uint64)))
    return (MIXED * mixed + APART * (mixed & ~lead)).astype(np.int8)


def _join_settled(columns: list[np.ndarray], settled: np.ndarray, emit: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """Settled runs of one text that touch or overlap become one row."""
    going = np.flatnonzero(emit & ~settled)
    going = going[np.argsort(order[going])]
    going = [c[going] for c in columns]
    done = [c[settled] for c in columns]
    if len(done[0]):
        order = np.lexsort((done[5], done[4], done[3], done[2]))
        done = [c[order] for c in done]
        new = np.ones(len(order), bool)
        new[1:] = (done[2][1:] != done[2][:-1]) | (done[3][1:] != done[3][:-1]) | (done[4][1:] > done[5][:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(order)) - 1
        done = [c[tail] if i == 5 else c[head] for i, c in enumerate(done)]
    return [np.concatenate(pair) for pair in zip(going, done, strict=True)]


def union(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one owner that touch or overlap joined into one; no run lies inside a later one."""
    order = np.lexsort((last, first, owner))
    owner, first, last = owner[order], first[order], last[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (first[1:] > last[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order)).astype(np.int64) - 1
    return owner[head], first[head], last[tail[: len(head)]]


def _places(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text (index), first and last of the runs of all texts, joined where they touch."""
    counts = np.diff(runs.offsets.to_numpy())
    inner = runs.flatten()
    first, last = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    return union(np.repeat(np.arange(len(runs)), counts), first, last)


def _mask(runs: pa.ListArray, bounds: np.ndarray) -> np.ndarray:
    text, first, last = _places(runs)
    return textarrays.covered(int(bounds[-1]), first + bounds[text], last + bounds[text] + 1)


def open_windows(symbols: Symbols, contents: Contents, window: int, keep_first: bool):
    """The single windows of the open runs, each once, by hash and contents.

    Of windows equal within one slice the first goes on as their twin, and the others are
    settled; if every occurrence counts, so are those that the task has sent a twin of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twins = Memory()
        for whole in batches:
            for batch in textarrays.slices(whole, "text"):
                h, bounds = symbols(batch.column("text"))
                text, first, last = _places(batch.column("runs"))
                sizes = last - first + 1
                n = int(sizes.sum())
                if not n:
                    continue
                heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                at = np.arange(n) - np.repeat(heads - first, sizes)
                owner = np.repeat(text, sizes)
                key = textarrays.rolled(h, window)[at + bounds[owner]].view(np.int64)
                check = contents(batch.column("text"), at + bounds[owner], window).view(np.int64)
                did = batch.column("did").to_numpy(zero_copy_only=False)[owner]
                th = batch.column("th").to_numpy(zero_copy_only=False)[owner]
                order = np.lexsort((at, th, did, check, key))
                key, check, did, th, at = (x[order] for x in (key, check, did, th, at))
                new = np.ones(n, bool)
                new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
                size = np.diff(np.append(np.flatnonzero(new), n))
                twin, settled = np.repeat(size > 1, size), ~new
                if keep_first:
                    head = np.repeat(np.flatnonzero(new), size)
                    settled &= ~((did == did[head]) & (th == th[head]) & (at == at[head]))
                else:
                    name = _pair(key, check)
                    known = twins.holds(name)
                    twins.add(name[new & twin & ~known])
                    settled |= known
                key = np.where(settled, textarrays.mix((did ^ (th << 1)).view(np.uint64) + at.view(np.uint64)).view(np.int64), key)
                columns = [key, np.where(settled, 0, check), did, th, at.astype(np.int32), (SETTLED * settled + TWIN * twin).astype(np.int8)]
                back = np.argsort(order)
                yield pa.RecordBatch.from_arrays([pa.array(c[back]) for c in columns], names=["key", "check", "did", "th", "first", "flags"])

    return run


def flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def repeated(docs: DataFrame, symbols: Symbols, contents: Contents, gram: int, window: int, keep_first: bool) -> DataFrame:
    """(did, th, text, spans) of `docs` (did, th, text): spans hold all repeated windows.

    keep_first: leave the first occurrence (least did, th, place) of each window out.
    Spans are [first, end) in symbols, not merged; null where a text has none.
    """
    runs = docs.mapInArrow(find_runs(symbols, lambda h, bounds: textarrays.anchors(h, bounds, gram, window), keep_first), RUNS)
    runs = runs.withColumns({"settled": flag(SETTLED), "twin": flag(TWIN)})
    same = Window.partitionBy("seed", "around").orderBy("did", "th", "first")
    seeds = Window.partitionBy("seed")
    place = F.rank().over(same)
    if keep_first:
        gone = F.col("settled") | (place > 1)
        opened = ~F.col("settled") & (place == 1)
    else:
        number = F.row_number().over(same)
        gone = F.col("settled") | F.col("twin") | (F.count("*").over(Window.partitionBy("seed", "around")) > 1)
        opened = ~F.col("settled") & (number == 1)
    decided = runs.select("*", gone.alias("gone"), opened.alias("opened"), (F.min("around").over(seeds) != F.max("around").over(seeds)).alias("mixed"))
    decided = decided.select(*KEY, "first", "last", "gone", (F.col("opened") & F.col("mixed")).alias("opened"))
    decided = materialise(decided.filter("gone or opened"), "runs")

    text = docs.repartition(*KEY)
    wanted = decided.filter("opened").groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    single = text.hint("merge").join(wanted, KEY).select(*KEY, "text", "runs").mapInArrow(open_windows(symbols, contents, window, keep_first), WINDOWS)
    single = single.withColumns({"settled": flag(SETTLED), "twin": flag(TWIN)})
    alike = Window.partitionBy("key", "check")
    if keep_first:
        again = F.col("settled") | (F.rank().over(alike.orderBy("did", "th", "first")) > 1)
    else:
        again = F.col("settled") | F.col("twin") | (F.count("*").over(alike) > 1)
    single = single.withColumn("again", again).filter("again").select(*KEY, "first", F.col("first").alias("last"))
    spans = decided.filter("gone").select(*KEY, "first", "last").unionByName(single)
    spans = spans.groupBy(*KEY).agg(F.collect_list(F.struct("first", (F.col("last") + window).alias("end"))).alias("spans"))
    return text.join(spans, KEY, "left").select(*KEY, "text", "spans")


def span_arrays(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, starts and ends of a column of spans."""
    spans = spans if isinstance(spans, pa.ListArray) else spans.combine_chunks()
    lengths = np.diff(spans.offsets.to_numpy())
    lengths = np.where(spans.is_null().to_numpy(zero_copy_only=False), 0, lengths) if spans.null_count else lengths
    inner = spans.flatten()
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    first, end = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    return bounds, first, end
