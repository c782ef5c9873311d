"""Periodic run detection (operator 11): stretches of words that repeat with a period.

A run is a stretch of words whose smallest period q fits at least `EXPONENT` times into it
(and that has at least LEAST words), which no neighbouring word extends. Words are numbered
per slice of texts and all texts of a slice are worked on at once, a word of its own between
two of them, so no run crosses.

Periods up to DIRECT are found by direct scans of each lag. Longer ones by minimizers at one
scale per doubling: for periods in (k/2, k] grams of k words are hashed and the least gram of
every window of k/2 grams is chosen. In a run of four periods two windows one period apart
hold the same words, so they choose grams one period apart; within a run grams of k >= q words
are equal at multiples of q only, so these two are neighbours among the equal chosen grams.
Neighbours at a distance in (k/2, k] are seeds; each seed is extended word by word both ways
unless a stretch of its lag holds it already. Every equality that counts is of words: a
collision of gram hashes (64 bits) can only add a seed that extension refuses.

Periods of a stretch that are not smallest are refused by a test of the divisors of the lag;
the stretch is found with the smaller one. Work is linear in the text a scale.

Defined results: a null text has no words; repeated rows are worked on each by itself; an empty
table gives no rows; a column of another name in the table does no harm, as only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textarrays
from ledgerline.llm.rows import doc_id, keyed
from ledgerline.session import table

EXPONENT = 4
LEAST = 6
#: Periods up to here are scanned lag by lag; scales begin above. A power of two.
DIRECT = 8
WORD = r"[^\x20\x09-\x0D]+"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "did long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def least_length(period: int) -> int:
    return max(LEAST, EXPONENT * period)


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] if n > 1 else found


def _smallest(ids: np.ndarray, start: int, lag: int) -> bool:
    """Whether a stretch of two lags or more has no smaller period: none that divides the lag (a smaller one would)."""
    root = ids[start : start + lag]
    return not any(np.array_equal(root[lag // p :], root[: lag - lag // p]) for p in _primes(lag))


def _agreeing(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from places i and j on, forwards (step 1) or backwards (-1), by growing blocks."""
    done, block = 0, 32
    room = len(ids) - j if step > 0 else i + 1
    while done < room:
        n = min(block, room - done)
        if step > 0:
            same = ids[i + done : i + done + n] == ids[j + done : j + done + n]
        else:
            same = ids[i - done - n + 1 : i - done + 1][::-1] == ids[j - done - n + 1 : j - done + 1][::-1]
        if not same.all():
            return done + int(same.argmin())
        done, block = done + n, min(2 * block, 1 << 16)
    return done


def _direct(ids: np.ndarray, lag: int) -> Iterator[tuple[int, int, int]]:
    """Runs of one short period: maximal stretches of places that agree with the place a lag further on."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ids[lag:] == ids[:-lag], [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2] + lag
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if len(starts) else ():
        if b - a >= least_length(lag) and _smallest(ids, a, lag):
            yield a, b - a, lag


def _seeds(grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring equal minimizers at distances in (k/2, k]: earlier places and distances."""
    low = np.uint64((1 << max(28, len(grams).bit_length())) - 1)
    order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = np.unique((textarrays._sliding_min(order, k // 2) & low).astype(np.int64))
    by = np.lexsort((at, grams[at]))
    at, values = at[by], grams[at][by]
    gap = at[1:] - at[:-1]
    use = (values[1:] == values[:-1]) & (gap > k // 2) & (gap <= k)
    return at[:-1][use], gap[use]


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of numbered words, by start, then period. longest: words of the longest text."""
    found: list[tuple[int, int, int]] = []
    for lag in range(1, min(DIRECT, longest // EXPONENT) + 1):
        found.extend(_direct(ids, lag))
    grams, k = textarrays.mix(ids.astype(np.uint64) + np.uint64(1)), 1
    #: Runs of periods in (k/2, k] have 4 (k/2 + 1) words at least.
    while EXPONENT * (k // 2 + 1) <= longest or k <= DIRECT:
        if k > DIRECT:
            places, lags = _seeds(grams, k)
            by = np.lexsort((places, lags))
            held, end = 0, -1
            for i, lag in zip(places[by].tolist(), lags[by].tolist(), strict=True):
                if lag == held and i < end:
                    continue
                before, after = _agreeing(ids, i - 1, i + lag - 1, -1), _agreeing(ids, i, i + lag, 1)
                held, end = lag, i + after
                length = before + after + lag
                if length >= least_length(lag) and _smallest(ids, i - before, lag):
                    found.append((i - before, length, lag))
        if len(grams) <= k:
            break
        grams = textarrays.mix(grams[:-k] * _ROLL + grams[k:])
        k *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, a number of its own after each text, and where each text starts."""
    known: dict[bytes, int] = {}
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    ids = np.empty(int(starts[-1]), np.int64)
    for a, words in zip(starts.tolist(), texts, strict=False):
        ids[a : a + len(words)] = [known.setdefault(w, len(known)) for w in words]
    ids[starts[1:] - 1] = len(known) + np.arange(len(texts))
    return ids, starts


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textarrays.slices(whole, "text"):
            #: bytes.split() parts at exactly the six characters that words don't hold.
            texts = [t.encode().split() for t in batch.column("text").to_pylist()]
            ids, starts = _numbered(texts)
            runs: list[list[dict]] = [[] for _ in texts]
            for a, n, q in find_runs(ids, max(map(len, texts))):
                own = int(np.searchsorted(starts, a, side="right")) - 1
                runs[own].append({"start": a - int(starts[own]), "length": n, "period": q})
            collapsed = []
            for words, own in zip(texts, runs, strict=True):
                if own:
                    start, length, period = (np.array([r[k] for r in own]) for k in ("start", "length", "period"))
                    gone = textarrays.covered(len(words), start + period, start + length)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                collapsed.append(b" ".join(words).decode())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("did"), sizes, pa.array(runs, pa.list_(_RUN)), pa.array(collapsed)], names=["did", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(did, n_words, runs, collapsed) of docs (doc_id, text): runs by start, then period; collapsed keeps a run's first period."""
    return keyed(docs).select("did", "text").mapInArrow(_scan, _RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 of the doc_id ends in the digit 0 get a run: from word a on, the p words there repeat.

    With h the crc32, g = h div 10 and n words: a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    g = F.expr("crc32(cast(doc_id as string)) div 10")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    n = F.size("_words")
    planted = F.expr("array_join(transform(_words, (w, i) -> if(i < _a, w, _words[cast(_a + (i - _a) % _p as int)])), ' ')")
    #: Words are kept for the few documents that need them only.
    out = docs.select("doc_id", "text", g.alias("_g"), F.when(F.expr("crc32(cast(doc_id as string)) % 10 = 0"), words).alias("_words"))
    out = out.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    out = out.withColumn("_p", F.expr("1 + (size(_words) - _a) div (3 + _g % 8)"))
    return out.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def greatest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties take the smallest start, then period, which comes first."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.reduce(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", greatest(F.col("runs")))
    return found.select(
        doc_id(), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
