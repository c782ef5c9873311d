"""Cross-tokenizer alignment (operator 13): which tokens of two vocabularies cover the same bytes.

Vocabulary A is a byte-level BPE file of the tokenizers library, B a sentencepiece model with
byte fallback. Both read a blank and the text. Where tokens of A and B end at one byte, a group
ends; every A token of a group is linked with every B token of it. How many documents hold an
id pair linked is counted over the whole table by external spill counting:

1. Tasks align documents and flush what they found in runs of about RUN_RECORDS pair-document
   records. A run holds each of its pairs once, with the number of its documents, radix-parted
   by the A id, side-major (by A, then B) within a part, each part a zstd blob. So a pair that
   all documents hold travels once a run, not once a document.
2. Per radix part a k-way heap merge over the heads of the runs adds up each pair; as all pairs
   of an A id come together, its highest count is known when the merge leaves it. More than
   FAN_IN runs are merged in several levels.
3. The merged counts are streamed against the part's runs once more and every run gets back the
   counts of its own pairs; with them its documents are summed up.

Both tokenizers are cut at the same places (a single blank or newline before a visible
character), which no token of either crosses, so a distinct piece of text is aligned once a
worker and remembered. Groups of very many tokens are formed from distinct ids with their
multiplicities, so that work and memory stay bounded.

Defined results: a text that is null, empty or not reproduced byte by byte by both vocabularies
has no tokens (zeros and an empty text of groups); repeated rows are documents of their own;
an empty table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textarrays, tokens
from ledgerline.llm.rows import doc_id, keyed
from ledgerline.session import materialise, table

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Pair-document records in a run, and documents in it at most.
RUN_RECORDS = 2_000_000
RUN_DOCUMENTS = 50_000
#: Runs that one heap merges.
FAN_IN = 1024
#: Distinct pieces of text that a worker remembers when a run begins; it flushes a run early at half as many again.
REMEMBERED = 300_000
#: Bits of a B id within a pair.
_B_BITS = 20
#: Groups with more links than this are formed from distinct ids.
_LARGE = 4096
#: Runs that a task may number.
_SPAN = 1 << 32

_ALIGNED = "kind int, run long, part int, did long, n_a long, n_b long, n_groups long, n_links long, groups string, data binary"
_MERGED = "part int, grp long, data binary"
_RETURNED = "run long, part int, data binary"
_SUMMED = "did long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _pack(*columns: np.ndarray) -> bytes:
    """Sorted keys as differences, then further columns of one length, as one zstd blob."""
    keys, *rest = columns
    raw = np.diff(keys, prepend=0).astype("<i8").tobytes() + b"".join(c.astype("<i8").tobytes() for c in rest)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8").reshape(columns, -1)
    return [np.cumsum(flat[0]), *flat[1:]]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given lengths."""
    running = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return running[ends] - running[ends - counts]


class Aligner:
    """Aligns texts piece by piece; remembers pieces and numbers the id pairs it meets."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokens.Encoder(path_a, plain=True), tokens.PieceEncoder(path_b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.size_a, self.size_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: How an id is written: before another id of its side, and as the last one of its group.
        self.text_a, self.text_b = ([np.array([b"%d%c" % (i, c) for i in range(len(table))], object) for c in b"," + last] for table, last in ((self.bytes_a, b"|"), (self.bytes_b, b";")))
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.pair_number: dict[int, int] = {}
        self.pair_keys = np.zeros(0, np.int64)
        #: Per piece: tokens of A and B, groups, links, whether both give back its bytes; its groups; where its links are.
        self.facts = np.zeros((0, 5), np.int64)
        self.texts = np.zeros(0, object)
        self.bounds = np.zeros(1, np.int64)
        self.links, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Align pieces that aren't known yet."""
        raw = [p.encode() for p in pieces]
        coded_a, coded_b = self.a.encode_pieces(pieces), self.b.encode_pieces(pieces)
        flat_a, flat_b = np.frombuffer(b"".join(coded_a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(coded_b), np.int64)
        count_a, count_b = (np.fromiter(map(len, c), np.int64, len(pieces)) // k for c, k in ((coded_a, 4), (coded_b, 1)))
        size = np.fromiter(map(len, raw), np.int64, len(pieces))
        same = (_sums(self.size_a[flat_a], count_a) == size) & (_sums(self.size_b[flat_b], count_b) == size)
        for table, flat, count in ((self.bytes_a, flat_a, count_a), (self.bytes_b, flat_b, count_b)):
            #: One comparison for all pieces of the right size, and single ones where it fails.
            told = b"".join(map(table.__getitem__, flat[np.repeat(same, count)].tolist()))
            if told != b"".join(compress(raw, same)):
                ends = np.cumsum(count)
                same &= [b"".join(map(table.__getitem__, flat[e - n : e].tolist())) == r for e, n, r in zip(ends, count, raw, strict=True)]
        good = np.flatnonzero(same)
        ids_a, ids_b = flat_a[np.repeat(same, count_a)], flat_b[np.repeat(same, count_b)]
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        many_a, many_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        piece_ends = np.cumsum(size[good])
        owner = np.searchsorted(piece_ends, ends)  # of groups, among the good
        links = many_a * many_b

        facts = np.zeros((len(pieces), 5), np.int64)
        for k, values in enumerate((many_a, many_b, np.ones(len(ends), np.int64), links)):
            own = np.zeros(len(good), np.int64)
            np.add.at(own, owner, values)
            facts[good, k] = own
        facts[good, 4] = 1

        #: Written groups: A ids, then B ids, each followed by what stands behind it.
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
        last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
        out = np.empty(len(ids_a) + len(ids_b), object)
        out[np.arange(len(ids_a)) + first_b[group_a]] = np.where(last_a, self.text_a[1][ids_a], self.text_a[0][ids_a])
        out[np.arange(len(ids_b)) + (first_a + many_a)[group_b]] = np.where(last_b, self.text_b[1][ids_b], self.text_b[0][ids_b])
        ends_out = np.concatenate(([0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))))
        cuts = ends_out[np.concatenate(([0], np.cumsum(facts[good, 0] + facts[good, 1])))].tolist()
        written = b"".join(out)
        texts = np.full(len(pieces), b"", object)
        texts[good] = np.array([written[a:b] for a, b in pairwise(cuts)] + [None], object)[:-1]

        small = links[group_a] <= _LARGE
        at = np.flatnonzero(small)
        width = many_b[group_a[at]]
        left = np.repeat(at, width)
        step = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
        keys = [ids_a[left] << _B_BITS | ids_b[first_b[group_a[left]] + step]]
        pieces_of = [owner[group_a[left]]]
        times = [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(links > _LARGE):
            x, nx = np.unique(ids_a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
            y, ny = np.unique(ids_b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            keys.append((x[:, None] << _B_BITS | y[None]).ravel())
            times.append((nx[:, None] * ny[None]).ravel())
            pieces_of.append(np.full(len(x) * len(y), owner[g]))
        keys, times, pieces_of = np.concatenate(keys), np.concatenate(times), good[np.concatenate(pieces_of)]
        order = np.lexsort((keys, pieces_of))
        keys, times, pieces_of = keys[order], times[order], pieces_of[order]
        head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (pieces_of[1:] != pieces_of[:-1]))) if len(keys) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, head) if len(head) else times
        keys, pieces_of = keys[head], pieces_of[head]

        distinct, where = np.unique(keys, return_inverse=True)
        numbers = self.pair_number
        numbered = np.array([numbers.setdefault(k, len(numbers)) for k in distinct.tolist()], np.int64)
        grown = np.empty(len(numbers), np.int64)
        grown[: len(self.pair_keys)] = self.pair_keys
        grown[numbered] = distinct
        self.pair_keys = grown
        base = len(self.known)
        for i, p in enumerate(pieces):
            self.known[p] = base + i
        self.facts = np.concatenate((self.facts, facts))
        self.texts = np.concatenate((self.texts, texts))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(np.bincount(pieces_of, minlength=len(pieces)))))
        self.links, self.times = np.concatenate((self.links, numbered[where])), np.concatenate((self.times, times))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Facts and written groups of each text; then its distinct pairs: text, pair number, how often linked."""
        cut = [self.a.cut(" " + t) if t else [] for t in texts]
        new = {p for own in cut for p in own if p not in self.known}
        if new:
            self.learn(list(new))
        sizes = np.array([len(own) for own in cut], np.int64)
        at = np.fromiter((self.known[p] for own in cut for p in own), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(self.facts[at], 0)))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        facts = sums[bounds[1:]] - sums[bounds[:-1]]
        good = (facts[:, 4] == sizes) & (sizes > 0)
        facts[~good] = 0
        written = self.texts[at]
        groups = [b"".join(written[bounds[i] : bounds[i + 1]])[:-1] if good[i] else b"" for i in range(len(texts))]
        #: Distinct pieces of each text, then the pairs of these.
        seen, times = np.unique((owner * (len(self.known) + 1) + at)[good[owner]], return_counts=True)
        owner, at = np.divmod(seen, len(self.known) + 1)
        width = self.bounds[at + 1] - self.bounds[at]
        flat = np.repeat(self.bounds[at] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        owner, pair, times = np.repeat(owner, width), self.links[flat], self.times[flat] * np.repeat(times, width)
        order = np.argsort(owner << 32 | pair)
        owner, pair, times = owner[order], pair[order], times[order]
        if len(pair):
            head = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])))
            owner, pair, times = owner[head], pair[head], np.add.reduceat(times, head)
        return facts, groups, owner, pair, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's own aligner of two vocabularies."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _align(path_a: str, path_b: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, schema = aligner(path_a, path_b), _schema(_ALIGNED)
        number = TaskContext.get().partitionId() * _SPAN
        held: list[tuple] = []
        records = documents = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, records, documents
            count = np.bincount(np.concatenate([h[3] for h in held]), minlength=len(al.pair_keys)) if held else np.zeros(0, np.int64)
            used = np.flatnonzero(count)
            part = (al.pair_keys[used] >> _B_BITS) % parts
            order = np.lexsort((al.pair_keys[used], part))
            used, part = used[order], part[order]
            place = np.zeros(len(count), np.int64)
            place[used] = np.arange(len(used))
            heads = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [_pack(al.pair_keys[u], count[u]) for u in np.split(used, heads[1:])] if len(used) else []
            if blobs:
                yield _batch(schema, kind=[0] * len(blobs), run=[number] * len(blobs), part=part[heads], data=blobs)
            for dids, facts, owner, pair, times, groups in held:
                data, at = [], np.searchsorted(owner, np.arange(len(dids) + 1))
                spot = place[pair]
                for i, j in zip(at[:-1], at[1:], strict=True):
                    own = np.argsort(spot[i:j])
                    raw = np.diff(spot[i:j][own], prepend=0).astype("<u4").tobytes() + times[i:j][own].astype("<u4").tobytes()
                    data.append(zstandard.ZstdCompressor(level=1).compress(raw))
                named = dict(zip(("n_a", "n_b", "n_groups", "n_links"), facts.T[:4], strict=True))
                yield _batch(schema, kind=[1] * len(dids), run=[number] * len(dids), did=dids, groups=[g.decode() for g in groups], data=data, **named)
            number, held, records, documents = number + 1, [], 0, 0
            if len(al.known) > REMEMBERED:
                al.reset()

        for whole in batches:
            for batch in textarrays.slices(whole, "text"):
                facts, groups, owner, pair, times = al.align(batch.column("text").to_pylist())
                held.append((batch.column("did").to_numpy(zero_copy_only=False), facts, owner, pair, times, groups))
                records, documents = records + len(pair), documents + batch.num_rows
                if records >= RUN_RECORDS or documents >= RUN_DOCUMENTS or 2 * len(al.known) > 3 * REMEMBERED:
                    yield from flush()
        if held:
            yield from flush()

    return run


def heap_merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge runs of (sorted pairs, counts): one A id after another, its B ids in order with their sums."""
    heads = []
    for r, (keys, _) in enumerate(runs):
        if len(keys):
            heads.append((int(keys[0] >> _B_BITS), r, 0))
    heapq.heapify(heads)
    while heads:
        side, keys, counts = heads[0][0], [], []
        while heads and heads[0][0] == side:
            _, r, at = heads[0]
            own, number = runs[r]
            end = int(np.searchsorted(own, (side + 1) << _B_BITS))
            keys.append(own[at:end])
            counts.append(number[at:end])
            if end < len(own):
                heapq.heapreplace(heads, (int(own[end] >> _B_BITS), r, end))
            else:
                heapq.heappop(heads)
        if len(keys) == 1:
            yield keys[0], counts[0]
            continue
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        yield distinct, total


def _merge(final: bool):
    """Merge the runs of each (part, grp); the final level also says which pairs have their A id's highest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_MERGED)

        def merged(key: tuple[int, int], blobs: list[bytes]) -> pa.RecordBatch:
            keys, counts, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own, number in heap_merge([tuple(_unpack(b, 2)) for b in blobs]):
                keys.append(own)
                counts.append(number)
                best.append((number == number.max()).astype(np.int64))
            columns = [np.concatenate(c) for c in ((keys, counts, best) if final else (keys, counts))]
            return _batch(schema, part=[key[0]], grp=[key[1]], data=[_pack(*columns)])

        key, blobs = None, []
        for batch in batches:
            for part, grp, blob in zip(*(batch.column(k).to_pylist() for k in ("part", "grp", "data")), strict=True):
                if key is not None and key != (part, grp):
                    yield merged(key, blobs)
                    blobs = []
                key = (part, grp)
                blobs.append(blob)
        if key is not None:
            yield merged(key, blobs)

    return run


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's merged counts come first, then its runs: each gets the counts of its own pairs."""
    schema = _schema(_RETURNED)
    keys = counts = best = None
    for batch in batches:
        rows = []
        for kind, number, part, blob in zip(*(batch.column(k).to_pylist() for k in ("kind", "run", "part", "data")), strict=True):
            if kind == 0:
                keys, counts, best = _unpack(blob, 3)
                continue
            at = np.searchsorted(keys, _unpack(blob, 2)[0])
            rows.append((number, part, zstandard.ZstdCompressor(level=1).compress((counts[at] << 1 | best[at]).astype("<i8").tobytes())))
        if rows:
            number, part, data = zip(*rows, strict=True)
            yield _batch(schema, run=number, part=part, data=data)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run's counts come first, part by part, then its documents."""
    schema, zstd = _schema(_SUMMED), zstandard.ZstdDecompressor()
    current, given, count, best = None, [], None, None
    for batch in batches:
        kinds, numbers, data = (batch.column(k).to_pylist() for k in ("kind", "run", "data"))
        rows, n_best, count_sum = [], [], []
        for i, (kind, number, blob) in enumerate(zip(kinds, numbers, data, strict=True)):
            if number != current:
                current, given, count = number, [], None
            if kind == 0:
                given.append(np.frombuffer(zstd.decompress(blob), "<i8"))
                continue
            if count is None:
                both = np.concatenate([np.zeros(0, np.int64), *given])
                count, best, given = both >> 1, both & 1, []
            step, times = np.frombuffer(zstd.decompress(blob), "<u4").reshape(2, -1).astype(np.int64)
            at = np.cumsum(step)
            rows.append(i)
            n_best.append(int((times * best[at]).sum()))
            count_sum.append(int((times * count[at]).sum()))
        if rows:
            kept = batch.take(pa.array(rows))
            columns = {k: kept.column(k) for k in ("did", "n_a", "n_b", "n_groups", "n_links", "groups")}
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.array({"n_best": n_best, "count_sum": count_sum}[f.name], f.type) for f in schema], schema=schema)


def aligned(docs: DataFrame, path_a: str, path_b: str, parts: int) -> DataFrame:
    """Documents (kind 1, with their groups written out) and the parts of the runs (kind 0) that a task flushes."""
    return keyed(docs).select("did", "text").mapInArrow(_align(path_a, path_b, parts), _ALIGNED)


def summed(rows: DataFrame, parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """Count the pairs of a written table of `aligned` rows and sum up its documents."""
    runs = rows.filter("kind = 0").select("run", "part", "data")
    count = runs.agg(F.countDistinct("run")).first()[0]
    merged, level = runs.select("part", F.col("run").alias("grp"), "data"), count
    while level > fan_in:
        level = -(-level // fan_in)
        dealt = merged.withColumn("grp", F.pmod(F.xxhash64("grp"), F.lit(level)))
        merged = materialise(dealt.repartition("part", "grp").sortWithinPartitions("part", "grp").mapInArrow(_merge(False), _MERGED), "merged")
    whole = merged.withColumn("grp", F.lit(0).cast("long")).repartition(parts, "part").sortWithinPartitions("part")
    whole = materialise(whole.mapInArrow(_merge(True), _MERGED), "counts")
    both = whole.select(F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("run"), "part", "data").unionByName(runs.select(F.lit(1).alias("kind"), "run", "part", "data"))
    returned = both.repartition(parts, "part").sortWithinPartitions("part", "kind", "run").mapInArrow(_give_back, _RETURNED)
    owned = rows.filter("kind = 1").unionByName(returned.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return owned.repartition("run").sortWithinPartitions("run", "kind", "part").mapInArrow(_sum_up, _SUMMED)


def radix_parts(spark: SparkSession) -> int:
    """Parts of the pairs by A id: as many as the session shuffles into."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(did, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document."""
    parts = radix_parts(docs.sparkSession)
    return summed(materialise(aligned(docs, path_a, path_b, parts), "aligned"), parts)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = radix_parts(spark)
    rows = aligned(table(spark, sf_dir, "documents"), tokens.vocabulary(VOCABULARY_A), tokens.vocabulary(VOCABULARY_B), parts)
    #: The digest takes the place of the written groups before the table is written.
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    out = summed(materialise(rows.withColumn("groups", digest), "aligned"), parts)
    return out.select(doc_id(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
