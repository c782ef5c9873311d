"""SimHash near-dedup by multi-index hashing (operator 9).

Each text gives a 64-bit fingerprint over its three-word shingles. Equal fingerprints are
put together first. A fingerprint is cut into two segments of 32 bits: of two fingerprints
within three bits, one segment differs in one bit at most. So each fingerprint is kept in a
table under both segment values and looks up the ball of radius one around each; every
match is verified by its complete distance. Links inside a dense cloud are thinned before
the look-up, without changing what is reachable: see `_near_chains`.

Defined results: A-Z are lower-cased, nothing else; null or blank text has fingerprint zero,
linked like any other; under three words the whole sequence is one shingle; null doc_ids get
fingerprints, and a component's id is its least non-null doc_id (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import textarrays
from ledgerline.llm.components import components
from ledgerline.llm.rows import NO_ID, doc_id, keyed
from ledgerline.session import materialise, table

SHINGLE = 3
SEED = 42
DISTANCE = 3
_SEGMENT = 32


def _shingle_hashes(words: list[bytes]) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(t), SEED) for t in zip(words, words[1:], words[2:], strict=False)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints, as unsigned numbers."""
    hashes: list[int] = []
    counts = []
    for text in texts:
        own = _shingle_hashes((text or "").encode().lower().split())
        hashes += own
        counts.append(len(own))
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array(counts, np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        votes = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        ones = (2 * votes > sizes[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textarrays.slices(whole, "text"):
            prints = fingerprints(batch.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array(prints)], names=["did", "th", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(did, th, fp) for each row of docs (doc_id, text); fp holds the 64 bits as a signed long."""
    return keyed(docs).mapInArrow(_fingerprint, "did long, th long, fp long")


def _near_chains(distinct: DataFrame) -> DataFrame:
    """Links between neighbours in the order of the fingerprints under each segment value.

    They are true links, and there is at most one for a fingerprint and segment. They join
    most of a dense cloud, so that few of its many pairs are left for the complete look-up.
    """
    chains = []
    for key in (F.shiftright("fp", _SEGMENT), F.col("fp").bitwiseAND(0xFFFFFFFF)):
        order = Window.partitionBy("key").orderBy("fp")
        chains.append(distinct.withColumn("key", key).select("fp", F.lag("fp").over(order).alias("b")))
    both = chains[0].unionByName(chains[1]).filter("b is not null")
    return both.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= DISTANCE).select(F.col("fp").alias("a"), "b")


def links(labelled: DataFrame) -> DataFrame:
    """Links (a, b) within DISTANCE bits between fingerprints of different groups. labelled: (fp, root)."""
    segments = [F.shiftright("fp", _SEGMENT), F.col("fp").bitwiseAND(0xFFFFFFFF)]
    entries = F.array(*[F.struct(F.lit(i).alias("segment"), v.bitwiseAND(0xFFFFFFFF).alias("key")) for i, v in enumerate(segments)])
    stored = labelled.select("fp", "root", F.inline(entries)).select("segment", "key", F.col("fp").alias("b"), F.col("root").alias("other"))
    bits = F.array(*[F.lit(1 << i) for i in range(_SEGMENT)])
    #: The value itself, and the values one bit up: of two values one bit apart, the lower finds the higher.
    ball = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.filter(bits.cast("array<long>"), lambda x: x.bitwiseAND(F.col("key")) == 0)))
    probes = labelled.select(F.col("fp"), "root", F.inline(entries)).select("segment", "key", F.col("fp").alias("a"), "root", ball.alias("flip"))
    probes = probes.withColumn("key", F.col("key").bitwiseOR(F.col("flip")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    once = (F.col("flip") != 0) | (F.col("a") < F.col("b"))
    found = probes.join(stored, ["segment", "key"]).filter(near & once & (F.col("root") != F.col("other")))
    return found.select("a", "b")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(did, th, fp, component_id, first) for each row of docs (doc_id, text).

    first says whether the row is its group's least by doc_id (null last) and text hash.
    """
    prints = materialise(with_fingerprints(docs), "fingerprints")
    order = F.struct((F.col("did") == NO_ID).alias("unnamed"), F.col("did"), F.col("th"))
    distinct = prints.groupBy("fp").agg(F.min(order).alias("least"))
    chained = components(_near_chains(distinct))
    labelled = distinct.join(chained, distinct.fp == chained.id, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = materialise(labelled, "labelled")
    found = links(labelled).join(labelled.select(F.col("fp").alias("a"), F.col("root").alias("ra")), "a")
    found = found.join(labelled.select(F.col("fp").alias("b"), F.col("root").alias("rb")), "b")
    joined = components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    whole = labelled.join(joined, labelled.root == joined.id, "left").select("fp", "least", F.coalesce(joined.root, labelled.root).alias("top"))
    whole = materialise(whole, "groups")
    names = whole.groupBy("top").agg(F.min("least").alias("head"))
    named = prints.join(whole.join(names, "top").select("fp", "head"), "fp")
    component = F.when(~F.col("head.unnamed"), F.col("head.did"))
    first = (F.col("did") == F.col("head.did")) & (F.col("th") == F.col("head.th"))
    return named.select("did", "th", "fp", component.alias("component_id"), first.alias("first"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select(doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
