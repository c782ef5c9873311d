"""Language ID by a bidirectional gated recurrent network over bytes (operator 5).

The network labels every byte of the whole text; a text is read in stretches of STRETCH
bytes that are run side by side, and its language is the one with the highest mean
probability over all its bytes. It is trained here, in numpy, by backpropagation through
time on at most SAMPLE labelled rows a language and TOTAL in all (the bound), in the order of
a hash of doc_id; of each such row a stretch of at most EXCERPT characters, anywhere in the
text, is used for training.

Only text and non-null lang of rows with crc32(doc_id as text) mod 3 other than 1 are
learned from. Defined results: null text and text without a letter give `und` with score 1;
a null doc_id is not held out and not learned from; if no labelled row exists, all is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import textarrays
from ledgerline.llm.recurrent import Adam, Bidirectional, GatedCell
from ledgerline.llm.rows import hash_share
from ledgerline.session import table

SAMPLE = 400
TOTAL = 25_600
EXCERPT = 2000
STRETCH = 64
HIDDEN = 10
STEPS = 350
BATCH = 192
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")


def remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample: (lang, excerpt), SAMPLE rows a language and TOTAL of all languages at most."""
    order = F.xxhash64("doc_id")
    room = F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1
    known = docs.filter("lang is not null and text is not null and text rlike '\\\\p{L}'").filter(remainder() != 1)
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return []
    wanted = max(1, min(SAMPLE, TOTAL // len(counts)))
    #: Only a low range of hashes goes on, so that no task ranks all rows of a frequent language.
    below = F.coalesce(*[F.when(F.col("lang") == r["lang"], hash_share(order, wanted, r["count"])) for r in counts])
    drawn = known.filter(below).select("lang", order.alias("order"), F.substring("text", (F.pmod(order, room) + 1).cast("int"), F.lit(EXCERPT)).alias("excerpt"))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("order", "excerpt"))).filter(F.col("r") <= wanted)
    return sorted((r["lang"], r["excerpt"]) for r in ranked.collect())


def train(rows: list[tuple[str, str]], steps: int = STEPS) -> tuple[list[str], Bidirectional]:
    """Languages in order, and the trained network."""
    languages = sorted({r[0] for r in rows})
    texts = {k: [np.frombuffer(t.encode(), np.uint8) for lang, t in rows if lang == k and t] for k in languages}
    net = Bidirectional(GatedCell, 256, HIDDEN, len(languages), symbols=True, seed=5)
    adam, rng = Adam(net.p, 0.02), np.random.default_rng(5)
    for step in range(steps):
        x, mask = np.zeros((STRETCH, BATCH), np.int64), np.zeros((STRETCH, BATCH), np.float32)
        label = np.empty((STRETCH, BATCH), np.int64)
        for j in range(BATCH):
            k = (step * BATCH + j) % len(languages)
            own = texts[languages[k]]
            text = own[rng.integers(len(own))]
            #: Short stretches too, since some texts are a word or two.
            size = min(len(text), STRETCH if rng.random() < 0.7 else int(rng.integers(4, STRETCH)))
            at = int(rng.integers(len(text) - size + 1))
            x[:size, j], mask[:size, j], label[:, j] = text[at : at + size], 1, k
        grads, _ = net.gradients(x, mask, label)
        adam.step(grads, 0.1 if step > 0.8 * steps else 1.0)
    return languages, net


def pooled(net: Bidirectional, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Mean class probabilities over the bytes of each (non-empty) text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + within * STRETCH
    lengths = np.minimum(STRETCH, offsets[owner + 1] - starts)
    out = np.zeros((len(sizes), net.p["v"].shape[1]))
    padded = np.concatenate((data, np.zeros(STRETCH, np.uint8)))
    for i in range(0, len(starts), 4096):
        s, n = starts[i : i + 4096], lengths[i : i + 4096]
        steps = np.arange(STRETCH)[:, None]
        mask = (steps < n).astype(np.float32)
        full = bool((n == STRETCH).all())
        prob = net.probabilities(padded[s + steps], None if full else mask)
        np.add.at(out, owner[i : i + 4096], (prob * mask[..., None]).sum(axis=0))
    return out / np.maximum(sizes, 1)[:, None]


def _predictor(languages: list[str], net: Bidirectional):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textarrays.slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                spoken = np.array([bool(t and _LETTER.search(t)) for t in texts]) & bool(languages)
                offsets, data = textarrays.flat(batch.column("text"))
                lang, score = np.full(len(texts), UNDETERMINED, object), np.ones(len(texts))
                if spoken.any():
                    prob = pooled(net, offsets, data)
                    best = prob.argmax(axis=1)
                    lang[spoken] = np.array(languages, object)[best[spoken]]
                    score[spoken] = np.clip(prob.max(axis=1)[spoken], 0, 1)
                others = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
                names = [x for x in batch.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays([*others, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, languages: list[str], net: Bidirectional | None) -> DataFrame:
    """docs (text and other columns) with lang_pred and score in place of text."""
    others = [(c, t) for c, t in docs.dtypes if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*others, ("lang_pred", "string"), ("score", "double")])
    return docs.mapInArrow(_predictor(languages, net), schema)


def fitted(docs: DataFrame) -> tuple[list[str], Bidirectional | None]:
    rows = training_rows(docs)
    return train(rows) if rows else ([], None)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs)
    held = F.coalesce(remainder() == 1, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), *model)
