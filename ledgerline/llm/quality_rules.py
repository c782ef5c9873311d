"""Quality rules by gradient-boosted trees over document statistics (operator 6).

Base rules come first: under 20 words, or over 30 % of the words inside repeated eight-word
windows, and the document fails. The others get the verdict of boosted trees that are
trained here on at most SAMPLE labelled documents (the bound), in the order of a hash of
doc_id. Shares of symbols, repeated lines, repeated words and capitals may only lower the
score (monotonic constraints). The trees are flattened into numpy node arrays, and every
document is scored from statistics over its whole text.

Defined results: null text has no words, lines or symbols, so it fails the base rules; null
labels are not learned from; if labels hold one class only or none, the base rules decide
alone; a doc_id that occurs twice is labelled and scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import doc_stats, textarrays
from ledgerline.llm.boosting import Boosted
from ledgerline.llm.rows import hash_share
from ledgerline.session import materialise, table

SAMPLE = 20_000
LEAST_WORDS = 20
REPEAT_PERCENT = 30
KEEP_FROM = 0.5

#: Shares the trees see, and the sign that each may act with.
FEATURES = {
    "symbols_per_char": ("n_symbols", "word_chars", -1), "dup_lines_per_line": ("n_dup_lines", "n_lines", -1), "repeat_words_per_word": ("n_repeat_words", "n_words", -1),
    "upper_per_char": ("n_upper", "word_chars", -1), "chars_per_word": ("word_chars", "n_words", 0), "distinct_per_word": ("n_distinct", "n_words", 0),
    "stops_per_word": ("n_stops", "n_words", 0), "words_per_line": ("n_words", "n_lines", 0), "digits_per_char": ("n_digits", "word_chars", 0),
}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textarrays.slices(whole, "text"):
            stats = doc_stats.statistics(*textarrays.flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(stats[n]) for n in doc_stats.NAMES)], names=["doc_id", *doc_stats.NAMES])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, and one long for each name in doc_stats.NAMES) for each row of docs (doc_id, text)."""
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in doc_stats.NAMES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, schema)


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([columns[a] / np.maximum(1, columns[b]) for a, b, _ in FEATURES.values()], axis=1)


def train(stats: DataFrame, labels: DataFrame) -> Boosted | None:
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = stats.join(known, "doc_id")
    joined = joined.filter(hash_share(F.xxhash64("doc_id"), SAMPLE, joined.count()))
    rows = joined.orderBy(F.xxhash64("doc_id"), *doc_stats.NAMES).limit(SAMPLE).select("quality", *doc_stats.NAMES).toPandas()
    y = (rows["quality"].to_numpy() > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    x = features({n: rows[n].to_numpy(np.float64) for n in doc_stats.NAMES})
    return Boosted().fit(x, y, np.array([s for _, _, s in FEATURES.values()]))


def _scorer(model: Boosted | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in doc_stats.NAMES}
            good = model.probability(features(columns)) if model and batch.num_rows else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good)], names=[*batch.schema.names, "p_good"])

    return run


def scored(stats: DataFrame, model: Boosted | None) -> DataFrame:
    """stats with p_good, base_failed and kept."""
    schema = ", ".join(f"{n} {t}" for n, t in stats.dtypes) + ", p_good double"
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = stats.mapInArrow(_scorer(model), schema).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(measured(table(spark, sf_dir, "documents")), "statistics")
    out = scored(stats, train(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
