"""Substring dedup by run and window hashes on winnowed anchors (operator 8).

Words `[^\\x20\\x09-\\x0D]+` stay as they are. Texts are joined on winnowed anchors of ten
words (a window of twenty words always holds one), and every word that an earlier repeat of
twenty words or more covers is removed. The dealt method, seed and extend, is replaced: no
match is extended. The run of windows around an anchor is compared by a hash of its whole
surroundings; where these differ, each of its windows is hashed and ranked by itself. Extension
compares pairs of occurrences, n^2 of them for n copies; hashes and ranks form no pair. The
words covered are the same: a maximal repeat is the union of the windows that it holds.

Defined results: null or blank text gives no words and an empty kept text; texts of under
twenty words lose nothing; rows equal in doc_id and text count once and get equal results;
rows that share a doc_id but not the text are ordered by a hash of the text; a null doc_id
comes before all others. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import repeats, textarrays
from ledgerline.llm.rows import doc_id, keyed
from ledgerline.session import table

WINDOW = 20
GRAM = 10

_RESULT = "did long, th long, n_words long, n_removed long, kept string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textarrays.slices(whole, "text"):
            texts = batch.column("text").to_pylist()
            bounds, first, end = repeats.span_arrays(batch.column("spans"))
            total, removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = text.encode().split()
                a, b = bounds[i], bounds[i + 1]
                if a < b:
                    gone = textarrays.covered(len(words), first[a:b], end[a:b])
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    left = words
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["did", "th", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(did, th, n_words, n_removed, kept) for each row of docs (doc_id, text)."""
    found = repeats.repeated(keyed(docs), repeats.word_symbols, repeats.word_contents, gram, window, keep_first=True)
    return found.mapInArrow(_cut, _RESULT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(doc_id(), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM starts
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE r > 1
), lost AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), joined AS (
  SELECT words.doc_id, w, coalesce(gone, []) AS gone FROM words LEFT JOIN lost ON words.doc_id = lost.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM joined
"""
