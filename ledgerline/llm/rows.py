"""Row identity shared by the document operators.

A document row is known by (did, th): its doc_id (null sorts first) and a hash of its text.
Rows equal in both are the same document given twice and get the same result. Columns with
clashing names do no harm: operators select doc_id and text first and work on private names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null doc_id inside an operator.
NO_ID = -(2**63)

KEY = ["did", "th"]


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text): text null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def doc_id() -> Column:
    return F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id")


def hash_share(order: Column, wanted: int, total: int) -> Column:
    """Rows whose hash lies in a low range that holds about 1.5 times the wanted rows.

    Taken before a bounded sample is sorted, so that no task sends its own `wanted` rows.
    """
    share = min(1.0, 1.5 * wanted / max(1, total))
    return F.lit(True) if share >= 1 else order < F.lit(int(-(2**63) + share * 2**64))
