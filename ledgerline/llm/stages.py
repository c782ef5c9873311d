"""Operators as corpus stages: docs (the columns of documents) in, the same columns out.

Every stage keeps or changes whole rows by its operator's decisions; a changed text gets its
n_chars counted anew. Other columns travel along by the row's key and are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import language_id, mixing, packing, simhash_dedup, substring_dedup, tokens
from ledgerline.llm.rows import KEY, NO_ID, doc_id
from ledgerline.session import materialise

#: Least mean probability of the best language over a text's bytes.
SURE = 0.6


def _key(docs: DataFrame) -> DataFrame:
    """(did, th, row): a row's own columns stand apart from the names used here."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(did.alias("did"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), F.struct("*").alias("row"))


def keep_languages(docs: DataFrame) -> DataFrame:
    """Documents of a learned language that the network is sure enough of; the others go.

    Rejected are texts without any letter (undetermined), and texts whose bytes do not agree on a
    language: the best one has a mean probability under SURE over the whole text. Without any
    labelled row nothing can be told, and all stay.
    """
    languages, net = language_id.fitted(docs)
    if not languages:
        return docs
    guessed = language_id.predict(docs.select(F.struct("*").alias("row"), "text"), languages, net)
    return guessed.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= SURE)).select("row.*")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document with the least doc_id of each SimHash group; rows equal in doc_id and text give one."""
    kept = simhash_dedup.simhash_groups(docs).filter("first").groupBy(*KEY).agg(F.count("*").alias("times"))
    joined = _key(docs).join(kept, KEY)
    once = joined.filter("times = 1").select("row")
    return once.unionByName(joined.filter("times > 1").dropDuplicates(KEY).select("row")).select("row.*")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Texts without the words that an earlier passage holds; untouched texts stay byte for byte, emptied ones go."""
    cut = substring_dedup.substring_dedup(docs).filter("n_removed > 0").dropDuplicates(KEY)
    joined = _key(docs).join(cut.select(*KEY, F.col("kept").alias("left")), KEY, "left")
    row = F.col("row")
    changed = row.withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.char_length("left").cast(dict(docs.dtypes)["n_chars"]))
    return joined.filter("left is null or left <> ''").select(F.when(F.col("left").isNull(), row).otherwise(changed).alias("row")).select("row.*")


def mixed(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it; a document that it takes twice is there twice."""
    rows = materialise(mixing.sized(docs, F.array("source")), "sizes")
    chosen, _ = mixing.mix(rows)
    chosen = chosen.filter("copies > 0").groupBy(*KEY).agg(F.max("copies").alias("times"))
    joined = _key(docs).join(chosen, KEY)
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    cut = packing.pieces(docs, tokens.vocabulary(packing.VOCABULARY))
    cut = materialise(cut.select("did", "th", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.pack(cut).select(doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
