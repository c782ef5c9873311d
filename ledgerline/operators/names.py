"""Matching of company names: candidates come from equi-joins that lose no pair of the least score."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerline.functions.scalars import name_tokens, normalise_code, normalise_name

#: The least score of a fuzzy match, and the length of the character grams that names are looked up by.
LEAST, GRAM = 0.72, 3
#: The least ratio of names without a common token: their score is 0.8 times the ratio, rounded to four places.
_RATIO = (LEAST - 0.00005) / 0.8
#: The least share of common tokens of names below that ratio: their score is 0.45 times the share and at most 0.55.
_SHARE = (LEAST - 0.00005 - 0.55) / 0.45


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def _prepared(rows: DataFrame, key: str, name: str, side: str) -> DataFrame:
    norm = normalise_name(F.col(name))
    return rows.select(F.col(key).alias(f"{side}_id"), norm.alias(f"{side}_name"), F.array_distinct(name_tokens(norm)).alias(f"{side}_tokens")).filter(F.col(f"{side}_name") != "")


def token_pairs(queries: DataFrame, query_key: str, query_name: str, known: DataFrame, known_key: str, known_name: str) -> DataFrame:
    """Pairs of names that share a token, each once, and equal names that hold legal suffixes only.

    A pair is kept at the first token it shares. Work grows with the pairs that share a token, so
    `known` should be free of repeated names and words that most names hold belong into the legal
    suffixes, which block nothing.
    """
    q, k = _prepared(queries, query_key, query_name, "q"), _prepared(known, known_key, known_name, "k")
    left = q.withColumn("token", F.explode("q_tokens"))
    right = k.withColumn("token", F.explode("k_tokens"))
    shared = left.join(right, "token").filter(F.col("token") == F.array_min(F.array_intersect("q_tokens", "k_tokens"))).drop("token")
    bare = q.filter("size(q_tokens) = 0").join(k.filter("size(k_tokens) = 0"), F.col("q_name") == F.col("k_name"))
    return shared.unionByName(bare)


def _by_rarity(rows: DataFrame, side: str, counts: DataFrame) -> DataFrame:
    """`rows` with `ranked`, their tokens from the rarest of the known names' to the commonest, and `n`, how many."""
    own = [f"{side}_id", f"{side}_name", f"{side}_tokens"]
    each = rows.distinct().select(*own, F.explode(f"{side}_tokens").alias("token")).join(counts, "token", "left")
    ranked = each.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token"))).alias("ranked"))
    return ranked.select(*own, F.col("ranked.token").alias(f"{side}_ranked"), F.size("ranked").alias(f"{side}_n"))


def _prefixes(rows: DataFrame, side: str, own: str, other: str) -> DataFrame:
    """Each name under the tokens by which names of m tokens find it, for every m that can share _SHARE with its n.

    Two such names share at least o = _SHARE / (1 + _SHARE) * (n + m) tokens, so the rarest token
    that they share is among the n - o + 1 rarest of one and the m - o + 1 rarest of the other.
    """
    n, tokens = F.col(f"{side}_n"), F.col(f"{side}_ranked")
    partners = F.sequence(F.ceil(_SHARE * n - 1e-9).cast("int"), F.floor(n / _SHARE + 1e-9).cast("int"))
    least = lambda m: F.ceil(_SHARE / (1 + _SHARE) * (n + m) - 1e-9).cast("int")
    keys = F.transform(partners, lambda m: F.transform(F.slice(tokens, F.lit(1), F.greatest(F.lit(0), n - least(m) + 1)), lambda t: F.struct(m.alias("m"), t.alias("token"))))
    found = rows.withColumn("_key", F.explode(F.flatten(keys)))
    return found.select(*rows.columns, F.col("_key.token").alias("token"), n.alias(own), F.col("_key.m").alias(other))


def close_token_pairs(queries: DataFrame, query_key: str, query_name: str, known: DataFrame, known_key: str, known_name: str) -> DataFrame:
    """Pairs of names that share _SHARE of their tokens or more, each once, and equal names of legal suffixes only.

    A pair is found at the rarest token it shares. A word that most names hold comes last in every
    name, so that names meet under it only where it makes up most of one of them.
    """
    q, k = _prepared(queries, query_key, query_name, "q"), _prepared(known, known_key, known_name, "k")
    counts = k.select(F.explode("k_tokens").alias("token")).groupBy("token").count()
    left, right = _prefixes(_by_rarity(q, "q", counts), "q", "_nq", "_nk"), _prefixes(_by_rarity(k, "k", counts), "k", "_nk", "_nq")
    first = F.get(F.array_intersect("q_ranked", "k_ranked"), F.lit(0))
    shared = left.join(right, ["token", "_nq", "_nk"]).filter((F.col("token") == first) & ~_few_shared())
    bare = q.filter("size(q_tokens) = 0").join(k.filter("size(k_tokens) = 0"), F.col("q_name") == F.col("k_name"))
    return shared.select(*bare.columns).unionByName(bare)


def _few_shared() -> Column:
    return _overlap() < _SHARE * F.size(F.array_union("q_tokens", "k_tokens")) - 1e-9


def _grams(name: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.length(name) - (size - 1))
    found = F.transform(places, lambda i: F.substring(name, i, F.lit(size)))
    return F.when(F.length(name) >= size, found).otherwise(F.array().cast("array<string>"))


def _looked_up(rows: DataFrame, side: str, counts: DataFrame) -> DataFrame:
    """`rows` with `parts` (all parts of up to GRAM characters), `key` (the rarest gram) and `rare` (a prefix filter's grams).

    Names of a ratio of _RATIO or more differ by at most D = (1 - _RATIO) * (la + lb) characters. One
    that is left out breaks three grams, one that is put in two, so that of la - 2 grams at least
    (0.5 - 2.5 * (1 - _RATIO)) * (la + lb) - 2 stay, with lb >= la * _RATIO / (2 - _RATIO). With both
    names' grams in one order, a common one is among the first n + 1 - that many of either.
    """
    name, own = F.col(f"{side}_name"), [f"{side}_id", f"{side}_name", f"{side}_tokens"]
    each = rows.distinct().select(*own, F.explode_outer(_grams(name, GRAM)).alias("gram"))
    each = each.join(F.broadcast(counts), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = each.groupBy(*own).agg(F.array_sort(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct("n", "gram")))).alias("ranked"))
    stay = F.greatest(F.lit(1), F.ceil((0.5 - 2.5 * (1 - _RATIO)) * 2 / (2 - _RATIO) * F.length(name) - 2 - 1e-9))
    grams = F.col("ranked.gram")
    return ranked.select(
        *own,
        F.array_distinct(F.concat(*(_grams(name, n) for n in range(1, GRAM + 1)))).alias(f"{side}_parts"),
        F.coalesce(F.get(grams, F.lit(0)), name).alias(f"{side}_key"),
        F.array_distinct(F.slice(grams, F.lit(1), F.greatest(F.lit(0), F.size("ranked") - stay + 1).cast("int"))).alias(f"{side}_rare"),
    )


def candidate_pairs(queries: DataFrame, query_key: str, query_name: str, known: DataFrame, known_key: str, known_name: str) -> DataFrame:
    """All pairs of names that can score LEAST or more in `fuzzy_matches`, each once.

    Besides the pairs of `close_token_pairs`: names inside one another, found at the rarest gram of
    the inner one, and names of a ratio of _RATIO or more, found at rare grams of both. Grams are of
    37 characters, so their counts (37^3 rows at most) are broadcast.
    """
    args = (queries, query_key, query_name, known, known_key, known_name)
    q, k = _prepared(queries, query_key, query_name, "q"), _prepared(known, known_key, known_name, "k")
    counts = k.select(F.explode(_grams(F.col("k_name"), GRAM)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    q, k = _looked_up(q, "q", counts), _looked_up(k, "k", counts)
    none = F.size(F.array_union("q_tokens", "k_tokens")) == 0
    apart = (none | _few_shared()) & (F.col("q_name") != F.col("k_name"))
    k_in_q, q_in_k = F.contains("q_name", "k_name"), F.contains("k_name", "q_name")
    inner_k = q.withColumn("part", F.explode("q_parts")).join(k, F.col("part") == F.col("k_key")).filter(apart & k_in_q)
    inner_q = k.withColumn("part", F.explode("k_parts")).join(q, F.col("part") == F.col("q_key")).filter(apart & q_in_k)
    near = q.withColumn("gram", F.explode("q_rare")).join(k.withColumn("gram", F.explode("k_rare")), "gram")
    near = near.filter(apart & ~k_in_q & ~q_in_k & (F.col("gram") == F.array_min(F.array_intersect("q_rare", "k_rare"))))
    #: The Levenshtein distance is never above the characters left out and put in.
    near = near.filter(F.levenshtein("q_name", "k_name") <= (1 - _RATIO) * (F.length("q_name") + F.length("k_name")) + 1e-9)
    pairs = close_token_pairs(*args)
    for more in (inner_k, inner_q, near):
        pairs = pairs.unionByName(more.select(*pairs.columns))
    return pairs


def _overlap() -> Column:
    return F.size(F.array_intersect("q_tokens", "k_tokens"))


def fuzzy_matches(pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """The best known name of each query at or above the least score.

    Equal names score 1, a name inside the other 0.93, others by shared tokens and matching blocks.
    """
    within = F.contains("q_name", "k_name") | F.contains("k_name", "q_name")
    exact = F.when(F.col("q_name") == F.col("k_name"), 1.0).when(within, 0.93)
    scored = pairs.withColumn("exact", exact)
    ratio = sequence_ratio("q_name", "k_name")
    jaccard = _overlap() / F.greatest(F.lit(1), F.size(F.array_union("q_tokens", "k_tokens")))
    open_pairs = scored.filter("exact is null").withColumn("ratio", ratio)
    open_pairs = open_pairs.withColumn("score", F.round(F.greatest(jaccard * 0.45 + F.col("ratio") * 0.55, F.col("ratio") * 0.8), 4)).drop("ratio", "exact")
    every = open_pairs.unionByName(scored.filter("exact is not null").withColumnRenamed("exact", "score")).filter(F.col("score") >= least)
    return every.groupBy("q_id").agg(F.min_by("k_id", F.struct(-F.col("score"), F.col("k_id"))).alias("k_id"), F.max("score").alias("score"))


def name_score() -> Column:
    """Coverage of the query's tokens and precision of the candidate's, with a bonus for a common beginning."""
    bonus = F.when(F.startswith("k_name", "q_name") | F.startswith("q_name", "k_name"), 0.1).otherwise(0.0)
    score = F.least(F.lit(1.0), 0.7 * _overlap() / F.size("q_tokens") + 0.3 * _overlap() / F.size("k_tokens") + bonus)
    return F.when(F.col("q_name") == F.col("k_name"), 1.0).otherwise(F.round(score, 4))


def decide(queries: DataFrame, key: str, scored: DataFrame, threshold: float, gap: float) -> DataFrame:
    """matched, ambiguous or no_results for each query, by its best score and the distance to the next."""
    order = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "k_id")
    ranked = scored.select("q_id", "k_id", "score", F.lead("score", 1, 0.0).over(order).alias("second"), F.row_number().over(order).alias("n")).filter("n = 1").drop("n")
    out = queries.select(F.col(key).alias("q_id")).join(ranked, "q_id", "left")
    sure = (F.col("score") >= threshold) & (F.round(F.col("score") - F.col("second"), 6) >= gap)
    return out.withColumn("status", F.when(F.col("score").isNull(), "no_results").when(sure, "matched").otherwise("ambiguous"))


def candidate_scores(candidates: DataFrame, name: str, found: str, rank: str, nse: str | None = None, bse: str | None = None, slug: str | None = None) -> DataFrame:
    """Search results with `nse_match`, `bse_match` and the `score` of a candidate.

    `name` and `found` are the asked and the found name, `rank` the place in the search, `slug` the
    code in the candidate's address. Codes score 1 and 0.95, equal names 0.84, equal normalised names
    0.8; below 0.95 token overlap and matching blocks add up to 0.18 each and the first rank 0.03.
    """
    q, k = normalise_name(F.col(name)), normalise_name(F.col(found))
    rows = candidates.withColumns({"q_name": q, "k_name": k, "q_tokens": F.array_distinct(name_tokens(q)), "k_tokens": F.array_distinct(name_tokens(k))})
    rows = rows.withColumn("ratio", sequence_ratio("q_name", "k_name"))
    same = lambda code: F.coalesce(normalise_code(F.col(code)) == normalise_code(F.col(slug)), F.lit(False)) if code and slug else F.lit(False)
    rows = rows.withColumns({"nse_match": same(nse), "bse_match": same(bse)})
    base = F.when(F.col("nse_match"), 1.0).when(F.col("bse_match"), 0.95).when(F.lower(name) == F.lower(found), 0.84).when(F.col("q_name") == F.col("k_name"), 0.8).otherwise(0.0)
    jaccard = _overlap() / F.greatest(F.lit(1), F.size(F.array_union("q_tokens", "k_tokens")))
    bonus = F.least(jaccard * 0.18, F.lit(0.18)) + F.least(F.col("ratio") * 0.18, F.lit(0.18)) + F.when(F.col(rank) == 1, 0.03).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), base + F.when(base < 0.95, bonus).otherwise(0.0)), 4)
    return rows.withColumn("score", score).drop("q_name", "k_name", "q_tokens", "k_tokens", "ratio")


def decide_candidates(queries: DataFrame, key: str, scored: DataFrame, found: str, rank: str, threshold: float, gap: float) -> DataFrame:
    """matched, ambiguous or no_results for each query of `candidate_scores`; equal scores stay in the order of the search.

    An NSE code decides by itself, a BSE code if it leads by 0.03, others by threshold and gap.
    """
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), rank)
    best = scored.select(key, found, "nse_match", "bse_match", "score", F.lead("score", 1, 0.0).over(order).alias("second"), F.row_number().over(order).alias("n")).filter("n = 1").drop("n")
    ahead = F.round(F.col("score") - F.col("second"), 6)
    sure = F.col("nse_match") | (F.col("bse_match") & (ahead >= 0.03)) | ((F.col("score") >= threshold) & (ahead >= gap))
    status = F.when(F.col("score").isNull(), "no_results").when(sure, "matched").otherwise("ambiguous")
    out = queries.select(key).join(best, key, "left").withColumn("status", status)
    return out.select(key, F.when(F.col("status") == "matched", F.col(found)).alias("matched"), F.coalesce("score", F.lit(0.0)).alias("confidence"), F.coalesce("second", F.lit(0.0)).alias("second"), "status")
