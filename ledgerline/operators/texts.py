"""Text-to-table jobs: keyword scores, phrases, contacts, links and grouped lines, all built from column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keyword groups of adverse mentions with their weights.
ADVERSE = {
    "fraud_signal_hits": ("fraud", "forgery", "embezzlement", "diversion", "misappropriation", "siphoning", "wilful defaulter", "willful defaulter", "scam", "sfio", "ed raid"),
    "regulatory_action_hits": ("sebi", "rbi penalty", "penalty", "show cause", "adjudication", "regulatory action", "nclt", "nclat", "suspension", "disqualified"),
    "insolvency_signal_hits": ("insolvency", "ibc", "bankruptcy", "resolution professional", "liquidation", "default", "npa", "restructuring", "cdr"),
    "litigation_signal_hits": ("litigation", "court", "legal notice", "petition", "lawsuit", "criminal case", "f.i.r", "fir"),
}
ADVERSE_WEIGHTS = {"fraud_signal_hits": 2.5, "regulatory_action_hits": 1.75, "insolvency_signal_hits": 2.25, "litigation_signal_hits": 1.25, "promoter_adverse_hits": 1.5, "public_negative_news_hits": 0.5}
PEOPLE = ("promoter", "director")
RISK_CAP, RISK_FLAG, OUTLOOK_CAP = 10.0, 4.0, 5.0

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}"
LINK = 'href="([^"]+)"'


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the lower-cased text holds, each counted once; null text holds none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return _total([lowered.contains(w).cast("int") for w in words])


def adverse_scores(mentions: DataFrame, company: str, text: Column) -> DataFrame:
    """Adverse hits and the capped risk score of each company."""
    hits = mentions.select(company, *(keyword_hits(text, words).alias(group) for group, words in ADVERSE.items()), (keyword_hits(text, PEOPLE) > 0).alias("people"))
    bad = _total([F.col(g) for g in ADVERSE]) > 0
    sums = hits.groupBy(company).agg(*(F.sum(g).alias(g) for g in ADVERSE), F.sum((bad & F.col("people")).cast("int")).alias("promoter_adverse_hits"), F.sum(bad.cast("int")).alias("public_negative_news_hits"))
    score = F.least(F.lit(RISK_CAP), _total([F.col(c) * w for c, w in ADVERSE_WEIGHTS.items()]))
    return sums.withColumn("public_risk_score", score).withColumn("public_risk_flag", F.col("public_risk_score") >= RISK_FLAG)


def outlook_scores(mentions: DataFrame, group: str, rank: str, text: str, positive: tuple[str, ...], negative: tuple[str, ...], keep: int = 5) -> DataFrame:
    """Positive minus negative hits, clipped, and the ranks of the first mentions."""
    hit = keyword_hits(F.col(text), positive) - keyword_hits(F.col(text), negative)
    first = F.row_number().over(Window.partitionBy(group).orderBy(rank)) <= keep
    out = mentions.select(group, rank, hit.alias("hit"), first.alias("first")).groupBy(group)
    return out.agg(F.greatest(F.lit(-OUTLOOK_CAP), F.least(F.lit(OUTLOOK_CAP), F.sum("hit").cast("double"))).alias("outlook"), F.array_sort(F.collect_list(F.when(F.col("first"), F.col(rank)))).alias("mentions"))


def signal_rates(rows: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """(by, signal, mentions, rate) of boolean columns; signals never set are left out."""
    long = rows.select(by, *(F.col(f).cast("int").alias(f) for f in flags)).unpivot(by, flags, "signal", "value")
    return long.groupBy(by, "signal").agg(F.sum("value").alias("mentions"), F.avg("value").alias("rate")).filter("mentions > 0")


def top_phrases(rows: DataFrame, by: str, phrases: Column, n: int = 10) -> DataFrame:
    """The n commonest phrases of each group; equal counts go by phrase."""
    counts = rows.select(by, F.explode(phrases).alias("phrase")).groupBy(by, "phrase").agg(F.count("*").alias("mentions"))
    order = Window.partitionBy(by).orderBy(F.col("mentions").desc(), "phrase")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def line_groups(docs: DataFrame, key: str, text: str, start: str, end: str) -> DataFrame:
    """Lines from each start line up to the next start or end line, as one record each.

    Lines before the first start, and from an end line up to the next start, belong to none.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line"))
    starts, ends = F.col("line").rlike(start), F.col("line").rlike(end) & ~F.col("line").rlike(start)
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"record": F.sum(starts.cast("int")).over(so_far), "closed": F.sum(ends.cast("int")).over(so_far)})
    opened = F.min("closed").over(Window.partitionBy(key, "record"))
    inside = lines.filter("record > 0").withColumn("opened", opened).filter("closed = opened")
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return inside.groupBy(key, "record").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))


def fill_down(rows: DataFrame, by: list[str], order: str, cell: str) -> DataFrame:
    """Empty cells take the nearest filled cell above."""
    above = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(cell, F.last(F.nullif(F.col(cell), F.lit("")), ignorenulls=True).over(above))


def emails(text: Column, n: int = 2) -> Column:
    """The first n e-mail addresses of a text in lower case, each once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, F.lower)), 1, n)


def links(pages: DataFrame, key: str, url: str, html: str, n: int = 20) -> DataFrame:
    """The first n distinct link targets of each page; targets from / on get the page's host."""
    host = F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1)
    raw = pages.select(key, host.alias("host"), F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)).alias("found"))
    full = F.transform("found", lambda x: F.when(x.startswith("/"), F.concat("host", x)).otherwise(x))
    return raw.select(key, F.posexplode(F.slice(F.array_distinct(full), 1, n)).alias("place", "link"))
