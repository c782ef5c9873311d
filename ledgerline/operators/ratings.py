"""Rating labels, document kinds, score blends and notes, all built from column functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Both label scales from best to worst, other spellings of short-term labels,
# the words of outlooks, watches, states and actions, agencies and platforms with their words,
# and the patterns of liquidity labels.
LONG_TERM = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "C+", "C", "D")
SHORT_TERM = ("A1+", "A1", "A2+", "A2", "A3+", "A3", "A4+", "A4", "D")
SHORT_TERM_ALIASES = {"P1+": "A1+", "P1": "A1", "P2+": "A2+", "P2": "A2", "P3+": "A3+", "P3": "A3", "P4+": "A4+", "P4": "A4", "P5": "D"}
OUTLOOKS = ("STABLE", "POSITIVE", "NEGATIVE")
WATCHES = ("WATCH", "DEVELOPING")
STATES = {"is_withdrawn": "WITHDRAWN", "is_issuer_not_cooperating": "ISSUER NOT COOPERATING", "is_not_cooperating": "NOT COOPERATING", "is_best_available_information": "BEST AVAILABLE INFORMATION"}
ACTIONS = ("reaffirmed", "upgraded", "downgraded", "withdrawn", "assigned", "revised", "removed from issuer not cooperating category", "continues to remain")
AGENCIES = {
    "crisil": ("crisil ratings", "crisil limited", "crisil"),
    "care": ("care ratings", "careedge ratings", "careedge"),
    "india_ratings": ("india ratings and research", "ind-ra", "india ratings"),
    "acuite": ("acuite ratings", "acuite ratings & research", "acuite"),
    "brickwork": ("brickwork ratings", "bwr "),
    "infomerics": ("infomerics", "ivr "),
    "icra": ("icra",),
}
DOCUMENT_KINDS = {"press_release": ("press release",), "rating_rationale": ("rating rationale",)}
OTHER_KIND = "credit_rating_report"
PLATFORMS = {"RXIL": ("rxil",), "M1xchange": ("m1xchange",), "Invoicemart": ("invoicemart",), "KredX": ("kredx",), "TReDS": ("treds",), "Invoice Discounting": ("invoice discounting",)}
LIQUIDITY = {
    "Strong": ("\\bliquidity[: ]+strong\\b",),
    "Adequate": ("\\bliquidity[: ]+adequate\\b", "\\bliquidity adequate\\b", "\\bliquidity position is adequate\\b"),
    "Comfortable": ("\\bliquidity[: ]+comfortable\\b", "\\bliquidity remains comfortable\\b"),
    "Stretched": ("\\bliquidity[: ]+stretched\\b", "\\bliquidity remains stretched\\b"),
    "Weak": ("\\bliquidity[: ]+weak\\b",),
}
BLEND = (0.42, 0.2, 0.1, 0.13, 0.15)
CLASSIFIER_SHARE, RANK_SPREAD = 0.65, 1.15
HEAD = 3000


def clean_label(label: Column) -> Column:
    """Upper case; brackets, commas and semicolons are blanks; one blank between words; null is empty."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(label, F.lit(""))), "[\\[\\]();,\\s]+", " "))


def alternatives(words) -> str:
    """A pattern of any of the words, longer ones first."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def _token(clean: Column, words) -> Column:
    return F.nullif(F.regexp_extract(clean, f"(?<![A-Z0-9])({alternatives(words)})(?![A-Z0-9])", 1), F.lit(""))


def _word(clean: Column, words) -> Column:
    return F.initcap(F.nullif(F.regexp_extract(clean, f"\\b({alternatives(words)})\\b", 1), F.lit("")))


def rating_columns(label: Column) -> dict[str, Column]:
    """Scale, canonical label, rank from 1, outlook, watch and special states of a label's text.

    A long-term token goes before a short-term one. Without a token, scale, label and rank are null.
    """
    clean = clean_label(label)
    long, raw = _token(clean, LONG_TERM), _token(clean, (*SHORT_TERM, *SHORT_TERM_ALIASES))
    alias = F.create_map(*(F.lit(x) for pair in SHORT_TERM_ALIASES.items() for x in pair))
    short = F.coalesce(alias[raw], raw)
    place = lambda scale, x: F.nullif(F.array_position(F.array(*map(F.lit, scale)), x).cast("int"), F.lit(0))
    return {
        "scale": F.when(long.isNotNull(), "long_term").when(short.isNotNull(), "short_term"),
        "label": F.coalesce(long, short),
        "rank": F.coalesce(place(LONG_TERM, long), place(SHORT_TERM, short)),
        "outlook": _word(clean, OUTLOOKS),
        "watch": _word(clean, WATCHES),
        **{state: clean.rlike(f"\\b{words}\\b") for state, words in STATES.items()},
    }


def rating_action(text: Column) -> Column:
    found = F.regexp_extract(F.lower(text), f"\\b({alternatives(ACTIONS)})\\b", 1)
    return F.nullif(F.regexp_replace(F.initcap(found), "\\bTo\\b", "to"), F.lit(""))


def rating_records(events: DataFrame, group: list[str], order: list[str], current: str, previous: str, instrument: str) -> DataFrame:
    """One record per event: an id that counts the events of its group, both labels' parts, and flags.

    An event whose own label has no rank takes the previous label's.
    """
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    now, before = rating_columns(F.col(current)), rating_columns(F.col(previous))
    slug = F.regexp_replace(F.lower(F.coalesce(F.col(instrument), F.concat(F.lit("event_"), number.cast("string")))), "[^a-z0-9]+", "_")
    return events.select(
        "*", F.concat_ws("__", *group, slug, F.format_string("%02d", number)).alias("record_id"), now["scale"].alias("scale"), now["label"].alias("label"), now["outlook"].alias("outlook"),
        F.coalesce(now["rank"], before["rank"]).alias("rank"), rating_action(F.col(current)).alias("action"), now["is_withdrawn"].alias("is_withdrawn"),
        (now["is_issuer_not_cooperating"] | now["is_best_available_information"]).alias("is_not_cooperating"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def any_of(holds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, holds)


def matched(text: Column, lowered: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a pattern matches the text, case ignored; lowered: the text in lower case.

    A pattern is words, `\\b` and repeated sets of characters. Its words are looked for first, which costs
    a tenth of the pattern.
    """

    def holds(pattern: str) -> Column:
        words = [w.lower() for w in re.split(r"\\b|\[[^\]]*\]\+", pattern) if w]
        if any(re.search(r"[^a-z0-9 '-]", w) for w in words):
            raise ValueError(f"not words, \\b and repeated sets: {pattern}")
        return reduce(lambda a, b: a & b, (lowered.contains(w) for w in words)) & text.rlike(f"(?i){pattern}")

    return any_of([holds(p) for p in patterns])


def _held(lowered: Column, words: tuple[str, ...]) -> Column:
    return any_of([lowered.contains(w) for w in words])


def first_label(text: Column, words: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """The first label, in the given order, of which the text holds a word; case is ignored."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda lowered: F.coalesce(*(F.when(_held(lowered, some), label) for label, some in words.items()), F.lit(default)))


def first_pattern(texts: list[Column], patterns: dict[str, tuple[str, ...]]) -> Column:
    """The first label whose pattern matches, looked for in one text after the other."""

    def found(text: Column) -> Column:
        return let(F.struct(text.alias("text"), F.lower(text).alias("lowered")), lambda t: F.coalesce(*(F.when(matched(t["text"], t["lowered"], some), label) for label, some in patterns.items())))

    return F.coalesce(*map(found, texts))


def all_labels(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """All labels of which the text holds a word, in the given order."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda lowered: F.array_compact(F.array(*(F.when(_held(lowered, some), label) for label, some in words.items()))))


def parse_messages(docs: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row (key, message) for each check that holds."""
    messages = F.array_compact(F.array(*(F.when(holds, message) for message, holds in checks.items())))
    return docs.select(key, F.explode(messages).alias("message"))


def blended_confidence(probability: Column, completeness: Column, coverage: Column, depth: Column, context: Column) -> Column:
    parts = [w * c for w, c in zip(BLEND, (probability, completeness, coverage, depth, context), strict=True)]
    total = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.round(total, 6)))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def blended_distribution(classifier: Column, rank: Column, n: int = len(LONG_TERM)) -> Column:
    """Shares of ranks 1..n: a classifier's (array, sums to one) and a bell around the predicted rank."""
    bell = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda r: F.exp(-((rank - r) * (rank - r)) / (2 * RANK_SPREAD**2)))
    #: Bound by a lambda, bell and total are computed once a row and not once an element.
    summed = F.transform(F.array(bell), lambda b: F.struct(b.alias("bell"), F.aggregate(b, F.lit(0.0), lambda a, x: a + x).alias("total")))
    blended = F.transform(summed, lambda s: F.zip_with(classifier, s["bell"], lambda c, b: CLASSIFIER_SHARE * c + (1 - CLASSIFIER_SHARE) * b / s["total"]))
    return F.when(rank.isNull(), classifier).otherwise(blended[0])


def company_validation(results: DataFrame, by: list[str]) -> DataFrame:
    """Per company: events, exact and near hits, mean error and confidence, latest date; null keys are a group.

    Confidences are summed as decimals, so that the mean doesn't depend on the order of rows.
    """
    error = F.abs(F.col("predicted") - F.col("actual"))
    rate = lambda c: F.round(F.avg(c), 4)
    return results.groupBy(*by).agg(F.count("event_id").alias("events_evaluated"), rate((error == 0).cast("int")).alias("exact_match_rate"), rate((error <= 1).cast("int")).alias("within_one_notch_rate"), rate(error).alias("mean_abs_notch_error"), F.round(F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double") / F.count("confidence"), 4).alias("average_confidence"), F.max("rating_date").alias("latest_rating_date"))


def extraction_status(records: DataFrame, company: str, resolved: Column, message: Column, order: str, keep: int = 5) -> DataFrame:
    """Found and resolved records of each company, its status and its first messages."""
    said = F.when(message.isNotNull(), F.row_number().over(Window.partitionBy(company, message.isNotNull()).orderBy(order)))
    rows = records.select(company, resolved.cast("int").alias("ok"), said.alias("n"), message.alias("message"))
    first = F.array_sort(F.collect_list(F.when(F.col("n") <= keep, F.struct("n", "message"))))
    sums = rows.groupBy(company).agg(F.count("*").alias("n_found"), F.sum("ok").alias("n_resolved"), F.array_join(F.transform(first, lambda x: x["message"]), " | ").alias("notes"))
    status = F.when(F.col("n_resolved") == 0, "rating_extraction_failed").when(F.col("n_resolved") < F.col("n_found"), "rating_history_partial").otherwise("rating_history_extracted")
    return sums.withColumn("status", status)


#: Bits of the hash that deal a label's rows into ranges.
HOLD_BITS = 12


def hold_out(rows: DataFrame, by: str, label: str, key: str, seed: int = 42) -> DataFrame:
    """Rows marked `held_out`: a quarter of each label where a group has ten rows and no label fewer than two, else none."""
    counts = rows.groupBy(by, label).agg(F.count("*").alias("n_label"))
    sizes = counts.groupBy(by).agg((F.sum("n_label") >= 10).alias("enough"), (F.min("n_label") >= 2).alias("each"))
    known = counts.join(sizes, by).withColumn("quota", F.when(F.col("enough") & F.col("each"), F.ceil(F.col("n_label") / 4)).otherwise(0)).select(by, label, "quota")
    order = F.xxhash64(key, F.lit(seed))
    marked = rows.join(F.broadcast(known), [by, label]).withColumn("_order", order).withColumn("_range", F.shiftright("_order", 64 - HOLD_BITS))
    #: The range of hashes that a label's quota ends in; only the rows of that range are put in order.
    ranges = marked.groupBy(by, label, "quota", "_range").agg(F.count("*").alias("_n"))
    until = F.sum("_n").over(Window.partitionBy(by, label).orderBy("_range"))
    edge = ranges.withColumn("_until", until).filter((F.col("_until") > F.col("quota")) & (F.col("_until") - F.col("_n") <= F.col("quota")))
    edge = edge.select(by, label, F.col("_range").alias("_edge"), (F.col("quota") - F.col("_until") + F.col("_n")).alias("_left"))
    marked = marked.join(F.broadcast(edge), [by, label], "left")
    place = F.row_number().over(Window.partitionBy(by, label, "_range").orderBy("_order", key))
    within = marked.filter("_range = _edge").withColumn("held_out", place <= F.col("_left"))
    clear = marked.filter("_edge is null or _range <> _edge").withColumn("held_out", F.coalesce(F.col("_range") < F.col("_edge"), F.col("quota") > 0))
    marked = within.unionByName(clear).drop("quota", "_order", "_range", "_edge", "_left")
    return marked


def simulation_notes(agency: Column, published: Column, usability: Column, priority: Column, history: Column, review: Column, reason: Column, band: Column) -> Column:
    """Notes of one simulated rating, in a fixed order; parts without a value are left out or named unknown."""
    known = lambda c, other="unknown": F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return F.array_compact(
        F.array(
            F.concat(F.lit("Selected agency: "), known(agency), F.lit(".")), F.concat(F.lit("Published range: "), known(published, "manual review required"), F.lit(".")),
            F.concat(F.lit("Range usability: "), known(usability), F.lit(".")), F.concat(F.lit("CA review priority: "), known(priority), F.lit(".")),
            F.concat(F.lit("Rating history context: "), F.nullif(history, F.lit("")), F.lit(".")),
            F.when(review, known(reason, "Narrow publishable range could not be supported confidently.")),
            F.when(review, F.concat(F.lit("Internal benchmark-only calibrated band: "), F.nullif(band, F.lit("")), F.lit("."))),
        )
    )
