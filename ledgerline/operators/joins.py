"""As-of, range, nearest-neighbour and choice joins as compositions of DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_window(events: DataFrame, periods: DataFrame, key: str, event_id: str, event_date: str, period_date: str, lag_days: int, n: int) -> DataFrame:
    """For each event the last n periods of its key that are at least lag_days older; recency 1 is the newest.

    Events and periods of a key are put in one order; an event knows how many periods lie before
    it and looks those n up by their number, so no event meets all periods of its key.
    """
    of = Window.partitionBy("_key").orderBy("_at", F.col("_is").desc()).rowsBetween(Window.unboundedPreceding, 0)
    marks = events.select(F.col(key).alias("_key"), F.date_sub(event_date, lag_days).alias("_at"), F.lit(0).alias("_is"), F.struct(*events.columns).alias("_event"), F.lit(None).cast(periods.schema).alias("_period"))
    lines = periods.select(F.col(key).alias("_key"), F.col(period_date).alias("_at"), F.lit(1).alias("_is"), F.lit(None).cast(events.schema).alias("_event"), F.struct(*periods.columns).alias("_period"))
    placed = marks.unionByName(lines).filter("_at is not null").withColumn("_n", F.sum("_is").over(of))
    first = F.greatest(F.col("_n") - (n - 1), F.lit(1))
    asked = placed.filter("_is = 0 and _n > 0").select("_key", "_event", "_n", F.explode(F.sequence(first, F.col("_n"))).alias("_place"))
    known = placed.filter("_is = 1").select("_key", F.col("_n").alias("_place"), "_period")
    kept = [f"_period.{c}" for c in periods.columns if c != key]
    return asked.join(known, ["_key", "_place"]).select("_event.*", *kept, (F.col("_n") - F.col("_place") + 1).cast("int").alias("recency"))


def prior_value(events: DataFrame, by: list[str], date: str, tie: str, value: str, name: str) -> DataFrame:
    """The value of the last event of the same keys on an earlier day (same-day events do not see each other)."""
    days = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    earlier = Window.partitionBy(*by).orderBy(days).rangeBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct(F.col(date), F.col(tie), F.col(value))).over(earlier)
    return events.withColumn(name, best[value]).withColumn(name + "_date", best[date])


def asof_latest(left: DataFrame, left_id: list[str], left_date: str, right: DataFrame, key: str, right_date: str, tie: str, values: list[str], bucket: str = "month") -> DataFrame:
    """Left rows (one for each left_id and date) with the newest right row of the same key strictly before their date (null if none).

    Both sides are put in one order within the buckets of time of their key, where the last right
    row is carried on; what an earlier bucket ends with comes from a table of one row a key and
    bucket. So a key of very many rows is split by its buckets, and no row meets all of its key.
    """
    row = F.struct(right_date, tie, *values)
    known = right.filter(F.col(key).isNotNull() & F.col(right_date).isNotNull()).select(F.col(key).alias("_key"), F.col(right_date).cast("date").alias("_at"), row.alias("_row"))
    asked = left.select(*left_id, left_date).distinct() if key in left_id else left.select(*left_id, left_date, key).distinct()
    marks = asked.select(F.col(key).alias("_key"), F.col(left_date).cast("date").alias("_at"), F.struct(*left_id, left_date).alias("_left"))
    both = marks.unionByName(known, allowMissingColumns=True).withColumn("_b", F.trunc("_at", bucket))
    days = F.datediff(F.col("_at"), F.lit("1970-01-01").cast("date"))
    earlier = Window.partitionBy("_key", "_b").orderBy(days).rangeBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("_within", F.max("_row").over(earlier)).filter("_left is not null")
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("_key", "_b").agg(F.max("_row").alias("_last")).withColumn("_carried", F.max("_last").over(before)).select("_key", "_b", "_carried")
    found = within.join(ends, ["_key", "_b"], "left").withColumn("_found", F.coalesce("_within", "_carried"))
    return found.select("_left.*", *(F.col("_found")[v].alias(v) for v in values))


def nearest_by_ratio(targets: DataFrame, candidates: DataFrame, group: str, own: str, value: str, tie: list[str], n: int, base: float = 2.0) -> DataFrame:
    """For each target (id `target`) the n candidates of its group nearest by |ln ratio|.

    in_band says whether a candidate lies within [value / base, value * base]; others count only
    for targets without any of those. Targets and candidates are ordered within logarithmic
    buckets of their group, and sums over the buckets make that an order of the whole group. A
    target looks up its neighbours on both sides by place: n, and as many as it owns itself.
    """
    bucket = F.floor(F.log(F.col(value)) / F.log(F.lit(base)))
    extra = [x for x in tie if x not in (own, group, value)]
    c = candidates.filter(F.col(value) > 0).withColumns({"_b": bucket, "_is": F.lit(1), "target": F.lit(None).cast(dict(targets.dtypes)["target"])})
    t = targets.filter(F.col(value) > 0).withColumns({"_b": bucket, "_is": F.lit(0)} | {x: F.lit(None).cast(dict(candidates.dtypes)[x]) for x in extra})
    columns = [group, "_b", "_is", "target", own, value, *extra]
    both = t.select(*columns).unionByName(c.select(*columns))
    ties = [own, *extra]
    rows = Window.unboundedPreceding, 0
    up = Window.partitionBy(group, "_b").orderBy(F.col(value), "_is", *ties).rowsBetween(*rows)
    down = Window.partitionBy(group, "_b").orderBy(F.col(value).desc(), F.col("_is").desc(), *ties).rowsBetween(*rows)
    both = both.withColumns({"_up": F.sum("_is").over(up), "_down": F.sum("_is").over(down)})
    sizes = c.groupBy(group, "_b").agg(F.count("*").alias("_size"))
    #: One row a bucket: places of candidates in the buckets below, and in those above.
    marks = both.select(group, "_b").distinct().join(sizes, [group, "_b"], "left")
    along = Window.partitionBy(group).orderBy("_b")
    against = Window.partitionBy(group).orderBy(F.col("_b").desc())
    before = lambda w: F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.select(group, "_b", before(along).alias("_under"), before(against).alias("_over"))
    placed = both.join(marks, [group, "_b"]).withColumns({"_up": F.col("_up") + F.col("_under"), "_down": F.col("_down") + F.col("_over")})
    owned = c.groupBy(F.col(group), F.col(own)).agg(F.count("*").alias("_owned"))
    asked = placed.filter("_is = 0").join(owned, [group, own], "left").withColumn("_reach", F.lit(n) + F.coalesce("_owned", F.lit(0)))
    ask = lambda side: asked.select(group, "target", own, F.col(value).alias("_v"), F.lit(side).alias("_side"), F.explode(F.sequence(F.col(side) + 1, F.col(side) + F.col("_reach"))).alias("_place"))
    tell = lambda side: placed.filter("_is = 1").select(group, F.lit(side).alias("_side"), F.col(side).alias("_place"), F.col(own).alias("_peer"), value, *extra)
    found = ask("_up").unionByName(ask("_down")).join(tell("_up").unionByName(tell("_down")), [group, "_side", "_place"]).filter(F.col(own) != F.col("_peer"))
    found = found.withColumn("in_band", F.col(value).between(F.col("_v") / base, F.col("_v") * base))
    any_band = F.max("in_band").over(Window.partitionBy("target"))
    distance = F.abs(F.log(F.col(value) / F.col("_v")))
    order = Window.partitionBy("target").orderBy(distance, "_peer", *extra)
    near = found.withColumn("_any", any_band).filter("in_band or not _any").withColumn("distance", distance).withColumn("nearness", F.row_number().over(order))
    return near.filter(F.col("nearness") <= n).select("target", own, group, "_v", "_peer", value, *extra, "in_band", "distance", "nearness")


def one_per_key(rows: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def first_source(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """All rows of the first source that knows the key, with the source's name."""
    parts = [df.withColumns({"source": F.lit(name), "_priority": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    best = F.min("_priority").over(Window.partitionBy(key))
    return union.withColumn("_best", best).filter("_priority = _best").drop("_priority", "_best")


def overlay(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Replace fields by the non-null values of the overrides."""
    o = overrides.select(key, *(F.col(f).alias("_" + f) for f in fields))
    return rows.join(o, key, "left").withColumns({f: F.coalesce("_" + f, f) for f in fields}).drop(*("_" + f for f in fields))


def text_key(c: str) -> Column:
    """A join key that matches null with null."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))
