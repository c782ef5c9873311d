"""Mixing sources to target weights by min-cost flow (operator 7).

Documents are aggregated by membership pattern (the set of sources they belong to). A flow
network joins patterns to the sources they may serve: a pattern offers its words once at no
cost, a second time at cost 1 and a third time at cost 2 (convex repetition costs), and every
source takes its target. The flow says how many words each pattern gives; whole rounds take
every document, and the last, partial round takes documents in the order of a seeded hash.

The network has one node for a pattern and one for a source. Its size follows the number of
sources, not of rows: it is refused beyond MAX_PATTERNS, where sources are no longer a
configuration. The seeded order is found from sums over HASH_BUCKETS ranges of the hash, and
over as many parts of the range that a pattern ends in, LEVELS times; only the documents of
the last such part are sorted.

Defined results: null text has size 0; null source is a source of its own, last in order; a
document without words is never taken; rows equal in doc_id and text share one decision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.rows import KEY, NO_ID, doc_id
from ledgerline.session import materialise, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 7
HASH_BUCKETS = 4096
LEVELS = 2
MAX_PATTERNS = 100_000
#: Documents that are still out and fit what their pattern owes.
OPEN = "not chosen and size > 0 and unit <= owed"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the total by weight; none above `repeats` times its size, the excess shared again."""
    total = float(sum(sizes))
    full: set[int] = set()
    while True:
        left = total - sum(repeats * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        share = {i: left * w / weight for i, w in enumerate(weights) if i not in full} if weight else {}
        over = {i for i, x in share.items() if x > repeats * sizes[i]}
        if not over:
            return [float(repeats * s) if i in full else share[i] for i, s in enumerate(sizes)]
        full |= over


def min_cost_flow(offers: list[int], members: list[list[int]], demands: list[int], repeats: int = REPEATS) -> list[int]:
    """Words that each pattern gives.

    A source that no pattern shares with another is settled at once: it takes its target or all that
    it offers. The others make a network of origin, patterns, sources and sink. Only the arcs from
    the origin have a cost, r for a pattern's round r + 1, so a cheapest path costs what its first
    arc does: rounds are opened one after the other, and in each the flow is raised to the greatest
    (blocking flows along shortest paths). That is the flow of least cost.
    """
    shared = {s for own in members if len(own) > 1 for s in own}
    given = [0] * len(offers)
    nodes = []
    for p, own in enumerate(members):
        if len(own) == 1 and own[0] not in shared:
            given[p] = min(demands[own[0]], repeats * offers[p])
        elif offers[p] and own:
            nodes.append(p)
    if not nodes:
        return given
    n, source = len(nodes), {s: k for k, s in enumerate(sorted(shared))}
    sink = 1 + n + len(source)
    head: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, size: int) -> None:
        for u, v, r in ((a, b, size), (b, a, 0)):
            arcs[u].append(len(head))
            head.append(v)
            room.append(r)

    for k, p in enumerate(nodes):
        arc(0, 1 + k, 0)
        for s in members[p]:
            arc(1 + k, 1 + n + source[s], repeats * offers[p])
    for s, k in source.items():
        arc(1 + n + k, sink, demands[s])
    for _ in range(repeats):
        for k, p in enumerate(nodes):
            room[arcs[0][k]] += offers[p]
        while _raise(head, room, arcs, sink):
            pass
    for k, p in enumerate(nodes):
        given[p] = room[arcs[0][k] ^ 1]
    return given


def _raise(head: list[int], room: list[int], arcs: list[list[int]], sink: int) -> bool:
    """Raise a flow from node 0 along all shortest paths; whether there was one. Arc i ^ 1 is the reverse of arc i."""
    level = [-1] * len(arcs)
    level[0] = 0
    reached = [0]
    for a in reached:
        if level[sink] >= 0 and level[a] >= level[sink]:
            break
        for i in arcs[a]:
            if room[i] and level[head[i]] < 0:
                level[head[i]] = level[a] + 1
                reached.append(head[i])
    if level[sink] < 0:
        return False
    at = [0] * len(arcs)
    path: list[int] = []
    a = 0
    while True:
        if a == sink:
            push = min(room[i] for i in path)
            for i in path:
                room[i] -= push
                room[i ^ 1] += push
            #: Go on from the first arc that is full now.
            full = next(k for k, i in enumerate(path) if not room[i])
            a = head[path[full] ^ 1]
            del path[full:]
            continue
        own = arcs[a]
        while at[a] < len(own) and not (room[own[at[a]]] and level[head[own[at[a]]]] == level[a] + 1):
            at[a] += 1
        if at[a] < len(own):
            path.append(own[at[a]])
            a = head[own[at[a]]]
        elif path:
            #: A dead end: the arc that led here is passed by.
            a = head[path.pop() ^ 1]
            at[a] += 1
        else:
            return True


def sized(docs: DataFrame, sources: Column) -> DataFrame:
    """(did, th, size, pattern): size in words; pattern is the sorted set of the row's sources, null last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), "[^x]+", "")).cast("long")
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), size.alias("size"), pattern.alias("pattern"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Decide a mix of rows (did, th, size, pattern), a table that is cheap to read again.

    Returns (did, th, size, pattern, copies) and (source, source_size, target). Sources take
    the weights in turn, in the order of their code points, null last.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted((tuple(r["pattern"]) for r in sums), key=lambda p: [(s is None, s or "") for s in p])
    size_of = {tuple(r["pattern"]): r["size"] for r in sums}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    held = dict.fromkeys(names, 0)
    for p in patterns:
        for s in p:
            held[s] += size_of[p]
    sizes = [held[s] for s in names]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    offers = [size_of[p] for p in patterns]
    place = {s: i for i, s in enumerate(names)}
    given = min_cost_flow(offers, [[place[s] for s in p] for p in patterns], [round(t) for t in wanted])
    plan = [(list(p), g // o if o else 0, g % o if o else 0) for p, o, g in zip(patterns, offers, given, strict=True)]
    plan = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, rounds long, rest long"))
    shares = spark.createDataFrame(list(zip(names, sizes, wanted, strict=True)), "source string, source_size long, target double")

    order = F.xxhash64("did", "th", F.lit(seed))
    dealt = rows.join(plan.withColumnRenamed("pattern", "p"), F.col("pattern").eqNullSafe(F.col("p")))
    dealt = dealt.select(*KEY, "size", "pattern", "rounds", F.col("rest").alias("owed"), order.alias("order"), F.lit(False).alias("chosen"))
    #: Equal rows share one decision, so what has to fit is all of them. Only sums of several rows are joined.
    sums = dealt.groupBy("pattern", "order").agg(F.sum("size").alias("unit"), F.count("*").alias("n")).filter("n > 1")
    sums = sums.select(F.col("pattern").alias("p"), F.col("order").alias("o"), "unit")
    dealt = dealt.join(sums, (F.col("order") == F.col("o")) & F.col("pattern").eqNullSafe(F.col("p")), "left").drop("p", "o")
    dealt = materialise(dealt.withColumn("unit", F.coalesce("unit", "size")), "mix")
    #: Each pass lowers what is owed, for the first open document of a pattern fits. Only open rows are written again.
    settled, still_open = [dealt.filter(f"not ({OPEN})")], dealt.filter(OPEN)
    while not still_open.isEmpty():
        filled = materialise(_fill(still_open), "mix")
        settled.append(filled.filter(f"not ({OPEN})"))
        still_open = filled.filter(OPEN)
    #: One table of few files again: plans and tasks of the last steps don't grow with the passes.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(reduce(DataFrame.unionByName, settled).coalesce(parts), "mix")
    #: What a pattern owes in the end is the least that any of its rows was settled with.
    dealt = _with(dealt, dealt.groupBy("pattern").agg(F.min("owed").alias("left"))).withColumn("owed", F.col("left")).drop("left")
    #: One more document comes as near as one can; the first in the seeded order among equals.
    miss = F.abs(F.col("owed") - F.col("unit"))
    filler = dealt.filter(~F.col("chosen") & (F.col("size") > 0) & (miss < F.col("owed"))).groupBy("pattern").agg(F.min(F.struct(miss.alias("miss"), F.col("order"))).alias("best"))
    dealt = _with(dealt, filler.select("pattern", F.col("best.order").alias("extra")))
    extra = F.col("chosen") | F.coalesce(F.col("order") == F.col("extra"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("rounds") + extra.cast("int")).otherwise(0)
    return dealt.select(*KEY, "size", "pattern", copies.cast("int").alias("copies")), shares


def _with(dealt: DataFrame, facts: DataFrame) -> DataFrame:
    """Join facts of which there is one row a pattern (MAX_PATTERNS at most)."""
    facts = F.broadcast(facts.withColumnRenamed("pattern", "p"))
    return dealt.join(facts, F.col("pattern").eqNullSafe(F.col("p")), "left").drop("p")


def _fill(dealt: DataFrame) -> DataFrame:
    """Choose documents in the seeded order up to what their pattern owes; longer ones are passed over."""
    near = dealt.filter(OPEN).select("pattern", "owed", "order", "size", F.lit(0).cast("long").alias("before"))
    marked = dealt
    #: Each level leaves one range a pattern at most: the one that what it owes ends in.
    for level in range(LEVELS):
        sums = near.groupBy("pattern", "owed", "before", _bucket(level).alias("bucket")).agg(F.sum("size").alias("sum"))
        until = F.col("before") + F.sum("sum").over(Window.partitionBy("pattern").orderBy("bucket"))
        edge = sums.withColumn("until", until).filter((F.col("until") > F.col("owed")) & (F.col("until") - F.col("sum") <= F.col("owed")))
        edge = edge.select("pattern", F.col("bucket").alias(f"edge{level}"), (F.col("until") - F.col("sum")).alias("from"))
        near = _with(near, edge).filter(_bucket(level) == F.col(f"edge{level}")).select("pattern", "owed", "order", "size", F.col("from").alias("before"))
        marked = _with(marked, edge.drop("from"))
    rows = near.groupBy("pattern", "owed", "before", "order").agg(F.sum("size").alias("sum"))
    rows = rows.withColumn("until", F.col("before") + F.sum("sum").over(Window.partitionBy("pattern").orderBy("order"))).filter("until <= owed")
    marked = _with(marked, rows.groupBy("pattern").agg(F.max("order").alias("limit")))
    inside = F.col("order") <= F.col("limit")
    for level in reversed(range(LEVELS)):
        edge = F.col(f"edge{level}")
        inside = F.when(edge.isNull() | (_bucket(level) < edge), True).when(_bucket(level) == edge, inside)
    marked = marked.withColumn("new", F.expr(OPEN) & F.coalesce(inside, F.lit(False)))
    got = marked.filter("new").groupBy("pattern").agg(F.sum("size").alias("got"))
    marked = _with(marked, got)
    return marked.select(*KEY, "size", "pattern", "rounds", (F.col("owed") - F.coalesce("got", F.lit(0))).alias("owed"), "order", "unit", (F.col("chosen") | F.col("new")).alias("chosen"))


def _bucket(level: int) -> Column:
    """The seeded order's digits at a level, each of HASH_BUCKETS values."""
    bits = (HASH_BUCKETS - 1).bit_length()
    return F.shiftrightunsigned("order", 64 - bits * (level + 1)).bitwiseAND(HASH_BUCKETS - 1)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(sized(table(spark, sf_dir, "documents"), F.array("source")), "sizes")
    mixed, shares = mix(rows)
    shares = F.broadcast(shares)
    out = mixed.join(shares, F.col("pattern")[0].eqNullSafe(F.col("source")))
    return out.select(doc_id(), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
