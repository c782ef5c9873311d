"""Sources, sinks, the stream, grouped lines and name matching on small fixtures."""

import datetime as dt
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerline import session
from ledgerline.operators import names, sinks, texts
from ledgerline.sources import scans
from ledgerline.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_absent_csv_is_empty(spark, tmp_path):
    assert rows(scans.csv_or_empty(spark, str(tmp_path / "none.csv"), "a string, b int")) == []
    (tmp_path / "some.csv").write_text('a,b\n"x ""y""",1\n')
    assert rows(scans.csv_or_empty(spark, str(tmp_path / "some.csv"), "a string, b int")) == [('x "y"', 1)]


@pytest.mark.parametrize("content", ['[{"a": "x", "b": 1}]', '{"rows": [{"a": "x", "b": 1}]}', '{"a": "x", "b": 1}'])
def test_json_shapes(spark, tmp_path, content):
    (tmp_path / "in.json").write_text(content)
    assert rows(scans.json_records(spark, str(tmp_path / "in.json"), "a string, b int")) == [("x", 1)]


def test_json_documents_and_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "ratios": [{"k": "x", "v": 1.0}, {"k": "y", "v": 2.0}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.error.json").write_text("{}")
    good, bad = scans.json_documents(spark, str(tmp_path), "id string, ratios array<struct<k: string, v: double>>")
    assert rows(scans.section(good, "id", "ratios")) == [("a", "x", 1.0), ("a", "y", 2.0)]
    assert sorted(r["file"] for r in bad.collect()) == ["b.json", "c.error.json"]


def test_text_documents_and_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("  \n")
    documents = scans.text_documents(spark, str(tmp_path))
    manifest = spark.createDataFrame([("a.txt",), ("b.txt",), ("c.txt",)], "file string")
    assert rows(scans.manifest_status(manifest, documents).select("file", "status")) == [("a.txt", "parsed"), ("b.txt", "parse_failed"), ("c.txt", "missing_file")]


def test_headers_and_keys(spark):
    wide = spark.createDataFrame([("x", "1", "2")], "`Company Name` string, `Revenue Cr` string, revenue string")
    assert scans.rename_aliases(wide, {"company_name": "company", "revenue_cr": "revenue"}).columns == ["company", "revenue"]
    assert scans.rename_aliases(wide, {"revenue_cr": "revenue"}).first()["revenue"] == "2"
    assert scans.company_column(["id", "Firm name"]) == "Firm name" and scans.company_column(["id", "x"]) == "id"
    keyed = spark.createDataFrame([("a__1", ""), ("b", "x"), (None, "x")], "company_id string, v string")
    assert rows(scans.well_keyed(keyed, "company_id")) == [("a__1", None)]
    master = spark.createDataFrame([("A b", "12.0", 2, "late"), ("A b", "12", 1, "early"), (" ", "9", 0, "none")], "name string, code string, n int, v string")
    assert [(r["company_id"], r["v"]) for r in scans.company_master(master, "name", ["code"], "n").collect()] == [("A_b__12", "early")]


def test_outputs(spark, tmp_path):
    t = spark.createDataFrame([("a", "Oil & Gas", 1), ("b", None, 2)], "id string, industry string, v int")
    sinks.write_by_group(t, "industry", str(tmp_path / "groups"))
    assert rows(spark.read.parquet(str(tmp_path / "groups")).select("id", "industry_slug")) == [("a", "oil_gas"), ("b", "unknown")]
    paths = sinks.write_package({"one": t, "two": t.select("v")}, t.filter("id = 'a'"), "id", str(tmp_path / "package"))
    assert [spark.read.parquet(p).count() for p in paths] == [1, 2]
    errors = sinks.error_records(t, "id", {"read:industry": ("no industry", F.col("industry").isNull())}, "1")
    assert rows(errors) == [("b", "read", "read:industry", "no industry", "1")]


def test_routes(spark):
    decided = spark.createDataFrame([("a", "matched"), ("b", "ambiguous"), ("c", "no_results")], "id string, status string")
    old = spark.createDataFrame([("a",), ("c",), ("d",)], "id string")
    out = sinks.route(decided, old, "id")
    assert {k: [r[0] for r in rows(v)] for k, v in out.items()} == {"status": ["a", "b", "c"], "review": ["b"], "failures": ["c", "d"]}


def test_stream_runs_again_without_change(spark, tmp_path):
    schema = "k int, at int, v string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, None)], schema).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        ingest.ingest_latest(spark, source, spark.read.parquet(source).schema, "k", ["at"], target, "v is not null")
        assert rows(ingest.latest(spark, target, "k", ["at"])) == [(1, 2, "new")]
    spark.createDataFrame([(1, 3, "newest"), (2, 2, "now"), (1, 0, "late")], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_latest(spark, source, spark.read.parquet(source).schema, "k", ["at"], target, "v is not null")
    assert rows(ingest.latest(spark, target, "k", ["at"])) == [(1, 3, "newest"), (2, 2, "now")]
    assert rows(ingest.failures(spark, target)) == [(2, 1, None)]


def test_line_groups(spark):
    text = "head\n* a\nmore\n* b\nEND\nlost\n* c"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    assert rows(texts.line_groups(docs, "id", "text", r"^\*", "^END")) == [(1, 1, 2, "* a\nmore"), (1, 2, 1, "* b"), (1, 3, 1, "* c")]


def test_fill_down_and_emails(spark):
    t = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "n int, c string")
    assert [r[1] for r in rows(texts.fill_down(t, [], "n", "c"))] == ["a", "a", "a", "b"]
    mail = spark.createDataFrame([("X@a.com, x@A.com; y@b.org z@c.net",), (None,)], "t string").select(texts.emails(F.col("t")))
    assert [r[0] for r in mail.collect()] == [["x@a.com", "y@b.org"], []]


def test_scores_by_hand(spark):
    t = spark.createDataFrame([(1, "Fraud case in court, director held"), (1, "growth"), (2, None)], "c int, text string")
    got = {r["c"]: r for r in texts.adverse_scores(t, "c", F.col("text")).collect()}
    assert got[1]["public_risk_score"] == 2.5 + 1.25 + 1.5 + 0.5 and got[1]["public_risk_flag"]
    assert got[2]["public_risk_score"] == 0 and not got[2]["public_risk_flag"]


def test_fuzzy_names_against_brute_force(spark):
    known = ["tata steel", "tata motors", "steel authority", "sun pharma industries", "asian paints"]
    asked = ["tata steel ltd", "tata steels", "steel authorty of india", "sun pharmaceutical industries", "unknown", "", "asian paint"]
    q = spark.createDataFrame([(x,) for x in asked], "n string")
    k = spark.createDataFrame([(x,) for x in known], "n string")
    got = {r["q_id"]: (r["k_id"], r["score"]) for r in names.fuzzy_matches(names.candidate_pairs(q, "n", "n", k, "n", "n")).collect()}
    want = {}
    for a in asked:
        scored = []
        for b in known:
            left, right = set(a.split()) - {"ltd"}, set(b.split())
            if not left & right:
                continue
            ratio = SequenceMatcher(None, a, b).ratio()
            score = 1.0 if a == b else 0.93 if a in b or b in a else round(max(0.45 * len(left & right) / len(left | right) + 0.55 * ratio, 0.8 * ratio), 4)
            if score >= 0.72:
                scored.append((-score, b))
        if scored:
            want[a] = (min(scored)[1], -min(scored)[0])
    assert got == want and "tata steel ltd" in got


def test_fuzzy_names_without_a_common_token(spark):
    rng = random.Random(5)
    words = ["reliance", "infosys", "technologies", "hindalco", "wipro", "bharatforge", "x", "ab", "the company", "limited", "aaaaaaaaaa", "ultratechcementworks"]
    words += ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 24))) for _ in range(60)]
    asked = ["reliancepower", "technologie", "infosyss", "limited", "The Company", "x", "abx", "hind alco", ""]
    for w in words:
        for _ in range(3):
            letters = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "q"])
            asked.append("".join(letters))
    asked = sorted({a for a in asked if a.strip() == a})
    stop = set("limited ltd private pvt company co corporation corp incorporated inc llp plc the".split())
    want, bare = {}, 0
    for a in asked:
        scored = []
        for b in words:
            x, y = a.lower(), b
            left, right = set(x.split()) - stop, set(y.split()) - stop
            ratio = SequenceMatcher(None, x, y).ratio()
            score = 0.0 if not x else 1.0 if x == y else 0.93 if x in y or y in x else round(max(0.45 * len(left & right) / max(len(left | right), 1) + 0.55 * ratio, 0.8 * ratio), 4)
            if score >= 0.72:
                scored.append((-score, b))
                bare += not left & right
        if scored:
            want[a] = (min(scored)[1], -min(scored)[0])
    q, k = spark.createDataFrame([(x,) for x in asked], "n string"), spark.createDataFrame([(x,) for x in words], "n string")
    pairs = names.candidate_pairs(q, "n", "n", k, "n", "n").cache()
    assert pairs.count() == pairs.select("q_id", "k_id").distinct().count()
    assert {r["q_id"]: (r["k_id"], r["score"]) for r in names.fuzzy_matches(pairs).collect()} == want
    assert bare > 100 and want["reliancepower"] == ("reliance", 0.93) and want["limited"] == ("limited", 1.0) and want["The Company"][1] == 1.0


def test_candidate_decisions_by_hand(spark):
    rows = [
        ("Tata Steel Ltd", "TATASTEEL", None, "Tata Motors", "OTHER", 1), ("Tata Steel Ltd", "TATASTEEL", None, "Tata Steel", "tatasteel", 2),
        ("Sun Pharma", None, "524715.0", "Sun Pharma Adv", "524715", 1), ("Sun Pharma", None, "524715.0", "Sun Pharma", "X", 2),
        ("Abc Ltd", None, None, "ABC LTD", "A", 1), ("Abc Ltd", None, None, "Xyz", "X", 2),
        ("Two", None, None, "Two!", "A", 1), ("Two", None, None, "Two.", "B", 2),
    ]
    found = spark.createDataFrame(rows, "name string, nse string, bse string, found string, slug string, rank int")
    scored = names.candidate_scores(found, "name", "found", "rank", "nse", "bse", "slug")
    got = {(r["name"], r["found"]): r["score"] for r in scored.collect()}
    for name, nse, bse, other, slug, rank in rows:
        x, y = (" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in (name, other))
        left, right = set(x.split()) - {"ltd"}, set(y.split()) - {"ltd"}
        base = 1.0 if nse == slug.upper() else 0.95 if bse == slug + ".0" else 0.84 if name.lower() == other.lower() else 0.8 if x == y else 0.0
        more = 0.18 * len(left & right) / len(left | right) + 0.18 * SequenceMatcher(None, x, y).ratio() + 0.03 * (rank == 1)
        assert got[name, other] == round(min(1.0, base + more * (base < 0.95)), 4)
    asked = spark.createDataFrame([(n,) for n in ("Tata Steel Ltd", "Sun Pharma", "Abc Ltd", "Two", "None")], "name string")
    decided = {r["name"]: tuple(r)[1:] for r in names.decide_candidates(asked, "name", scored, "found", "rank", 0.86, 0.08).collect()}
    assert decided == {
        "Tata Steel Ltd": ("Tata Steel", 1.0, got["Tata Steel Ltd", "Tata Motors"], "matched"),
        "Sun Pharma": (None, 1.0, 0.95, "ambiguous"), "Abc Ltd": ("ABC LTD", 1.0, got["Abc Ltd", "Xyz"], "matched"), "Two": (None, 1.0, 1.0, "ambiguous"), "None": (None, 0.0, 0.0, "no_results"),
    }


def test_stream_counts_once_and_leaves_late_rows_out(spark, tmp_path):
    at = lambda text: dt.datetime.fromisoformat(f"2024-05-{text}")
    batches = [
        [(1, at("01T01:00"), "a"), (1, at("01T01:00"), "a"), (2, at("01T23:00"), "b")],
        [(1, at("01T01:00"), "a"), (3, at("02T12:00"), "a"), (4, at("01T20:00"), "b")],
        [(5, at("01T02:00"), "a"), (6, at("03T12:00"), "b"), (3, at("02T12:00"), "a")],
    ]
    source, target = f"file://{tmp_path}/source", f"file://{tmp_path}/out"
    schema = "id int, at timestamp, kind string"
    counts = lambda: ingest.counted_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "id", "at", "kind", "1 day", "6 hours")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = ingest.run_to_end(counts(), target)
    #: Event 4 comes within six hours of the newest row before it, event 5 far behind; the third day isn't closed.
    assert sorted((r["start"].day, r["kind"], r["n"]) for r in out.collect()) == [(1, "a", 1), (1, "b", 2), (2, "a", 1)]
    assert ingest.run_to_end(counts(), target).count() == 3


def test_scratch_refuses_a_warehouse_of_each_machine():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.sql.warehouse.dir": "file:/tmp/w"})
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "app"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch(Session)
    Session.conf["spark.sql.warehouse.dir"] = "hdfs://n/w"
    assert session.scratch(Session) == "hdfs://n/w/_scratch-app"


def test_ingest_reads_the_last_table_and_what_came_since(spark, tmp_path):
    source, target, schema = f"file://{tmp_path}/source", f"file://{tmp_path}/out", "k int, at int, v string"
    for at in range(5):
        spark.createDataFrame([(1, at, f"a{at}"), (10 + at, at, "once"), (2, 9 - at, f"b{9 - at}")], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_latest(spark, source, schema, "k", ["at"], target, files=1, compact=2)
    want = [(1, 4, "a4"), (2, 9, "b9"), *((10 + at, at, "once") for at in range(5))]
    assert rows(ingest.latest(spark, target, "k", ["at"])) == sorted(want)
    assert sorted(p.name for p in (tmp_path / "out" / "current").iterdir()) == ["through=1", "through=3"]
    #: Batches that a table holds aren't read again.
    for n in range(4):
        (tmp_path / "out" / "latest" / f"batch={n}").rename(tmp_path / f"away-{n}")
    assert rows(ingest.latest(spark, target, "k", ["at"])) == sorted(want)


def test_fuzzy_names_with_a_word_in_every_name(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
    known = sorted({f"{word()} india" for _ in range(300)} | {f"{word()} {word()} india" for _ in range(200)} | {f"{word()} {word()} india group" for _ in range(100)} | {"india", "india group"})
    asked = sorted({f"{word()} india" for _ in range(150)} | {k.replace("india", "indian") for k in rng.sample(known, 40)} | {k.replace(" ", " new ", 1) for k in rng.sample(known, 40)} | {k[1:].strip() for k in rng.sample(known, 40)} | {"group india", "india x", "ndia"})
    stop = set("limited ltd private pvt company co corporation corp incorporated inc llp plc the".split())
    want = {}
    for a in asked:
        scored = []
        for b in known:
            left, right = set(a.split()) - stop, set(b.split()) - stop
            ratio = SequenceMatcher(None, a, b).ratio()
            score = 1.0 if a == b else 0.93 if a in b or b in a else round(max(0.45 * len(left & right) / max(len(left | right), 1) + 0.55 * ratio, 0.8 * ratio), 4)
            if score >= 0.72:
                scored.append((-score, b))
        if scored:
            want[a] = (min(scored)[1], -min(scored)[0])
    q, k = spark.createDataFrame([(x,) for x in asked], "n string"), spark.createDataFrame([(x,) for x in known], "n string")
    pairs = names.candidate_pairs(q, "n", "n", k, "n", "n").cache()
    #: Each pair once, and far from all pairs, though one word is in all names.
    assert pairs.count() == pairs.select("q_id", "k_id").distinct().count() < 8 * (len(asked) + len(known))
    assert {r["q_id"]: (r["k_id"], r["score"]) for r in names.fuzzy_matches(pairs).collect()} == want
