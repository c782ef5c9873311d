"""Cases of the third review: queries against their SQL on tables that the supplied data don't hold."""

from pathlib import Path

import duckdb
from test_oracle import rows

from ledgerline.catalog import ORACLE_SQL, QUERIES
from ledgerline.operators import documents

DATA = Path("/root/testdata/sf0.001")


def check(spark, folder: Path, name: str) -> list[str]:
    """The query's rows, which are those of its SQL on the tables of a folder and the supplied ones it lacks."""
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        if not (folder / f.name).exists():
            (folder / f.name).symlink_to(f)
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{folder / f.name}')")
    got = rows(QUERIES[name](spark, str(folder)).toPandas())
    assert got == rows(con.execute(ORACLE_SQL[name]).df())
    return got


def test_page_records_round_exact_halves_up(spark, tmp_path):
    """1.005 lies below the half as a binary number, but it stands for an exact half."""
    halves = ", ".join(f"({10050 + 100 * k}.0, {1 + k % 7}, {k})" for k in range(300))
    duckdb.execute(f"""COPY (SELECT 1::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, k::BIGINT AS l_suppkey, 1::INT AS l_linenumber, 1.0::DOUBLE AS l_quantity, price::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 1.0::DOUBLE AS l_tax,
  'A' AS l_returnflag, 'F' AS l_linestatus, make_timestamp(1990 + year, 1, 1, 0, 0, 0.0) AS l_shipdate FROM (VALUES {halves}) AS t(price, year, k)) TO '{tmp_path}/lineitem.parquet'""")
    duckdb.execute(f"COPY (SELECT k::BIGINT AS s_suppkey, 'Firm ' || k AS s_name, 1::INT AS s_nationkey, 1.0::DOUBLE AS s_acctbal FROM range(300) AS t(k)) TO '{tmp_path}/supplier.parquet'")
    assert any("1.03'" in row for row in check(spark, tmp_path, "page_records"))


def test_page_titles_decode_all_references(spark, tmp_path):
    """references by name, by number and without a semicolon, and a later heading where the first is empty."""
    titles = ["a &quot;b&quot;", "x &lt;y&gt; &amp", "&notit; &notin; &copy2 &Acy;", "&#65;&#x42;&#X43 &#128; &#0; &#1; &#xd800; &#55; &#129;", "&nbsp; b&nbsp;\u2003c &", "&bogus; & &; &#; &#x;", "it&apos;s &AMP; &ampx;", "&lang;&fjlig;&NewLine;z"]
    pages = [(i, f"http://h/{i}", f"<html><title>{t}</title><h1> </h1><p>x<h1 id=a>H {t}</h1></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    assert len(check(spark, tmp_path, "page_titles")) == len(titles)


def test_rows_are_spread_by_their_number(spark):
    """a task's rows don't grow with the table, whatever its files are."""
    from ledgerline.session import SPREAD_ROWS, spread

    tasks = spread(spark.range(0, 6 * SPREAD_ROWS - 1, 1, 1)).rdd.getNumPartitions()
    assert tasks == max(6, spark.sparkContext.defaultParallelism)


def test_signals_by_batches_equal_those_by_columns(spark):
    """matching batches of texts as they are gives what matching plain texts gives."""
    from pyspark.sql import functions as F

    from ledgerline.operators import documents

    texts = ["Small \t scale", "working\ncapital", "working  capital", "Liquidity:\t Adequate", "liquidity  strong", "LIQUIDITY weakly", "an MSA, no msax", "xregulatoryx", "", None, "top  customer\r\n low \tgearing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in documents.signal_table(df, ["id"], "text").collect()}
    plain = df.withColumn("text", documents.normal_text(F.col("text")))
    by_column = {r["id"]: tuple(r)[1:] for r in plain.select("id", *(F.col("text").rlike("(?i)" + "|".join(p)).alias(n) for n, p in documents.SIGNALS.items())).collect()}
    assert got == by_column == {r["id"]: tuple(r)[1:] for r in df.select("id", *(c.alias(n) for n, c in documents.signals(F.col("text")).items())).collect()}


def test_the_first_date_is_found_beyond_the_head(spark):
    """the head is only looked at first; a date across its end counts whole."""
    from pyspark.sql import functions as F

    from ledgerline.operators import documents

    n = documents.DATE_HEAD
    texts = ["x" * (n - k) + " March 5, 2022 and May 2019" for k in range(0, 20)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(documents.first_date(F.col("t")).cast("string")).collect()
    assert {r[0] for r in rows} == {"2022-03-05"}


def test_only_the_sections_asked_for_are_made(spark):
    """other headings still end a body, a repeated section counts once, and the rest is as it was."""
    texts = ["Key strengths\n- one\nLiquidity: Adequate\n- two\nStrengths: again\n• three\nAbout the Company\nx", "Rating Sensitivities\n- growth\nWeaknesses\n- a\n\nb", "", None, "no heading\n- at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "event_id long, text string")
    whole = documents.sections(docs, "event_id", "text")
    for asked in (("strengths", "weaknesses", "rating_sensitivities"), ("liquidity",)):
        got = documents.sections(docs, "event_id", "text", asked)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in whole.collect() if r["section"] in asked)
    assert {r["body"] for r in documents.sections(docs, "event_id", "text", ("strengths",)).collect()} == {"again\n• three"}


def test_directions_of_items_are_read_once_for_all_mentions(spark):
    """document_points counts items before it looks for the words of a direction in them."""
    plan = QUERIES["document_points"](spark, str(DATA))
    steps = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    regex = max(i for i, line in enumerate(steps) if "deterioration" in line)
    assert regex < next(i for i, line in enumerate(steps) if "Aggregate" in line)


def test_names_are_matched_from_distinct_names_written_once(spark):
    """no branch of fuzzy_names reads the whole table again."""
    read = QUERIES["fuzzy_names"](spark, str(DATA)).inputFiles()
    assert read and not any("part.parquet" in f for f in read)


def test_training_rows_are_made_once_and_only_their_documents_are_read(spark):
    """F16: texts are matched once, for the rows themselves, and what a statement says is made once a statement."""
    made = QUERIES["training_set"](spark, str(DATA))
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("MapInArrow" in line for line in plan) == 1
    assert not any("orders.parquet" in f or "events.parquet" in f for f in made.inputFiles())


def test_event_documents_match_a_line_that_batches_repeat_once(spark, monkeypatch, tmp_path):
    """the signals of events' documents ran as 22 patterns a document in the JVM; lines of a batch are matched once, documents by their lines."""
    from pyspark.sql import functions as F

    from ledgerline.operators import documents
    from ledgerline.plans import registry_queries

    lines = ["", "Group support", "net cash", "net cash position.", "FX risk", "key", "liquidity:  weak", "an msa\r", "• Export", "x ROCE", "low", "gearing", "a low \t gearing"]
    made = [None, "", "\n\n", *("\n".join(lines[(i * j + j) % len(lines)] for j in range(i % 7)) for i in range(400)), *(a + "\n" + b for a in lines for b in lines)]
    df = spark.createDataFrame(list(enumerate(made)), "id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in documents.signal_table(df.coalesce(1), ["id"], "text").collect()}
    assert got == {r["id"]: tuple(r)[1:] for r in df.select("id", *(c.alias(n) for n, c in documents.signals(F.col("text")).items())).collect()} and len(got) == len(made)
    monkeypatch.setattr(registry_queries.documents, "signals", None)
    k = F.col("id")
    spark.range(300).select(k.alias("o_orderkey"), (k % 9).alias("o_custkey"), F.lit("1997-03-04").alias("o_orderdate"), F.lit("P").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(4).select(k.alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = registry_queries.q_event_documents(spark, str(tmp_path)).collect()
    assert len(rows) == 300 and all((r["doc"] == "") == (r["event_id"] % 29 == 0) for r in rows) and not any(r["has_group_support"] for r in rows if r["doc"] == "") and any(r["has_group_support"] for r in rows)
