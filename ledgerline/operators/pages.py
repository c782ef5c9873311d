"""Web pages to records: cells of tables by the standard HTML parser, and relational steps on the cells."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of the addresses of rating documents.
DOCUMENT_HINTS = (".pdf", "getrationalreportfilepdf", "viewratingrationale", "ratingdetails", "rating-details", "fcompany-details", "company-details", "uploads/newsfiles/", "pressrelease/", "ratingdocs/")
_CELLS = "grid int, line int, place int, head boolean, cell string"
_TITLES = ("title", "h1")


class _Cells(HTMLParser):
    """Cells (table, row, column, is it a header, text) of all tables, and the page's titles as table -1."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, int, int, bool, str]] = []
        self.grid, self.line, self.place = -1, -1, -1
        self.open: str | None = None
        self.text: list[str] = []

    def _close(self) -> None:
        if self.open:
            text = " ".join("".join(self.text).split())
            at = (-1, 0, _TITLES.index(self.open)) if self.open in _TITLES else (self.grid, self.line, self.place)
            #: A cell outside any table is none.
            if self.open in _TITLES or self.grid >= 0:
                self.found.append((*at, self.open == "th", text))
        self.open, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "tr", "td", "th", *_TITLES):
            self._close()
        if tag == "table":
            self.grid, self.line = self.grid + 1, -1
        elif tag == "tr":
            self.line, self.place = self.line + 1, -1
        elif tag in ("td", "th"):
            self.place += 1
            self.open = tag
        elif tag in _TITLES:
            self.open = tag

    def handle_endtag(self, tag):
        if tag == self.open or tag in ("tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.open:
            self.text.append(data)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows = [], []
        for i, page in enumerate(batch.column(1).to_pylist()):
            parser = _Cells()
            parser.feed(page or "")
            parser.close()
            parser._close()
            keys += [i] * len(parser.found)
            rows += parser.found
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        arrays = [batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[0], "grid", "line", "place", "head", "cell"])


def cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, grid, line, place, head, cell): every table cell of every page; grid -1 holds title and first-level heading."""
    return pages.select(key, html).mapInArrow(_parse, f"`{key}` {dict(pages.dtypes)[key]}, {_CELLS}")


def identity(found: DataFrame, key: str) -> DataFrame:
    """(key, title, heading): the first of each that says something; a page's cells come from one task in page order."""
    first = lambda i: F.first(F.when((F.col("place") == i) & (F.col("cell") != ""), F.col("cell")), ignorenulls=True)
    return found.filter("grid = -1").groupBy(key).agg(first(0).alias("title"), first(1).alias("heading"))


def matrices(found: DataFrame, key: str) -> DataFrame:
    """(key, grid, metric, period, value): rows of a table whose first line names the periods."""
    tables = found.filter("grid >= 0")
    heads = tables.filter("line = 0 and place > 0").select(key, "grid", "place", F.col("cell").alias("period"))
    metrics = tables.filter("line > 0 and place = 0").select(key, "grid", "line", F.col("cell").alias("metric"))
    values = tables.filter("line > 0 and place > 0").select(key, "grid", "line", "place", F.col("cell").alias("value"))
    return values.join(heads, [key, "grid", "place"]).join(metrics, [key, "grid", "line"]).select(key, "grid", "metric", "period", "value")


def page_status(pages: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """(key, status, missing): parsed if every part gave something for the page, partial if some, failed if none."""
    out = pages.select(key).distinct()
    for name, found in parts.items():
        out = out.join(found.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in parts)))
    status = F.when(F.size(missing) == 0, "parsed").when(F.size(missing) == len(parts), "failed").otherwise("partial")
    return out.select(key, status.alias("status"), F.array_join(missing, ",").alias("missing"))


def _absolute(link: Column, url: Column) -> Column:
    host = F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(url, "^([a-z]+://[^?#]*/)", 1)
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(url, "^([a-z]+:)", 1), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder), link))


def ranked_links(pages: DataFrame, key: str, url: str, html: str, hints: tuple[str, ...] = DOCUMENT_HINTS, n: int = 20) -> DataFrame:
    """(key, place, link): anchors, then bare addresses, absolute and distinct; those with a hint first, n at most."""
    text = F.coalesce(F.col(html), F.lit(""))
    anchors = F.regexp_extract_all(text, F.lit("(?i)<a\\s[^>]*?href=[\"']([^\"']+)[\"']"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit("https?://[^\\s\"'<>]+"), F.lit(0))
    clean = F.filter(F.concat(anchors, bare), lambda x: ~x.contains("${") & ~F.lower(x).contains("%7b"))
    full = F.array_distinct(F.transform(clean, lambda x: _absolute(x, F.col(url))))
    rows = pages.select(key, F.posexplode(full).alias("at", "link"))
    hinted = F.coalesce(*(F.when(F.lower("link").contains(h), 0) for h in hints), F.lit(1))
    order = Window.partitionBy(key).orderBy(hinted, "at")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(key, "place", "link", (hinted == 0).alias("hinted"))
