"""Text out of pages: lines of PDF pages, Markdown of outside parsers, tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import HAN, han_count, nonspace_chars
from .web import MARKUP_ENTITIES, decode


def closed_up(text: Column) -> Column:
    """Letter-spaced Han characters without the gaps: at least three gaps, and one for four characters."""
    gap = rf"(?<=[{HAN}])[ 　]+(?=[{HAN}])"
    n = F.size(F.split(text, gap, -1)) - 1
    return F.when((n >= 3) & (n * 4 >= han_count(text)), F.regexp_replace(text, gap, "")).otherwise(text)


def scanned(pages: DataFrame, least: int = 20) -> DataFrame:
    """doc_id of documents whose pages (doc_id, page, text) hold fewer than `least` characters on average."""
    return pages.groupBy("doc_id").agg(F.sum(nonspace_chars(F.coalesce("text", F.lit("")))).alias("n"), F.count("*").alias("p")).filter(F.col("n") < F.col("p") * least).select("doc_id")


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, n, text of the lines of pages, without bare page numbers at their edges."""
    lines = pages.select("doc_id", "page", F.posexplode(F.filter(F.transform(F.split("text", r"\r?\n"), F.trim), lambda x: x != "")).alias("n", "text"))
    size = F.count("*").over(W.partitionBy("doc_id", "page"))
    edge = (F.col("n") == 0) | (F.col("n") == F.col("_s") - 1)
    return lines.withColumn("_s", size).filter(~(edge & F.col("text").rlike(r"^(?:[-—]\s*)?\d{1,4}(?:\s*[-—])?$|^第\s*\d+\s*页(?:\s*共\s*\d+\s*页)?$"))).select("doc_id", "page", "n", closed_up(F.col("text")).alias("text"))


def unwrapped(lines: DataFrame) -> DataFrame:
    """doc_id, index, text: lines joined where one ends a full row without the end of a sentence.

    A row is full at eight tenths of the ninth decile of the document's line lengths. A line belongs to the one before
    if that is full and open; runs of such lines are joined.
    """
    from .structure import heading

    sizes = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.length("text"))).alias("_l")).select("doc_id", F.get("_l", F.least(F.floor(F.size("_l") * 0.9), F.size("_l") - 1).cast("int")).alias("wide"))
    by = W.partitionBy("doc_id").orderBy("page", "n")
    rows = lines.join(sizes, "doc_id").withColumn("_h", heading(F.col("text")).isNotNull())
    open_ = (F.length("text") >= F.col("wide") * 0.8) & ~F.col("text").rlike("[。！？；：.!?;:]$") & ~F.col("_h")
    rows = rows.withColumn("_open", open_).withColumn("_new", (~F.coalesce(F.lag("_open").over(by), F.lit(False)) | F.col("_h")).cast("int"))
    rows = rows.withColumn("index", F.sum("_new").over(by) - 1)
    latin = r"[A-Za-z0-9,]$"
    joined = F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("page", "n", "text"))), lambda x: x.text), F.lit(""), lambda a, x: F.when(a.rlike(latin) & x.rlike("^[A-Za-z0-9]"), F.concat(a, F.lit(" "), x)).otherwise(F.concat(a, x)))
    return rows.groupBy("doc_id", "index").agg(joined.alias("text"))


def clean_markdown(text: Column) -> Column:
    """Without comments, images and tags, entities decoded; numbered headings lose their marks."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"!\[[^\]]*\]\([^)]*\)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)<br\s*/?>", "\n"), r"</?[A-Za-z][^>]*>", "")
    return F.regexp_replace(decode(bare, MARKUP_ENTITIES), r"(?m)^#{1,6}\s+(?=第[一二三四五六七八九十百零〇0-9]+[章节条]|[一二三四五六七八九十]+、)", "")


def pipe_cells(docs: DataFrame) -> DataFrame:
    """doc_id, tbl (index of the table's first line), row, col, text of pipe tables, an escaped bar is a bar."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("index", "line")).withColumn("_in", F.trim("line").rlike(r"^\|.*\|$"))
    island = F.col("index") - F.row_number().over(W.partitionBy("doc_id").orderBy("index"))
    rows = lines.filter("_in").withColumn("_i", island)
    rows = rows.withColumn("tbl", F.min("index").over(W.partitionBy("doc_id", "_i"))).filter(~F.trim("line").rlike(r"^\|[\s:|-]+\|$"))
    rows = rows.withColumn("row", F.row_number().over(W.partitionBy("doc_id", "tbl").orderBy("index")) - 1)
    parts = F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|")
    return rows.select("doc_id", "tbl", "row", F.posexplode(parts).alias("col", "text")).withColumn("text", F.trim(F.replace("text", F.lit("\\|"), F.lit("|"))))


# ---- tables ---------------------------------------------------------------------------------------------------------
TABLE, ROW = re.compile(r"<table\b[^>]*>.*?</table\s*>", re.I | re.S), re.compile(r"<tr\b[^>]*>(.*?)</tr\s*>", re.I | re.S)
CELL = re.compile(r"<t[dh]\b([^>]*)>(.*?)</t[dh]\s*>", re.I | re.S)
SPANS = tuple(re.compile(rf"\b{name}span\s*=\s*[\"']?\s*(\d+)", re.I) for name in ("row", "col"))
MOST_SPAN = 1000
#: Cells that a task hands on at once; tables of several texts share a batch.
CELLS = 20_000


def filled(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """The grid of a table from the cells (value, rows, columns) of its rows: a cell's value stands in every place that it
    covers. What is open are the columns that a cell above still covers, with its value and how many rows are left."""
    grid, below = [], {}
    for cells in rows:
        line = {column: value for column, (value, _) in below.items()}
        below = {column: (value, left - 1) for column, (value, left) in below.items() if left > 1}
        at = 0
        for value, down, across in cells:
            while at in line:
                at += 1
            for column in range(at, at + across):
                line[column] = value
                if down > 1:
                    below[column] = (value, down - 1)
            at += across
        grid.append([line.get(column, "") for column in range(max(line, default=-1) + 1)])
    return grid


def html_cells(docs: DataFrame) -> DataFrame:
    """doc_id, tbl, row, col, text of the HTML tables of texts, spans filled; text still has its tags. Only texts with a table
    go to Python; a null text has none."""

    def span(pattern: re.Pattern, attributes: str) -> int:
        found = pattern.search(attributes)
        return min(max(int(found[1]), 1), MOST_SPAN) if found else 1

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.int32()] * 3, pa.string()), strict=True)], ["doc_id", "tbl", "row", "col", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                for tbl, table in enumerate(TABLE.findall(text.as_py())):
                    rows = [[(value, span(SPANS[0], a), span(SPANS[1], a)) for a, value in CELL.findall(row)] for row in ROW.findall(table)]
                    grid = filled(rows)
                    wide = max(map(len, grid), default=0)
                    out += [(doc.as_py(), tbl, r, c, line[c] if c < len(line) else "") for r, line in enumerate(grid) for c in range(wide)]
                if len(out) >= CELLS:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    cells = docs.select("doc_id", "text").filter(F.col("text").rlike("(?i)<table")).mapInArrow(run, "doc_id long, tbl int, row int, col int, text string")
    bare = F.regexp_replace(F.regexp_replace("text", r"(?i)<br\s*/?>|</?(?:p|div)\b[^>]*>", " "), r"</?[A-Za-z][^>]*>", "")
    return cells.withColumn("text", F.trim(F.regexp_replace(decode(bare, MARKUP_ENTITIES), r"(?U)\s+", " ")))


def labelled_rows(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, n, text: tables (doc_id, tbl, row, col, text) as lines, in order n.

    The first row that is not blank is the header and gives a line of its own; every other row becomes "name：value" parts. A
    value under no name, or under itself, stands alone; neighbours that are alike, as merged cells leave them, count once.
    A table of one row or one column has no header. Rows of a table are gathered by table, cells by row.
    """
    by = ["doc_id", "tbl"]
    once = lambda a: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), x)), lambda x: x.isNotNull())
    # dealt out by table once; lines and what a table's first one says about the others are then formed in place
    lines = cells.repartition(*by).groupBy(*by, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("cells")).filter(F.exists("cells", lambda x: x != ""))
    whole = W.partitionBy(*by).orderBy("row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    top = {"head": F.first("cells"), "first": F.min("row"), "rows": F.count("*"), "wide": F.max(F.size("cells"))}
    rows = lines.withColumns({name: value.over(whole) for name, value in top.items()}).withColumn("_h", (F.col("rows") > 1) & (F.col("wide") > 1))
    full = lambda a: F.array_join(once(F.filter(a, lambda x: x != "")), " | ")
    part = lambda v, h: F.when(v == "", F.lit(None)).when((F.coalesce(h, F.lit("")) == "") | (h == v), v).otherwise(F.concat(h, F.lit("："), v))
    rows = rows.withColumn("_p", F.filter(F.zip_with("cells", "head", lambda v, h: part(F.coalesce(v, F.lit("")), h)), lambda x: x.isNotNull()))
    text = F.when(~F.col("_h"), full("cells")).when(F.col("row") == F.col("first"), F.concat(F.lit("表格列："), full("head"))).otherwise(F.array_join(once(F.col("_p")), "；"))
    return rows.select(*by, F.col("row").alias("n"), text.alias("text")).filter("text <> ''")


def search_results(responses: DataFrame, paths: tuple[str, ...] = ("$.webPages.value", "$.results", "$.data")) -> DataFrame:
    """query_id, url, title, snippet of search responses (query_id, body) of several shapes, the first of each url."""
    array = F.coalesce(*(F.get_json_object("body", p) for p in paths))
    each = responses.select("query_id", F.posexplode(F.from_json(array, "array<string>")).alias("pos", "x"))
    get = lambda *names: F.coalesce(*(F.get_json_object("x", f"$.{n}") for n in names))
    rows = each.select("query_id", "pos", get("url", "link", "href").alias("url"), get("title", "name").alias("title"), F.left(F.coalesce(get("snippet", "summary", "content"), F.lit("")), F.lit(400)).alias("snippet")).filter("url is not null")
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "url").orderBy("pos"))).filter("_r = 1").drop("_r")
