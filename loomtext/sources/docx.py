"""Word files as tables: paragraphs, table cells, comments, markers. One file is read in a small helper, the rest are joins."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NS14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
NS15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
HEADING = re.compile(r"^(?:heading|标题)\s*([1-9])$", re.I)
SCHEMA = """path string, error string,
    paragraphs array<struct<index:int,text:string,heading_level:int,num_id:string,level:int,in_table:boolean,row:int,col:int,span:int,merge:string,tbl:int>>,
    comments array<struct<id:string,author:string,initials:string,date:string,text:string,para_id:string>>,
    markers array<struct<paragraph:int,offset:int,kind:string,id:string>>,
    replies array<struct<para_id:string,parent:string,done:boolean>>"""


def val(node, name: str) -> str | None:
    found = node.find(NS + name) if node is not None else None
    return found.get(NS + "val") if found is not None else None


def style_levels(root) -> dict[str, int]:
    """Heading level of each style: its own outline level or name, else its base's."""
    own, base = {}, {}
    for s in root.iter(NS + "style"):
        key = s.get(NS + "styleId")
        outline = val(s.find(NS + "pPr"), "outlineLvl")
        named = HEADING.match(val(s, "name") or "")
        base[key] = val(s, "basedOn")
        if outline is not None and int(outline) < 9:
            own[key] = int(outline) + 1
        elif named:
            own[key] = int(named[1])
    out = {}
    for key in base:
        at, steps = key, 0
        while at is not None and at not in own and steps < 17:
            at, steps = base.get(at), steps + 1
        if at in own:
            out[key] = own[at]
    return out


def text_of(node, at: int, markers: list) -> str:
    """Accepted text of a paragraph: insertions count, deletions do not. Markers get their offsets."""
    out = ""
    for x in node:
        tag = x.tag.removeprefix(NS)
        if tag in ("del", "moveFrom", "pPr", "rPr", "delText", "instrText"):
            continue
        if tag == "t":
            out += x.text or ""
        elif tag == "tab":
            out += "\t"
        elif tag in ("br", "cr"):
            out += "" if x.get(NS + "type") == "page" else "\n"
        elif tag == "noBreakHyphen":
            out += "‑"
        elif tag == "sym":
            out += "□"
        elif tag in ("drawing", "pict", "object"):
            out += "￼"
        elif tag in ("commentRangeStart", "commentRangeEnd", "commentReference"):
            markers.append((at + len(out), {"commentRangeStart": "start", "commentRangeEnd": "end"}.get(tag, "reference"), x.get(NS + "id")))
        else:
            out += text_of(x, at + len(out), markers)
    return out


def parse(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
        body, styles = part("word/document.xml"), part("word/styles.xml")
        notes, extended = part("word/comments.xml"), part("word/commentsExtended.xml")
    levels = style_levels(styles) if styles is not None else {}
    paragraphs, markers = [], []
    n_tables = 0

    def paragraph(p, **place) -> None:
        found: list = []
        pr = p.find(NS + "pPr")
        outline, numbered = val(pr, "outlineLvl"), pr.find(NS + "numPr") if pr is not None else None
        level = int(outline) + 1 if outline is not None and int(outline) < 9 else levels.get(val(pr, "pStyle"))
        i = len(paragraphs)
        text = text_of(p, 0, found)
        paragraphs.append({"index": i, "text": text, "heading_level": level, "num_id": val(numbered, "numId"), "level": int(val(numbered, "ilvl") or 0), "in_table": False, "row": None, "col": None, "span": None, "merge": None, "tbl": None} | place)
        markers.extend({"paragraph": i, "offset": o, "kind": k, "id": c} for o, k, c in found)

    def walk(node) -> None:
        nonlocal n_tables
        for x in node:
            if x.tag == NS + "p":
                paragraph(x)
            elif x.tag == NS + "tbl":
                table, n_tables = n_tables, n_tables + 1
                for r, tr in enumerate(x.iter(NS + "tr")):
                    col = 0
                    for tc in tr.findall(NS + "tc"):
                        pr = tc.find(NS + "tcPr")
                        span = int(val(pr, "gridSpan") or 1)
                        merge = pr.find(NS + "vMerge") if pr is not None else None
                        kind = None if merge is None else "restart" if merge.get(NS + "val") == "restart" else "continue"
                        for p in tc.iter(NS + "p"):
                            paragraph(p, in_table=True, row=r, col=col, span=span, merge=kind, tbl=table)
                        col += span
            elif x.tag in (NS + "sdt", NS + "sdtContent", NS + "ins", NS + "customXml"):
                walk(x)

    walk(body.find(NS + "body"))
    comments = []
    for c in notes.iter(NS + "comment") if notes is not None else ():
        ps = list(c.iter(NS + "p"))
        comments.append({"id": c.get(NS + "id"), "author": c.get(NS + "author"), "initials": c.get(NS + "initials"), "date": c.get(NS + "date"), "text": "\n".join(text_of(p, 0, []) for p in ps), "para_id": ps[-1].get(NS14 + "paraId") if ps else None})
    replies = [{"para_id": x.get(NS15 + "paraId"), "parent": x.get(NS15 + "paraIdParent"), "done": x.get(NS15 + "done") == "1"} for x in extended.iter(NS15 + "commentEx")] if extended is not None else []
    return {"paragraphs": paragraphs, "comments": comments, "markers": markers, "replies": replies}


def read_docx(files: DataFrame) -> DataFrame:
    """A row a file (path, content) with its tables as arrays; error tells why a file could not be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out.append({"path": path, "error": None} | parse(content))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError, ValueError) as e:
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}", "paragraphs": [], "comments": [], "markers": [], "replies": []})
            yield pd.DataFrame(out, columns=["path", "error", "paragraphs", "comments", "markers", "replies"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def part(docs: DataFrame, name: str) -> DataFrame:
    """One of the arrays as rows of its own, with the file's path."""
    return docs.select("path", F.explode(name).alias("x")).select("path", "x.*")


def comment_table(docs: DataFrame) -> DataFrame:
    """Comments with parent (the comment that they answer), done and their anchor: start_par, start_off, end_par, end_off.

    An anchor is taken from start and end marks, else from what there is of start, end and reference; an answer without
    one has its parent's.
    """
    comments, replies = part(docs, "comments"), part(docs, "replies")
    marks = part(docs, "markers").withColumn("at", F.struct("paragraph", "offset"))
    first = marks.groupBy("path", "id").agg(*(F.min(F.when(F.col("kind") == k, F.col("at"))).alias(k) for k in ("start", "end", "reference")))
    start, end = F.coalesce("start", "end", "reference"), F.coalesce("end", "start", "reference")
    anchors = first.select("path", "id", start.alias("a"), end.alias("b"))
    own = comments.join(replies, ["path", "para_id"], "left").join(anchors, ["path", "id"], "left")
    parents = own.select("path", F.col("para_id").alias("parent"), F.col("id").alias("parent_id"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    rows = own.join(parents, ["path", "parent"], "left").withColumns({"a": F.coalesce("a", "pa"), "b": F.coalesce("b", "pb")})
    return rows.select("path", "id", "author", "initials", "date", "text", "parent_id", F.coalesce("done", F.lit(False)).alias("done"), F.col("a.paragraph").alias("start_par"), F.col("a.offset").alias("start_off"), F.col("b.paragraph").alias("end_par"), F.col("b.offset").alias("end_off"))


def cells(docs: DataFrame) -> DataFrame:
    """path, tbl, row, col, text of the table cells: spans fill their columns, continued cells take the text above."""
    rows = part(docs, "paragraphs").filter("in_table").groupBy("path", "tbl", "row", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "text"))), lambda x: x.text), "\n").alias("text"), F.first("span").alias("span"), F.first("merge").alias("merge"))
    wide = rows.withColumn("col", F.explode(F.sequence("col", F.col("col") + F.col("span") - 1)))
    above = F.last(F.when(F.coalesce(F.col("merge") != "continue", F.lit(True)), F.col("text")), True).over(W.partitionBy("path", "tbl", "col").orderBy("row"))
    return wide.select("path", "tbl", "row", "col", F.coalesce(above, F.col("text")).alias("text"))


def table_lines(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, line: below the first row each value follows its column's head; tables of one row or column are joined
    plainly. Neighbours that repeat within a row count once, empty values do not."""
    last = W.partitionBy(*keys, "row").orderBy("col")
    rows = cell_rows.withColumn("text", F.trim("text")).withColumn("before", F.lag("text").over(last)).filter("text <> '' and (before is null or before <> text)")
    size = cell_rows.groupBy(*keys).agg(F.countDistinct("row").alias("n_rows"), F.countDistinct("col").alias("n_cols"))
    heads = cell_rows.filter("row = 0").select(*keys, "col", F.trim("text").alias("head"))
    named = rows.join(heads, [*keys, "col"], "left").join(size, keys)
    plain = (F.col("n_rows") < 2) | (F.col("n_cols") < 2)
    value = F.when(plain | (F.coalesce("head", F.lit("")) == "") | (F.col("head") == F.col("text")), F.col("text")).otherwise(F.concat("head", F.lit("："), "text"))
    lines = named.filter(plain | (F.col("row") > 0)).groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("col", value.alias("v")))).alias("x"))
    return lines.select(*keys, "row", F.array_join(F.transform("x", lambda x: x.v), "；").alias("line"))
