"""Documents that a text cites: titles in book marks, standards and document numbers; their union, and their issues.

Mentions are found within a paragraph's row, and a number is given to the title that it stands in or next to. The union is a
fold over one document's mentions in order, with look-ups by each of its three keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as X
from ..functions.text import let, normalize

TITLE = r"《[^《》\n]{2,80}》"
#: Codes of standards, a longer one before its beginning; fixed values.
CODES = (
    r"GB/T GB/Z GBZ/T GBZ GB JGJ/T JGJ CJJ/T CJJ CJ/T CJ HJ/T HJ DB\d{2}/T DB\d{2} DG/TJ\s?08 DGJ\s?08 DBJ\s?\d{2} T/[A-Z]{2,10} CECS JTG/T JTG JT/T SL/T SL DL/T DL NB/T "
    "GA/T GA JB/T HG/T YB/T SH/T SY/T TB/T TB QX/T WS/T WS YY/T JC/T JG/T LY/T NY/T SJ/T YD/T GY/T MH/T JR/T AQ/T AQ XF/T XF CH/T DZ/T TD/T CQJTG/T"
).split()
#: A standard: code, number, year; a fixed pattern.
STANDARD = rf"(?<![A-Za-z0-9/])(?=[A-Z])({'|'.join(CODES)})\s*[-—–－]?\s*(\d{{1,6}}(?:\.\d{{1,3}})?)(?:\s*[-—–－]\s*((?:19|20)\d{{2}}))?"
#: Words by which a title is told to be a standard, a law or a policy; fixed values.
STANDARD_WORDS = "标准 规范 规程 导则 技术规定 技术要求 设计规定 图集".split()
RULE_WORDS = "规定 办法 细则 规则".split()
POLICY_WORDS = "通知 意见 方案 规划 纲要 计划 决定 指南 指引 公告 通告 批复 要点 措施 行动 政策".split()

#: Documents whose mentions a task holds as Python objects at once.
GROUP = 64
FOUND = "doc_id long, no int, title string, kind string, standard_no string, doc_no string, paragraphs array<int>"


def kind(title: Column, standard: Column, number: Column) -> Column:
    """standard, law, policy or unknown, by the words of a title and the numbers given with it (null without)."""
    has = lambda words: title.rlike("|".join(words))
    law = title.endswith("法") | title.contains("条例") | title.contains("法（") | title.startswith("中华人民共和国")
    rule = title.rlike(f"({'|'.join(RULE_WORDS)})($|（)")
    return (
        F.when(standard.isNotNull() | has(STANDARD_WORDS), "standard")
        .when(law, "law")
        .when(rule, F.when(number.isNotNull(), "policy").otherwise("law"))
        .when(has(POLICY_WORDS) | number.isNotNull(), "policy")
        .otherwise("unknown")
    )


def located(text: str, pattern: str) -> Column:
    """Array of struct(start, whole) of the matches in a column: it is cut at them, and the lengths are added up."""
    none = F.array().cast("array<struct<start:int,whole:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["m"])).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["g"]).alias("start"), x["m"].alias("whole"))).alias("out"))

    def placed(whole: Column) -> Column:
        zipped = F.zip_with(whole, F.slice(F.split(text, pattern, -1), 1, F.size(whole)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
        return F.when(F.size(whole) > 0, F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def standard_number(whole: Column) -> Column:
    """The canonical form: code, number, year; a code that ends in digits is joined with a hyphen."""
    part = lambda i: F.regexp_extract(whole, STANDARD, i)
    code = F.regexp_replace(part(1), r"\s", "")
    return F.concat(code, F.when(code.rlike("[0-9]$"), "-").otherwise(" "), part(2), F.when(part(3) != "", F.concat(F.lit("-"), part(3))).otherwise(""))


def spans(text: str) -> tuple[Column, Column, Column]:
    """Titles, standards and document numbers of a normalised text column: arrays of struct(start, end, value)."""

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    span = lambda m, value, lead=0: F.struct((m["start"] + lead).alias("start"), (m["start"] + F.length(m["whole"])).alias("end"), value.alias("value"))

    def each(mark: str, pattern: str, one) -> Column:  # lines without the mark, most of them, are not searched
        return F.when(F.col(text).rlike(mark), F.transform(located(text, pattern), one)).otherwise(none)

    titles = each("《", TITLE, lambda m: span(m, F.trim(F.substring(m["whole"], F.lit(2), F.length(m["whole"]) - 2))))
    standards = each("[A-Z][A-Z/]", STANDARD, lambda m: span(m, standard_number(m["whole"])))
    numbers = each("号", X.NUMBER, lambda m: let(F.get(X.number_matches(m["whole"]), F.lit(0)), lambda x: span(m, x["number"], F.coalesce(F.length(x["lead"]), F.lit(0)))))
    return titles, standards, F.filter(numbers, lambda m: m["value"].isNotNull())


def mentions(rows: DataFrame) -> DataFrame:
    """doc_id, place, title, kind, standard_no, doc_no: mentions in paragraphs (doc_id, index, text), in order of place.

    A number belongs to a title that it stands in, directly behind (at most two characters between, opening brackets,
    colons or spaces), or directly before. Numbers of no title are mentions themselves, behind all titles. A null text
    has none.
    """
    text = rows.select("doc_id", "index", normalize(F.col("text")).alias("_n")).filter(F.col("_n").rlike("[《号]|[A-Z]"))
    titles, standards, numbers = spans("_n")
    found = text.select("doc_id", "index", "_n", titles.alias("_t"), standards.alias("_s"), numbers.alias("_d"))
    between = lambda a, b: F.substring("_n", a + 1, b - a)

    def near(t: Column, x: Column) -> Column:
        inside = (x["start"] >= t["start"]) & (x["end"] <= t["end"])
        behind = (x["start"] >= t["end"]) & (x["start"] - t["end"] <= 2) & between(t["end"], x["start"]).rlike(r"(?U)^[\s（(：:]*$")
        before = (x["end"] <= t["start"]) & between(x["end"], t["start"]).rlike(r"(?U)^\s*$")
        return inside | behind | before

    own = lambda column: lambda t: F.get(F.filter(column, lambda x: near(t, x)), F.lit(0))
    paired = found.withColumn("_p", F.transform("_t", lambda t: F.struct(t["start"].alias("start"), t["value"].alias("title"), own("_s")(t).alias("s"), own("_d")(t).alias("d"))))
    place = lambda loose, order, start: F.struct(F.lit(loose).alias("loose"), F.col("index").alias("index"), F.lit(order).alias("order"), start.alias("start"))
    none = F.lit(None).cast("string")

    def row(at: Column, title: Column, standard: Column, number: Column) -> Column:
        return F.struct(at.alias("place"), title.alias("title"), standard.alias("standard_no"), number.alias("doc_no"))

    def left(column: str, field: str) -> Column:
        return F.filter(column, lambda x: ~F.exists("_p", lambda p: F.coalesce(p[field]["start"] == x["start"], F.lit(False))))

    every = F.concat(
        F.transform("_p", lambda p: row(place(0, 0, p["start"]), p["title"], p["s"]["value"], p["d"]["value"])),
        F.transform(left("_s", "s"), lambda x: row(place(1, 1, x["start"]), x["value"], x["value"], none)),
        F.transform(left("_d", "d"), lambda x: row(place(1, 2, x["start"]), x["value"], none, x["value"])),
    )
    each = paired.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")
    alone = lambda column: F.col("title") == F.col(column)
    what = F.when(alone("standard_no"), "standard").when(alone("doc_no"), "policy").otherwise(kind(F.col("title"), F.col("standard_no"), F.col("doc_no")))
    return each.select("doc_id", "place", "title", what.alias("kind"), "standard_no", "doc_no")


def union(rows: list[dict]) -> list[list]:
    """Mentions of a document, in order, as citations [title, kind, standard_no, doc_no, paragraphs].

    A mention joins the first citation that has its title (white space aside), its standard, or, for a number that stands
    alone, its number; it adds what that lacks. So a title's number finds later mentions by number.
    """
    out: list[list] = []
    by_title: dict[str, int] = {}
    by_standard: dict[str, int] = {}
    by_number: dict[str, int] = {}
    for m in rows:
        key = "".join(m["title"].split())
        keys = [by_title.get(key), by_standard.get(m["standard_no"]), by_number.get(m["doc_no"]) if m["title"] == m["doc_no"] else None]
        at = min((k for k in keys if k is not None), default=len(out))
        if at == len(out):
            out.append([m["title"], m["kind"], None, None, []])
            by_title.setdefault(key, at)
        one = out[at]
        one[1] = m["kind"] if one[1] == "unknown" else one[1]
        one[2], one[3] = one[2] or m["standard_no"], one[3] or m["doc_no"]
        if m["place"]["index"] not in one[4][-1:]:
            one[4].append(m["place"]["index"])
        for table, value in ((by_standard, one[2]), (by_number, one[3])):
            if value is not None:
                table[value] = min(at, table.get(value, at))
    for one in out:
        one[4] = list(dict.fromkeys(one[4]))
    return out


def citations(rows: DataFrame) -> DataFrame:
    """doc_id, no, title, kind, standard_no, doc_no, paragraphs: what each document cites, in order of first mention,
    titles before numbers that stand alone. Only mentions are gathered, those of one document in a row."""
    per = mentions(rows).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "title", "kind", "standard_no", "doc_no"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.int32()))
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):  # the mentions of a few documents are held as Python objects at once
                part = batch.slice(at, GROUP)
                out = [(doc, no, *c) for doc, found in zip(part.column("doc_id").to_pylist(), part.column("m").to_pylist(), strict=True) for no, c in enumerate(union(found))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return per.mapInArrow(run, FOUND)


def status_issues(found: DataFrame, status: DataFrame, rows: DataFrame) -> DataFrame:
    """Issues of citations that are repealed or superseded, in each paragraph that cites them: doc_id, index, category,
    severity, start, end, original, suggestion, reason, source.

    status: title, status, replacement_title, replacement_number, reason (the last three may be null). The standard's number
    is marked where it stands, else the title in its book marks, else the title; the suggestion is what replaces it.
    """
    what = F.when(F.col("status") == "repealed", "已废止").when(F.col("status") == "superseded", "已有新版本")
    known = status.withColumn("_what", what).filter("_what is not null").dropDuplicates(["title"])
    new = F.col("status") == "superseded"
    text = F.concat(
        F.lit("《"), "title", F.lit("》"), "_what",
        F.coalesce(F.when(new, F.concat(F.lit("，现行版本为《"), "replacement_title", F.lit("》"), F.coalesce(F.concat(F.lit("（"), "replacement_number", F.lit("）")), F.lit("")))), F.lit("")),
        F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit("。"), "reason")).otherwise(""),
    )
    cited = found.join(known, "title").select("doc_id", F.explode("paragraphs").alias("index"), "title", "standard_no", "status", F.when(new, F.col("replacement_title")).alias("_title"), F.when(new, F.col("replacement_number")).alias("_number"), text.alias("reason"))
    at = cited.join(rows.select("doc_id", "index", "text", normalize(F.col("text")).alias("_n")), ["doc_id", "index"])
    number = F.when(F.col("standard_no").isNotNull(), F.get(F.filter(spans("_n")[1], lambda x: x["value"] == F.col("standard_no")), F.lit(0)))
    place = lambda needle: F.when(F.instr("text", needle) > 0, F.struct((F.instr("text", needle) - 1).alias("start"), (F.instr("text", needle) - 1 + F.length(needle)).alias("end")))
    quoted = F.concat(F.lit("《"), "title", F.lit("》"))
    spots = at.withColumns({"_s": number, "_q": place(quoted), "_b": place(F.col("title"))})
    other = F.when(F.col("_title") != F.col("title"), F.when(F.col("_q").isNotNull(), F.concat(F.lit("《"), "_title", F.lit("》"))).otherwise(F.col("_title")))
    start, end = (F.coalesce(F.col(f"_s.{c}"), F.col(f"_q.{c}"), F.col(f"_b.{c}")) for c in ("start", "end"))
    out = spots.withColumns({"start": start, "end": end}).filter("start is not null")
    return out.select(
        "doc_id", "index", F.lit("citation").alias("category"), F.when(F.col("status") == "repealed", "error").otherwise("warning").alias("severity"), "start", "end",
        F.expr("substring(text, start + 1, `end` - start)").alias("original"), F.when(F.col("_s").isNotNull(), F.col("_number")).otherwise(other).alias("suggestion"), "reason", F.lit("model").alias("source"),
    )
