"""Small text functions on columns: spans, sentences, headings, file types, labels, gaps, index terms, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as T

#: Extensions of files that can be read; fixed values.
FILE_TYPES = ("pdf", "docx", "doc", "xlsx", "xls", "wps", "ofd", "txt", "md")
#: Words of a link text that name the act rather than the document; fixed values.
LINK_WORDS = ("下载", "点击", "查看", "原文", "全文", "附件", "打印", "文件")
#: How a gap in a draft begins, and who is to fill those that are not asked for; fixed values.
GAP, AUTHORS = "【待补充", "编制单位"
SENTENCE_ENDS = "。！？；\\n!?;"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def trim_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of a span of a text without white space at its ends; null for a blank span."""
    part = F.substring(text, start + 1, end - start)
    left, right = F.regexp_replace(part, r"(?U)^\s+", ""), F.regexp_replace(part, r"(?U)\s+$", "")
    return F.when(F.length(left) > 0, F.struct((end - F.length(left)).alias("start"), (start + F.length(right)).alias("end")))


def sentence_bounds(text: Column, at: Column) -> Column:
    """struct(start, end) of the sentence around an offset, without the mark that ends it. Both patterns are anchored where
    they begin, so the time is linear in the text, also in one without marks."""
    before = F.regexp_replace(F.left(text, at), rf"(?s)\A.*[{SENTENCE_ENDS}]", "")
    after = F.regexp_extract(F.substring(text, at + 1, F.length(text)), rf"\A[^{SENTENCE_ENDS}]*", 0)
    return F.struct((at - F.length(before)).alias("start"), (at + F.length(after)).alias("end"))


def heading_text(text: Column, most: int = 60) -> Column:
    """A heading for a path: white space squeezed, letter-spaced words closed up (all, or all behind the first), marks at the
    end dropped, cut at `most` characters."""
    one = squeezed(text)
    one = F.when(one.rlike(r"(?U)^\S( \S)+$"), F.replace(one, F.lit(" "), F.lit(""))).when(
        one.rlike(r"(?U)^\S{2,}( \S){2,}$"), F.concat(F.regexp_extract(one, r"^[^ ]* ", 0), F.replace(F.regexp_extract(one, r" (.*)$", 1), F.lit(" "), F.lit("")))
    ).otherwise(one)
    return T.clip(F.regexp_replace(one, "[。：:；;，,]+$", ""), most)


def book_marks(title: Column) -> Column:
    """Pointed quotes become Chinese title marks in titles with Han characters."""
    return F.when(title.rlike("[一-鿿]"), F.translate(title, "«»", "《》")).otherwise(title)


def extension(name: Column, types: tuple[str, ...] = FILE_TYPES) -> Column:
    """The listed extension that a file name ends in, else null."""
    ext = F.regexp_extract(F.lower(name), r"\.([^.]*)$", 1)
    return F.when(ext.isin(*types), ext)


def file_type(url: Column) -> Column:
    """The type that the last part of a url's path names."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return extension(F.regexp_extract(path, r"([^/]*)$", 1))


def named_type(text: Column) -> Column:
    """The type that a link text names, closing brackets aside."""
    return extension(F.regexp_replace(F.trim(text), "[）)]+$", ""))


def names_document(text: Column) -> Column:
    """Whether a link text names the document: at least four Han characters besides words such as "download"."""
    return F.regexp_count(F.regexp_replace(text, "|".join(LINK_WORDS), ""), F.lit("[一-鿿]")) >= 4


def range_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("第"), first.cast("string"), F.lit("段"))).otherwise(F.concat(F.lit("第"), first.cast("string"), F.lit("–"), last.cast("string"), F.lit("段")))


def without_label(text: Column) -> Column:
    """A paragraph without the label "[第n段]" that was copied in front of it."""
    return F.regexp_replace(text, r"(?U)^\[第[0-9]+段\]\s*", "")


def gaps(rows: DataFrame, before: int = 160, after: int = 60) -> DataFrame:
    """doc_id, need, passage: what drafts (doc_id, index, text) say is still to be filled in, the first of each need of a
    document, with what stands around it; gaps that only the authors can fill are left out."""
    pattern = rf"{GAP}[^】]*】"
    parts = rows.select("doc_id", "index", "text", F.regexp_extract_all("text", F.lit(f"({pattern})"), 1).alias("m"), F.split("text", pattern, -1).alias("g"))
    starts = F.expr("transform(m, (x, i) -> aggregate(slice(g, 1, i + 1), 0, (n, y) -> n + length(y)) + aggregate(slice(m, 1, i), 0, (n, y) -> n + length(y)))")
    each = parts.withColumn("s", starts).select("doc_id", "index", "text", F.explode(F.arrays_zip("m", "s")).alias("x")).select("doc_id", "index", "text", "x.*")
    need = F.trim(F.regexp_replace(F.expr(f"substring(m, {len(GAP) + 1}, length(m) - {len(GAP) + 1})"), r"^[：:]+", ""))
    begin = F.greatest(F.col("s") - before, F.lit(0))
    passage = F.substring("text", begin + 1, F.col("s") + F.length("m") + after - begin)
    found = each.select("doc_id", "index", "s", need.alias("need"), passage.alias("passage")).filter((F.col("need") != "") & ~F.col("need").contains(AUTHORS))
    return found.groupBy("doc_id", "need").agg(F.min_by("passage", F.struct("index", "s")).alias("passage"))


def mentions(text: Column, terms: Column) -> Column:
    """Whether a text has one of the terms, or two neighbouring characters, the first not ASCII, of a longer one."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    part = lambda p: ~p.rlike(r"^\p{ASCII}") & F.contains(text, p)
    return F.exists(terms, lambda t: F.contains(text, t) | ((F.length(t) > 2) & F.exists(pairs(t), part)))


# ---- rows -----------------------------------------------------------------------------------------------------------
def paragraph_range(rows: DataFrame, a: int, b: int) -> DataFrame:
    """Paragraphs from one index to another, both included, in either order."""
    return rows.filter(F.col("index").between(min(a, b), max(a, b)))


def in_categories(rows: DataFrame, categories: list[str], column: str = "category") -> DataFrame:
    """Rows of the categories; none given means all."""
    return rows.filter(F.col(column).isin(categories)) if categories else rows


def screened(rows: DataFrame, score: str = "score", least: float = 0.2) -> DataFrame:
    """Rows without a score, or with one that is high enough to be looked at."""
    return rows.filter(F.col(score).isNull() | (F.col(score) >= least))


def preferred_first(rows: DataFrame, group: list[str], preferred: Column, order: list[str], most: int) -> DataFrame:
    """At most `most` rows of a group with their place: preferred ones first, then in their order."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(preferred.desc(), *order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    """A number held between two bounds; the default where it is missing or no number."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), value)))


def settings(json: Column, defaults: dict[str, str | float | bool]) -> Column:
    """A struct of settings from a partial JSON text: what it lacks, or has in a wrong type, is the default."""
    kinds = {str: "string", float: "double", int: "bigint", bool: "boolean"}
    return F.struct(*(F.coalesce(F.get_json_object(json, f"$.{k}").try_cast(kinds[type(v)]), F.lit(v)).alias(k) for k, v in defaults.items()))


def by_index(answers: DataFrame, wanted: DataFrame, key: str = "request", value: str = "vector", size: int | None = None) -> DataFrame:
    """Answers (request, index, value) as one array a request, in the order of index. wanted: (request, n). A request whose
    answers are not exactly 0 to n - 1, or whose values are not of `size` elements, raises an error."""
    got = answers.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("index", value))).alias("_a"))  # of one request
    rows = wanted.join(got, key, "left")
    good = F.coalesce(F.transform("_a", lambda x: x["index"].cast("int")) == F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), F.col("n") == 0)
    if size is not None:
        good = good & F.coalesce(F.forall("_a", lambda x: F.size(x[value]) == size), F.lit(True))
    values = F.transform("_a", lambda x: x[value])
    return rows.select(key, F.when(good, values).otherwise(F.raise_error(F.lit("answers do not fit the request")).cast(f"array<{answers.schema[value].dataType.simpleString()}>")).alias(value))
