"""Title, number, issuer and date of official documents, from their first lines and their signature.

A document is a row with its lines as an array; each line is described once, and each field is the first of several rules
that finds something.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as X
from ..functions.text import HAN, let, normalize

#: Lines that the head of a document has, and those of them in which a date may stand under the title.
HEAD, TOP = 15, 8
#: Names of issuers end in these; titles in those; fixed values.
ISSUERS = "人民政府 政府 办公厅 办公室 委员会 委 部 厅 局 院 署 中心 公司 银行 集团 会 处".split()
TITLES = (
    "通知 意见 办法 规定 方案 报告 决定 批复 函 通报 公告 通告 条例 细则 规则 规划 计划 纲要 指引 指南 要点 请示 决议 纪要 说明 规范 制度 法 令 总结 讲话 标准 清单 目录 章程 守则 须知 答复 建议"
).split()
#: What a line above the title begins with, and what an issuer's name does not hold; fixed values.
MARKS = "签发人 密级 特急 加急 特提 平急 机密 秘密 绝密 份号 ★".split()
NO_ISSUER = "关于 通知 印发 如下".split()
#: A date, the label of one, and the note of a seal, in width-normalised lines; fixed patterns.
DATE = r"([0-9]{4}|[〇○零OoΟ一二三四五六七八九]{4})\s*年\s*([0-9]{1,2}|[一二三四五六七八九十]{1,3})\s*月\s*([0-9]{1,2}|[一二三四五六七八九十]{1,4})\s*日"
DATE_LABEL = r"^(?:发布|成文|发文|印发)(?:日期|时间)\s*:"
SEAL = r"(?<!\s)\s*\([^)]{0,4}章\)$"  # white space is tried from its start only
TITLE_END = rf"(?:{'|'.join(TITLES)})(?:\([^)]{{1,15}}\))?》?$"
#: Characters that TITLE_END can span, and a line terminator; a title about a subject has at most LONGEST.
TITLE_TAIL, LONGEST = max(map(len, TITLES)) + 20, 80
#: What (?U)\s matches, and the characters that normalize() changes.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WIDE = "[！-～　]"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def narrow(text: Column) -> Column:
    """normalize(), which looks at each character alone, only where there is something to change."""
    return F.when(text.rlike(WIDE), normalize(text)).otherwise(text)


def unsealed(n: Column) -> Column:
    """A stripped, width-normalised line without the note of a seal."""
    return F.when(n.endswith("章)"), F.regexp_replace(n, SEAL, "")).otherwise(n)


def titled(n: Column) -> Column:
    """Whether a width-normalised line ends like a title: only its end is searched."""
    return F.right(n, F.lit(TITLE_TAIL)).rlike(TITLE_END)


def iso_date(text: Column) -> Column:
    """A date as yyyy-mm-dd, null for one that is none."""
    number = lambda i: X.numeral(F.translate(F.regexp_extract(text, DATE, i), "OoΟ", "〇〇〇"))
    valid = number(1).between(1900, 2100) & number(2).between(1, 12) & number(3).between(1, 31)
    return F.when(valid, F.format_string("%04d-%02d-%02d", number(1), number(2), number(3)))


def is_issuer(line: Column) -> Column:
    """Whether a width-normalised line can be an issuer's name."""
    ends = rf"(?:{'|'.join(ISSUERS)})$"
    return let(let(stripped(line), unsealed), lambda n: F.length(n).between(2, 40) & ~n.rlike(f"^各|[:,。;!?0-9]|{'|'.join(NO_ISSUER)}") & n.rlike(ends))


def issuer_name(text: Column) -> Column:
    """An issuer's name as it is written, without the note of a seal, white space squeezed."""
    name = lambda t: F.left(t, F.length(F.regexp_replace(normalize(t), SEAL, "")))
    return let(stripped(text), lambda t: F.regexp_replace(stripped(name(t)), r"(?U)\s+", " "))


def is_letterhead(title: Column) -> Column:
    """The red head of a document, which is not its title."""
    return let(narrow(stripped(title)), letterhead)


def letterhead(n: Column) -> Column:
    return (F.length(n) <= 30) & (n.endswith("文件") | (F.size(X.number_matches(n)) > 0))


def described(line: Column) -> Column:
    """A line that is not blank, as a struct of what the rules ask about it. What they ask about titles is asked of lines that
    are short enough to be one, and only those and issuers keep their text."""

    def of(text: Column, n: Column) -> Column:
        size = F.length(n)
        number = let(F.get(X.number_matches(n), F.lit(0)), lambda m: F.when(size - F.length(m["whole"]) + F.length(m["lead"]) <= 12, m["number"]))
        noise = (size > LONGEST) | letterhead(n) | ((size <= 20) & n.rlike(DATE)) | n.rlike(f"^(?:{'|'.join(MARKS)})") | ~n.rlike(f"[{HAN}]")
        dates = F.regexp_extract_all(n, F.lit(DATE), F.lit(0))
        rest = stripped(F.regexp_replace(stripped(F.regexp_replace(n, rf"(?s)^(.*){DATE}", "$1")), r"^[()]+|[()]+$", ""))
        dated = n.contains("年") & n.contains("月") & n.contains("日")
        last = F.when(dated & ~n.rlike("印发|^抄送|^抄报"), F.when((rest == "") | is_issuer(rest), iso_date(F.element_at(F.when(F.size(dates) > 0, dates), -1))))
        first = F.get(dates, F.lit(0))
        top = F.when(dated & ((F.length(first) + 2 >= size) | n.startswith("(") | n.rlike(DATE_LABEL)), iso_date(first))
        kept = (size <= LONGEST) | is_issuer(n)
        return F.struct(
            F.when(kept, text).alias("text"), F.when(kept, n).alias("n"), n.endswith(":").alias("colon"), size.alias("size"), number.alias("number"), noise.alias("noise"), ((size <= 50) & ~n.rlike("[。,;]")).alias("short"), ((size <= LONGEST) & titled(n)).alias("title"),
            is_issuer(n).alias("issuer"), last.alias("signed"), F.when(dated, rest).alias("rest"), top.alias("top"), (stripped(unsealed(n)) == "").alias("seal"),
        )

    return let(stripped(line), lambda text: let(narrow(text), lambda n: of(text, n)))


def metadata(lines: DataFrame) -> DataFrame:
    """doc_id, title, doc_number, issuer, date of documents given by their lines (doc_id, index, text).

    Title: before the salutation, a line about a subject that ends like a title (or does with the next one), else a short
    line that does, else a short line. Number: a line of the head that holds little else. Date: the last line that is one,
    alone or with the issuer's name, else one under the title. Issuer: on that line; on up to four lines above it, a seal's
    note aside; in the letterhead; above the title; in the title. What is not found is null; blank lines do not count.
    """
    # described before they are gathered, so that long lines stay where they are
    each = lines.select("doc_id", "index", F.when(F.col("text").rlike(r"(?U)\S"), described(F.col("text"))).alias("x"))
    filled = each.groupBy("doc_id").agg(F.filter(F.sort_array(F.collect_list(F.struct("index", "x"))), lambda y: y["x"].isNotNull()).alias("_l"))  # the lines of one document
    rows = filled.select("doc_id", F.transform("_l", lambda y: y["x"]).alias("_l")).withColumn("_h", F.slice("_l", 1, HEAD))
    at = lambda array, test: F.get(F.filter(F.transform(array, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()), F.lit(0))
    first = lambda array, test: F.get(F.filter(array, test), F.lit(0))

    rows = rows.withColumn("_end", F.coalesce(at("_h", lambda x, i: x["colon"]), F.size("_h")))
    below = lambda i: F.get("_h", i + 1)
    wraps = lambda x, i: (i + 1 < F.col("_end")) & (below(i)["size"] <= 30) & titled(F.concat(x["n"], below(i)["n"]))
    may = lambda x, i: (i < F.col("_end")) & ~x["noise"]
    about = at("_h", lambda x, i: may(x, i) & x["n"].contains("关于") & (x["size"] <= LONGEST) & (x["title"] | F.coalesce(wraps(x, i), F.lit(False))))
    rows = rows.withColumn("_a", about).withColumn("_t", F.coalesce("_a", at("_h", lambda x, i: may(x, i) & x["short"] & x["title"]), at("_h", lambda x, i: may(x, i) & x["short"])))
    line = F.get("_h", F.col("_t"))
    title = F.when(F.col("_a").isNotNull() & ~line["title"], F.concat(line["text"], F.get("_h", F.col("_t") + 1)["text"])).otherwise(line["text"])
    rows = rows.withColumns({"title": title, "_s": F.array_max(F.transform("_l", lambda x, i: F.when(x["signed"].isNotNull(), i)))})

    signed = F.get("_l", F.col("_s"))
    # from the signature upwards: seals' notes first, then up to four names; the first line that is none ends them
    above = F.reverse(F.slice("_l", 1, F.coalesce(F.col("_s"), F.lit(0))))
    rows = rows.withColumns({"_date": signed["signed"], "_rest": signed["rest"], "_up": above})
    rows = rows.withColumn("_up", F.slice("_up", F.coalesce(at("_up", lambda x, i: ~x["seal"]), F.size("_up")) + 1, 4))
    rows = rows.withColumn("_up", F.slice("_up", 1, F.coalesce(at("_up", lambda x, i: ~x["issuer"]), F.size("_up"))))
    names = F.array_join(F.transform(F.reverse("_up"), lambda x: issuer_name(x["text"])), " ")
    letter = first(F.slice("_h", 1, 3), lambda x: x["n"].endswith("文件") & (x["size"] <= 30) & (x["size"] > 2))
    organ = F.split("title", "关于", 2)
    issuer = (
        F.when((F.col("_rest") != "") & is_issuer(F.col("_rest")), issuer_name(F.col("_rest"))),
        F.when(F.size("_up") > 0, names),
        issuer_name(F.regexp_replace(letter["n"], "文件$", "")),
        issuer_name(first(F.slice("_h", 1, F.least(F.coalesce(F.col("_t"), F.lit(0)), F.lit(5))), lambda x: x["issuer"])["text"]),
        F.when(F.col("title").contains("关于") & is_issuer(normalize(F.get(organ, F.lit(0)))), issuer_name(F.get(organ, F.lit(0)))),
    )
    top = first(F.slice("_h", 1, TOP), lambda x: x["top"].isNotNull())["top"]
    return rows.select("doc_id", "title", first("_h", lambda x: x["number"].isNotNull())["number"].alias("doc_number"), reduce(lambda a, b: F.coalesce(a, b), issuer).alias("issuer"), F.coalesce("_date", top).alias("date"))
