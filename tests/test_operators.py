"""Operators on small literal inputs, the Chinese forms among them."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext.functions import numbers as N
from loomtext.functions import terms
from loomtext.functions import text as T
from loomtext.operators import diff as D
from loomtext.operators import markup as M
from loomtext.operators import metadata as G2
from loomtext.operators import models as L
from loomtext.operators import numbering as U
from loomtext.operators import places as G
from loomtext.operators import proofread as P
from loomtext.operators import search as S
from loomtext.operators import structure as C
from loomtext.operators import tables as O
from loomtext.operators import web as H
from loomtext.sources import docx as X
from loomtext.sources import files as I
from loomtext.streaming import ingest as ST

ROWS = "doc_id long, index int, text string"


def one(spark, column, text: str):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


def paragraphs(spark, texts: list[str], doc: int = 1):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], ROWS)


# ---- text ----------------------------------------------------------------------------------------------------------
def test_text_functions(spark):
    t = F.col("text")
    assert one(spark, T.normalize(t), "ＡＢ１　ｃ") == "AB1 c"
    assert one(spark, T.search_terms(t), "环境保护 Law ２０") == ["环境", "境保", "保护", "law", "20"]
    assert one(spark, T.search_terms(t), "水 x") == ["水", "x"]
    assert one(spark, terms.query_terms(t, 2), "x b x c") == ["x", "b"]
    assert one(spark, T.nonspace_chars(t), " a　b\n") == 2
    assert one(spark, T.estimate_tokens(t), "中文abcde") == 4
    assert one(spark, T.clip(t, 3), "abcd") == "abc…"
    assert one(spark, T.clip_around(t, F.lit("d"), 1), "abcdefg") == "…cde…"
    assert one(spark, T.occurrences(t, F.lit("aa")), "aaab aa") == [0, 1, 5]
    assert one(spark, T.occurrences(t, F.lit(".")), "a.b.") == [1, 3]
    assert one(spark, T.occurrences(t, F.lit("x")), "abc") == [] == one(spark, T.occurrences(t, F.lit("")), "abc")
    assert one(spark, T.occurrences(t, F.lit("\\E")), "a\\Eb") == [1]
    assert one(spark, T.occurrences(t, F.lit("b")), "𠀀b𠀀b") == [1, 3]
    assert one(spark, T.safe_file_name(t), 'a/b:c?.docx') == "a_b_c_.docx"
    assert one(spark, T.bigrams(t), "a") == ["a"] and one(spark, T.bigrams(t), "aaab") == ["aa", "ab"]
    assert one(spark, T.xml_clean(t), "a\x00b\x0bc") == "abc"
    assert one(spark, T.worth_reading(t), "中文字") and not one(spark, T.worth_reading(t), "ab中")
    assert one(spark, T.highlight(t, "a.c b"), "xA.C b") == "x<mark>A.C</mark> <mark>b</mark>"


def test_numbers(spark):
    cases = {"12": 12, "十二": 12, "二十": 20, "一百零五": 105, "三千二百": 3200, "二〇一七": 2017, "两万三千": 23000, "１２": 12, "十": 10, "abc": None, "": None, "一x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "text string").select("text", N.parse_number("text").alias("v")).collect()
    assert {r["text"]: r["v"] for r in rows} == cases
    assert [N.number(N.chinese(i)) for i in range(1, 3000)] == list(range(1, 3000))
    assert [N.formatted(n, s) for n, s in ((4, "lowerRoman"), (28, "upperLetter"), (12, "chineseCounting"), (3, "decimalEnclosedCircle"), (5, "decimalZero"), (5, "bullet"), (7, "?"))] == ["iv", "BB", "十二", "③", "05", "", "7"]
    dates = {"二〇一七年三月五日": "2017-03-05", "于2024-2-31印发": "2024-02-31", "2024年13月1日": None, "none": None}
    rows = spark.createDataFrame([(k,) for k in dates], "text string").select("text", N.parse_date("text").alias("v")).collect()
    assert {r["text"]: r["v"] for r in rows} == dates
    for text, want in (("0.5", 0.5), ("80%", 0.8), ("True", 1.0), ("否", 0.0), ("1.7", 1.0), ("maybe", None)):
        assert one(spark, N.probability(F.col("text")), text) == want


# ---- structure -----------------------------------------------------------------------------------------------------
def test_headings(spark):
    """Line, kind, text of the heading, whether more follows on the line."""
    long = "各级人民政府应当加强公共数据管理工作"
    cases = [
        ("第一章 总则", "chapter", "第一章 总则", False), ("第一章　总　则", "chapter", "第一章 总则", False), ("第二节　范围", "section", "第二节 范围", False), ("第三部分 任务", "part", "第三部分 任务", False), ("第一编　总则", "part", "第一编 总则", False),
        ("第三条 为了保护环境，制定本办法。", "article", "第三条", True), ("第四条【目的】为了管理。", "article", "第四条【目的】", True), ("第五条", "article", "第五条", False), ("第20条（范围）", "article", "第20条（范围）", False),
        ("一、目标", "level1", "一、目标", False), ("（二）原则", "level2", "（二）原则", False), ("(二) 范围", "level2", "(二) 范围", False), ("1.范围", "level3", "1.范围", False), ("2．原则", "level3", "2．原则", False), ("3、工作", "level3", "3、工作", False), ("（1）甲", "level4", "（1）甲", False), ("⑴甲", "level4", "⑴甲", False), ("①乙", "level5", "①乙", False),
        ("附件1", "attachment", "附件1", False), ("附件 二：", "attachment", "附件 二", False), (f"（一）加强领导。{long * 4}", "level2", "（一）加强领导", True), (f"1. 加强领导。{long * 2}", "level3", "1. 加强领导", True), (f"一、{'长' * 30}。{long}", "level1", f"一、{'长' * 30}。{long}", False),
    ]
    none = ["第二十条规定的情形", "第五条第二款所列数据", "1.5倍", "一、甲；", "（一）甲，", "普通段落", "", "附件1 清单", f"1. {long * 4}", f"（1）{long * 3}", "（1）甲。乙", "①甲：乙", f"第三章{'很长的正文' * 10}", "第三章 甲。", "2024年3月15日", f"一、{'长' * 61}"]
    rows = spark.createDataFrame([(c[0],) for c in cases] + [(t,) for t in none], "text string").select("text", C.heading(F.col("text")).alias("h")).collect()
    got = {r["text"]: r["h"] and (r["h"]["kind"], r["h"]["text"], r["h"]["has_body"]) for r in rows}
    assert got == {t: rest for t, *r in cases for rest in [tuple(r)]} | dict.fromkeys(none)


def levels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, index int, level int, display string")


def test_chunks_follow_structure(spark):
    """Offsets into the text as it is, sizes, cover and paths; line feeds, carriage returns and both mixed."""
    body = "第一句话说明情况。" * 60
    lines = ["办法", "", "第一章 总则", body, "第一节 范围", "短。", "第一条 甲", "（一）乙", "第二条", "丙", "第二章 附则", body * 4, "附件1", "一、甲", "丁"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\r\n".join(lines)), (3, "\n".join(x + "\r" * (i % 2) for i, x in enumerate(lines)) + "\n \n"), (4, None), (5, ""), (6, " \r\n ")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = C.chunks(docs, texts=True).orderBy("doc_id", "chunk_no").collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3}
    for doc in (1, 2, 3):
        own, whole = [r for r in out if r["doc_id"] == doc], texts[doc]
        assert all(r["end"] - r["start"] <= C.CHILD and r["parent_end"] - r["parent_start"] <= C.PARENT and r["parent_start"] <= r["start"] < r["end"] <= r["parent_end"] for r in own)
        assert all(r["text"] == whole[r["start"] : r["end"]] == r["text"].strip() and r["parent_text"] == whole[r["parent_start"] : r["parent_end"]] for r in own)
        seen = {i for r in own for i in range(r["start"], r["end"])}
        assert all(i in seen or c.isspace() for i, c in enumerate(whole))
        assert [r["chunk_no"] for r in own] == list(range(len(own)))
        paths = []
        for r in own:
            if r["path"] not in paths:
                paths.append(r["path"])
        top = ["第一章 总则", "第一节 范围"]
        assert paths == [[], top[:1], top, [*top, "第一条"], [*top, "第二条"], ["第二章 附则"], ["附件1", "一、甲"]]
    # an item below an article is its text; a chapter without text of its own joins its first part
    assert next(r["text"] for r in out if r["path"][-1:] == ["第一条"]).replace("\r", "") == "第一条 甲\n（一）乙"
    assert next(r["text"] for r in out if r["path"][:1] == ["附件1"]).replace("\r", "") == "附件1\n一、甲\n丁"


def test_styles_and_numbers_stack(spark):
    """By style where both have one, else by rank; a styled heading holds numbered ones, not the other way round."""
    body = "正文内容。" * 120
    lines = ["项目概述", "建设背景", "一、现状分析", body, "建设目标", body, "实施计划", body, "x" * 101, "1. 第一项", body]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    styled = levels(spark, [(1, 0, 0, None), (1, 1, 1, None), (1, 4, 1, "2 建设目标"), (1, 6, 0, None), (1, 8, 0, None)])
    out = C.chunks(docs, styled).orderBy("chunk_no").collect()
    paths = list(dict.fromkeys(tuple(r["parent_path"]) for r in out))
    assert paths == [("项目概述", "建设背景", "一、现状分析"), ("项目概述", "2 建设目标"), ("实施计划",), ("实施计划", "1. 第一项")]
    article = C.outline(["a", "b", "c", "d"], {0: C.Head(4, None, "条"), 1: C.Head(5, None, "一"), 2: C.Head(5, 3, "styled"), 3: C.Head(2, None, "章")})
    assert article == [(0, ["条"]), (2, ["条", "styled"]), (3, ["章"])]


def test_short_document_is_one_parent(spark):
    text = "关于做好值班工作的通知\n一、加强值班\n各单位要落实制度。\n二、做好应急\n遇有事件及时报告。"
    out = C.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_no").collect()
    assert {(r["parent_start"], r["parent_end"], tuple(r["parent_path"]), r["parent_no"]) for r in out} == {(0, len(text), (), 0)}
    assert [r["path"] for r in out] == [[], ["一、加强值班"], ["二、做好应急"]]
    shared = C.chunks(spark.createDataFrame([(1, "第一章 甲\n一、乙\n丙\n二、丁\n戊")], "doc_id long, text string")).collect()
    assert {tuple(r["parent_path"]) for r in shared} == {("第一章 甲",)}


def plain_groups(pieces, most):
    """The two passes, stated over all ways to join neighbours."""
    def joined(enough):
        out, k = [], 0
        while k < len(pieces):
            end = k
            while end + 1 < len(pieces) and pieces[end][1] - pieces[k][0] < enough and pieces[end + 1][1] - pieces[k][0] <= most:
                end += 1
            out.append((pieces[k][0], pieces[end][1]))
            k = end + 1
        return out

    tight = joined(10**9)
    even = joined(-(-(pieces[-1][1] - pieces[0][0]) // len(tight)))
    return even if len(even) <= len(tight) else tight


def test_cuts_in_two_passes():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["甲", "乙", " ", "\n", "。", "”", "，", "；", "x" * r.randrange(1, 30)]) for _ in range(r.randrange(1, 80)))
        most = r.randrange(1, 60)
        got = C.spans(text, most)
        assert all(0 < b - a <= most for a, b in got) and all(b <= c for (_, b), (c, _) in zip(got, got[1:], strict=False))
        seen = {i for a, b in got for i in range(a, b)}
        assert all(i in seen or c.isspace() for i, c in enumerate(text))
        whole = C.trimmed(text, 0, len(text))
        assert got == ([] if whole is None else plain_groups(list(C.parts(text, *whole, most)), most))
    cuts = lambda t, most: [t[a:b] for a, b in C.spans(t, most)]
    assert cuts("甲甲甲。”乙乙乙。丙丙丙。丁", 9) == ["甲甲甲。”乙乙乙。", "丙丙丙。丁"]
    assert cuts("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and cuts(" \n ", 10) == [] and cuts("", 3) == []
    assert cuts("一二三四五六七八九十，一二三。", 8) == ["一二三四五六七八", "九十，一二三。"]
    # as even as it gets without more parts: 12 pieces of 3 in parts of at most 30 are two of 18, not 30 and 6
    assert [b - a for a, b in C.spans("甲甲。" * 12, 30)] == [18, 18]


def test_parent_cut_before_a_space():
    """A parent of a run without ends is cut every `most` characters; its only chunk is the parent, a space in front too."""
    text = "x" * 10 + " " + "y" * 5
    assert [c[3:] for c in C.cut(text, {}, 10, 8)] == [(0, 10, 0, 8), (0, 10, 8, 10), (10, 16, 10, 16)]


def test_markdown_and_paths(spark):
    docs = spark.createDataFrame([(1, "# A\r\ntext\n```\n# no\n~~~\n# nor\n```\n## B ##\nmore\n# C")], "doc_id long, text string")
    lines = C.markdown_lines(docs)
    rows = lines.orderBy("index").collect()
    assert [r["level"] for r in rows] == [1, None, None, None, None, None, None, 2, None, 1]
    assert [r["display"] for r in rows if r["level"]] == ["A", "B", "C"]
    out = C.chunks(docs, lines, texts=True).orderBy("chunk_no").collect()
    assert [(r["path"], r["text"]) for r in out] == [(["A"], "# A\r\ntext\n```\n# no\n~~~\n# nor\n```"), (["A", "B"], "## B ##\nmore"), (["C"], "# C")]


META = {
    "某省人民政府文件\n某政发[2020] 012号\n关于加强水资源管理的通知\n各市人民政府：\n正文。\n某省人民政府\n2020年5月6日": ("关于加强水资源管理的通知", "某政发〔2020〕12号", "某省人民政府", "2020-05-06"),
    "某市人民政府\n某政发[2023]5号\n某市人民政府关于加快建设的实施方案\n各区人民政府，各委、办、局：\n　　通知如下。\n某市人民政府　　2023年5月10日": ("某市人民政府关于加快建设的实施方案", "某政发〔2023〕5号", "某市人民政府", "2023-05-10"),
    "财政部 税务总局文件\n财预【2022】1号\n关于优惠政策的公告\n　　期限为2022年1月1日至2024年12月31日。\n财政部　　　　税务总局\n（盖章）\n2022年3月14日\n抄送：各省财政厅（局）。\n财政部办公厅　　2022年3月15日印发": ("关于优惠政策的公告", "财预〔2022〕1号", "财政部 税务总局", "2022-03-14"),
    "某市统计局关于加强管理的规定\n某统发〔2024〕3号\n发布日期：2024年1月20日\n第一条 应当注明来源。": ("某市统计局关于加强管理的规定", "某统发〔2024〕3号", "某市统计局", "2024-01-20"),
    "某国数据安全法\n（2021年6月10日某届常务委员会通过）\n第一章　总　　则\n本法自2021年9月1日起施行。": ("某国数据安全法", None, None, "2021-06-10"),
    "某办公厅关于印发《五年设想》\n的通知\n各省：\n正文\n某局\n某委员会（章）\n二〇二四年十二月三十一日": ("某办公厅关于印发《五年设想》的通知", None, "某局 某委员会", "2024-12-31"),
    "\n \nplain text without anything": (None, None, None, None),
    "会议内容，第一段；\n简短的一行\n2024年13月1日": ("简短的一行", None, None, None),
}


def test_metadata(spark):
    rows = spark.createDataFrame([(d, i, x) for d, t in enumerate(META) for i, x in enumerate(t.split("\n"))] + [(99, 0, None)], ROWS)
    got = {r["doc_id"]: tuple(r)[1:] for r in G2.metadata(rows).collect()}
    assert got == {d: v for d, v in enumerate(META.values())} | {99: (None,) * 4}
    heads = spark.createDataFrame([("某市人民政府文件",), ("某政发〔2020〕1号",), ("关于文件的通知",)], "t string")
    assert [r["x"] for r in heads.select(G2.is_letterhead(F.col("t")).alias("x")).collect()] == [True, True, False]


def test_metadata_long_lines(spark):
    """Lines that are too long for a title leave their text where they are, and are still described."""
    d = G2.described(F.col("text"))
    assert one(spark, d["text"], "通知" * 41) is None and one(spark, d["text"], "通知" * 40) == "通知" * 40
    gap, long = " " * 20_000, "某" * 100
    texts = [f"a{gap}b", f"关于{long}的通知", f"{long}：", "关于水的通知", "某局", f"某委员会{gap}(盖章)", f"x{gap}(盖章)y", f"{long}。", "某厅", f"{gap}（章）", "2024年5月6日", gap]
    got = [tuple(r) for r in G2.metadata(paragraphs(spark, texts)).collect()]
    assert got == [(1, None, None, "某厅", "2024-05-06")]


# ---- proofreading --------------------------------------------------------------------------------------------------
def issues_of(df):
    return {(r["start"], r["end"], r["original"], r["suggestion"]) for r in df.collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (" 开头", {(0, 1, " ", "")}),
        ("结尾 ", {(2, 3, " ", "")}),
        ("两个  字", {(2, 4, "  ", " ")}),
        ("中 文", {(1, 2, " ", "")}),
        ("好,行", {(1, 2, ",", "，")}),
        ("见(附件)说明", {(1, 5, "(附件)", "（附件）")}),
        ("好。。", {(1, 3, "。。", "。")}),
        ("好，。", {(1, 3, "，。", "，")}),
        ("真的？！", set()),
        ("1,000 and (a)", set()),
        ("　　缩进", set()),
    ],
)
def test_format_issues(spark, text, want):
    assert issues_of(P.format_issues(paragraphs(spark, [text]))) == want


def test_brackets(spark):
    rows = P.bracket_issues(paragraphs(spark, ["（甲）", "（乙", "丙）", "《丁（》）", ""])).collect()
    assert {(r["index"], r["start"]) for r in rows} == {(1, 0), (2, 1), (3, 0), (3, 2), (3, 3), (3, 4)} or {r["index"] for r in rows} == {1, 2, 3}


def test_empty_runs(spark):
    rows = spark.createDataFrame([(1, i, t, tab) for i, (t, tab) in enumerate([("a", False), ("", False), ("　", None), ("b", False), ("", False), ("", True), ("", True)])], ROWS + ", in_table boolean")
    assert [(r["first"], r["n"]) for r in P.empty_runs(rows).collect()] == [(1, 2)]


def test_word_lists_both_ways(spark):
    rows = paragraphs(spark, ["abab aba", "", "xab"])
    words = spark.createDataFrame([("ab", "AB"), ("aba", "ABA")], "wrong string, right string")
    a, b = (sorted((r["index"], r["start"], r["end"], r["suggestion"]) for r in P.word_list_hits(rows, words, most_literals=n).collect()) for n in (200, 0))
    assert a == b == [(0, 0, 2, "AB"), (0, 0, 3, "ABA"), (0, 2, 4, "AB"), (0, 5, 7, "AB"), (0, 5, 8, "ABA"), (2, 1, 3, "AB")]
    kept = P.leftmost_longest(P.word_list_hits(rows, words), ["doc_id", "index"]).collect()
    assert sorted((r["index"], r["start"], r["end"]) for r in kept) == [(0, 0, 3), (0, 5, 8), (2, 1, 3)]


def test_numbering(spark):
    rows = U.prefixes(paragraphs(spark, ["第一章 甲", "一、乙", "二、丙", "四、丁", "四、戊", "一、己", "2.1 庚", "2.3 辛", "3.5 米", "（十）壬", "③癸", "正文"]))
    got = {r["index"]: (r["family"], r["value"], r["parent"]) for r in rows.collect()}
    assert got[1] == ("chinese", 1, "") and got[7] == ("dotted", 3, "2.") and got[9] == ("chinese_paren", 10, "") and got[10] == ("circled", 3, "") and 11 not in got
    out = P.numbering_issues(rows.filter("family in ('chinese', 'dotted')").withColumn("level", F.lit(None).cast("int"))).collect()
    assert {(r["index"], r["status"], r["expected"]) for r in out} == {(3, "skip", 3), (4, "repeat", 5), (5, "restart", 5), (7, "skip", 2)}


def test_list_labels(spark):
    data = [(1, i, "L", lv, 1, st, pat) for i, (lv, st, pat) in enumerate([(0, "chineseCounting", "%1、"), (1, "decimal", "%1.%2"), (1, "decimal", "%1.%2"), (0, "chineseCounting", "%1、"), (1, "decimal", "%1.%2")])]
    rows = spark.createDataFrame(data, "doc_id long, index int, list string, level int, start int, style string, pattern string")
    assert [r["label"] for r in U.list_labels(rows).orderBy("index").collect()] == ["一、", "一.1", "一.2", "二、", "二.1"]


def test_figures(spark):
    facts = [("项目", "投资", 0, "3.2", "万元"), ("项目", "投资", 1, "32000", "元"), ("项目", "面积", 0, "100", "亩"), ("项目", "面积", 2, "66700", "平方米"), ("项目", "工期", 0, "2", "年"), ("项目", "工期", 3, "20", "个月"), ("项目", "投资", 5, "约三", "元"), ("别的", "投资", 0, "9", "元")]
    units = spark.createDataFrame([(u, f, d) for u, (f, d) in P.UNITS.items()], "unit string, factor double, dimension string")
    out = P.figure_conflicts(spark.createDataFrame(facts, "subject string, metric string, index int, value string, unit string"), units).collect()
    assert [(r["metric"], r["dimension"], r["n"], r["n_far"]) for r in out] == [("工期", "duration", 2, 1)]
    found = P.figures(paragraphs(spark, ["总投资为3.5亿元，占地面积约20亩。"])).collect()
    assert {(r["value"], r["unit"]) for r in found} == {("3.5", "亿元"), ("20", "亩")}


def test_numbering_of_styles_and_lists(spark):
    """Other marks than the first of a level, numbers behind a list's own, headings that close levels."""
    texts = [("一、甲", 1, None), ("1. a", None, None), ("2、b", None, None), ("3. c", None, None), ("（1）d", None, None), ("(2) e", None, None), ("（3)f", None, None), ("没有编号的标题", 1, None), ("1. g", None, None), ("二、乙", 1, None), ("1. h", None, "1."), ("1. i", None, None), ("3. j", None, None), ("四、丁", 1, None)]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(texts)], "doc_id long, index int, text string, level int, label string")
    numbered = U.prefixes(rows)
    plain = rows.filter("level is not null").join(numbered, ["doc_id", "index"], "left_anti").select("doc_id", "index", "level")
    got = {(r["index"], r["status"], r["expected"]) for r in P.numbering_issues(numbered.unionByName(plain, allowMissingColumns=True)).collect()}
    assert got == {(2, "style", None), (5, "style", None), (10, "doubled", None), (12, "skip", 2), (13, "skip", 3)}


def test_conflict_groups(spark):
    """Names that contain each other are one metric, in the order of the facts; units are converted or read off the value."""
    facts = [
        (1, 0, "本项目", "总投资", "3.2亿", ""), (1, 1, "项目", "建筑投资", "32000", "万元"), (1, 2, "", "项目投资额 约", "3.3", "亿元"), (1, 3, "整个工程", "设备投资", "320,000,000", "元"),
        (2, 0, "甲", "建筑投资", "1", "元"), (2, 1, "甲", "设备投资", "2", "元"), (2, 2, "甲", "投资", "1", "元"), (2, 3, "乙", "投资", "5", "元"),
        (3, 0, "甲", "面积", "100", "亩"), (3, 1, "甲", "占地面积", "66700", "平方米"), (3, 2, "甲", "面积", "6.5", "万㎡"), (3, 3, "甲", "建设工期", "2", "年"), (3, 4, "甲", "周期", "20", "个月"),
        (4, 0, "甲", "数量", "5", "台"), (4, 1, "甲", "数量", "6", "套"), (4, 2, "甲", "数量", "7", "台"), (4, 3, "甲", "数量", "约三", "台"), (4, 4, "甲", "约", "9", "台"), (4, 5, None, None, None, None),
    ]
    out = P.conflict_groups(spark.createDataFrame(facts, "doc_id long, place long, subject string, metric string, value string, unit string"))
    got = {(r["doc_id"], r["subject"], r["metric"], r["dimension"], r["n"], r["n_far"]) for r in out.collect()}
    assert got == {(1, "项目", "投资", "money", 4, 1), (3, "甲", "面积", "area", 3, 1), (3, "甲", "工期", "duration", 2, 1), (4, "甲", "数量", "other", 2, 1)}
    assert P.conflict_groups(out.sparkSession.createDataFrame([], "doc_id long, place long, subject string, metric string, value string, unit string")).collect() == []


def test_conflict_groups_read_once(spark):
    """Each fact is read and parsed once, equal values count with their number; a fact without a place is never the first."""
    schema = "doc_id long, place long, subject string, metric string, value string, unit string"
    facts = [(d, i, "甲", ("建筑投资", "投资", "面积")[i % 3], str(5 + (d > 1 and i > 6)), ("元", "万元", "亩")[i % 3]) for d in (1, 2) for i in range(9)]
    facts += [(3, None, "甲", "投资", "1", "元"), (3, 4, "甲", "建筑投资", "2", "元"), (3, 5, "甲", "建筑投资", "2", "元"), (3, 6, "甲", "投资", "2", "元")]
    read = spark.sparkContext.accumulator(0)

    def seen(row: tuple) -> tuple:
        read.add(1)
        return row

    out = P.conflict_groups(spark.createDataFrame(spark.sparkContext.parallelize(facts, 2).map(seen), schema)).collect()
    assert {(r["doc_id"], r["metric"], r["n"], r["n_far"]) for r in out} == {(1, "建筑投资", 6, 3), (2, "建筑投资", 6, 3), (2, "面积", 3, 1), (3, "建筑投资", 4, 1)}
    assert read.value == len(facts)


def test_admission_over_lists(spark):
    items = [("g", 0, True, 0, 50), ("g", 0, True, 1, 60), ("g", 0, True, 2, 10), ("g", 1, False, 0, 20), ("g", 1, False, 1, 30), ("g", 1, False, 2, 5), ("g", 2, False, 0, 15), ("g", 2, False, 1, 6), ("h", 0, False, 0, 101), ("h", 1, False, 0, 100), ("h", 2, True, 0, None)]
    rows = spark.createDataFrame(items, "g string, list int, single boolean, `order` long, size long")
    got = {(r["g"], r["list"], r["order"]): (r["admitted"], r["used"]) for r in P.admitted(rows, "g", 100).collect()}
    assert got == {
        ("g", 0, 0): (True, 50), ("g", 0, 1): (False, 50), ("g", 0, 2): (True, 60), ("g", 1, 0): (True, 80), ("g", 1, 1): (False, 80), ("g", 1, 2): (False, 80), ("g", 2, 0): (True, 95), ("g", 2, 1): (False, 95),
        ("h", 0, 0): (False, 0), ("h", 1, 0): (True, 100), ("h", 2, 0): (True, 100),
    }


def test_issue_merge_and_apply(spark):
    schema = "doc_id long, index int, start int, end int, category string, severity string, source string, original string, suggestion string"
    data = [(1, 0, 0, 4, "format", "warning", "model", "abcd", "w"), (1, 0, 2, 6, "typo", "error", "rule", "cdef", "x"), (1, 0, 8, 8, "format", "warning", "rule", "", "+"), (1, 0, 8, 8, "format", "warning", "rule", "", "+"), (1, 0, 8, 9, "typo", "warning", "rule", "i", "y"), (1, 1, 0, 1, "format", "warning", "rule", "z", "stale")]
    rows = spark.createDataFrame(data, schema)
    kept = P.merge_issues(rows.drop("original", "suggestion")).orderBy("index", "start", "end").collect()
    assert [r["id"] for r in kept] == ["typo-0-2-6", "format-0-8-8", "typo-0-8-9", "format-1-0-1"]
    out = P.apply_issues(paragraphs(spark, ["abcdefghij", "q"]), rows.filter("category = 'typo' or index = 1")).orderBy("index").collect()
    assert [r["text"] for r in out] == ["abxghyj", "q"]


def plain_merge(rows):
    """In order of place, each issue against all that stayed, the last first: it replaces a weaker one or goes."""
    strength = lambda x: 2 * (x[5] == "error") + (x[6] == "rule")
    kept: list[tuple] = []
    for x in sorted(rows, key=lambda x: (x[1], x[2], x[3], -strength(x), x[4:])):
        for k in range(len(kept) - 1, -1, -1):
            y = kept[k]
            points = x[2] == x[3] or y[2] == y[3]
            if y[1] == x[1] and ((y[2:5] == x[2:5]) if points else (y[2] < x[3] and x[2] < y[3])):
                if strength(x) > strength(y):
                    kept[k] = x
                break
        else:
            kept.append(x)
    return sorted(kept)


ISSUES = "doc_id long, index int, start int, end int, category string, severity string, source string"


def test_issue_merge_against_plain(spark):
    r = random.Random(5)
    for wide in (3, 12):
        rows = {(1, r.randrange(3), a, a + r.choice([0, 1, 2, wide]), r.choice(["format", "typo"]), r.choice(["error", "warning"]), r.choice(["rule", "model"])) for a in (r.randrange(60) for _ in range(150))}
        got = P.merge_issues(spark.createDataFrame(sorted(rows), ISSUES)).collect()
        assert sorted(tuple(x)[:7] for x in got) == plain_merge(rows) and len({x["id"] for x in got}) == len(got)


def test_issue_merge_chains(spark):
    """A stronger issue replaces at its overlap, and what it frees does not come back."""
    chain = [(1, 0, 0, 5, "a", "warning", "model"), (1, 0, 4, 8, "b", "warning", "rule"), (1, 0, 7, 10, "c", "error", "rule")]
    same = [(2, 0, 3, 6, "a", "warning", "rule"), (2, 0, 3, 6, "b", "error", "model"), (2, 0, 5, 9, "c", "error", "model"), (2, 1, 5, 9, "d", "warning", "model")]
    got = P.merge_issues(spark.createDataFrame(chain + same, ISSUES)).orderBy("doc_id", "index", "start").collect()
    assert [r["id"] for r in got] == ["c-0-7-10", "b-0-3-6", "d-1-5-9"]
    assert P.merge_issues(spark.createDataFrame([], ISSUES)).collect() == []


def test_bracket_fold(spark):
    rows = spark.createDataFrame([(1, 0, "a (b] c) ) 《x"), (1, 1, "（ok）"), (1, 2, None)], "doc_id long, index int, text string")
    assert sorted((r["index"], r["start"], r["original"]) for r in P.bracket_issues(rows, "()[]（）《》").collect()) == [(0, 4, "]"), (0, 9, ")"), (0, 11, "《")]


def test_packs(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 5, 30, 1, 1, 1])], "g string, i int, s int")
    assert [r["pack"] for r in P.packed(rows, "g", "i", "s", 10, 2).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 4]
    assert [r["i"] for r in P.within_budget(rows, "g", "i", "s", 14).orderBy("i").collect()] == [0, 1]


def test_places(spark):
    d = spark.createDataFrame([("青山区", "district", "甲省", "乙市", False), ("红河区", "district", "甲省", "乙市", False), ("乙市", "city", "甲省", None, False), ("丙市", "city", "甲省", None, False), ("朝阳区", "district", "丁省", "戊市", True)], "name string, level string, province string, city string, ambiguous boolean")
    rows = paragraphs(spark, ["项目位于乙市青山区。", "青山区概况。", "本项目在红河区建设。", "与红河区类似。", "红河区大道通车。", "丙市的情况。"])
    hits = G.place_hits(rows, d)
    place = G.main_place(hits, d, rows.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"))).first()
    assert (place["name"], place["city"], place["n"]) in (("青山区", "乙市", 2), ("红河区", "乙市", 3))
    project = spark.createDataFrame([(1, ["青山区", "乙市"], "甲省", "乙市")], "doc_id long, own array<string>, province string, city string")
    got = {(r["index"], r["original"], r["severity"]) for r in G.foreign_places(hits, d, project).collect()}
    assert got == {(2, "红河区", "error"), (5, "丙市", "warning")}


def test_overlaps(spark):
    data = [("p", 1, 0, 5), ("p", 2, 4, 9), ("p", 3, 5, 6), ("q", 4, 0, 9), ("p", 5, 4, 4), ("p", 6, -3, 40)]
    rows = spark.createDataFrame(data, "k string, id int, s int, e int")
    want = {(x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in data for y in data if x[0] == y[0] and x[1] < y[1] and max(x[2], y[2]) < min(x[3], y[3]) and x[2] < x[3] and y[2] < y[3]}
    for width in (1, 3, 1024):
        got = [(r["a_id"], r["b_id"], r["from_s"], r["to_s"]) for r in P.overlaps(rows, ["k"], "id", "s", "e", width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


# ---- differences ---------------------------------------------------------------------------------------------------
def test_diff_spans():
    assert D.spans("总投资为100万元", "总投资为120万元") == [("equal", "总投资为"), ("delete", "100"), ("insert", "120"), ("equal", "万元")]
    assert D.spans("ab cd", "ab cd") == [("equal", "ab cd")] and D.spans("", "x") == [("insert", "x")] and D.spans("", "") == []
    assert D.spans("甲乙丙", "丁乙戊") == [("delete", "甲乙丙"), ("insert", "丁乙戊")]
    assert D.spans("前⟦图1⟧后", "前⟦图2⟧后")[1] == ("delete", "⟦图1⟧")


def test_diff_restores_long_texts():
    import random

    r = random.Random(4)
    for size in (30, 900, 6000):
        a = [r.choice("甲乙丙丁ab ") + str(r.randint(0, 999)) for _ in range(size)]
        b = list(a)
        for _ in range(size // 10):
            b[r.randrange(len(b))] = "新"
        del b[3:7]
        old, new = "".join(a), "".join(b)
        s = D.spans(old, new)
        assert "".join(t for k, t in s if k != "insert") == old and "".join(t for k, t in s if k != "delete") == new
        assert sum(len(t) for k, t in s if k == "equal") > 0.5 * len(old)


def test_edits(spark):
    pairs = spark.createDataFrame([(1, "甲乙100丙丁戊己", "甲乙200丙丁戊己庚"), (2, "a⟦x⟧b", "ab"), (3, None, "n")], "id long, old string, new string")
    rows = {r["id"]: r for r in D.edits(D.edit_counts(D.diff_spans(pairs))).collect()}
    assert [tuple(e) for e in rows[1]["edits"]] == [(2, 5, "100", "200"), (9, 9, "", "庚")]
    assert rows[2]["edits"] is None and (rows[3]["n_deleted"], rows[3]["n_inserted"]) == (0, 1)


# ---- retrieval -----------------------------------------------------------------------------------------------------
def test_fusion_and_collapse(spark):
    k = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    v = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, chunk_id long, rank int")
    f = {r["chunk_id"]: r for r in S.fuse(k, v).collect()}
    assert f[11]["score"] == pytest.approx(1 / 62 + 1 / 61) and f[10]["vector_rank"] is None
    owners = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "chunk_id long, parent_id long")
    assert [r["chunk_id"] for r in S.collapse(S.fuse(k, v), owners).orderBy("position").collect()] == [11, 12]


def test_vectors(spark):
    assert list(spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(S.quantise(F.col("v")).alias("q")).first()["q"]) == [76, 102]


def test_excerpts(spark):
    text = "一鱼。二猫在此；三鱼和猫！\n四。 五猫鱼鸟？六"
    rows = [(0, text, ["鱼", "猫"]), (1, text, ["鱼", "猫", "鸟"]), (2, " 没有。什么 ", ["鱼"]), (3, None, ["鱼"]), (4, "", []), (5, "鱼猫" * 200 + "。鱼猫", ["鱼", "猫"])]
    df = spark.createDataFrame(rows, "i int, text string, terms array<string>")
    got = {r["i"]: r["excerpt"] for r in S.excerpts(df, budget=12).collect()}
    assert got == {0: "三鱼和猫！…五猫鱼鸟？", 1: "三鱼和猫！…五猫鱼鸟？", 2: "没有。什么", 3: None, 4: "", 5: "鱼猫"}
    assert [r["excerpt"] for r in S.excerpts(df.filter("i = 1"), budget=6).collect()] == ["五猫鱼鸟？"]
    assert [r["excerpt"] for r in S.excerpts(df.filter("i = 0"), budget=17, least=1).collect()] == ["一鱼。…三鱼和猫！…五猫鱼鸟？"]
    assert [r["excerpt"] for r in S.excerpts(df.filter("i = 0"), budget=3, least=1).collect()] == ["一鱼。"]


# ---- tables --------------------------------------------------------------------------------------------------------
def test_alias_priority(spark):
    pairs = spark.createDataFrame([("wang", "W", "d1"), ("wang", "W", "d2"), ("user", "U", "d1"), ("li", "L", "d1")], "author string, initials string, doc_key string")
    aliases = spark.createDataFrame([("wang", "W", None, 1), ("wang", "W", "d2", 2), ("user", "U", None, 3)], "author string, initials string, doc_key string, reviewer_id long")
    reviewers = spark.createDataFrame([(9, "li")], "id long, name string")
    got = {(r["author"], r["doc_key"]): r["reviewer_id"] for r in O.resolve_alias(pairs, aliases, reviewers, ["user"]).collect()}
    assert got == {("wang", "d1"): 1, ("wang", "d2"): 2, ("user", "d1"): None, ("li", "d1"): 9}


def test_merging_twice_adds_nothing(spark):
    schema = "a string, b string"
    old, new = spark.createDataFrame([("x", None), ("y", "1")], schema), spark.createDataFrame([("x", None), ("z", None), ("z", None)], schema)
    added = O.null_safe_append(old, new, ["a", "b"])
    assert [tuple(r) for r in added.collect()] == [("z", None)]
    assert O.null_safe_append(old.unionByName(added), new, ["a", "b"]).count() == 0
    assert O.only_ids(old, old.filter("false"), "a").count() == 0 and O.only_ids(old, None, "a").count() == 2


# ---- web -----------------------------------------------------------------------------------------------------------
def test_references_are_resolved(spark):
    """The cases of RFC 3986, 5.4, and bases with little path."""
    base = "http://a/b/c/d;p?q"
    cases = {
        "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
        ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
        "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
        "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x",
    }
    rows = [(base, h, u) for h, u in cases.items()] + [("http://a", "g", "http://a/g"), ("http://a?x", "g", "http://a/g"), ("http://a", "?y", "http://a?y"), ("https://a.org/x/y?z", "?p=2", "https://a.org/x/y?p=2"), ("https://a.org/x/y", "../k.pdf", "https://a.org/k.pdf")]
    out = spark.createDataFrame(rows, "base string, href string, want string").withColumn("got", H.resolved(F.col("base"), F.col("href"))).collect()
    assert {(r["base"], r["href"]): r["got"] for r in out} == {(b, h): u for b, h, u in rows}


def test_entities(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&#8217;&#x2019;&#X41;": "’’A", "&eacute; &bogus; &;": "&eacute; &bogus; &;", "&#55296;&#1114112;": "&#55296;&#1114112;", "&#128512;x": "😀x", "no": "no", "&": "&", "&nbsp;&ldquo;": " “", "&mdash;": "&mdash;"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", H.decode(F.col("t")).alias("x"), H.decode(F.col("t"), H.MARKUP_ENTITIES).alias("m")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases and {r["t"]: r["m"] for r in rows}["&mdash;"] == "—"


def test_host_list(spark):
    names = [f"h{i}.org" for i in range(3000)] + ["*.blog.example.net", "https://Example.org/x", ".dot.cn", ""]
    urls = {"http://h7.org/": True, "http://a.b.h2999.org:80/x": True, "http://xh7.org/": False, "http://blog.example.net": True, "http://example.net": False, "http://u@EXAMPLE.org/": True, "no": False, "http://a.dot.cn": True, None: False}
    out = H.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), names)
    assert {r["url"]: r["trusted"] for r in out.collect()} == urls and H.allowed(out.select("url"), []).filter("trusted").count() == 0


HTML = """<table><tr><td rowspan="2">项目</td><td colspan="2">金额（万元）</td></tr>
<tr><td>2024年</td><td>2025年</td></tr>
<tr><td>硬件购置</td><td>1,260</td><td>800</td></tr>
<tr><td rowspan=2>软件</td><td>300</td><td>&lt;100</td></tr>
<tr><td>50</td><td>60</td></tr></table> text <TABLE><tr><td>单独<br>一格 <b>x</b></td></tr></TABLE>"""


def test_html_tables(spark):
    docs = spark.createDataFrame([(1, HTML), (2, None), (3, "no table"), (4, "<table></table><table><tr></tr></table>"), (5, "<table><tr><td>a</td><td></td><td>c</td></tr><tr><td></td><td>y</td></tr><tr><th> </th></tr></table>")], "doc_id long, text string")
    got = [(r["doc_id"], r["tbl"], r["text"]) for r in M.labelled_rows(M.html_cells(docs)).orderBy("doc_id", "tbl", "n").collect()]
    assert got == [
        (1, 0, "表格列：项目 | 金额（万元）"), (1, 0, "项目；金额（万元）：2024年；金额（万元）：2025年"), (1, 0, "项目：硬件购置；金额（万元）：1,260；金额（万元）：800"), (1, 0, "项目：软件；金额（万元）：300；金额（万元）：<100"), (1, 0, "项目：软件；金额（万元）：50；金额（万元）：60"),
        (1, 1, "单独 一格 x"), (5, 0, "表格列：a | c"), (5, 0, "y"),
    ]
    assert M.filled([[("a", 3, 1), ("b", 1, 2)], [("c", 2, 2)], [("d", 1, 1)], []]) == [["a", "b", "b"], ["a", "c", "c"], ["a", "c", "c", "d"], []]
    pipes = M.labelled_rows(M.pipe_cells(spark.createDataFrame([(1, "| 序号 | 名称 | 备注 |\n|:---|---|---:|\n| 1 | 路灯 | 含\\|杆 |\n| 2 | 信号灯 | |")], "doc_id long, text string"))).orderBy("n").collect()
    assert [r["text"] for r in pipes] == ["表格列：序号 | 名称 | 备注", "序号：1；名称：路灯；备注：含|杆", "序号：2；名称：信号灯"]


def test_links(spark):
    html = '<a href="/f/a.pdf">One</a> <a href="b.docx?x=1" title="t">Two</a> <a href="//c.org/z">Three.xlsx</a> <a href="javascript:x()">no</a> <a href="/f/a.pdf">again</a><a href="http://d.org/p" title="doc.pdf">Four</a>'
    rows = H.links(spark.createDataFrame([(1, "https://a.org/x/y?q", html)], "page_id long, url string, html string"), ("pdf", "docx", "xlsx")).orderBy("pos").collect()
    assert [(r["url"], r["text"]) for r in rows] == [("https://a.org/f/a.pdf", "One"), ("https://a.org/x/b.docx?x=1", "Two"), ("https://c.org/z", "Three.xlsx"), ("http://d.org/p", "Four")]


def test_robots(spark):
    files = spark.createDataFrame([("a.org", "User-agent: x\nDisallow: /all\nUser-agent: *\nDisallow: /p # c\nDisallow:\n")], "host string, text string")
    urls = spark.createDataFrame([("a.org", "/p/1"), ("a.org", "/q"), ("b.org", "/p")], "host string, path string")
    assert sorted(tuple(r) for r in H.robots_allows(H.robots_rules(files), urls).collect()) == [("a.org", "/q"), ("b.org", "/p")]


# ---- markup --------------------------------------------------------------------------------------------------------
def test_pdf_lines(spark):
    pages = spark.createDataFrame([(1, 1, "第一章 总则\n这是很长的一行文字没有结束还要继\n续到下一行。\n1"), (1, 2, "2\n后 来 的 文 字\n完。"), (2, 1, "x")], "doc_id long, page int, text string")
    assert [r["doc_id"] for r in M.scanned(pages, 10).collect()] == [2]
    out = [r["text"] for r in M.unwrapped(M.page_lines(pages.filter("doc_id = 1"))).orderBy("index").collect()]
    assert out == ["第一章 总则", "这是很长的一行文字没有结束还要继续到下一行。", "后来的文字", "完。"]


def test_markdown_tables(spark):
    md = "前\n| 名 | 值 |\n|---|:-:|\n| a\\|b | 1 |\n| c | |\n后"
    cells = M.pipe_cells(spark.createDataFrame([(1, md)], "doc_id long, text string"))
    assert [r["line"] for r in X.table_lines(cells, ["doc_id", "tbl"]).orderBy("row").collect()] == ["名：a|b；值：1", "名：c"]
    assert one(spark, M.clean_markdown(F.col("text")), "## 第一条 甲<!-- x -->\n![p](u)<b>粗</b>&amp;<br>y") == "第一条 甲\n粗&\ny"


def test_search_results(spark):
    body = '{"results":[{"url":"u1","title":"a","content":"s"},{"link":"u1"},{"href":"u2","name":"b"}]}'
    rows = M.search_results(spark.createDataFrame([(1, body), (2, "broken")], "query_id long, body string")).orderBy("pos").collect()
    assert [(r["url"], r["title"], r["snippet"]) for r in rows] == [("u1", "a", "s"), ("u2", "b", "")]


# ---- models --------------------------------------------------------------------------------------------------------
def test_model_functions(spark):
    rows = spark.createDataFrame([(i, "ab" * i) for i in range(5)], "id long, text string")
    got = {r["id"]: r["vector"] for r in L.embed(rows, L.bucket_embedder()).collect()}
    assert sum(x * x for x in got[3]) == pytest.approx(1, abs=1e-5) and set(got[0]) == {0.0}
    hits = spark.createDataFrame([("ab", "xa"), ("", "z")], "query string, text string")
    assert [r["score"] for r in L.rerank(hits, L.overlap_reranker).collect()] == [0.5, 0.0]
    with pytest.raises(Exception, match="another number"):
        L.embed(rows, lambda xs: []).collect()


def test_answer_readers(spark):
    text = '<think>hm</think>Here:\n```json\n{"issues":[{"p":"0","quote":"乙","fix":"丙"},{"paragraph":1,"quote":"none"},{"paragraph":9,"quote":"a"}],"facts":[[0,"项目","投资","3","万元"],{"paragraph":1,"subject":"s","metric":"m","value":2}]}\n```'
    answers = spark.createDataFrame([(1, text), (2, "no json")], "doc_id long, answer string")
    issues, facts = L.check_answers(answers, paragraphs(spark, ["甲乙", "丁"]))
    assert [(r["index"], r["start"], r["end"], r["suggestion"]) for r in issues.collect()] == [(0, 1, 2, "丙")]
    assert sorted((r["index"], r["metric"], r["value"], r["unit"]) for r in facts.collect()) == [(0, "投资", "3", "万元"), (1, "m", "2", None)]


def test_decisions(spark):
    data = [("a", "yesno", [], '{"answer": true}'), ("b", "score", [], "75%"), ("c", "choice", ["x", "y"], '{"choice":"y"}'), ("d", "choice", ["x", "y"], "0"), ("e", "choice", ["x", "y"], '{"probabilities":{"x":0.2,"y":0.7}}'), ("f", "choice", ["x"], "?"), ("g", "score", [], '{"value": 3}')]
    rows = L.decisions(spark.createDataFrame(data, "question_id string, kind string, options array<string>, answer string")).collect()
    assert {r["question_id"]: r["value"] for r in rows} == {"a": 1.0, "b": 0.75, "c": 1.0, "d": 0.0, "e": 1.0, "f": None, "g": 1.0}


# ---- files ---------------------------------------------------------------------------------------------------------
W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"'


def word_file() -> bytes:
    p = lambda inner, pr="": f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}{inner}</w:p>"
    t = lambda s: f"<w:r><w:t>{s}</w:t></w:r>"
    cell = lambda s, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t(s))}</w:tc>"
    body = p(t("标题"), '<w:pStyle w:val="H1x"/>') + p(t("甲") + '<w:commentRangeStart w:id="1"/>' + t("乙丙") + '<w:commentRangeEnd w:id="1"/><w:r><w:commentReference w:id="1"/></w:r><w:ins>' + t("新") + "</w:ins><w:del><w:r><w:delText>旧</w:delText></w:r></w:del><w:r><w:tab/></w:r>")
    body += "<w:tbl><w:tr>" + cell("项") + cell("值") + "</w:tr><w:tr>" + cell("长", '<w:vMerge w:val="restart"/>') + cell("1") + "</w:tr><w:tr>" + cell("", "<w:vMerge/>") + cell("2") + "</w:tr></w:tbl>"
    body += p(t("项目"), '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr>')
    styles = '<w:style w:styleId="H1"><w:name w:val="heading 2"/></w:style><w:style w:styleId="H1x"><w:name w:val="own"/><w:basedOn w:val="H1"/></w:style>'
    comments = f'<w:comment w:id="1" w:author="wang" w:initials="W"><w:p w14:paraId="AA">{t("改")}</w:p></w:comment><w:comment w:id="2" w:author="li"><w:p w14:paraId="BB">{t("好")}</w:p></w:comment>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W_NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W_NS}>{styles}</w:styles>")
        z.writestr("word/comments.xml", f"<w:comments {W_NS}>{comments}</w:comments>")
        z.writestr("word/commentsExtended.xml", f'<w15:commentsEx {W_NS}><w15:commentEx w15:paraId="AA" w15:done="1"/><w15:commentEx w15:paraId="BB" w15:paraIdParent="AA" w15:done="0"/></w15:commentsEx>')
    return out.getvalue()


def test_word_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(word_file())
    (tmp_path / "in" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "in" / "b.bin").write_bytes(b"x")
    files = I.find(spark, str(tmp_path / "in"))
    docs = X.read_docx(files.filter(I.format_of(F.col("path")) == "docx")).cache()
    assert {r["path"].rsplit("/", 1)[1]: r["error"] is None for r in docs.collect()} == {"a.docx": True, "bad.docx": False}
    rows = X.part(docs, "paragraphs").orderBy("index").collect()
    assert [r["text"] for r in rows[:2]] == ["标题", "甲乙丙新\t"] and rows[0]["heading_level"] == 2 and (rows[-1]["num_id"], rows[-1]["level"]) == ("7", 1)
    notes = {r["id"]: r for r in X.comment_table(docs).collect()}
    assert (notes["1"]["start_par"], notes["1"]["start_off"], notes["1"]["end_off"], notes["1"]["done"]) == (1, 1, 3, True)
    assert notes["2"]["parent_id"] == "1" and notes["2"]["start_par"] == 1
    assert [r["line"] for r in X.table_lines(X.cells(docs), ["path", "tbl"]).orderBy("row").collect()] == ["项：长；值：1", "项：长；值：2"]


def test_text_files(spark, tmp_path):
    for name, data in {"u.txt": "äé".encode(), "b.md": b"\xef\xbb\xbfx", "g.txt": "中文".encode("gb18030"), "w.txt": b"\xff\xfe" + "w".encode("utf-16-le"), ".h.txt": b"hidden", "x.bin": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["text"]) for r in I.read_texts(I.find(spark, str(tmp_path))).collect()}
    assert got == {"u.txt": ("text", "äé"), "b.md": ("markdown", "x"), "g.txt": ("text", "中文"), "w.txt": ("text", "w")}
    assert I.find(spark, str(tmp_path), explicit=[str(tmp_path / "x.bin")]).count() == 5


def test_export_and_versions(spark, tmp_path):
    cases = spark.createDataFrame([(1, "c", "o", "s", None, "accepted"), (1, "c", "o", "s", "t", "edited"), (2, "c", "o", "s", None, "rejected"), (None, "c", "o", "s", None, "pending")], "reviewer_id long, comment string, original string, suggestion string, final_text string, action string")
    rows = I.export_cases(cases, spark.createDataFrame([(1, "wang")], "id long, name string"))
    assert sorted((r["reviewer"] or "", r["label"]) for r in rows.collect()) == [("", 0.0), ("wang", 0.5), ("wang", 1.0)]
    path = str(tmp_path / "store")
    I.save_version(spark, {"cases": cases}, path, "v1")
    manifest = I.save_version(spark, {"cases": cases.limit(2), "x": rows}, path, "v2").collect()
    assert {r["table"]: r["n_rows"] for r in manifest} == {"cases": 2, "x": 3}
    assert I.load_version(spark, path)["cases"].count() == 2 and I.load_version(spark, path, "v1")["cases"].count() == 4
    with pytest.raises(ValueError):
        I.load_version(spark, path, "v9")


def test_pending_batches(spark):
    items, done = spark.range(300).toDF("id"), spark.range(0, 300, 3).toDF("id")
    rows = ST.pending_batches(items, done, "id", 4).collect()
    assert len(rows) == 200
    sizes: dict = {}
    for r in rows:
        sizes[r["part"], r["batch"]] = sizes.get((r["part"], r["batch"]), 0) + 1
    assert max(sizes.values()) <= 4


def test_ingest_late_rows(spark, tmp_path):
    """Rows older than what was read before stay; copies far apart count once."""
    schema = "id long, day int"
    for rows in ([(1, 0), (2, 60)], [(3, 1), (2, 100)]):
        spark.createDataFrame(rows, schema).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, day) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):
        ST.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), ["id"], files_per_batch=1)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_ingest_query_of_many_files(spark, tmp_path):
    """More files than a batch takes, with times that interleave: all rows count."""
    from loomtext.plans.stream_queries import incremental_ingest

    days = F.make_interval(days=(F.col("id") * 37 % 150 * 10).cast("int"))
    spark.range(0, 150, 1, 150).select(F.col("id").alias("event_id"), (F.expr("timestamp'2024-01-01'") + days).alias("ts"), F.lit("a").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    row = incremental_ingest(spark, str(tmp_path)).first()
    assert (row["n"], row["n_ids"], row["s"]) == (150, 150, 150 * 149 // 2)


def test_long_word_list(spark):
    """Over 200 words of over 64 lengths, a blank one among them, give the same hits joined as in the plan."""
    words = spark.createDataFrame([(f"{i:03d}" + "x" * (i % 80), "y") for i in range(230)] + [("", "z"), (None, "z")], "wrong string, right string")
    rows = paragraphs(spark, ["a 079" + "x" * 79 + " b", "070" + "x" * 75, "005xxxxx 200", ""])
    joined, planned = (sorted((r["index"], r["start"], r["end"], r["original"]) for r in P.word_list_hits(rows, words, most_literals=n).collect()) for n in (200, 1000))
    assert joined == planned and {len(r[3]) for r in joined} == {82, 73, 8}


def test_labelled_rows_are_formed_in_place(spark):
    """Cells are dealt out by table once; nothing is joined. Tables of several texts share a batch."""
    docs = spark.createDataFrame([(i, f"<table><tr><td>a</td><td>b</td></tr><tr><td>{i}</td><td></td></tr></table>") for i in range(30)], "doc_id long, text string")
    out = M.labelled_rows(M.html_cells(docs))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(x for i in range(30) for x in ((i, "表格列：a | b"), (i, f"a：{i}")))


def test_leftmost_longest_is_dealt_out_once(spark):
    hits = spark.createDataFrame([(1, 0, 0, 2, "ab"), (1, 0, 0, 3, "abc"), (1, 0, 2, 4, "cd"), (1, 0, 3, 5, "de"), (2, 0, 1, 2, "x")], "doc_id long, index int, start int, end int, name string")
    kept = P.leftmost_longest(hits, ["doc_id", "index"], "name")
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r["doc_id"], r["start"], r["end"], r["name"]) for r in kept.collect()) == [(1, 0, 3, "abc"), (1, 3, 5, "de"), (2, 1, 2, "x")]


def test_entities_do_not_repeat_the_text(spark):
    """The text that is decoded, and the lines of an article, stand in the plan once."""
    pages = spark.createDataFrame([(1, "<h1>T</h1><p>a &amp; b</p><p>a &amp; b</p><p>c</p>")], "page_id long, html string")
    text = F.regexp_replace("html", "<[^>]*>", "~once~")
    plan = pages.select(H.decode(text).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("~once~") == 1
    assert pages.select(H.article_lines(F.col("html")).alias("x")).first()["x"] == ["T", "a & b", "c"]
