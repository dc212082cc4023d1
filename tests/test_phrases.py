"""Small text functions on literal inputs."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions import phrases as H
from loomtext.functions import terms as W


def one(spark, f, *values):
    names = "abc"[: len(values)]
    row = spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'int'}" for n, v in zip(names, values, strict=True)))
    return row.select(f(*map(F.col, names)).alias("x")).first()["x"]


def test_texts(spark):
    for f, cases in (
        (H.heading_text, {" 第 一 章 ": "第一章", "第一章 总 则": "第一章 总则", "一  般 规定：；": "一 般 规定", "x" * 61: "x" * 60 + "…", "": ""}),
        (H.book_marks, {"«办法»": "《办法》", "«x»": "«x»"}),
        (H.file_type, {"http://a/b/c.PDF?x=1": "pdf", "http://a.pdf/": None, "http://a/b.exe": None, "http://a/x.tar.md": "md"}),
        (H.named_type, {"附件：办法.pdf）": "pdf", "办法": None}),
        (H.names_document, {"下载附件": False, "建设项目管理办法下载": True, "PDF": False}),
        (H.without_label, {"[第12段] 正文": "正文", "[第x段] 正文": "[第x段] 正文"}),
        (W.without_accents, {"Crème brûlée ñ ß ø": "Creme brulee n ß ø", "Cre\u0300me Việt": "Creme Viet", "": ""}),
        (W.doc_numbers, {"根据国办发[2024]第012号和京政发（2023）5号，见财预【2022】1号": ["国办发〔2024〕12号", "京政发〔2023〕5号", "财预〔2022〕1号"], "〔2024〕12号": [], "按照〔2024〕3号": [], "国发〔1824〕1号": []}),
        (W.numeral, {"十": 10, "二十三": 23, "一百零五": 105, "一千二百": 1200, "二〇二四": 2024, "12": 12, "两百": 200, "十五": 15}),
    ):
        for text, want in cases.items():
            assert one(spark, f, text) == want, (f.__name__, text)


def test_spans(spark):
    assert tuple(one(spark, H.trim_span, "ab  cd  ", 2, 8)) == (4, 6) and one(spark, H.trim_span, "a   b", 1, 3) is None
    assert tuple(one(spark, H.sentence_bounds, "甲。乙丙丁；戊", 3)) == (2, 5) and tuple(one(spark, H.sentence_bounds, "abc", 1)) == (0, 3)
    assert one(spark, H.range_label, 3, 3) == "第3段" and one(spark, H.range_label, 3, 5) == "第3–5段"


def test_long_sentence_takes_linear_time(spark):
    """The search for the mark before an offset looks at each character once, behind a long sentence too."""
    text = F.concat(F.repeat(F.lit("a b "), 100_000), F.lit("。x"))
    began = time.monotonic()
    row = spark.range(1).select(H.sentence_bounds(text, F.lit(400_001)).alias("x")).first()["x"]
    assert tuple(row) == (400_001, 400_002) and time.monotonic() - began < 20


def test_terms_and_mentions(spark):
    assert one(spark, W.index_terms, "国办发〔2024〕12号，the Crème 第二十条")[:2] == ["国办发202412号", "第20条"]
    terms = one(spark, W.index_terms, "the Crème of 规划")
    assert "creme" in terms and "the" not in terms and "of" not in terms and "规划" in terms
    mentions = lambda text, *t: one(spark, lambda a: H.mentions(a, F.array(*map(F.lit, t))), text)
    assert mentions("生态环境", "环境影响") and not mentions("abxx", "abcd") and mentions("xabcdx", "abcd") and not mentions("环", "环境")


def test_gaps(spark):
    rows = spark.createDataFrame([(1, 0, "前文【待补充：面积】中间【待补充面积】和【待补充：由编制单位提供】"), (1, 1, "【待补充: 投资】后"), (2, 0, "没有"), (2, 1, "【待补充未完"), (3, 0, None)], "doc_id long, index int, text string")
    got = {(r["doc_id"], r["need"]): r["passage"] for r in H.gaps(rows, 2, 3).collect()}
    assert got == {(1, "面积"): "前文【待补充：面积】中间【", (1, "投资"): "【待补充: 投资】后"}


def test_rows(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], s) for i, s in enumerate([0.1, 0.2, None, 0.9])], "index int, category string, score double")
    assert {r["index"] for r in H.paragraph_range(rows, 2, 1).collect()} == {1, 2}
    assert H.in_categories(rows, []).count() == 4 and H.in_categories(rows, ["a"]).count() == 2
    assert {r["index"] for r in H.screened(rows).collect()} == {1, 2, 3}
    assert [(r["index"], r["place"]) for r in H.preferred_first(rows, ["category"], F.coalesce(F.col("score") > 0.5, F.lit(False)), ["index"], 1).orderBy("index").collect()] == [(0, 1), (3, 1)]
    assert [r["x"] for r in rows.orderBy("index").select(H.clamped(F.col("score"), 0.15, 0.5, 0.3).alias("x")).collect()] == [0.15, 0.2, 0.3, 0.5]
    s = one(spark, lambda a: H.settings(a, {"n": 3, "name": "x", "on": True}), '{"n": "bad", "on": false}')
    assert (s["n"], s["name"], s["on"]) == (3, "x", False)


def test_answers_by_index(spark):
    answers = spark.createDataFrame([("r", 1, [2.0]), ("r", 0, [1.0]), ("q", 0, [3.0])], "request string, index int, vector array<double>")
    wanted = spark.createDataFrame([("r", 2), ("q", 1)], "request string, n int")
    assert {r["request"]: r["vector"] for r in H.by_index(answers, wanted, size=1).collect()} == {"r": [[1.0], [2.0]], "q": [[3.0]]}
    for bad in (H.by_index(answers, wanted.withColumn("n", F.col("n") + 1)), H.by_index(answers, wanted, size=2)):
        with pytest.raises(Exception, match="do not fit"):
            bad.collect()
