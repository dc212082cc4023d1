"""Citations: forms of numbers, kinds, pairs of titles and numbers, the union, and issues of what is out of force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomtext.operators import citations as C

ROWS = "doc_id long, index int, text string, title string"


def rows(spark, *texts, doc=1):
    return spark.createDataFrame([(doc, i, t, "x") for i, t in enumerate(texts)], ROWS)


def found(df):
    return [(r["title"], r["kind"], r["standard_no"], r["doc_no"], r["paragraphs"]) for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["no"]))]


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("执行GB/T 50378-2019标准", ["GB/T 50378-2019"]), ("按照GB 50016—2014（2018年版）", ["GB 50016-2014"]), ("《室外排水设计标准》GB50014-2021", ["GB 50014-2021"]), ("DG/TJ 08-2012-2018及DB31/T 1234-2020", ["DG/TJ08-2012-2018", "DB31/T 1234-2020"]),
        ("ＧＢ／Ｔ ５０３７８－２０１９", ["GB/T 50378-2019"]), ("JGJ/T 98-2010、CJJ 1-2008、HJ 2.2-2018", ["JGJ/T 98-2010", "CJJ 1-2008", "HJ 2.2-2018"]), ("T/CECS 123-2020", ["T/CECS 123-2020"]), ("配置32GB 内存、128GB 硬盘", []), ("8GB 128", []), ("", []),
    ],
)
def test_standards(spark, text, numbers):
    got = spark.createDataFrame([(C.normalize(F.col("t")) is not None, text)], "x boolean, t string").withColumn("_n", C.normalize(F.col("t"))).select(C.spans("_n")[1].alias("s")).first()["s"]
    assert [x["value"] for x in got] == numbers


def test_kinds(spark):
    cases = [("中华人民共和国水法", None, None, "law"), ("排水与污水处理条例", None, None, "law"), ("招标投标管理办法", None, None, "law"), ("关于加强管理的若干规定", None, "n", "policy"), ("关于加强管理的若干规定", None, None, "law"), ("室外排水设计标准", None, None, "standard"), ("污染物排放", "s", None, "standard"), ("城市总体规划（2017—2035年）", None, None, "policy"), ("世界级生态岛发展", None, None, "unknown"), ("发展", None, "n", "policy")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, s string, d string")
    assert [r["k"] for r in df.orderBy("i").select(C.kind(F.col("t"), F.col("s"), F.col("d")).alias("k")).collect()] == [c[3] for c in cases]


def test_extracted_and_merged(spark):
    texts = [
        "依据《中华人民共和国水污染防治法》和《室外排水设计标准》（GB 50014-2021）。",
        "管网设计执行《室外排水设计标准》GB 50014-2021，并参照DG/TJ 08-2012-2018。",
        "根据《关于加快污水处理设施建设的通知》（沪府办发〔2023〕5号）要求。",
        "同时满足GB 50014-2021和沪府办发[2023]第5号的规定。",
        None,
        "没有引用。",
    ]
    assert found(C.citations(rows(spark, *texts))) == [
        ("中华人民共和国水污染防治法", "law", None, None, [0]),
        ("室外排水设计标准", "standard", "GB 50014-2021", None, [0, 1, 3]),
        ("关于加快污水处理设施建设的通知", "policy", None, "沪府办发〔2023〕5号", [2, 3]),
        ("DG/TJ08-2012-2018", "standard", "DG/TJ08-2012-2018", None, [1]),
    ]
    assert found(C.citations(rows(spark))) == []


def test_pairs_by_place(spark):
    """Inside, directly behind or before; further away, a number stands alone. Kinds are raised, documents are apart."""
    got = found(C.citations(rows(spark, "《水质 GB 3838-2002》《发展》", "国发〔2020〕1号《发展》", "《公报》，HJ 2.1-2016", "GB 1-2000 《指标》", "《公报》 （ GB 2-2001")))
    assert got == [
        ("水质 GB 3838-2002", "standard", "GB 3838-2002", None, [0]),
        ("发展", "policy", None, "国发〔2020〕1号", [0, 1]),
        ("公报", "unknown", None, None, [2, 4]),
        ("指标", "standard", "GB 1-2000", None, [3]),
        ("HJ 2.1-2016", "standard", "HJ 2.1-2016", None, [2]),
        ("GB 2-2001", "standard", "GB 2-2001", None, [4]),
    ]
    two = rows(spark, "《甲法》").union(rows(spark, "《甲法》", doc=2))
    assert found(C.citations(two)) == [("甲法", "law", None, None, [0])] * 2


def test_issues(spark):
    texts = ["执行《排水标准》（GB 5-2011）。", "满足ＧＢ 5—2011。", "按《旧办法》办理；旧办法已失效。", "旧办法", "《新法》"]
    df = rows(spark, *texts)
    status = spark.createDataFrame(
        [("排水标准", "superseded", "排水新标准", "GB 5-2021", ""), ("旧办法", "repealed", "别的", None, "2020年废止"), ("新法", "current", None, None, None), ("旧办法", "repealed", "别的", None, "2020年废止")],
        "title string, status string, replacement_title string, replacement_number string, reason string",
    )
    cited = C.citations(df).filter("title <> '旧办法'").union(spark.createDataFrame([(1, 9, "旧办法", "law", None, None, [2, 3, 77])], C.FOUND))
    got = sorted((r["index"], r["start"], r["end"], r["original"], r["suggestion"], r["severity"], r["reason"]) for r in C.status_issues(cited, status, df).collect())
    reason = "《排水标准》已有新版本，现行版本为《排水新标准》（GB 5-2021）"
    assert got == [
        (0, 9, 18, "GB 5-2011", "GB 5-2021", "warning", reason),
        (1, 2, 11, "ＧＢ 5—2011", "GB 5-2021", "warning", reason),
        (2, 1, 6, "《旧办法》", None, "error", "《旧办法》已废止。2020年废止"),
        (3, 0, 3, "旧办法", None, "error", "《旧办法》已废止。2020年废止"),
    ]
    title_only = spark.createDataFrame([("排水标准", "superseded", "排水新标准", None, None)], status.schema)
    assert {r["suggestion"] for r in C.status_issues(C.citations(rows(spark, "《排水标准》")), title_only, rows(spark, "《排水标准》")).collect()} == {"《排水新标准》"}
