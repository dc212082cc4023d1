"""Result pages, labelled facts, and lists that are cut with an explicit order."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from loomtext.operators import facts as A
from loomtext.operators import tables as O
from loomtext.operators import web as H


def code(text: bytes) -> str:
    return base64.urlsafe_b64encode(text).decode().rstrip("=")


def test_click_targets(spark):
    at = "https://www.bing.com/ck/a?!&&p=1&u=a1"
    cases = {at + code("https://ä.org/?x>y?".encode()) + "&n=1": "https://ä.org/?x>y?", at + code(b"http://b"): "http://b"}
    same = [at + code(b"ftp://b"), at + code(b"\xff\xfe\xfa"), at + "!", "https://www.bing.com/ck/b?u=a1" + code(b"http://b"), "https://notbing.com/ck/a?u=a1" + code(b"http://b"), "https://a.org", ""]
    rows = spark.createDataFrame([(h,) for h in [*cases, *same]], "h string").select("h", H.click_target(F.col("h")).alias("t")).collect()
    assert {r["h"]: r["t"] for r in rows} == cases | {h: h for h in same}


def test_result_links(spark):
    html = '<li class="b_algo"><h2><a href="http://a/?x&amp;y">A &lt;b</a></h2><p>s<br>t</p></li><li class="b_algo"><h2>no link</h2></li><div class="c-container" mu="http://m/"><h3><a href="http://r">R</a></h3></div><div class="x c-container y"><h3><a href="http://q">Q</a></h3><div class="c-abstract">z</div></div>'
    out = H.result_links(spark.createDataFrame([(1, html), (2, None), (3, "")], "query_id long, html string")).orderBy("pos").collect()
    assert [tuple(r) for r in out] == [(1, 0, "http://a/?x&y", "A <b", "st"), (1, 2, "http://m/", "R", ""), (1, 3, "http://q", "Q", "z")]


def test_first_facts(spark):
    texts = ["项目名称：  ", "工程名称： 甲桥。", "项目名称：乙桥", "总投资3,200.5万元，建设周期约为18个月，建设规模：两座桥。", "业主单位为丙局，场地地处丁镇。", None, "总投资为9元"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "没有")], "doc_id long, index int, text string")
    got = {r["fact"]: (r["value"], r["index"]) for r in A.labelled(rows).collect()}
    assert got == {"name": ("甲桥", 1), "investment": ("3,200.5万元", 3), "period": ("18个月", 3), "scale": ("两座桥", 3), "owner": ("丙局", 4), "place": ("丁镇", 4)}


def test_shown(spark):
    rows = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 1)], "g string, i int")
    assert sorted(map(tuple, O.shown(rows, ["g"], [F.desc("i")], 2).collect())) == [("g", 3, 2, 5), ("g", 4, 1, 5), ("h", 1, 1, 1)]
