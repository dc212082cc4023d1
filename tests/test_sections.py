"""The section check as a job, and readers of its answers."""

from __future__ import annotations

import json
import tempfile

import pytest

from loomtext.operators import models as L
from loomtext.operators import sections as C
from loomtext.operators import tables as O

ROWS = "doc_id long, index int, text string"


def answer(texts):
    return [json.dumps({"issues": [{"paragraph": int(line.split("段")[0][2:]), "quote": "错"} for line in t.split("\n") if "错" in line], "facts": [[0, "项目", "投资", "5", "元"]]}) if "拒答" not in t else None for t in texts]


def fails(texts):
    if any("停" in t for t in texts):
        raise RuntimeError("stopped")
    return answer(texts)


def never(texts):
    if texts:
        raise RuntimeError("asked again")
    return []


def test_job_is_resumed(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/answers"
    rows = spark.createDataFrame([(d, i, t) for d in range(6) for i, t in enumerate([f"第一段有错文{d}", "ab", f" 第一段有错文{d} ", "停" * 3 if d == 3 else "好好好", None])] + [(9, 0, "拒答拒答错"), (9, 1, "x")], ROWS)
    parts = C.sections(rows, 12)
    assert {r["text"] for r in parts.filter("doc_id = 1").collect()} == {"[第0段] 第一段有错文1\n[第3段] 好好好"} and parts.filter("doc_id = 9").count() == 1
    with pytest.raises(Exception, match="stopped"):
        C.check(rows, fails, path, 12)
    kept = C.stored_answers(spark, path).count()
    issues, facts = C.check(rows, answer, path, 12)
    assert sorted((r["doc_id"], r["index"], r["start"]) for r in issues.filter("doc_id < 6").collect()) == [(d, i, 4) for d in range(6) for i in (0, 2)]
    assert issues.filter("doc_id = 9").count() == 0 and facts.count() == 6
    n = C.stored_answers(spark, path).count()
    assert kept < n == 6
    known = rows.filter("doc_id < 6")
    assert C.check(known, never, path, 12)[0].count() == issues.count()
    assert C.check(rows.filter("false"), never, path)[0].collect() == []


def test_readers(spark):
    rows = [(1, 2, '```json\n{"groups": [{"id": 1, "conflict": true, "reason": "r"}, {"group": "2", "contradiction": "true"}, {"id": 3, "conflict": true}, {"id": 2, "conflict": false}]}\n```'), (2, 1, "no json"), (3, 1, '[{"id": 1, "conflict": true, "理由": "x"}]')]
    got = {(r["doc_id"], r["group"], r["reason"]) for r in L.confirmed_groups(spark.createDataFrame(rows, "doc_id long, n_groups int, answer string")).collect()}
    assert got == {(1, 0, "r"), (1, 1, ""), (3, 0, "x")}
    told = [("a", '{"status": "废止", "reason": "old", "replacement": {"title": "b"}}'), ("c", '{"状态": "Superseded", "replacement": {"name": "《d》", "no": "GB 1"}}'), ("e", '{"status": "?"}'), ("f", "{}"), ("g", None), ("h", '{"status": "replaced", "replacement": {"number": "GB 2"}}')]
    status = {r["title"]: tuple(r)[1:] for r in L.citation_statuses(spark.createDataFrame(told, "title string, answer string")).collect()}
    assert status == {"a": ("repealed", None, None, "old"), "c": ("superseded", "d", "GB 1", ""), "e": ("unknown", None, None, ""), "h": ("superseded", None, None, "")}


def test_precedence(spark):
    key = spark.createDataFrame([(i,) for i in range(4)], "k int")
    manual = spark.createDataFrame([(0, 5, None), (1, None, "m")], "k int, size int, mode string")
    fetched = spark.createDataFrame([(0, 6), (1, 7), (9, 9)], "k int, size int")
    built = spark.createDataFrame([(1, "b"), (2, "b")], "k int, mode string")
    out = O.by_precedence(key, {"manual": manual, "fetched": fetched, "built-in": built}, "k", {"size": 1, "mode": "d"})
    assert sorted(map(tuple, out.collect())) == [(0, 5, "d", "manual"), (1, 7, "m", "fetched"), (2, 1, "b", "default"), (3, 1, "d", "default")]


def test_sections_are_formed_once(spark):
    """The blocks of keys read stored sections: paragraphs are not taken up anew for each."""
    taken = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            taken.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(d, i, f"第{d}段第{i}句有错字。") for d in range(5) for i in range(4)], "doc_id long, index int, text string")
    issues, _ = C.check(rows.mapInPandas(count, rows.schema), lambda texts: ['{"issues": []}'] * len(texts), tempfile.mkdtemp(prefix="spark-"))
    assert issues.count() == 0 and taken.value <= 20 * 5
