"""Imports, search and review feedback on small literal tables."""

from __future__ import annotations


from loomtext.operators import knowledge as K
from loomtext.operators import models as L
from loomtext.operators import proofread as P
from loomtext.operators import review as R
from loomtext.operators import structure as C

CATALOG = "doc_id long, path string, sha256 string, parser string, file_name string, title string, doc_number string, issuer string, date string, meta_edited boolean"


def catalog(spark, rows):
    return spark.createDataFrame(rows, CATALOG)


def test_import_plan(spark):
    old = catalog(spark, [(1, "/a", "h1", "builtin", "a.txt", "A", None, None, None, True), (2, "/b", "h2", "ocr", "b.txt", "B", None, None, None, False)])
    files = spark.createDataFrame([("/a", "h1", "builtin"), ("/x", "h1", "ocr"), ("/b", "h9", "builtin"), ("/c", "h3", "builtin"), ("/d", "h3", "builtin"), ("/e", "h2", "builtin")], "path string, sha256 string, parser string")
    got = {r["path"]: (r["action"], r["doc_id"]) for r in K.plan_import(old, files).collect()}
    assert got["/a"] == ("unchanged", 1) and got["/x"] == ("replace", 1) and got["/b"] == ("replace", 2) and got["/e"] == ("unchanged", 2)
    assert got["/c"][0] == "new" and got["/d"] == ("copy", got["/c"][1])
    new = catalog(spark, [(1, "/a", "h7", "ocr", "a.txt", "New", "n", None, None, False), (2, "/b", "h9", "builtin", "b.txt", "New", None, None, None, False)])
    rows = {r["doc_id"]: r for r in K.replaced(old, new).collect()}
    assert (rows[1]["sha256"], rows[1]["title"], rows[1]["meta_edited"]) == ("h7", "A", True) and rows[2]["title"] == "New"
    same = {r["doc_id"]: (r["title"], r["meta_edited"]) for r in K.edited_metadata(old, spark.createDataFrame([(2, " T ", "", None, None)], "doc_id long, title string, doc_number string, issuer string, date string")).collect()}
    assert same == {1: ("A", True), 2: ("T", True)}
    poor = catalog(spark, [(1, "/a", "h", "b", "f", "某市人民政府文件", None, None, None, False), (2, "/b", "h", "b", "f", "0123456789abcdef01", None, None, None, True)])
    assert {r["doc_id"]: r["title"] for r in K.retitled(poor, spark.createDataFrame([(1, "好"), (2, "好")], "doc_id long, title string")).collect()} == {1: "好", 2: "0123456789abcdef01"}


def test_search_end_to_end(spark):
    texts = {1: "水资源管理办法\n第一条 加强水资源保护。\n第二条 节约用水。", 2: "大气污染防治\n治理大气污染。", 3: "cats and dogs\nwater for cats"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cat = catalog(spark, [(1, "/1", "a", "b", "one.txt", None, "某政发〔2020〕12号", None, None, False), (2, "/2", "b", "b", "two.txt", "大气", "某环发〔2021〕3号", None, None, False), (3, "/3", "c", "b", "three.md", None, None, None, None, False)])
    chunks = K.chunk_table(docs).cache()
    assert {r["text"] for r in chunks.collect()} >= {"cats and dogs\nwater for cats"}
    vectors = L.embed(chunks.select("chunk_id", "text"), L.bucket_embedder()).cache()
    asked = spark.createDataFrame([(1, "水资源"), (2, "cats"), (3, "污染，见某政发[2020]12号"), (4, "zzz")], "query_id long, text string")
    queries = L.embed(asked, L.bucket_embedder())
    plain = K.search(asked, chunks, cat).collect()
    top = {r["query_id"]: r for r in plain if r["position"] == 1}
    assert top[1]["doc_id"] == 1 and top[1]["title"] == "one" and top[2]["doc_id"] == 3 and 4 not in top
    assert top[3]["doc_id"] == 1
    both = K.search(queries, chunks, cat, vectors, limit=2).collect()
    assert all(r["position"] <= 2 for r in both) and {r["query_id"] for r in both} == {1, 2, 3, 4}
    assert len({(r["query_id"], r["doc_id"], r["parent_text"]) for r in both}) == len(both)
    none = K.search(queries, chunks, cat, vectors, only=cat.filter("false")).collect()
    assert none == []
    ranked = K.search(queries, chunks, cat, vectors, limit=2, reranker=L.overlap_reranker)
    assert {r["query_id"]: r["doc_id"] for r in ranked.filter("position = 1").collect()}[2] == 3
    cited = K.numbered_citations(ranked).collect()
    assert sorted(r["n"] for r in cited if r["query_id"] == 2) == list(range(1, 1 + sum(r["query_id"] == 2 for r in cited)))
    view = K.document_view(P.lines(docs), C.chunks(docs)).filter("doc_id = 1").orderBy("index").collect()
    assert [r["rank"] for r in view] == [None, 4, 4] and all(r["chunk_no"] is not None for r in view)


def test_review_tables(spark):
    cases = spark.createDataFrame([(1, 7, "s", None, "pending", 5), (2, 7, "s", None, "pending", 6), (3, 8, "s", None, "pending", 7), (4, 8, "s", None, "pending", 8)], "id long, reviewer_id long, suggestion string, final_text string, action string, updated_at long")
    done = R.outcomes(cases, spark.createDataFrame([(1, "s", False), (2, "t", False), (3, None, True)], "id long, final_text string, rejected boolean"))
    assert {r["id"]: (r["action"], r["final_text"]) for r in done.collect()} == {1: ("accepted", "s"), 2: ("edited", "t"), 3: ("rejected", None), 4: ("pending", None)}
    due = R.due_profiles(done, spark.createDataFrame([(7, 6), (8, 9)], "reviewer_id long, created_at long"), 1)
    assert [tuple(r) for r in due.collect()] == [(7, 1)]
    schema = "author string, initials string, doc_key string, reviewer_id long"
    aliases = R.assigned(spark.createDataFrame([("a", "", None, 1)], schema), spark.createDataFrame([("a", "A", "d", 2), ("user", "U", "d", 3)], schema), ["user"])
    assert {tuple(r) for r in aliases.collect()} == {("a", "", None, 2), ("a", "A", None, 2), ("user", "U", "d", 3), ("user", "", "d", 3)}
    kept, moved = R.merged_reviewers(aliases, cases, 7, 8)
    assert {r["reviewer_id"] for r in moved.collect()} == {8} and kept.count() == 4
    old = spark.createDataFrame([("m1", "f", "mine"), ("m2", "f", None), ("m3", "f", "own")], "k string, v string, manual string")
    new = R.refreshed(old, spark.createDataFrame([("m1", "g"), ("m4", "g")], "k string, v string"), "k", "manual")
    assert {tuple(r) for r in new.collect()} == {("m1", "g", "mine"), ("m4", "g", None), ("m3", "f", "own")}


def test_paragraph_context(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["甲", "", "乙", "甲 ", "丙", "丁"])], "doc_id long, index int, text string")
    firsts = R.first_copies(rows)
    assert {r["index"]: r["first"] for r in firsts.collect()}[3] == 0
    issues = spark.createDataFrame([(1, 0, "x"), (1, 2, "y")], "doc_id long, index int, note string")
    assert sorted(tuple(r) for r in R.shared_findings(issues, firsts).collect()) == [(1, 0, "x"), (1, 2, "y"), (1, 3, "x")]
    near = {r["index"]: (r["before"], r["after"]) for r in R.neighbours(rows).collect()}
    assert near[3] == (["甲", "乙"], ["丙", "丁"]) and 1 not in near
    found = spark.createDataFrame([(1, 3, "甲"), (1, 4, "“丙 ”"), (1, 5, "甲"), (1, 5, "")], "doc_id long, index int, quote string")
    assert R.quoted(found, rows).count() == 1 and R.quoted(found, rows, exact=False).count() == 2
    runs = spark.createDataFrame([("p", 0, 0, 3, "abc"), ("p", 0, 3, 6, "def")], "path string, paragraph int, start int, end int, text string")
    marks = spark.createDataFrame([("p", "1", 0, 2, 5)], "path string, id string, paragraph int, start int, end int")
    assert [(r["start"], r["end"], r["text"]) for r in R.quotes_of_runs(marks, runs).orderBy("start").collect()] == [(2, 3, "c"), (3, 5, "de")]
