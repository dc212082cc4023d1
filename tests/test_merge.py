"""Merging bases with new ids, and replacing all tables with a backup."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from loomtext.operators import merge as M
from loomtext.sources import files as I


def base(spark, docs, models, vectors):
    """docs: {id: (content, [chunks])}; one parent a document, with the document's id."""
    chunks = [(10 * d + k, d, d, c) for d, (_, cs) in docs.items() for k, c in enumerate(cs)]
    return {
        "documents": spark.createDataFrame([(d, sha, f"{d}.txt", "old", d % 2 == 0) for d, (sha, _) in docs.items()], "doc_id long, sha256 string, file_name string, stored_name string, meta_edited boolean"),
        "parents": spark.createDataFrame([(d, d) for d in docs], "parent_id long, doc_id long"),
        "chunks": spark.createDataFrame(chunks, "chunk_id long, doc_id long, parent_id long, text string"),
        "models": spark.createDataFrame(models, "model_id long, name string, dim int"),
        "embeddings": spark.createDataFrame(vectors, "chunk_id long, model_id long, vector array<double>"),
    }


def test_merge_with_new_ids(spark):
    ours = base(spark, {1: ("a", ["x"]), 5: ("b", ["y", "z"])}, [(1, "m", 2), (2, "k", 3)], [(10, 1, [1.0, 2.0])])
    theirs = base(spark, {1: ("c", ["p", "q"]), 2: ("a", ["x"]), 3: ("c", ["p", "q"]), 5: ("d", ["r"])}, [(1, "k", 4), (2, "m", 2), (7, "new", 1)], [(10, 2, [3.0, 4.0]), (11, 2, [3.0]), (10, 1, [1.0] * 4), (50, 7, [9.0]), (20, 2, [5.0, 6.0])])
    theirs["documents"] = theirs["documents"].withColumn("unknown", F.lit(1)).drop("meta_edited")
    theirs["chunks"] = theirs["chunks"].union(spark.createDataFrame([(99, 5, 77, "no parent")], theirs["chunks"].schema))
    merged, report = M.merged_bases(ours, theirs)
    docs = {r["doc_id"]: (r["sha256"], r["stored_name"], r["meta_edited"]) for r in merged["documents"].collect()}
    assert docs == {1: ("a", "old", False), 5: ("b", "old", False), 6: ("c", "6-1.txt", None), 7: ("d", "7-5.txt", None)}
    chunks = {r["chunk_id"]: (r["doc_id"], r["parent_id"], r["text"]) for r in merged["chunks"].collect()}
    assert chunks == {10: (1, 1, "x"), 50: (5, 5, "y"), 51: (5, 5, "z"), 52: (6, 6, "p"), 53: (6, 6, "q"), 54: (7, 7, "r")}
    assert {(r["parent_id"], r["doc_id"]) for r in merged["parents"].collect()} == {(1, 1), (5, 5), (6, 6), (7, 7)}
    assert {(r["model_id"], r["name"], r["dim"]) for r in merged["models"].collect()} == {(1, "m", 2), (2, "k", 3), (3, "new", 1)}
    assert sorted((r["chunk_id"], r["model_id"], r["vector"]) for r in merged["embeddings"].collect()) == [(10, 1, [1.0, 2.0]), (52, 1, [3.0, 4.0]), (54, 3, [9.0])]
    assert {(r["what"], r["name"]): r["n"] for r in report.collect()} == {("documents skipped", ""): 2, ("documents added", ""): 2, ("chunks added", ""): 3, ("embeddings added", ""): 2, ("model skipped", "k"): 1}
    again, nothing = M.merged_bases(merged, theirs)
    assert again["chunks"].count() == 6 and {r["what"]: r["n"] for r in nothing.collect() if not r["name"]} == {"documents skipped": 4, "documents added": 0, "chunks added": 0, "embeddings added": 0}


def test_replace_all(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/state"
    with pytest.raises(ValueError):
        I.read_current(spark, path)
    one, two = ({"a": spark.range(n), "b": spark.range(3)} for n in (5, 2))
    first = I.replace_all(spark, one, path)
    with pytest.raises(ValueError, match="no backup"):
        I.restore_backup(spark, path)
    second = I.replace_all(spark, two, path)
    assert I.current(spark, path) == (second, first) and I.read_current(spark, path)["a"].count() == 2
    fails = {"a": spark.range(1), "b": spark.range(3).select(F.raise_error(F.lit("lost")).alias("id"))}
    with pytest.raises(Exception, match="lost"):
        I.replace_all(spark, fails, path)
    assert I.current(spark, path) == (second, first)
    assert I.restore_backup(spark, path) == first and I.read_current(spark, path)["a"].count() == 5
    assert I.restore_backup(spark, path) == second
