"""The stored index: maintenance, look-ups, vectors, and the one rule of terms."""

from __future__ import annotations

import math
import os
import random
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import terms as X
from loomtext.operators import index as N
from loomtext.operators import knowledge as K
from loomtext.operators import search as S
from loomtext.operators.storage import dealt

CHUNKS = "chunk_id long, doc_id long, body string, head string, doc string, term string"


def new(spark, **more):
    return N.Index(spark, tempfile.mkdtemp(prefix="spark-") + "/index", **more)


def state(index):
    tables = {t: sorted(map(str, index.live(t).drop("q").collect())) for t in ("postings", "lengths", "vectors")}
    totals = index.read("totals").agg(F.sum("n").alias("n"), F.round(F.sum("len"), 6).alias("len")).first()
    return tables | {"frequencies": sorted(map(str, index.frequencies().collect())), "totals": tuple(totals)}


def rows(r, ids, n=2):
    words = ["alpha", "beta", "gamma", "Crème", "the", "第二条", "水资源"]
    return [(10 * i + k, i, " ".join(r.choices(words, k=r.randrange(0, 12))), r.choice(words), None, "x") for i in ids for k in range(n)]


def test_updates_equal_a_rebuild(spark):
    r = random.Random(1)
    texts = {i: rows(r, [i]) for i in range(30)}
    index = new(spark)
    vectors = lambda ids: spark.createDataFrame([(10 * i, i, "m", [float(i), 1.0, -2.0]) for i in ids], "chunk_id long, doc_id long, model string, vector array<double>")
    frame = lambda ids: spark.createDataFrame([x for i in ids for x in texts[i]], CHUNKS)
    assert index.batches() == [] and index.live("postings").count() == 0
    index.update(frame(range(25)), vectors(range(25)))
    texts |= {i: rows(r, [i], 3) for i in (3, 4, 29)}
    assert index.update(frame([3, 4, 29, *range(25, 29)]), vectors([3, 4, *range(25, 30)]), gone=spark.createDataFrame([(7,), (8,), (99,), (None,)], "doc_id long")) == 1
    texts[4] = [(40, 4, "", "", "", "x")]  # a document that loses all its terms
    index.update(frame([4]), vectors([4]))
    left = [i for i in range(30) if i not in (7, 8)]
    rebuilt = new(spark)
    rebuilt.update(frame(left), vectors(left))
    assert state(index) == state(rebuilt)
    packed = index.compacted(index.path + "-packed")
    assert packed.batches() == [0] and state(packed) == state(rebuilt)
    # only the changed documents were written
    assert {x["doc_id"] for x in index._batch("postings", 1).collect()} <= {3, 4, 25, 26, 27, 28, 29}


def test_failed_update_is_not_seen(spark):
    index = new(spark)
    index.update(spark.createDataFrame([(1, 1, "alpha", None, None, "x")], CHUNKS))
    before = state(index)
    second = spark.createDataFrame([(1, 1, "beta beta", None, None, "x")], CHUNKS)
    fails = second.withColumn("doc_id", F.when(F.rand() < 2, F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        index.update(fails)
    # a batch that is written but for its last table
    index._write(index._batch("postings", 0), "postings", 1)
    assert index.batches() == [0] and state(index) == before
    assert index.update(second) == 1
    assert [x["term"] for x in index.live("postings").collect()] == ["beta"] and {x["term"]: x["df"] for x in index.frequencies().collect()} == {"beta": 1}


def plain_bm25(texts, weights, query, k1=1.2, b=0.75):
    tf = {i: Counter() for i in texts}
    for i, fields in texts.items():
        for name, words in fields.items():
            for w in words:
                tf[i][w] += weights[name]
    tf = {i: c for i, c in tf.items() if c}
    size = {i: sum(c.values()) for i, c in tf.items()}
    average = sum(size.values()) / len(size)
    df = Counter(w for c in tf.values() for w in c)
    return {i: round(sum(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * size[i] / average)) for w in query if w in c), 9) for i, c in tf.items() if any(w in c for w in query)}


def test_scores(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(20)]
    texts = {i: {"body": r.choices(words, k=r.randrange(9)), "head": r.choices(words, k=r.randrange(3)), "doc": r.choices(words, k=2)} for i in range(40)} | {90: {"body": [], "head": [], "doc": []}}
    index = new(spark)
    index.update(spark.createDataFrame([(i, i, *(" ".join(f[k]) for k in ("body", "head", "doc")), "x") for i, f in texts.items()], CHUNKS))
    asked = {1: ["w1", "w2"], 2: ["w3"], 3: ["none"]}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    got = {(x["query_id"], x["chunk_id"]): x["score"] for x in index.keyword_scores(terms).collect()}
    assert got == pytest.approx({(q, i): s for q, ts in asked.items() for i, s in plain_bm25(texts, S.FIELD_WEIGHTS, ts).items()})
    only = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "chunk_id long")
    part = {(x["query_id"], x["chunk_id"]): x["score"] for x in index.keyword_scores(terms, only=only).collect()}
    assert part == {k: v for k, v in got.items() if k[1] % 3 == 0 and k[1] < 40}
    assert index.keyword_scores(terms, only=only.filter("false")).collect() == []
    assert new(spark).keyword_scores(terms).collect() == []


def test_vectors(spark, monkeypatch):
    """All blocks, ties by id, zero vectors; the codes are those of the column expression."""
    monkeypatch.setattr(N, "BLOCK", 7)
    r = np.random.default_rng(2)
    vectors = np.round(r.normal(size=(60, 5)), 1)
    vectors[10:20] = vectors[3]
    vectors[30] = 0
    index = new(spark)
    table = spark.createDataFrame([(i, i, "m", v.tolist()) for i, v in enumerate(vectors)] + [(100, 100, "other", [1.0, 2.0]), (101, 101, "m", None)], "chunk_id long, doc_id long, model string, vector array<double>")
    index.update(spark.createDataFrame([], CHUNKS), table)
    codes = {x["chunk_id"]: list(np.frombuffer(x["q"], np.int8)) for x in index.live("vectors").filter("model = 'm'").collect()}
    assert codes == {x["chunk_id"]: x["q"] for x in table.filter("model = 'm' and vector is not null").select("chunk_id", S.quantise(F.col("vector")).alias("q")).collect()}
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 60, 4)], "query_id long, vector array<double>")
    got = {(x["query_id"], x["rank"]): (x["chunk_id"], x["dot"]) for x in index.vector_top(queries, "m", 9).collect()}
    for q in range(0, 60, 4):
        best = sorted(((-int(np.dot(np.array(codes[q], int), np.array(codes[i], int))), i) for i in codes))[:9]
        assert [got[q, k + 1] for k in range(9)] == [(i, -d) for d, i in best]
    only = spark.createDataFrame([(4,), (15,), (77,)], "chunk_id long")
    assert {x["chunk_id"] for x in index.vector_top(queries, "m", 9, only).collect()} == {4, 15}
    assert index.vector_top(queries, "unknown").collect() == []
    with pytest.raises(Exception, match="vector lengths differ"):
        index.vector_top(queries, "other").collect()


def test_same_terms_for_index_and_query(spark):
    index = new(spark)
    texts = ["Crème the brûlée", "依照本法第20条", "国办发〔2024〕12号的规定", "Việt Nam", "水资源 law", "a of the"]
    index.update(spark.createDataFrame([(i, i, t, None, None, "x") for i, t in enumerate(texts)], CHUNKS))
    asked = ["creme", "第二十条", "见国办发[2024]第12号", "VIET", "The law of", "Crème", "of the", "二十"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    terms = queries.select("query_id", F.explode(X.query_terms(F.col("text"))).alias("term"))
    hits: dict = {}
    for x in index.keyword_scores(terms).collect():
        hits.setdefault(x["query_id"], set()).add(x["chunk_id"])
    assert hits == {0: {0}, 1: {1}, 2: {2}, 3: {3}, 4: {4}, 5: {0}}
    own = {x["query_id"]: x["t"] for x in queries.select("query_id", X.query_terms(F.col("text")).alias("t")).collect()}
    assert own[1] == ["第20条"] and own[6] == [] and "12" not in own[2]


def test_metadata_reaches_search(spark):
    """A corrected title is found, only its document is written anew, and its vectors stay."""
    chunks = spark.createDataFrame([(i, i, i, ["第一章"], 0, 4, f"text{i}", f"text{i}", "") for i in range(6)], "chunk_id long, doc_id long, parent_id long, path array<string>, start int, end int, text string, parent_text string, embedding_text string")
    schema = "doc_id long, path string, sha256 string, parser string, file_name string, title string, doc_number string, issuer string, date string, meta_edited boolean"
    cat = spark.createDataFrame([(i, f"/{i}", "h", "builtin", f"{i}.txt", f"title {i}", None, None, None, False) for i in range(6)], schema)
    index = new(spark)
    vectors = spark.createDataFrame([(i, i, "m", [1.0, float(i)]) for i in range(6)], "chunk_id long, doc_id long, model string, vector array<double>")
    index.update(K.index_rows(chunks, cat), vectors)
    after = K.edited_metadata(cat, spark.createDataFrame([(3, " Harbour ", None, None, None)], "doc_id long, title string, doc_number string, issuer string, date string")).cache()
    batch = K.refreshed_index(index, cat, after, chunks)
    assert {x["doc_id"] for x in index._batch("postings", batch).collect()} == {3} and index.live("vectors").count() == 6
    rebuilt = new(spark)
    rebuilt.update(K.index_rows(chunks, after), vectors)
    assert state(index) == state(rebuilt)
    asked = spark.createDataFrame([(1, "harbour", [0.0, 1.0])], "query_id long, text string, vector array<double>")
    got = K.search(asked, chunks, after, index=index, model="m").orderBy("position").collect()
    assert (got[0]["doc_id"], got[0]["title"], got[0]["keyword_rank"]) == (3, "Harbour", 1) and got[0]["vector_rank"] is not None
    assert os.path.isdir(f"{index.path}/postings/batch=0")


def test_texts_are_dealt_out_by_size(spark):
    """Parts in proportion to the texts, not to what the session sets; one task's share stays bounded."""
    rows = spark.range(400).select(F.col("id"), F.repeat(F.lit("x"), 100).alias("text"))
    parts = dealt(rows, "id", F.col("text"), size=500)
    assert parts.rdd.getNumPartitions() == 80 and parts.count() == 400
    assert parts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 2500
    assert dealt(rows.filter("false"), "id", F.col("text")).count() == 0


def test_vector_top_merges_blocks_of_a_task(spark, monkeypatch):
    """Blocks of vectors that one task reads are merged there, ties by id; all in one partition, five to a block."""
    monkeypatch.setattr(N.blocks, "__defaults__", (("ids", "codes"), 5))
    r = np.random.default_rng(4)
    codes = r.integers(-3, 4, (60, 2)).astype(np.int8)
    vectors = spark.createDataFrame([(i, bytes(c.tobytes())) for i, c in enumerate(codes)], "chunk_id long, q binary").coalesce(1)
    queries = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)], "query_id long, vector array<double>")
    asked = {q["chunk_id"]: np.frombuffer(q["q"], np.int8) for q in N.quantised(queries.selectExpr("query_id chunk_id", "0 doc_id", "'' model", "vector")).collect()}
    got = sorted((x["query_id"], x["rank"], x["chunk_id"]) for x in N.vector_top(queries, vectors, 7).collect())
    dots = {k: codes.astype(int) @ q.astype(int) for k, q in asked.items()}
    assert got == sorted((k, n + 1, i) for k, d in dots.items() for n, i in enumerate(sorted(range(60), key=lambda i: (-d[i], i))[:7]))
