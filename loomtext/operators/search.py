"""Retrieval: ranks, quantised vectors, rank fusion, parent collapse, reranking, excerpts. A query is a row of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .storage import dealt, stored

#: BM25's usual constants, the weights of the index's fields, and the constant of reciprocal rank fusion.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"body": 1.0, "head": 2.0, "doc": 0.5}
RRF = 60
POOL = 50


def ranked(scores: DataFrame, top: int = POOL, id_col: str = "chunk_id", by: str = "score") -> DataFrame:
    """The best `top` of each query with their rank; ties by id."""
    order = W.partitionBy("query_id").orderBy(F.col(by).desc(), F.col(id_col))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def quantise(vector: Column) -> Column:
    """Unit length times 127, rounded half away from zero; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm == 0, 0).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127 / norm).cast("int")))).cast("int"))


def fuse(keyword: DataFrame, vector: DataFrame, id_col: str = "chunk_id", constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: score and both ranks, null where a list has not the id."""
    both = keyword.select("query_id", id_col, F.col("rank").alias("k"), F.lit(None).cast("int").alias("v")).unionByName(vector.select("query_id", id_col, F.lit(None).cast("int").alias("k"), F.col("rank").alias("v")))
    ranks = both.groupBy("query_id", id_col).agg(F.min("k").alias("keyword_rank"), F.min("v").alias("vector_rank"))
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return ranks.withColumn("score", part("keyword_rank") + part("vector_rank"))


def final_order(fused: DataFrame, id_col: str = "chunk_id", cited: Column | None = None) -> list[Column]:
    """Cited documents first, then by score, by the better rank, by id."""
    best = F.least(F.coalesce("keyword_rank", F.lit(1 << 30)), F.coalesce("vector_rank", F.lit(1 << 30)))
    first = [cited.desc()] if cited is not None else []
    return [*first, F.col("score").desc(), best, F.col(id_col)]


def collapse(fused: DataFrame, owners: DataFrame, limit: int = 30, id_col: str = "chunk_id", parent_col: str = "parent_id", cited: str | None = None) -> DataFrame:
    """The best chunk of each parent, then the best `limit` of each query. owners: (id, parent); ids without one go."""
    rows = fused.join(owners, id_col)
    order = final_order(rows, id_col, F.col(cited) if cited else None)
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy("query_id", parent_col).orderBy(*order))).filter("_r = 1").drop("_r")
    return best.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("position") <= (limit or 30))


def rerank(hits: DataFrame, scores: DataFrame, limit: int = 30, id_col: str = "chunk_id") -> DataFrame:
    """Order by the reranker's score; hits without one come last; equal ones keep their order (position)."""
    rows = hits.join(scores.select("query_id", id_col, F.col("score").alias("rerank_score")), ["query_id", id_col], "left")
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("position"))
    return rows.withColumn("new_position", F.row_number().over(order)).filter(F.col("new_position") <= limit)


def cited_first(first: DataFrame, rest: DataFrame, limit: int = POOL, key: str = "id") -> DataFrame:
    """Union of two ranked lists (query_id, key, rank): the first list's order, then what only the other has, cut."""
    both = first.select("query_id", key, F.lit(0).alias("list"), "rank").unionByName(rest.select("query_id", key, F.lit(1).alias("list"), "rank"))
    one = both.groupBy("query_id", key).agg(F.min(F.struct("list", "rank")).alias("at"))
    return one.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("at", key))).filter(F.col("position") <= limit).select("query_id", key, "position")


def related(paragraphs: DataFrame, query_terms: DataFrame, least_terms: int = 2, least_chars: int = 8, least_score: float = 2.0, top: int = 8, terms: Callable[[Column], Column] = T.search_terms) -> DataFrame:
    """Paragraphs (doc_id, index, text) that share rare terms with a query (query_id, term): IDF sums, best `top`, by place.

    The paragraphs are dealt out by document in parts of a bounded size. The queries' terms are written first, then their
    weights: their size is then known, and Spark sends them to the paragraphs if they are small; scores are summed up where
    the paragraphs lie and only the best of each part are shuffled.
    """
    rows = dealt(paragraphs.select("doc_id", "index", "text"), "doc_id", F.col("text"))
    at = rows.filter(F.length("text") >= least_chars).select("doc_id", "index", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    n = paragraphs.agg(F.count("*").alias("n"))
    asked = stored(query_terms.select("term").distinct(), "asked-terms")
    df = at.join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # n: one row
    idf = df.select("term", F.greatest(F.lit(0.0), F.log(F.col("n") / (1 + F.col("df")))).alias("w"))
    wanted = stored(query_terms.join(idf, "term").select("query_id", "term", "w"), "query-weights")
    scored = at.join(wanted, "term").groupBy("query_id", "doc_id", "index").agg(F.round(F.sum("w"), 9).alias("score"), F.count("*").alias("n_terms"))
    scored = scored.filter((F.col("n_terms") >= least_terms) & (F.col("score") > least_score))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "index")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id", "index")))


def similar_cases(queries: DataFrame, cases: DataFrame, top: int = 3, recent: int = 200) -> DataFrame:
    """For each query (query_id, text, reviewer), its reviewer's `top` most similar of the `recent` newest cases
    (case_id, reviewer, text, created), by Dice similarity of character pairs."""
    newest = cases.withColumn("_r", F.row_number().over(W.partitionBy("reviewer").orderBy(F.desc("created"), F.desc("case_id")))).filter(F.col("_r") <= recent)
    pairs = queries.select("query_id", "reviewer", T.bigrams(F.col("text")).alias("a")).join(newest.select("case_id", "reviewer", T.bigrams(F.col("text")).alias("b")), "reviewer")
    scored = pairs.select("query_id", "case_id", T.dice(F.col("a"), F.col("b")).alias("score")).filter("score > 0")
    return ranked(scored, top, "case_id")


def excerpts(rows: DataFrame, budget: int = 600, least: int = 2, ends: str = "。！？；", longest: int = 300) -> DataFrame:
    """rows (text, terms) with excerpt: the sentences that hold most of the terms and fit in `budget` characters together, in
    their order, a gap marked with an ellipsis; the beginning of the text where no sentence holds `least` terms.

    Sentences end behind the marks of `ends` and with lines, and are cut at `longest` characters. One that does not fit is
    passed over; of equal ones the first is taken. A null text gives null.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split("text", rf"(?<=[{ends}])|\n"), lambda s: F.left(strip(s), F.lit(longest))), lambda s: s != "")
    held = lambda s: F.size(F.filter("terms", lambda t: F.contains(s, t)))
    scored = F.transform("_s", lambda s, i: F.struct((-held(s)).alias("k"), i.alias("i"), F.length(s).alias("n")))
    best = F.array_sort(F.filter(scored, lambda x: x.k <= -least))
    picked = F.expr(f"""aggregate(_best, named_struct('n', 0, 'p', cast(array() as array<int>)), (a, x) ->
        if(a.n + x.n <= {budget}, named_struct('n', a.n + x.n, 'p', array_append(a.p, x.i)), a), a -> array_sort(a.p))""")
    joined = F.array_join(F.transform("_p", lambda i, k: F.concat(F.when((k > 0) & (F.get("_p", k - 1) + 1 != i), "…").otherwise(""), F.get("_s", i))), "")
    out = rows.withColumn("_s", parts).withColumn("_best", best).withColumn("_p", picked)
    return out.withColumn("excerpt", F.when(F.size("_best") > 0, joined).otherwise(strip(F.left("text", F.lit(budget))))).drop("_s", "_best", "_p")
