"""Retrieval queries over documents, benchmark, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms as X
from ..operators import search as S
from ..operators.index import Index
from ..operators.storage import shared_path
from .registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def words_sql(column: str) -> str:
    """Terms of a column by the rule of index and queries; the tables have no Han."""
    return rf"list_filter(regexp_extract_all(lower(strip_accents({column})), '[\p{{L}}\p{{N}}]+'), lambda x: x not in ({STOP_SQL}))"


WORDS = words_sql("text")
#: The distinct terms of each benchmark item, the first 128.
TERMS_SQL = f"""
    terms as (select item_id as query_id, unnest(list_transform(list_sort(list_transform(list_distinct(l), lambda x: {{'i': list_position(l, x), 't': x}}))[1 : {X.MOST_TERMS}], lambda y: y.t)) as term
        from (select item_id, {WORDS} as l from benchmark)),"""
#: Fields of the index and their weights: the text, the source as a heading, the language as the document's name.
POSTINGS_SQL = f"""p as (select term, doc_id, sum(w)::double as tf from (select doc_id, unnest({WORDS}) as term, 1.0 as w from documents
        union all select doc_id, unnest({words_sql("source")}), 2.0 from documents union all select doc_id, unnest({words_sql("lang")}), 0.5 from documents) group by 1, 2),"""
BM25_SQL = """
    len as (select doc_id, sum(tf) as len from p group by 1), st as (select count(*) as n, avg(len) as av from len),
    df as (select term, count(*) as df from p group by 1),
    scores as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))), 9) as score
        from terms join p using (term) join df using (term) join len using (doc_id) cross join st {where} group by 1, 2),"""

#: Indexes of this process by session and tables: made by the first query that asks, read by all others.
INDEXES: dict[tuple[str, str], Index] = {}
MODEL = "given"


def chunks_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("body"), F.col("source").alias("head"), F.col("lang").alias("doc"))


def vectors_of(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.lit(MODEL).alias("model"), F.col("embedding").alias("vector"))


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents (each one chunk) and vectors of a folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in INDEXES:
        made = Index(spark, shared_path(spark, "index"))
        made.update(chunks_of(table(spark, sf_dir, "documents")), vectors_of(table(spark, sf_dir, "embeddings")))
        INDEXES[key] = made
    return INDEXES[key]


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(X.query_terms(F.col("text"))).alias("term"))


def keyword(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    only = only if only is None else only.select(F.col("doc_id").alias("chunk_id"))
    return index(spark, sf_dir).keyword_scores(benchmark_terms(spark, sf_dir), only=only).withColumnRenamed("chunk_id", "doc_id")


def with_points(df: DataFrame) -> DataFrame:
    return df.withColumn("points", F.round(F.col("score") * 10000).cast("long")).drop("score")


@R.query(f"with {POSTINGS_SQL} l as (select doc_id, sum(tf) as len from p group by 1) select term, doc_id, tf, len from p join l using (doc_id)")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored postings, frequencies weighted by field."""
    return index(spark, sf_dir).live("postings").select("term", "doc_id", "tf", "len")


@R.query(f"with {POSTINGS_SQL[:-1]} select term, count(*) as df from p group by 1")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored frequencies."""
    return index(spark, sf_dir).frequencies()


#: What a changed document gains: accented letters, an article, a document number; and the terms that it is found under.
ADDED, ADDED_TERMS = " Crème Việt 第二十条 国办发〔2024〕12号", "['第20条', '国办发202412号', 'creme', 'viet', '第二', '二十', '十条', '国办', '办发', '2024', '12']"


@R.query(f"""with t as (select doc_id, list_concat(case when doc_id % 10 = 3 and doc_id % 20 = 3 then {ADDED_TERMS} else [] end, {WORDS}) as w, source, lang from documents where doc_id % 10 <> 7),
    p as (select term, doc_id, sum(w)::double as tf from (select doc_id, unnest(w) as term, 1.0 as w from t union all select doc_id, unnest({words_sql("source")}), 2.0 from t
        union all select doc_id, unnest({words_sql("case when doc_id % 20 = 13 then 'fr' else lang end")}), 0.5 from t) group by 1, 2)
    select term, count(*) as df, count(*) as n_postings, sum(tf)::double as tf, sum(doc_id)::bigint as ids from p group by 1""")
def index_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after three batches: all documents; some with a longer text, others with other metadata; some deleted.
    Its frequencies and live postings are those of the documents as they are then."""
    docs = table(spark, sf_dir, "documents")
    made = Index(spark, shared_path(spark, "maintained"))
    made.update(chunks_of(docs))
    text = F.when(F.col("doc_id") % 20 == 3, F.concat("text", F.lit(ADDED))).otherwise(F.col("text"))
    made.update(chunks_of(docs.filter("doc_id % 10 = 3").withColumns({"text": text, "lang": F.when(F.col("doc_id") % 20 == 13, "fr").otherwise(F.col("lang"))})))
    made.update(chunks_of(docs.filter("false")), gone=docs.filter("doc_id % 10 = 7").select("doc_id"))
    live = made.live("postings").groupBy("term").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("tf"), F.sum("doc_id").alias("ids"))
    return made.frequencies().join(live, "term", "full").select("term", "df", "n_postings", "tf", "ids")


@R.query(f"select doc_id, len({WORDS})::bigint as n_tokens, len(list_distinct({WORDS}))::bigint as n_distinct from documents")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.index_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


TOP_SQL = "select query_id, doc_id, rank, round(score * 10000)::bigint as points from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores) where rank <= 10"


@R.query(f"with {TERMS_SQL}{POSTINGS_SQL}{BM25_SQL.format(where='').rstrip(',')} select x.query_id, x.doc_id, x.rank, x.points, d.lang, d.source from ({TOP_SQL}) x join documents d using (doc_id)")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for each benchmark item's words, with language and source."""
    hits = with_points(S.ranked(keyword(spark, sf_dir), 10, "doc_id"))
    return hits.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@R.query(f"with {TERMS_SQL}{POSTINGS_SQL}{BM25_SQL.format(where=chr(119) + 'here doc_id in (select doc_id from documents where lang = ' + chr(39) + 'de' + chr(39) + ')').rstrip(',')} {TOP_SQL}")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in German documents only; statistics stay those of all."""
    only = table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id")
    return with_points(S.ranked(keyword(spark, sf_dir, only), 10, "doc_id"))


@R.query("select query_id, doc_id, rank, points from (select 0::bigint as query_id, 0::bigint as doc_id, 0 as rank, 0::bigint as points) where false")
def bm25_no_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty set of documents gives no hits."""
    only = table(spark, sf_dir, "documents").filter("false").select("doc_id")
    return with_points(S.ranked(keyword(spark, sf_dir, only), 10, "doc_id"))


NORM_SQL = """n as (select vec_id, embedding as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings),
    q as (select vec_id, list_transform(e, lambda x: case when norm = 0 then 0 else greatest(-127, least(127, round(x::double * 127 / norm))) end::int) as q from n)"""


@R.query(f"with {NORM_SQL} select vec_id, array_to_string(q, ',') as q from q")
def quantised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(S.quantise(F.col("embedding")).cast("array<string>"), ",").alias("q"))


VECTOR_SQL = """with {norm}, s as (select a.vec_id as query_id, b.vec_id as vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1]::bigint * z[2]::bigint))::bigint as dot from q a, q b where a.vec_id % 50 = 0 {where})
    select query_id, vec_id, dot, rank from (select *, row_number() over (partition by query_id order by dot desc, vec_id) as rank from s) where rank <= 10"""


def vector_batch(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The stated query set, ids divisible by 50, against all stored vectors."""
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = index(spark, sf_dir).vector_top(q, MODEL, 10, only if only is None else only.select(F.col("vec_id").alias("chunk_id")))
    return found.select("query_id", F.col("chunk_id").alias("vec_id"), "dot", "rank")


@R.query(VECTOR_SQL.format(norm=NORM_SQL, where=""))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_batch(spark, sf_dir)


@R.query(VECTOR_SQL.format(norm=NORM_SQL, where="and b.vec_id in (select vec_id from embeddings where label = 1)"))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_batch(spark, sf_dir, table(spark, sf_dir, "embeddings").filter("label = 1").select("vec_id"))


#: Benchmark item i asks with its words and with the vector of id i.
HYBRID_SQL = f"""with {TERMS_SQL}{POSTINGS_SQL}{BM25_SQL.format(where='')} {NORM_SQL},
    k as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as kr from scores qualify kr <= 50),
    s as (select a.vec_id as query_id, b.vec_id as doc_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1]::bigint * z[2]::bigint))::bigint as dot from q a join benchmark on item_id = a.vec_id, q b),
    v as (select query_id, doc_id, row_number() over (partition by query_id order by dot desc, doc_id) as vr from s qualify vr <= 50),
    f as (select coalesce(k.query_id, v.query_id) as query_id, coalesce(k.doc_id, v.doc_id) as doc_id, kr, vr, coalesce(1.0::double / (60 + kr), 0) + coalesce(1.0::double / (60 + vr), 0) as score
        from k full join v on k.query_id = v.query_id and k.doc_id = v.doc_id)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = S.ranked(keyword(spark, sf_dir), S.POOL, "doc_id")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(asked, "query_id", "left_semi")
    v = index(spark, sf_dir).vector_top(q, MODEL, S.POOL).withColumnRenamed("chunk_id", "doc_id")
    return S.fuse(k, v, "doc_id")


@R.query(f"{HYBRID_SQL} select query_id, doc_id, coalesce(kr, 0) as keyword_rank, coalesce(vr, 0) as vector_rank, round(score * 1000000)::bigint as points from f")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("keyword_rank", "vector_rank")), F.round(F.col("score") * 1000000).cast("long").alias("points"))


@R.query(
    f"""{HYBRID_SQL}, o as (select f.*, source, least(coalesce(kr, 1 << 30), coalesce(vr, 1 << 30)) as best from f join documents using (doc_id)),
    c as (select * from o qualify row_number() over (partition by query_id, source order by score desc, best, doc_id) = 1)
    select query_id, doc_id, source, row_number() over (partition by query_id order by score desc, best, doc_id) as position from c qualify position <= 10"""
)
def collapse_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit a source, as chunks collapse into their parents."""
    owners = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("parent_id"))
    return S.collapse(fused(spark, sf_dir), owners, 10, "doc_id").select("query_id", "doc_id", F.col("parent_id").alias("source"), "position")


RERANK_SQL = "case when doc_id % 7 = 0 then null else round((doc_id % 13) / 13.0::double, 6) end"


@R.query(f"""with h as (select lang as query_id, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as position from documents qualify position <= 30)
    select query_id, doc_id, row_number() over (partition by query_id order by {RERANK_SQL} desc nulls last, position) as new_position from h""")
def rerank_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's scores (an injected function of the id here): missing ones last, ties keep their order."""
    order = W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    hits = table(spark, sf_dir, "documents").withColumn("position", F.row_number().over(order)).filter("position <= 30").select(F.col("lang").alias("query_id"), "doc_id", "position")
    scores = hits.select("query_id", "doc_id", F.when(F.col("doc_id") % 7 != 0, F.round((F.col("doc_id") % 13) / F.lit(13.0), 6)).alias("score"))
    return S.rerank(hits, scores, 30, "doc_id").select("query_id", "doc_id", "new_position")


@R.query("""with a as (select lang as query_id, doc_id, row_number() over (partition by lang order by n_chars, doc_id) as rank from documents qualify rank <= 20),
    b as (select lang as query_id, doc_id, row_number() over (partition by lang order by doc_id) as rank from documents qualify rank <= 40),
    u as (select *, 0 as l from a union all select *, 1 from b), o as (select query_id, doc_id, min((l, rank)) as place from u group by 1, 2)
    select query_id, doc_id, row_number() over (partition by query_id order by place, doc_id) as position from o qualify position <= 50""")
def union_priority_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "query_id")
    a = S.ranked(d.select("query_id", "doc_id", (-F.col("n_chars")).alias("score")), 20, "doc_id")
    b = S.ranked(d.select("query_id", "doc_id", (-F.col("doc_id")).alias("score")), 40, "doc_id")
    return S.cited_first(a, b, 50, "doc_id")


BIGRAMS_SQL = "list_distinct(list_transform(range(1, greatest(length(text), 1)), lambda i: substr(text, i, 2)))"


@R.query(f"""with c as (select conv_id, turn, role, conv_id * 100 + turn as case_id, {BIGRAMS_SQL} as g from conversations),
    n as (select * from c qualify row_number() over (partition by role order by case_id desc) <= 200),
    s as (select q.case_id as query_id, n.case_id, 2.0::double * len(list_intersect(q.g, n.g)) / (len(q.g) + len(n.g)) as score from c q join n using (role) where q.conv_id % 50 = 0)
    select query_id, case_id, rank, round(score * 10000)::bigint as points from (select *, row_number() over (partition by query_id order by score desc, case_id) as rank from s where score > 0) where rank <= 3""")
def bigram_dice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 100 + turn").alias("case_id"), F.col("role").alias("reviewer"), "text", "conv_id")
    queries = c.filter("conv_id % 50 = 0").select(F.col("case_id").alias("query_id"), "reviewer", "text")
    return with_points(S.similar_cases(queries, c.select("case_id", "reviewer", "text", F.col("case_id").alias("created")), 3))


@R.query(f"""with par as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx from documents),
    k as (select * from par where length(text) >= 8), {TERMS_SQL}
    pt as (select distinct doc_id, idx, unnest({WORDS}) as term from k), h as (select * from pt where term in (select term from terms)),
    n as (select count(*) as n from par), w as (select term, greatest(0, ln(any_value(n) / (1 + count(*)))) as w from h, n group by 1),
    s as (select query_id, doc_id, idx, round(sum(w), 9) as score, count(*) as n_terms from terms join h using (term) join w using (term) group by 1, 2, 3 having count(*) >= 2 and round(sum(w), 9) > 2.0)
    select query_id, doc_id, idx as index, rank, n_terms from (select *, row_number() over (partition by query_id order by score desc, doc_id, idx) as rank from s) where rank <= 8""")
def idf_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share rare words with each benchmark item."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "text"))
    return S.related(lines, benchmark_terms(spark, sf_dir), terms=X.index_terms).select("query_id", "doc_id", "index", "rank", "n_terms")
