"""A knowledge base as tables: imports that keep ids and edited metadata, hybrid search, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.terms import number_matches, query_terms
from . import search as S
from .index import Index
from .metadata import is_letterhead
from .storage import shared_path
from .structure import chunks, heading

META = ("title", "doc_number", "issuer", "date")


def title_of(title: Column, file_name: Column) -> Column:
    """The title, else the file's name without its extension."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""))


def plan_import(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """files (path, sha256, parser) with action and doc_id.

    unchanged: the content is there, read by the same parser, or the new one is the built-in; replace: the content is
    there by another parser, or the path with other content; the id stays. new: all others, one for each content.
    """
    same = catalog.groupBy("sha256").agg(F.min_by(F.struct("doc_id", "parser"), "doc_id").alias("c"))
    place = catalog.groupBy("path").agg(F.max("doc_id").alias("at_path"))
    first = F.row_number().over(W.partitionBy("sha256").orderBy("path"))
    rows = files.withColumn("_n", first).join(same, "sha256", "left").join(place, "path", "left")
    known = F.col("c").isNotNull()
    keep = (F.col("parser") == "builtin") | (F.col("parser") == F.col("c.parser"))
    action = F.when(known & keep, "unchanged").when(known, "replace").when(F.col("_n") > 1, "copy").when(F.col("at_path").isNotNull(), "replace").otherwise("new")
    doc_id = F.when(known, F.col("c.doc_id")).otherwise(F.coalesce("at_path", F.xxhash64("sha256")))
    return rows.select(*files.columns, action.alias("action"), doc_id.alias("doc_id"))


def replaced(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalog with incoming rows in place of those of their ids; metadata that a user edited stays as it was."""
    old = catalog.filter("meta_edited").select("doc_id", F.struct(*META).alias("_old"))
    rows = incoming.join(old, "doc_id", "left")
    kept = {m: F.when(F.col("_old").isNotNull(), F.col(f"_old.{m}")).otherwise(F.col(m)) for m in META}
    rows = rows.withColumns(kept | {"meta_edited": F.col("_old").isNotNull()}).drop("_old")
    return catalog.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows.select(*catalog.columns))


def edited_metadata(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """catalog with the users' changes (doc_id and META): trimmed, blank as null, marked as edited."""
    new = changes.select("doc_id", F.struct(*(F.nullif(F.trim(m), F.lit("")).alias(m) for m in META)).alias("_new"))
    rows = catalog.join(new, "doc_id", "left")
    some = F.col("_new").isNotNull()
    return rows.withColumns({m: F.when(some, F.col(f"_new.{m}")).otherwise(F.col(m)) for m in META} | {"meta_edited": some | F.col("meta_edited")}).drop("_new").select(*catalog.columns)


def retitled(catalog: DataFrame, titles: DataFrame) -> DataFrame:
    """New titles (doc_id, title) for documents whose title is a letterhead or a hash, unless a user edited it."""
    poor = ~F.col("meta_edited") & (F.col("title").isNull() | T.hash_like(F.col("title")) | is_letterhead(F.col("title")))
    rows = catalog.join(titles.select("doc_id", F.col("title").alias("_t")), "doc_id", "left")
    return rows.withColumn("title", F.when(poor, F.coalesce("_t", "title")).otherwise(F.col("title"))).drop("_t").select(*catalog.columns)


def document_view(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, index, text, char_start, rank of the line's heading, and the number of the chunk where the line begins."""
    ranked = lines.withColumn("rank", heading(F.col("text"))["rank"])
    ranges = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "chunk_no"))).alias("_c"))
    inside = F.filter("_c", lambda c: (c["start"] <= F.col("char_start") + F.length("text")) & (c["end"] > F.col("char_start")))
    return ranked.join(ranges, "doc_id", "left").select("doc_id", "index", "text", "char_start", "rank", F.get(inside, F.lit(0))["chunk_no"].alias("chunk_no"))


def chunk_table(docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """chunk_id, doc_id, parent_id, path, start, end, text, parent_text, embedding_text of documents (doc_id, text), with
    the levels of their lines if these have styles; ids are hashes, the same in every run. Texts are the document's own
    characters between the offsets."""
    rows = chunks(docs, lines, texts=True)
    rows = rows.withColumns({"chunk_id": F.xxhash64("doc_id", "chunk_no", F.lit("chunk")), "parent_id": F.xxhash64("doc_id", "parent_no", F.lit("parent"))})
    with_path = F.when(F.size("path") > 0, F.concat(F.array_join("path", " > "), F.lit("\n"), "text")).otherwise(F.col("text"))
    return rows.select("chunk_id", "doc_id", "parent_id", "path", "start", "end", "text", "parent_text", with_path.alias("embedding_text"))


def cited_documents(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose number a query names, as it is or with words that run into it."""
    found = queries.select("query_id", F.explode(number_matches(T.normalize(F.col("text")))).alias("m")).select("query_id", "m.number", "m.context")
    tail = lambda c: F.regexp_extract(c, r"(〔\d{4}〕\d+号)$", 1)
    known = catalog.filter("doc_number is not null").select("doc_id", "doc_number", tail("doc_number").alias("tail"))
    pairs = found.withColumn("tail", tail("number")).join(known, "tail")
    return pairs.filter((F.col("number") == F.col("doc_number")) | F.endswith("context", F.col("doc_number"))).select("query_id", "doc_id").distinct()


def index_rows(chunk_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """What an index keeps of chunks: body, head (the path), doc (title, number and issuer of the document)."""
    named = catalog.select("doc_id", F.concat_ws(" ", title_of(F.col("title"), F.col("file_name")), "doc_number", "issuer").alias("doc"))
    return chunk_rows.join(named, "doc_id").select("chunk_id", "doc_id", F.col("text").alias("body"), F.array_join("path", " ").alias("head"), "doc")


def refreshed_index(index: Index, before: DataFrame, after: DataFrame, chunk_rows: DataFrame) -> int:
    """Bring metadata that changed between two states of the catalog into the index: only the documents whose indexed
    fields differ are written anew, with the vectors that they have. Returns the batch."""
    fields = F.xxhash64(*(F.coalesce(c, F.lit("")) for c in ("file_name", *META[:3])))
    old = before.select("doc_id", fields.alias("_h"))
    changed = after.select("doc_id", fields.alias("_g")).join(old, "doc_id", "left").filter("_h is null or _h <> _g").select("doc_id")
    gone = before.select("doc_id").join(after.select("doc_id"), "doc_id", "left_anti")
    return index.update(index_rows(chunk_rows.join(changed, "doc_id", "left_semi"), after), gone=gone, keep_vectors=True)


def search(queries: DataFrame, chunk_rows: DataFrame, catalog: DataFrame, vectors: DataFrame | None = None, only: DataFrame | None = None, limit: int = 30, reranker: Callable | None = None, index: Index | None = None, model: str = "") -> DataFrame:
    """Hybrid search for a batch of queries (query_id, text, and vector where they ask by vector): query_id, position,
    chunk_id, doc_id, title, path, text, parent_text, keyword_rank, vector_rank, score.

    index: a stored index of the chunks and of the model's vectors; without one, one is made of chunk_rows and vectors
    (chunk_id, vector). Keyword and vector lists of 50 are fused; chunks of documents that the query cites come first; one
    chunk a parent; with a reranker the best max(30, limit) are ordered anew and cut. limit 0 stands for 30.
    """
    limit = limit or 30
    if index is None:
        index = Index(queries.sparkSession, shared_path(queries.sparkSession, "search"))
        own = None if vectors is None else vectors.select("chunk_id", "vector").join(chunk_rows.select("chunk_id", "doc_id"), "chunk_id").select("chunk_id", "doc_id", F.lit(model).alias("model"), "vector")
        index.update(index_rows(chunk_rows, catalog), own)
    ids = None if only is None else chunk_rows.join(only.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")
    terms = queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
    scores = index.keyword_scores(terms, only=ids)
    cited = cited_documents(queries, catalog).withColumn("cited", F.lit(True))
    owners = chunk_rows.select("chunk_id", "doc_id", "parent_id")
    # chunks of cited documents fill the list first, the rest follows in order
    marked = scores.join(owners.select("chunk_id", "doc_id"), "chunk_id").join(cited, ["query_id", "doc_id"], "left")
    order = W.partitionBy("query_id").orderBy(F.coalesce("cited", F.lit(False)).desc(), F.desc("score"), "chunk_id")
    keyword = marked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= S.POOL).select("query_id", "chunk_id", "rank")
    if "vector" in queries.columns:
        vector = index.vector_top(queries.select("query_id", "vector"), model, S.POOL, ids).select("query_id", "chunk_id", "rank")
    else:
        vector = keyword.filter("false")
    fused = S.fuse(keyword, vector).join(owners, "chunk_id").join(cited, ["query_id", "doc_id"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    best = S.collapse(fused.drop("parent_id"), owners.select("chunk_id", "parent_id"), max(30, limit) if reranker else limit, cited="cited")
    hits = best.join(chunk_rows.select("chunk_id", "path", "text", "parent_text"), "chunk_id").join(catalog.select("doc_id", title_of(F.col("title"), F.col("file_name")).alias("title")), "doc_id")
    if reranker:
        from .models import rerank as score_hits

        asked = hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id").withColumn("fused_score", F.col("score")).drop("score")
        scored = score_hits(asked, reranker)
        hits = S.rerank(scored.drop("score").withColumnRenamed("fused_score", "score"), scored.select("query_id", "chunk_id", "score"), limit).drop("position", "rerank_score").withColumnRenamed("new_position", "position")
    return hits.select("query_id", "position", "chunk_id", "doc_id", "title", "path", "text", "parent_text", "keyword_rank", "vector_rank", "score")


def numbered_citations(hits: DataFrame) -> DataFrame:
    """hits with n, 1 and on for each query: one for each document and parent text, in order of position."""
    one = W.partitionBy("query_id", "doc_id", F.coalesce("parent_text", "text")).orderBy("position")
    rows = hits.withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("position")))
