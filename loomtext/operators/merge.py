"""Merging one knowledge base into another: new ids for what comes in, carried through every table that refers to them.

A base is a dict of tables: documents (doc_id, sha256, file_name and more), parents (parent_id, doc_id), chunks (chunk_id,
doc_id, parent_id), models (model_id, name, dim), embeddings (chunk_id, model_id, vector); further columns are kept where
both sides have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import stored_name
from .storage import stored

REPORT = "what string, name string, n long"


def id_map(rows: DataFrame, column: str, taken: DataFrame) -> DataFrame:
    """(old, new): the ids of rows in order, numbered on from the largest that is taken.

    Sorted by ranges and numbered by zipWithIndex, which counts the partitions first: no task sees all ids.
    """
    spark = rows.sparkSession
    numbered = rows.select(F.col(column).cast("long")).distinct().orderBy(column).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    first = taken.agg((F.coalesce(F.max(F.col(column).cast("long")), F.lit(0)) + 1).alias("_first"))
    found = spark.createDataFrame(numbered, "old long, n long", verifySchema=False)
    return stored(found.crossJoin(F.broadcast(first)).select("old", (F.col("n") + F.col("_first")).alias("new")), "ids")  # first: one row


def remapped(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows with a column's ids replaced by the new ones; rows of other ids go."""
    return rows.join(ids.select(F.col("old").alias(column), F.col("new").alias("_new")), column).withColumn(column, F.col("_new")).drop("_new")


def appended(ours: DataFrame, more: DataFrame) -> DataFrame:
    """Both, with the columns of ours; a column that more lacks is null there."""
    missing = {c: F.lit(None).cast(ours.schema[c].dataType) for c in ours.columns if c not in more.columns}
    return ours.unionByName(more.withColumns(missing).select(*(F.col(c).cast(ours.schema[c].dataType).alias(c) for c in ours.columns)))


def merged_bases(ours: dict[str, DataFrame], other: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The merged base, and a report (what, name, n).

    Documents whose content ours has are left out, and of equal contents in other all but the one of the least id; what
    belongs to them goes too. Models are the same by name; one of another dimension is reported and its vectors are left
    out, as are vectors of a wrong length. Ids of what comes in follow on from the largest of ours, in their old order.
    """
    first = F.row_number().over(W.partitionBy("sha256").orderBy("doc_id"))
    new = other["documents"].join(ours["documents"].select("sha256").distinct(), "sha256", "left_anti").withColumn("_n", first).filter("_n = 1").drop("_n")
    doc_ids = id_map(new, "doc_id", ours["documents"])
    documents = remapped(new, "doc_id", doc_ids)
    if "stored_name" in documents.columns:
        documents = documents.withColumn("stored_name", stored_name(F.col("doc_id"), F.col("file_name")))

    parents = remapped(other["parents"], "doc_id", doc_ids)
    parent_ids = id_map(parents, "parent_id", ours["parents"])
    chunks = remapped(remapped(other["chunks"], "doc_id", doc_ids), "parent_id", parent_ids)
    chunk_ids = id_map(chunks, "chunk_id", ours["chunks"])

    known = other["models"].join(ours["models"].select("name", F.col("model_id").alias("_id"), F.col("dim").alias("_dim")), "name", "left")
    fresh = known.filter("_id is null")
    fresh_ids = id_map(fresh, "model_id", ours["models"])
    usable = known.filter("_dim = dim").select(F.col("model_id").alias("old"), F.col("_id").alias("new")).unionByName(fresh_ids)
    models = remapped(fresh.drop("_id", "_dim"), "model_id", fresh_ids)
    sizes = other["models"].select("model_id", F.col("dim").alias("_dim"))
    vectors = other["embeddings"].join(sizes, "model_id").filter(F.size("vector") == F.col("_dim")).drop("_dim")
    embeddings = remapped(remapped(vectors, "chunk_id", chunk_ids), "model_id", usable)

    came = {"documents": documents, "parents": remapped(parents, "parent_id", parent_ids), "chunks": remapped(chunks, "chunk_id", chunk_ids), "models": models, "embeddings": embeddings}
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("name"), "n")
    skipped = other["documents"].join(new.select("doc_id"), "doc_id", "left_anti")
    report = count(skipped, "documents skipped")
    for name in ("documents", "chunks", "embeddings"):
        report = report.unionByName(count(came[name], f"{name} added"))
    report = report.unionByName(known.filter("_dim <> dim").select(F.lit("model skipped").alias("what"), "name", F.lit(1).cast("long").alias("n")))
    return {name: appended(ours[name], came[name]) for name in came}, report
