"""A corpus pipeline of five stages: each reads what the one before has written, the last returns packed pieces.

Quality rules and toxicity drop documents, near-dedup leaves one document of each group, substring dedup replaces the
text of a document that loses words (and its n_chars), packing cuts what is left into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import common, neardup, quality, substring, tokens, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps. A null, empty or blank text has few words and goes; a very long text is measured
    whole; repeated rows and rows without an id are judged each; an empty table gives none."""
    return quality.accepted(docs, "v1")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, by a model fitted on labelled documents that are still there. A null or empty text
    stays; a very long text is scored whole; repeated rows and rows without an id are judged each; an empty table gives none."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies. A text without words is in no group and stays; rows
    without an id go; rows repeated with a kept id all stay; an empty table gives none."""
    return docs.join(neardup.near_duplicates(docs).filter("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text that loses nothing stays as it is, spaces and lines included; one that loses words has those left joined by
    spaces. A null or empty text has no words and stays; a row repeated with its id counts once; rows without an id go; an empty
    table gives none; further columns stay, whatever their names."""
    out = substring.dedup(docs, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars").cast("long"))}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents. A null or empty text is the end id alone; a very long one is cut over many sequences;
    repeated rows are packed each; rows without an id go; an empty table gives no pieces."""
    return tokens.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The fitted model and the tokenizer have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
