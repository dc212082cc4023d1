"""The check of documents by sections as a job that can be stopped and run again: answers are a table with a key of what was
asked, and only what it lacks is asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import models as L
from . import proofread as P
from . import review as R
from .storage import committed, dealt, stored

#: Characters of a section, at most, unless one paragraph has more.
SECTION = 1800
ANSWERS = "key string, answer string"


def sections(rows: DataFrame, most: int = SECTION, question: str = "check") -> DataFrame:
    """doc_id, section, key, text: the paragraphs (doc_id, index, text) worth reading, each text of a document once, with their
    numbers, packed in order. key is a hash of the question and the text: equal sections of two documents share it."""
    kept = R.first_copies(rows).filter(F.col("index") == F.col("first")).filter(T.worth_reading(F.col("text"))).select("doc_id", "index", "text", F.length("text").alias("size"))
    packs = P.packed(kept, "doc_id", "index", "size", most).withColumnRenamed("pack", "section")
    line = F.concat(F.lit("[第"), F.col("index").cast("string"), F.lit("段] "), F.trim("text"))
    each = kept.join(packs, ["doc_id", "index"]).groupBy("doc_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return each.select("doc_id", "section", F.sha2(F.concat(F.lit(question + "\n"), "text"), 256).alias("key"), "text")


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer): one answer for each key, from the batches whose write has succeeded."""
    paths = [f"{path}/batch={n}" for n in committed(spark, path, "batch")]
    rows = spark.read.schema(ANSWERS).parquet(*paths) if paths else spark.createDataFrame([], ANSWERS)
    return rows.dropDuplicates(["key"])


def ask_missing(asked: DataFrame, ask: Callable[[list[str]], list[str | None]], path: str, blocks: int = 4) -> DataFrame:
    """The stored answers after those that were missing for asked (key, text) have been asked for.

    Keys are asked for in blocks by their hash; each block is stored when it is done, so a run that fails keeps what it
    has, and the next one asks only for the rest. A null answer is not stored and is asked for again.
    """
    spark = asked.sparkSession
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    for i in range(blocks):
        missing = asked.filter(block == i).dropDuplicates(["key"]).join(stored_answers(spark, path), "key", "left_anti").select("key", "text")
        done = L.mapped(missing, ask, "text", "answer", "string").select("key", "answer").filter("answer is not null")
        n = max(committed(spark, path, "batch"), default=-1) + 1
        done.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return stored_answers(spark, path)


def check(rows: DataFrame, ask: Callable[[list[str]], list[str | None]], path: str, most: int = SECTION, question: str = "check") -> tuple[DataFrame, DataFrame]:
    """(issues, facts) of paragraphs (doc_id, index, text), by a model's answers for their sections.

    Issues count if their quote stands in the paragraph; copies of a paragraph within a document get the issues of the first.
    Sections without a readable answer have none.
    """
    rows = dealt(rows.select("doc_id", "index", "text"), "doc_id", F.col("text"))  # what is formed of a document stays there
    parts = stored(sections(rows, most, question), "sections")  # read once for each block of keys
    answers = parts.join(ask_missing(parts.select("key", "text"), ask, path), "key").select("doc_id", "answer")
    issues, facts = L.check_answers(answers, rows)
    return R.shared_findings(issues, R.first_copies(rows)), facts
