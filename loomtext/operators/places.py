"""Place names: which province, city or district a text is about, and names that do not belong there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .proofread import leftmost_longest, word_list_hits

#: Words after a name that make it part of another one, and words of comparison beside which other places are fine.
PART_OF = "路|街|大道|桥|站|镇|村|大学|银行|机场|高速"
COMPARED = "对比|参照|借鉴|类似|相比|毗邻|距离|来自|产自"


def place_hits(rows: DataFrame, divisions: DataFrame, most_literals: int = 200) -> DataFrame:
    """doc_id, index, start, end, name: names of the gazetteer (name) in the paragraphs, leftmost longest."""
    words = divisions.select(F.col("name").alias("wrong"), F.col("name").alias("right")).distinct()
    kept = leftmost_longest(word_list_hits(rows, words, most_literals=most_literals).select("doc_id", "index", "start", "end"), ["doc_id", "index"])
    return kept.join(rows.select("doc_id", "index", "text"), ["doc_id", "index"]).select("doc_id", "index", "start", "end", F.expr("substring(text, start + 1, `end` - start)").alias("name"), "text")


def main_place(hits: DataFrame, divisions: DataFrame, sizes: DataFrame, least: int = 2, head: int = 10, share: float = 0.15) -> DataFrame:
    """doc_id, name, province, city: the place named most often, at least `least` times, in the first paragraphs (`head`
    of them or a share of all); districts before cities, earlier before later. sizes: (doc_id, n_paragraphs)."""
    near = hits.join(sizes, "doc_id").filter(F.col("index") < F.greatest(F.lit(head), F.ceil(F.col("n_paragraphs") * share)))
    counts = near.join(divisions.filter("not ambiguous"), "name").groupBy("doc_id", "name", "level", "province", "city").agg(F.count("*").alias("n"), F.min(F.struct("index", "start")).alias("at"))
    order = W.partitionBy("doc_id").orderBy((F.col("level") == "district").desc(), F.desc("n"), "at")
    return counts.filter(F.col("n") >= least).withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("doc_id", "name", "level", "province", "city", "n")


def foreign_places(hits: DataFrame, divisions: DataFrame, project: DataFrame) -> DataFrame:
    """Hits of sibling places: districts of the project's city, or cities of its province, other than its own.

    project: (doc_id, own: names that belong to the project, province, city). Names inside longer names and sentences that
    compare do not count. severity is error where the sentence speaks of the project itself.
    """
    known = hits.join(divisions.select("name", "level", "province", "city", "ambiguous"), "name").filter("not ambiguous")
    rows = known.join(project.select("doc_id", "own", F.col("province").alias("_p"), F.col("city").alias("_c")), "doc_id")
    sibling = ((F.col("level") == "district") & (F.col("city") == F.col("_c"))) | ((F.col("level") == "city") & (F.col("province") == F.col("_p")))
    rest = F.expr("substring(text, `end` + 1)")
    before, after = F.regexp_extract(F.expr("left(text, start)"), "([^。！？；]*)$", 1), F.regexp_extract(rest, "^([^。！？；]*)", 1)
    sentence = F.concat(before, "name", after)
    rows = rows.filter(sibling & ~F.array_contains("own", F.col("name")) & ~rest.rlike(f"^(?:{PART_OF})") & ~sentence.rlike(COMPARED))
    return rows.select("doc_id", "index", "start", "end", F.col("name").alias("original"), F.when(sentence.rlike("本项目|项目位于|建设地点|项目所在地"), "error").otherwise("warning").alias("severity"))
