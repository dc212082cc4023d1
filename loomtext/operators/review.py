"""Review feedback: cases and their outcomes, reviewers and their names, context of a paragraph, reuse of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import since_latest


def outcomes(cases: DataFrame, decided: DataFrame) -> DataFrame:
    """cases with the decisions (id, final_text, rejected): accepted where the text is the suggestion, else edited."""
    d = decided.select("id", F.col("final_text").alias("_f"), "rejected")
    rows = cases.join(d, "id", "left")
    action = F.when(F.col("rejected").isNull(), F.col("action")).when(F.col("rejected"), "rejected").when(F.col("_f").eqNullSafe(F.col("suggestion")), "accepted").otherwise("edited")
    return rows.withColumns({"action": action, "final_text": F.when(F.col("rejected").isNotNull() & ~F.col("rejected"), F.col("_f")).otherwise(F.col("final_text"))}).select(*cases.columns)


def due_profiles(cases: DataFrame, profiles: DataFrame, least: int) -> DataFrame:
    """reviewer_id, n_since of the reviewers with at least `least` decided cases since their last profile."""
    facts = cases.filter("action <> 'pending' and reviewer_id is not null").select("reviewer_id", "updated_at")
    return since_latest(facts, profiles.select("reviewer_id", "created_at"), "reviewer_id", "updated_at", "created_at").filter(F.col("n_since") >= least)


def assigned(aliases: DataFrame, author: DataFrame, generic: list[str]) -> DataFrame:
    """aliases with new assignments (author, initials, doc_key, reviewer_id), each also without initials; those of
    generic authors hold in their document only, those of others everywhere. A later one replaces an earlier one."""
    new = author.withColumn("initials", F.explode(F.array_distinct(F.array("initials", F.lit("")))))
    is_generic = F.lower(F.trim("author")).isin(generic) | (F.trim("author") == "")
    new = new.withColumn("doc_key", F.when(is_generic, F.col("doc_key")))
    both = aliases.withColumn("_s", F.lit(0)).unionByName(new.select(*aliases.columns).withColumn("_s", F.lit(1)))
    last = W.partitionBy("author", "initials", "doc_key").orderBy(F.desc("_s"), "reviewer_id")
    return both.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select(*aliases.columns)


def merged_reviewers(aliases: DataFrame, cases: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """(aliases, cases) with the source reviewer's rows as the target's; where both have an alias, the moved one holds."""
    moved = aliases.withColumn("_s", (F.col("reviewer_id") == source).cast("int")).withColumn("reviewer_id", F.when(F.col("reviewer_id") == source, F.lit(target)).otherwise(F.col("reviewer_id")))
    last = W.partitionBy("author", "initials", "doc_key").orderBy(F.desc("_s"))
    kept = moved.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select(*aliases.columns)
    return kept, cases.withColumn("reviewer_id", F.when(F.col("reviewer_id") == source, F.lit(target)).otherwise(F.col("reviewer_id")))


def refreshed(old: DataFrame, fetched: DataFrame, key: str, manual: str) -> DataFrame:
    """A fetched list in place of the old one; rows with manual data stay, and keep it where they were fetched again."""
    mine = old.filter(F.col(manual).isNotNull())
    again = fetched.join(mine.select(key, F.col(manual).alias("_m")), key, "left").withColumn(manual, F.col("_m")).select(*old.columns)
    return again.unionByName(mine.join(fetched.select(key), key, "left_anti"))


def first_copies(rows: DataFrame) -> DataFrame:
    """rows with first: the index of the document's first paragraph with the same trimmed text."""
    return rows.withColumn("first", F.min("index").over(W.partitionBy("doc_id", F.trim("text"))))


def shared_findings(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """Issues of first paragraphs, and the same for each of their copies. rows: the result of first_copies."""
    places = rows.select("doc_id", F.col("index").alias("_i"), F.col("first").alias("index"))
    return issues.join(places, ["doc_id", "index"]).withColumn("index", F.col("_i")).drop("_i").select(*issues.columns)


def neighbours(rows: DataFrame, n: int = 2) -> DataFrame:
    """Paragraphs that are not blank with the texts of the n such before and after them."""
    filled = rows.filter(F.trim(F.regexp_replace("text", r"(?U)\s", "")) != "")
    by = W.partitionBy("doc_id").orderBy("index")
    return filled.withColumns({"before": F.collect_list("text").over(by.rowsBetween(-n, -1)), "after": F.collect_list("text").over(by.rowsBetween(1, n))})


def quoted(findings: DataFrame, rows: DataFrame, exact: bool = True) -> DataFrame:
    """Findings (doc_id, index, quote) whose quote stands in their paragraph; not exact: whatever the space and quotes."""
    plain = lambda c: c if exact else F.regexp_replace(c, r"(?U)[\s\"'“”‘’「」『』]", "")
    both = findings.join(rows.select("doc_id", "index", F.col("text").alias("_t")), ["doc_id", "index"])
    return both.filter((plain(F.col("quote")) != "") & F.contains(plain(F.col("_t")), plain(F.col("quote")))).drop("_t")


def quotes_of_runs(comments: DataFrame, runs: DataFrame) -> DataFrame:
    """Comment ranges (path, id, paragraph, start, end) met with runs (path, paragraph, start, end, text): each shared
    stretch and its text."""
    a, b = comments.alias("a"), runs.alias("b")
    meet = (F.col("a.path") == F.col("b.path")) & (F.col("a.paragraph") == F.col("b.paragraph")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    lo, hi = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    return a.join(b, meet).select("a.path", "a.id", "a.paragraph", lo.alias("start"), hi.alias("end"), F.substring(F.col("b.text"), lo - F.col("b.start") + 1, hi - lo).alias("text"))
