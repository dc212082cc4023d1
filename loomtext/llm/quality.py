"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the stored bits.

Native DataFrame functions only. Each document is measured within its row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of characters other than these; fixed by the contract.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits. Each is true where a document fails; thresholds are parameters of the ledger.
#: few_words and repeats are the base; the others are thresholds that running prose in Latin scripts stays far from.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
    "short_lines": "n_lines >= 20 and n_words < 2 * n_lines",
}
BASE = ("few_words", "repeats")
#: Versioned policies: names of the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"v1": (*BASE, "symbols"), "v2": (*BASE, "symbols", "dup_lines", "word_length"), "v3": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """doc_id and the measurements of each text; with whole_rows also row, a struct of the input's columns, and nth, a
    number that rises with the row.

    A null or empty text has no words and measures 0 everywhere; a row without id is measured with a null id; repeated
    rows are measured each. n_repeat_words: the windows of three words are sorted by hash and position, neighbours of
    equal hash are repeats, and the words that they cover are counted from the sorted positions.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = ["row"] if whole_rows else []
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole_rows else []
    words = docs.select(*row, F.col(id_col).cast("long").alias("doc_id"), text.alias("_t"), F.array_remove(F.split(text, SPACE), "").alias("_w"))
    windows = words.select(
        *keep,
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(F.size("_w") < 3, F.array().cast("array<struct<h:bigint,i:int>>"))
        .otherwise(F.sort_array(F.expr("transform(sequence(0, greatest(size(_w), 3) - 3), i -> named_struct('h', xxhash64(_w[i], _w[i + 1], _w[i + 2]), 'i', i))")))
        .alias("_s"),
    )
    repeats = windows.select(
        *keep,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.expr("transform(filter(_s, (x, k) -> x.h = get(_s, k - 1).h or x.h = get(_s, k + 1).h), x -> x.i)")).alias("_p"),
    )
    covered = F.expr("aggregate(transform(_p, (p, k) -> least(3, coalesce(get(_p, k + 1) - p, 3))), 0L, (a, x) -> a + x)")
    # a filter on the results must not be moved below this, where each measurement would be made once for every rule
    keep += [F.monotonically_increasing_id().alias("nth")] if whole_rows else []
    return repeats.select(*keep, "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def failed_bits(rules: Mapping[str, str] = RULES) -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(rules.values())]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out.cast("long")


def ledger(docs: DataFrame, policy: str = "v1", **cols) -> DataFrame:
    """Measurements, failed (the bits of RULES), base_failed and kept under the policy: one row a document."""
    out = measure(docs, **cols).withColumn("failed", failed_bits())
    return out.withColumn("base_failed", F.col("failed").bitwiseAND(mask(BASE)) != 0).withColumn("kept", F.col("failed").bitwiseAND(mask((*BASE, *POLICIES[policy]))) == 0)


def accepted(docs: DataFrame, policy: str = "v1", **cols) -> DataFrame:
    """The rows of docs, all columns, that the policy keeps."""
    return ledger(docs, policy, whole_rows=True, **cols).filter("kept and nth >= 0").select("row.*")


def ablation(led: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: documents rejected, and those that only this rule rejects.

    One bitwise aggregation over the stored bits; no rule is evaluated again.
    """
    counts = led.groupBy("failed").count()
    rows = [(p, r, mask(rules), mask((r,))) for p, rules in policies.items() for r in rules]
    plan = led.sparkSession.createDataFrame(rows, "policy string, rule string, policy_mask long, rule_mask long")
    joined = counts.join(F.broadcast(plan), F.col("failed").bitwiseAND(F.col("rule_mask")) != 0)  # at most policies x rules rows
    alone = F.col("failed").bitwiseAND(F.col("policy_mask")) == F.col("rule_mask")
    return joined.groupBy("policy", "rule").agg(F.sum("count").alias("n_failed"), F.sum(F.when(alone, F.col("count")).otherwise(0)).alias("n_only"))
