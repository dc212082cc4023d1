"""Fill-in-the-middle: each text is cut into prefix, middle and suffix at places drawn from its id, and arranged with
sentinels. Built-in SQL functions only; every document is arranged within its row, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or white space alone; fixed by the contract, like the sentinels.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(seed: int, id_col: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arrange(docs: DataFrame, seed: int = 42, plain_from: int = 50, spm_below: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, text, output.

    plain_from, spm_below: per cent of documents that are arranged, and of these the share in order suffix, prefix,
    middle. A null text is empty; an empty text and one that holds a sentinel stay plain. A row without an id draws from
    the seed alone; repeated rows come out alike; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = draws(seed, id_col)
    # the draws are made before the units, in a projection of their own: each is used more than once
    drawn = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *(x.alias(f"_h{i + 1}") for i, x in enumerate(h)))
    units = drawn.withColumn("_u", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).withColumn("n", F.size("_u"))
    cuts = units.withColumns({"_a": F.least(F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)).cast("int"), "_b": F.greatest(F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)).cast("int")})
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (F.col("_h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_below, "spm").otherwise("psm")

    def joined(first: Column, count: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_u", first, count), ""))

    formed = cuts.withColumn("form", form)
    parts = formed.select("doc_id", F.col("n").cast("long").alias("n"), "form", "text", joined(F.lit(1), F.col("_a")).alias("_p"), joined(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("_m"), joined(F.col("_b") + 1, F.col("n") - F.col("_b")).alias("_s"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "_p", F.lit(SUFFIX), "_s", F.lit(MIDDLE), "_m"))
        .otherwise(F.concat(F.lit(SUFFIX), "_s", F.lit(PREFIX), "_p", F.lit(MIDDLE), "_m"))
    )
    return parts.select("doc_id", "n", "form", F.length("_p").cast("long").alias("prefix_chars"), F.length("_m").cast("long").alias("middle_chars"), "text", output.alias("output"))


def restore(arranged: DataFrame) -> DataFrame:
    """arranged (form, output) with restored, the text rebuilt from these two. Pieces of an arranged text hold no
    sentinel, and none can arise where a piece meets one: no proper beginning of a sentinel is an end of another. So the
    output falls apart at the sentinels. A null output or form gives null or the output as it is."""
    pieces = arranged.withColumn("_x", F.when(F.col("form").isin("psm", "spm"), F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}")))

    def joined(*at: int) -> Column:
        return F.concat(*(F.get("_x", F.lit(i)) for i in at))

    whole = F.when(F.col("form") == "psm", joined(1, 3, 2)).when(F.col("form") == "spm", joined(2, 3, 1)).otherwise(F.col("output"))
    return pieces.withColumn("restored", whole).drop("_x")


def digests(arranged: DataFrame) -> DataFrame:
    """The arrangement with sha256 of its output and of the text rebuilt from it, in place of both texts."""
    return restore(arranged).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
