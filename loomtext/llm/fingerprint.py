"""Document fingerprints by improved consistent weighted sampling. Native DataFrame functions only.

A text's terms are its words (by a 64-bit hash) with their counts w as weights. For each sample k and term, r and c are
gamma(2, 1) and beta is uniform, all from hashes of (term, k). With t = floor(ln w / r + beta), the term of the least
ln c - r (t - beta) - r is drawn, and (term, t) is the sample. Two texts draw the same sample k with a probability that
equals their generalised Jaccard similarity, the sum of least weights over the sum of greatest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, stored

#: The standard error of a likeness is sqrt(s (1 - s) / SAMPLES): 0.0625 at most.
SAMPLES = 64
#: Samples drawn in one aggregate. With more, the code of one would pass 8,000 bytes, beyond which the JVM only interprets it.
AT_ONCE = 4
#: Bits of a sample that a fingerprint keeps: two different samples look equal once in 65,536 times.
KEPT_BITS = 16


def words(text: Column) -> Column:
    """The text cut at each space and control character from 0x09 to 0x0D; empty strings where two meet."""
    return F.split(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\v\f\r", text), " ")


def sample_keys(rows: DataFrame, count: int) -> DataFrame:
    """From rows with term, first (a sample's number) and log_w (of the weight): k0, k1 and on for `count` samples from first.

    A key has the rank ln a in the high bits and KEPT_BITS of the hash of (term, t) in the low ones. Steps are columns of
    their own, so that each is computed once.
    """
    # three 21-bit numbers of one hash, two of another; never 0
    part = lambda x, i: f"((shiftrightunsigned({x}, {21 * i}) & 2097151L) + 0.5D)"
    log2 = lambda x: f"ln({part(x, 0)} * {part(x, 1)} / 4398046511104.0D)"  # of a product of two uniforms
    ks = range(count)
    rows = rows.withColumns({f"{c}{k}": F.expr(f"xxhash64(term, 2L * first + {2 * k + i}L)") for k in ks for i, c in enumerate("hg")})
    rows = rows.withColumns({f"minus_r{k}": F.expr(log2(f"h{k}")) for k in ks} | {f"beta{k}": F.expr(f"{part(f'h{k}', 2)} / 2097152.0D") for k in ks})
    rows = rows.withColumns({f"t{k}": F.expr(f"cast(floor(beta{k} - log_w / minus_r{k}) as double)") for k in ks})
    # ranks lie within 512 of 0: the logarithms are of 42-bit numbers
    rank = lambda k: f"ln(-{log2(f'g{k}')}) + minus_r{k} * (t{k} - beta{k} + 1.0D)"
    return rows.withColumns({f"k{k}": F.expr(f"shiftleft(cast(({rank(k)} + 512.0D) * 268435456.0D as bigint), {KEPT_BITS}) | (xxhash64(h{k}, t{k}) & {(1 << KEPT_BITS) - 1}L)") for k in ks})


def following(ids: DataFrame, parts: int) -> DataFrame:
    """doc_id and next_id: the id before it in descending order; the smallest is followed by the largest.

    Ids are dealt out by ranges, stored with their range's number and ordered within each; the first of a range comes from
    the next range that has rows. The ends of the ranges, one row each, meet in one window.
    """
    ranged = stored(ids.repartitionByRange(parts, "doc_id").withColumn("p", F.spark_partition_id()), "ranges")
    inner = ranged.withColumn("before", F.lag("doc_id").over(W.partitionBy("p").orderBy("doc_id")))
    ends = ranged.groupBy("p").agg(F.max("doc_id").alias("top"))
    largest = ends.agg(F.max("top")).first()[0]
    edges = ends.select("p", F.coalesce(F.lag("top").over(W.orderBy("p")), F.lit(largest).cast("long")).alias("edge"))
    return inner.join(F.broadcast(edges), "p").select("doc_id", F.coalesce("before", "edge").alias("next_id"))  # a row a range


def signed(texts: DataFrame, a: str, b: str, samples: int = SAMPLES) -> DataFrame:
    """doc_id and, for each of two text columns, an array of its samples of the same name, null for a text without words.

    If the rows are dealt out by doc_id, nothing is shuffled: words are counted and samples drawn in place. A term that
    has the same weight in both texts is drawn for once. Samples are drawn by runs of AT_ONCE, each a copy of the terms.
    """
    each = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).alias("t")) for i, c in enumerate((a, b))))
    found = texts.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.c", F.explode(words(F.col("e.t"))).alias("word")).filter("word <> ''")
    counts = found.groupBy("doc_id", F.xxhash64("word").alias("term")).agg(*(F.count_if(F.col("c") == i).alias(f"w{i}") for i in range(2)))
    weight = lambda w, in_a, in_b: f"named_struct('w', {w}, 'in_a', {in_a}, 'in_b', {in_b})"
    weights = F.expr(f"if(w0 = w1, array({weight('w0', 'true', 'true')}), filter(array({weight('w0', 'true', 'false')}, {weight('w1', 'false', 'true')}), x -> x.w > 0))")
    terms = counts.select("doc_id", "term", F.explode(weights).alias("x")).select("doc_id", "term", F.log("x.w").alias("log_w"), "x.in_a", "x.in_b")
    size = min(samples, AT_ONCE)
    runs = terms.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // size)))).withColumn("first", (F.col("run") * size).cast("long"))
    keys = sample_keys(runs, size)
    least = keys.groupBy("doc_id", "run").agg(*(F.min(F.when(F.col(f"in_{c}"), F.col(f"k{k}"))).alias(f"{c}{k}") for k in range(size) for c in "ab"))
    low = lambda c: F.when(F.col(f"{c}0").isNotNull(), F.array(*(F.expr(f"cast(({c}{k} & {(1 << KEPT_BITS) - 1}L) - {1 << KEPT_BITS - 1} as smallint)") for k in range(size))))
    drawn = least.select("doc_id", "run", low("a").alias("a"), low("b").alias("b"))
    joined = drawn.groupBy("doc_id").agg(*(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("run", F.col(c).alias("s"))))).alias(c) for c in "ab"))
    return joined.select("doc_id", *(F.when(F.size(c) > 0, F.slice(F.flatten(F.col(f"{c}.s")), 1, samples)).alias(name) for c, name in (("a", a), ("b", b))))


def text_of(fingerprint: Column) -> Column:
    """A fingerprint as a string: four hexadecimal digits a sample; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x.cast("int") + (1 << KEPT_BITS - 1)), KEPT_BITS // 4, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 if only one has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / samples)


def compare_edits(docs: DataFrame, parts: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third of code points is replaced by the first as many of
    the next document's in descending id order (after the last: the first).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty; a
    text without words has an empty fingerprint. A row repeated with its id counts once; rows without an id are left
    out. A single document follows itself.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = W.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    # the drawing takes long for few bytes: a number of parts that adaptive execution does not lower
    docs = id_text(docs, id_col, text_col).repartition(parts, "doc_id")
    sizes = docs.groupBy("doc_id").agg(F.min_by(F.length("text"), F.xxhash64("text")).alias("n"))
    docs = docs.withColumn("_k", F.row_number().over(one)).filter("_k = 1").drop("_k")
    after = stored(following(sizes.select("doc_id"), parts), "following")
    # each document learns which document it follows, and how much of its beginning that one takes
    follows = after.join(sizes, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), F.expr("n div 3").alias("take"))
    tails = docs.join(follows, "doc_id").select(F.col("for_id").alias("doc_id"), F.expr("left(text, take)").alias("tail"), "take")
    both = docs.join(tails, "doc_id").select("doc_id", "text", F.concat(F.expr("left(text, length(text) - take)"), "tail").alias("edited"))
    plain = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    prints = stored(plain.join(signed(both, "text", "edited"), "doc_id", "left"), "fingerprints")
    nexts = after.join(prints.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next")), "next_id").select("doc_id", "next")
    return prints.join(nexts, "doc_id").select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("text")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("next")).alias("near_next"),
    )
