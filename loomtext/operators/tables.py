"""Table maintenance: dedupe, merges, upserts, look-ups and counts over immutable tables. Each returns a new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_originals(docs: DataFrame, id_col: str, content: Column) -> DataFrame:
    """id, sha256, original (the least id with the same content), is_copy. Hashes are grouped, never the content."""
    keys = docs.select(F.col(id_col), F.sha2(content.cast("binary"), 256).alias("sha256"))
    first = keys.groupBy("sha256").agg(F.min(id_col).alias("original"))
    return keys.join(first, "sha256").select(id_col, "sha256", "original", (F.col(id_col) != F.col("original")).alias("is_copy"))


def new_content(docs: DataFrame, catalog: DataFrame, key: str = "sha256") -> DataFrame:
    return docs.join(catalog.select(key).distinct(), key, "left_anti")


def only_ids(rows: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """None keeps all rows; an empty set of ids keeps none."""
    return rows if ids is None else rows.join(ids.select(key).distinct(), key, "left_semi")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of the rows of a key in both tables, the one latest by `order`; new before old, where they tie."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    by = W.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_src").desc())
    return both.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "_src")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def null_safe_append(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys (nulls equal nulls) old has not; repeats within new count once."""
    mine, other = new.dropDuplicates(keys).alias("n"), old.select(*keys).distinct().alias("o")
    same = reduce(lambda a, b: a & b, (F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys))
    return mine.join(other, same, "left_anti")


def merge_if_newer(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of source newer than the newest of their key in target, or of a key that target has not."""
    newest = target.groupBy(*keys).agg(F.max(order).alias("_newest"))
    return source.join(newest, keys, "left").filter(F.col("_newest").isNull() | (F.col(order) > F.col("_newest"))).drop("_newest")


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Delete the ids (one column) from every table by its key column."""
    key = gone.columns[0]
    return {name: df.join(gone.select(F.col(key).alias(col)).distinct(), col, "left_anti") for name, (df, col) in tables.items()}


#: How much of each kind a request shows at most; fixed values.
SHOWN = {"citations": 60, "conflicts": 30, "findings": 15}


def shown(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group in an order, with their place from 1 and how many the group has."""
    place = W.partitionBy(*group).orderBy(*order)
    return rows.withColumns({"place": F.row_number().over(place), "of": F.count("*").over(W.partitionBy(*group))}).filter(F.col("place") <= most)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def next_versions(existing: DataFrame, new: DataFrame, key: str, version: str, order: list[Column]) -> DataFrame:
    """Number new rows of a key on from its last version."""
    last = existing.groupBy(key).agg(F.max(version).alias("_last"))
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return new.join(last, key, "left").withColumn(version, F.coalesce("_last", F.lit(0)) + n).drop("_last")


def pending(items: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Items without a result, in order of their key."""
    left = items.join(done.select(key).distinct(), key, "left_anti").orderBy(key)
    return left.limit(limit) if limit is not None else left


def first_wins(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """The first row of each key by place (dropDuplicates has no order)."""
    return latest(rows, keys, [F.col(p) for p in place])


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str], now: Column, days: int, created: str = "created_at", result: str = "result") -> DataFrame:
    """wanted with the cached result of its keys, null where there is none or it is too old."""
    fresh = cache.filter(F.col(created) >= now - F.expr(f"interval {days} days")).select(*keys, result)
    return wanted.join(fresh, keys, "left")


def by_precedence(wanted: DataFrame, sources: dict[str, DataFrame], key: str, defaults: dict[str, object]) -> DataFrame:
    """wanted (key) with each field of defaults from the first source that has it, else the default; and source: where the
    first of the fields came from ("default" where no source has it). sources come in their order; of a key they have one
    row and any of the fields."""
    out, fields = wanted.select(key), list(defaults)
    for i, (_, rows) in enumerate(sources.items()):
        has = [f for f in fields if f in rows.columns]
        out = out.join(rows.select(key, *(F.col(f).alias(f"_{i}_{f}") for f in has)), key, "left")
    of = lambda f: [(name, F.col(f"_{i}_{f}")) for i, (name, rows) in enumerate(sources.items()) if f in rows.columns]
    origin = F.coalesce(*(F.when(c.isNotNull(), name) for name, c in of(fields[0])), F.lit("default"))
    return out.select(key, *(F.coalesce(*(c for _, c in of(f)), F.lit(defaults[f])).alias(f) for f in fields), origin.alias("source"))


def resolve_alias(pairs: DataFrame, aliases: DataFrame, reviewers: DataFrame, generic: list[str]) -> DataFrame:
    """reviewer_id of each (author, initials, doc_key).

    aliases: (author, initials, doc_key or null for all documents, reviewer_id). A document's own rows come before
    those for all documents, which generic authors do not have; then the same with empty initials; then a reviewer
    named like the author.
    """
    is_generic = lambda c: F.lower(F.trim(c)).isin(generic) | (F.trim(c) == "")
    usable = aliases.filter(F.col("doc_key").isNotNull() | ~is_generic(F.col("author")))
    own = usable.filter("doc_key is not null")
    everywhere = usable.filter("doc_key is null").drop("doc_key")
    out = pairs
    for name, initials in (("exact", F.col("initials")), ("blank", F.lit(""))):
        a = own.select("author", F.col("initials").alias("_i"), "doc_key", F.col("reviewer_id").alias(f"own_{name}"))
        b = everywhere.select("author", F.col("initials").alias("_i"), F.col("reviewer_id").alias(f"all_{name}"))
        out = out.withColumn("_i", initials).join(a, ["author", "_i", "doc_key"], "left").join(b, ["author", "_i"], "left").drop("_i")
    named = reviewers.select(F.col("id").alias("by_name"), F.col("name").alias("_n"))
    out = out.join(named, F.trim("author") == F.col("_n"), "left")
    by_name = F.when(~is_generic(F.col("author")), F.col("by_name"))
    return out.select(*pairs.columns, F.coalesce("own_exact", "all_exact", "own_blank", "all_blank", by_name).alias("reviewer_id"))


def judged(answers: DataFrame, weights: dict[str, float], hard: dict[str, float], soft: float, threshold: Column) -> DataFrame:
    """Weighted confidence of each case (case_id, item, value) and whether it passed: confidence at the threshold, hard
    items at theirs, the others at `soft`."""
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value")))
    weight = F.coalesce(*(F.when(F.col("item") == i, F.lit(w)) for i, w in weights.items()), F.lit(0.0))
    least = F.coalesce(*(F.when(F.col("item") == i, F.lit(v)) for i, v in hard.items()), F.lit(soft))
    is_hard = F.col("item").isin(list(hard))
    out = answers.groupBy("case_id").agg(F.round(F.sum(weight * value), 9).alias("confidence"), F.bool_and((value >= least) | ~is_hard).alias("hard_passed"), F.count_if(value < least).alias("n_failed"))
    return out.withColumn("passed", F.col("hard_passed") & (F.col("confidence") >= threshold))


def expected_level(probabilities: Column) -> Column:
    """Expected index of a distribution, negative values as 0, rescaled to sum to 1; null if nothing is left."""
    p = F.transform(probabilities, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, weighted / total)


def since_latest(facts: DataFrame, marks: DataFrame, key: str, fact_time: str, mark_time: str) -> DataFrame:
    """How many facts of each key lie at or after its latest mark; all of them where it has none."""
    last = marks.groupBy(key).agg(F.max(mark_time).alias("_last"))
    late = F.col("_last").isNull() | (F.col(fact_time) >= F.col("_last"))
    return facts.join(last, key, "left").groupBy(key).agg(F.count_if(late).alias("n_since"))
