"""Table maintenance queries: merges, versions, counts, look-ups, on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phrases import preferred_first
from ..operators import merge
from ..operators import tables as O
from ..operators.storage import shared_path
from ..operators.structure import hard_cuts
from ..sources.files import read_current, replace_all, restore_backup
from .registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.query("""select doc_id, sha256(text) as sha256, min(doc_id) over (partition by sha256(text)) as original, doc_id <> min(doc_id) over (partition by sha256(text)) as is_copy from documents""")
def sha_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.content_originals(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@R.query("select l_orderkey, l_linenumber, o_orderstatus, c_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey")
def hit_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way inner join of hits with their parents and owners."""
    l, o, c = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    hits = l.select("l_orderkey", "l_linenumber")
    rows = hits.join(o.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name")


@R.query("select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@R.query("select count(vec_id) as embedded, count(*) as total from documents left join embeddings on vec_id = doc_id")
def embedding_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(e, F.col("vec_id") == F.col("doc_id"), "left").agg(F.count("vec_id").alias("embedded"), F.count("*").alias("total"))


@R.query("select n_name, count(c_custkey) as n_customers from nation left join customer on c_nationkey = n_nationkey group by 1")
def per_model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n_customers"))


@R.query("""select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders, coalesce((select max(o_orderkey) from orders where o_custkey = c_custkey), 0) as last_order from customer""")
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("m", F.lit(0)).alias("last_order"))


@R.query("""with m as (select user_id, max(ts) as last from events where event_type = (select min(event_type) from events) group by 1)
    select user_id, count(*) filter (where last is null or ts >= last) as n_since from events left join m using (user_id) group by 1""")
def since_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    kind = e.agg(F.min("event_type").alias("event_type"))
    marks = e.join(F.broadcast(kind), "event_type").select("user_id", F.col("ts").alias("mark"))  # kind: one row
    return O.since_latest(e, marks, "user_id", "ts", "mark")


@R.query("select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@R.query("""with old as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as version from orders where o_orderkey % 2 = 0)
    select o_orderkey, o_custkey, coalesce(m, 0) + row_number() over (partition by o_custkey order by o_orderkey) as version
    from orders left join (select o_custkey, max(version) as m from old group by 1) using (o_custkey) where o_orderkey % 2 = 1""")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    old = O.next_versions(o.filter("false").withColumn("version", F.lit(0)), o.filter("o_orderkey % 2 = 0"), "o_custkey", "version", [F.col("o_orderkey")])
    return O.next_versions(old, o.filter("o_orderkey % 2 = 1"), "o_custkey", "version", [F.col("o_orderkey")])


@R.query("""select o_custkey, o_orderkey, o_orderpriority from (select *, 0 as s from orders where o_orderkey % 3 <> 0 union all select *, 1 from orders where o_orderkey % 3 <> 1)
    qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey desc, s desc) = 1""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return O.last_wins(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@R.query("""select doc_id, quality from labels where doc_id % 2 = 0 union all select doc_id, 1 - quality from labels where doc_id % 3 = 0 and doc_id % 2 <> 0""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return O.insert_or_ignore(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality")), ["doc_id"])


@R.query("""with e as (select case when user_id % 5 = 0 then null else user_id end as u, event_type as t from events),
    o as (select distinct * from e where t < 'm')
    select coalesce(u, -1) as u, t from (select distinct * from (select u, case when t >= 'm' then t else 'zz' end as t from e union all select * from o)) n
    where not exists (select 1 from o where o.u is not distinct from n.u and o.t = n.t)""")
def null_safe_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("u"), F.col("event_type").alias("t"))
    old = e.filter("t < 'm'")
    new = e.withColumn("t", F.when(F.col("t") >= "m", F.col("t")).otherwise("zz")).unionByName(old)
    return O.null_safe_append(old, new, ["u", "t"]).withColumn("u", F.coalesce("u", F.lit(-1)))


@R.query("""with t as (select o_custkey, max(o_orderdate) as newest from orders where o_orderkey % 2 = 0 group by 1)
    select o_orderkey, o_custkey from orders left join t using (o_custkey) where o_orderkey % 2 = 1 and (newest is null or o_orderdate > newest)""")
def merge_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return O.merge_if_newer(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderdate").select("o_orderkey", "o_custkey")


@R.query("""select 'customer' as "table", count(*) as n_left from customer where c_custkey % 10 <> 0 union all select 'orders', count(*) from orders where o_custkey % 10 <> 0""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    left = O.cascade_delete(c.filter("c_custkey % 10 = 0").select("c_custkey"), {"customer": (c, "c_custkey"), "orders": (o, "o_custkey")})
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n_left")) for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@R.query("""with a as (select doc_id, sha256(text) as h from documents where doc_id % 2 = 0), b as (select doc_id, sha256(text) as h from documents where doc_id % 2 = 1)
    select min(doc_id) as doc_id, h as sha256 from b where h not in (select h from a) group by h""")
def merge_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the other half has and this one lacks, each content once."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return O.new_content(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0")).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))


def base(spark: SparkSession, sf_dir: str, keep: str, names: list[tuple[int, str, int]]) -> dict[str, DataFrame]:
    """A knowledge base of the documents that `keep` picks: chunks of 400 characters, parents of four of them, and two
    models' vectors, the second's of half the length."""
    docs = table(spark, sf_dir, "documents").filter(keep)
    chunks = hard_cuts(docs).select(F.expr("doc_id * 1000 + chunk_no").alias("chunk_id"), "doc_id", F.expr("doc_id * 1000 + chunk_no div 4").alias("parent_id"), "start", "text")
    firsts = docs.select(F.expr("doc_id * 1000").alias("chunk_id"), F.col("doc_id").alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(firsts, "vec_id")
    whole = vectors.select("chunk_id", F.lit(1).cast("long").alias("model_id"), F.col("embedding").alias("vector"))
    half = vectors.select("chunk_id", F.lit(2).cast("long").alias("model_id"), F.slice("embedding", 1, 32).alias("vector"))
    return {
        "documents": docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.concat("source", F.lit("/?.txt")).alias("file_name"), F.lit("old").alias("stored_name")),
        "parents": chunks.select("parent_id", "doc_id").distinct(),
        "chunks": chunks,
        "models": spark.createDataFrame(names, "model_id long, name string, dim int"),
        "embeddings": whole.unionByName(half),
    }


OURS, THEIRS = [(1, "whole", 64), (2, "half", 16)], [(1, "half", 64), (2, "whole", 64)]
#: Half of the documents, and a third with ids that clash; what comes in follows on in the old order.
MERGE_SQL = """with recursive o as (select doc_id, sha256(text) as h, source, text from documents where doc_id % 2 = 0), t as (select doc_id, sha256(text) as h, source, text from documents where doc_id % 3 = 0),
    n as (select * from t where h not in (select h from o) qualify row_number() over (partition by h order by doc_id) = 1),
    d as (select doc_id as old, doc_id, source, text, true as own from o union all select doc_id, (select max(doc_id) from o) + row_number() over (order by doc_id), source, text, false from n),
    c as (select old, doc_id, own, old * 1000 + i as chunk_id, old * 1000 + i // 4 as parent_id, i * 400 as start, substr(text, i * 400 + 1, 400) as text from (select *, unnest(range(0, (length(text) + 399) // 400)) as i from d)),
    p as (select parent_id, (select max(parent_id) from c where own) + row_number() over (order by parent_id) as new from (select distinct parent_id from c where not own)),
    m as (select c.old, c.doc_id, own, c.chunk_id as was, case when own then c.chunk_id else (select max(chunk_id) from c where own) + row_number() over (partition by own order by chunk_id) end as chunk_id, case when own then c.parent_id else p.new end as parent_id, start, text
        from c left join p using (parent_id))"""


@R.query(f"""{MERGE_SQL}, v as (select chunk_id, count(*) as n from m join embeddings on was = vec_id * 1000 and old = vec_id, (select unnest([1, 2]) as model) where own group by 1)
    select doc_id::bigint as doc_id, chunk_id::bigint as chunk_id, parent_id::bigint as parent_id, start::int as start, length(text)::int as n_chars, coalesce(v.n, 0)::bigint as n_vectors from m left join v using (chunk_id)""")
def merged_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a merged base with all their ids, and how many vectors they have. The other base calls a model of
    another length half, and whole one whose vectors have half the length, so none of its vectors can be taken."""
    merged, _ = merge.merged_bases(base(spark, sf_dir, "doc_id % 2 = 0", OURS), base(spark, sf_dir, "doc_id % 3 = 0", THEIRS))
    counts = merged["embeddings"].groupBy("chunk_id").agg(F.count("*").alias("n_vectors"))
    rows = merged["chunks"].join(counts, "chunk_id", "left")
    return rows.select("doc_id", "chunk_id", "parent_id", "start", F.length("text").alias("n_chars"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))


@R.query(f"""{MERGE_SQL}, e as (select count(*) as n from m join embeddings on was = vec_id * 1000 and old = vec_id where not own)
    select 'documents skipped' as what, '' as name, (select count(*) from t) - (select count(*) from n) as n union all select 'documents added', '', count(*) from n union all select 'chunks added', '', count(*) from m where not own
    union all select 'embeddings added', '', n from e union all select 'model skipped', 'half', 1""")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge took and what it left: the first model's vectors come in under its number here."""
    theirs = base(spark, sf_dir, "doc_id % 3 = 0", [(1, "whole", 64), (2, "half", 32)])
    return merge.merged_bases(base(spark, sf_dir, "doc_id % 2 = 0", OURS), theirs)[1]


@R.query("""with a as (select count(*) as n, sum(doc_id)::bigint as ids from documents), b as (select count(*) as n, sum(doc_id)::bigint as ids from documents where doc_id % 2 = 0)
    select 1 as step, n, ids from a union all select 2, n, ids from b union all select 3, n, ids from b union all select 4, n, ids from a""")
def replace_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current documents after a first import, after one that replaces them, after one whose check fails, and after the
    backup was named current again."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "state")

    def state(step: int) -> DataFrame:
        return read_current(spark, path)["documents"].agg(F.lit(step).alias("step"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))

    def check(tables: dict[str, DataFrame]) -> None:
        if tables["documents"].filter("text is null").limit(1).count():
            raise ValueError("a document without text")

    replace_all(spark, {"documents": docs}, path, check)
    out = state(1)
    replace_all(spark, {"documents": docs.filter("doc_id % 2 = 0")}, path, check)
    out = out.unionByName(state(2))
    try:
        replace_all(spark, {"documents": docs.withColumn("text", F.lit(None).cast("string"))}, path, check)
    except ValueError:
        out = out.unionByName(state(3))
    restore_backup(spark, path)
    return out.unionByName(state(4))


@R.query("""with c as (select user_id, event_type, max(ts) as t from events group by 1, 2), now as (select max(ts) as now from events),
    w as (select distinct user_id + 1 as user_id, event_type from events)
    select user_id, event_type, coalesce(t >= now - interval 3 days, false) as hit from w cross join now left join c using (user_id, event_type)""")
def cache_ttl_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds that the user with the number before has do have an entry of the last three days of the table."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    now = F.broadcast(e.agg(F.max("ts").alias("_now")))  # one row
    cache = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("created_at")).withColumn("result", F.lit(True)).crossJoin(now)
    wanted = e.select((F.col("user_id") + 1).alias("user_id"), "event_type").distinct()
    return O.cached(wanted, cache, ["user_id", "event_type"], F.col("_now"), 3).select("user_id", "event_type", F.coalesce("result", F.lit(False)).alias("hit"))


@R.query("""with c as (select user_id, event_type, max(ts) as t from events group by 1, 2), now as (select max(ts) as now from events)
    select user_id, bool_and(t >= now - interval 3 days) as all_cached from c cross join now group by 1""")
def section_all_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    now = F.broadcast(e.agg(F.max("ts").alias("_now")))  # one row
    newest = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("created_at")).withColumn("result", F.lit(True)).crossJoin(now)
    rows = O.cached(newest.select("user_id", "event_type"), newest, ["user_id", "event_type"], F.col("_now"), 3)
    return rows.groupBy("user_id").agg(F.bool_and(F.coalesce("result", F.lit(False))).alias("all_cached"))


@R.query("""select c.conv_id, c.turn, coalesce(p.turn, c.turn) as parent, coalesce(p.role, c.role) as parent_role from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1""")
def reply_parent_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is a reply to the one before and takes what it lacks from it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("pt"), F.col("role").alias("pr"))
    return c.join(p, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("pt", "turn").alias("parent"), F.coalesce("pr", "role").alias("parent_role"))


@R.query("""with pairs as (select s_suppkey as case_id, s_name as author, (s_nationkey % 3)::varchar as initials, (s_suppkey % 4)::varchar as doc_key from supplier),
    al as (select s_name as author, case when s_suppkey % 2 = 0 then (s_nationkey % 3)::varchar else '' end as initials, case when s_suppkey % 3 = 0 then (s_suppkey % 4)::varchar end as doc_key, s_suppkey * 10 as rid from supplier where s_suppkey % 5 <> 0)
    select case_id, coalesce((select any_value(rid) from al a where a.author = p.author and a.initials = p.initials and a.doc_key = p.doc_key),
        (select any_value(rid) from al a where a.author = p.author and a.initials = p.initials and a.doc_key is null),
        (select any_value(rid) from al a where a.author = p.author and a.initials = '' and a.doc_key = p.doc_key),
        (select any_value(rid) from al a where a.author = p.author and a.initials = '' and a.doc_key is null), case_id * 1000) as reviewer_id from pairs p""")
def alias_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    pairs = s.select(F.col("s_suppkey").alias("case_id"), F.col("s_name").alias("author"), (F.col("s_nationkey") % 3).cast("string").alias("initials"), (F.col("s_suppkey") % 4).cast("string").alias("doc_key"))
    aliases = s.filter("s_suppkey % 5 <> 0").select(F.col("s_name").alias("author"), F.when(F.col("s_suppkey") % 2 == 0, (F.col("s_nationkey") % 3).cast("string")).otherwise("").alias("initials"), F.when(F.col("s_suppkey") % 3 == 0, (F.col("s_suppkey") % 4).cast("string")).alias("doc_key"), (F.col("s_suppkey") * 10).alias("reviewer_id"))
    reviewers = s.select((F.col("s_suppkey") * 1000).alias("id"), F.col("s_name").alias("name"))
    return O.resolve_alias(pairs, aliases, reviewers, ["author", "user"]).select("case_id", "reviewer_id")


@R.query("select role, count(*) as n, min(conv_id * 100 + turn) as first_seen from conversations group by 1")
def role_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.min(F.expr("conv_id * 100 + turn")).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@R.query("select quality, toxic, count(*) as n from labels group by 1, 2")
def issues_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@R.query("""with a as (select doc_id as case_id, unnest(['fact', 'form', 'meaning', 'tone']) as item, unnest([quality::double, 0.5 + 0.5 * toxic, 1.0 - toxic, (doc_id % 10) / 8.0::double]) as value from labels),
    v as (select case_id, item, least(1, greatest(0, value)) as v from a),
    s as (select case_id, round(sum(v * case item when 'meaning' then 0.4 when 'fact' then 0.25 when 'form' then 0.25 else 0.1 end), 9) as c,
        bool_and(case when item = 'meaning' then v >= 0.8 when item = 'fact' then v >= 0.7 else true end) as h,
        count(*) filter (where v < case item when 'meaning' then 0.8 when 'fact' then 0.7 else 0.625 end) as n from v group by 1)
    select case_id, round(c * 10000)::bigint as points, h as hard_passed, n as n_failed, h and c >= 0.8 as passed from s""")
def judge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    items = {"fact": F.col("quality").cast("double"), "form": 0.5 + 0.5 * F.col("toxic"), "meaning": 1.0 - F.col("toxic"), "tone": (F.col("doc_id") % 10) / F.lit(8.0)}
    answers = labels.select(F.col("doc_id").alias("case_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("item"), v.cast("double").alias("value")) for k, v in items.items()))).alias("x")).select("case_id", "x.*")
    out = O.judged(answers, {"meaning": 0.4, "fact": 0.25, "form": 0.25, "tone": 0.1}, {"meaning": 0.8, "fact": 0.7}, 0.625, F.lit(0.8))
    return out.select("case_id", F.round(F.col("confidence") * 10000).cast("long").alias("points"), "hard_passed", "n_failed", "passed")


@R.query("""with p as (select vec_id, list_transform(embedding, lambda x: greatest(x::double, 0)) as p from embeddings), s as (select vec_id, p, list_sum(p) as t from p)
    select vec_id, case when t > 0 then round(list_sum(list_transform(p, lambda x, i: x * (i - 1))) / t * 10000)::bigint else -1 end as points from s""")
def expected_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(F.round(O.expected_level(p) * 10000).cast("long"), F.lit(-1)).alias("points"))


@R.query("""select doc_id, case when quality = 1 and toxic = 0 then 1.0::double when quality = 1 then 0.5::double else 0.0::double end as label, n_chars, source from labels join documents using (doc_id)""")
def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the data set export, before they are written as JSON lines."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).when(F.col("quality") == 1, 0.5).otherwise(0.0)
    return rows.select("doc_id", label.alias("label"), "n_chars", "source")


@R.query("""with e as (select event_id, user_id, epoch(ts)::bigint as a, epoch(ts)::bigint + (1 + event_id % 7) * 3600 as b from events)
    select x.event_id as a_id, y.event_id as b_id, greatest(x.a, y.a) as from_s, least(x.b, y.b) as to_s from e x join e y on x.user_id = y.user_id and x.a < y.b and y.a < x.b and x.event_id < y.event_id""")
def range_overlap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of intervals of a user: a range join inside an equality, as comments meet runs of a paragraph."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.rint(F.col("ts").cast("timestamp").cast("double")).cast("long").alias("a"))
    e = e.withColumn("b", F.col("a") + (1 + F.col("event_id") % 7) * 3600)
    from ..operators.proofread import overlaps

    return overlaps(e, ["user_id"], "event_id", "a", "b", 4 * 3600).select("a_id", "b_id", "from_s", "to_s")


@R.query("""select l_orderkey, l_linenumber, case when l_linenumber = p + 1 then 'next' when l_linenumber = p then 'repeat' when l_linenumber = 1 then 'restart' when l_linenumber > p + 1 then 'skip' else 'reversed' end as status
    from (select l_orderkey, l_partkey, l_suppkey, l_linenumber, lag(l_linenumber) over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) as p from lineitem) where p is not null""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each number follows the one before in its scope."""
    from ..operators.proofread import sequence_status

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return sequence_status(rows, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"], "l_linenumber").select("l_orderkey", "l_linenumber", "status")


@R.query("""select d.doc_id, coalesce(case when d.doc_id % 5 = 0 then d.n_chars end, case when d.doc_id % 3 = 0 then l.quality * 1000 end, 7)::bigint as size, coalesce(l.toxic, -1)::bigint as flag,
    case when d.doc_id % 5 = 0 and d.n_chars is not null then 'manual' when d.doc_id % 3 = 0 and l.quality is not null then 'fetched' else 'default' end as source from documents d left join labels l using (doc_id)""")
def field_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field of a document from the first source that has it: by hand, fetched, or a default."""
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    manual = d.filter("doc_id % 5 = 0").select("doc_id", F.col("n_chars").alias("size"))
    fetched = marks.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("quality") * 1000).cast("long").alias("size"), F.col("toxic").cast("long").alias("flag"))
    return O.by_precedence(d.select("doc_id"), {"manual": manual, "fetched": fetched}, "doc_id", {"size": 7, "flag": -1})


@R.query("""select conv_id, turn, role, place, n as "of" from (select conv_id, turn, role, row_number() over (partition by role order by length(text) desc, conv_id, turn) as place, count(*) over (partition by role) as n from conversations) where place <= 15""")
def findings_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen longest turns of each role, and how many there are."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return O.shown(rows, ["role"], [F.desc("n"), F.col("conv_id"), F.col("turn")], O.SHOWN["findings"]).select("conv_id", "turn", "role", "place", "of")


@R.query("""select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_mktsegment = 'BUILDING' desc, c_custkey) as place from customer""")
def role_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that fit the role first, then the others, by their ids."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    return preferred_first(rows, ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", ["c_custkey"], 1 << 30).select("c_nationkey", "c_custkey", "place")
