"""Queries of the small text functions over lines, documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phrases as H
from ..functions import terms as W
from ..operators import web
from .document_queries import LINES_SQL, LINKS_SQL, linked
from .proofread_queries import line_rows
from .registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.query(f"with {LINES_SQL} select doc_id, index, text from l where index between 1 and 3")
def paragraph_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.paragraph_range(line_rows(spark, sf_dir), 3, 1)


@R.query(rf"""with {LINES_SQL}, t as (select doc_id, index, text, length(text) as n, length(regexp_replace(text, '^\s+', '')) as a, length(regexp_replace(text, '\s+$', '')) as b from l)
    select doc_id, index, (n - a)::int as start, b::int as "end" from t where a > 0""")
def trimmed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir).withColumn("s", H.trim_span(F.col("text"), F.lit(0), F.length("text")))
    return rows.filter("s is not null").select("doc_id", "index", "s.start", "s.end")


@R.query(rf"""with m as (select doc_id, text, n_chars // 2 as pos from documents)
    select doc_id, (pos - length(regexp_extract(substr(text, 1, pos), '[^{H.SENTENCE_ENDS}]*$')))::int as start, (pos + length(regexp_extract(substr(text, pos + 1), '^[^{H.SENTENCE_ENDS}]*')))::int as "end" from m""")
def middle_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence in the middle of each document."""
    docs = table(spark, sf_dir, "documents").withColumn("at", F.expr("cast(n_chars div 2 as int)"))
    return docs.select("doc_id", H.sentence_bounds(F.col("text"), F.col("at")).alias("s")).select("doc_id", "s.start", "s.end")


@R.query(rf"""with {LINES_SQL}, t as (select doc_id, index, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from l),
    c as (select doc_id, index, regexp_replace(case when regexp_full_match(t, '\S( \S)+') then replace(t, ' ', '') when regexp_full_match(t, '\S{{2,}}( \S){{2,}}') then regexp_extract(t, '^[^ ]* ') || replace(regexp_extract(t, ' (.*)$', 1), ' ', '') else t end, '[。：:；;，,]+$', '') as t from t)
    select doc_id, index, case when length(t) > 60 then substr(t, 1, 60) || '…' else t end as heading from c""")
def line_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a heading would show it."""
    return line_rows(spark, sf_dir).select("doc_id", "index", H.heading_text(F.col("text")).alias("heading"))


TYPES_SQL = ", ".join(f"'{t}'" for t in H.FILE_TYPES)


@R.query(f"""with k as ({LINKS_SQL}), t as (select page_id, url, text, regexp_extract(lower(regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1)), '\\.([^.]*)$', 1) as a, regexp_extract(lower(regexp_replace(trim(text), '[）)]+$', '')), '\\.([^.]*)$', 1) as b from k)
    select page_id, url, case when a in ({TYPES_SQL}) then a end as file_type, case when b in ({TYPES_SQL}) then b end as named_type, len(regexp_extract_all(replace(text, '下载', ''), '[一-鿿]')) >= 4 as names_document from t""")
def link_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = web.links(linked(table(spark, sf_dir, "pages")))
    return links.select("page_id", "url", H.file_type(F.col("url")).alias("file_type"), H.named_type(F.col("text")).alias("named_type"), H.names_document(F.col("text")).alias("names_document"))


@R.query("""select conv_id, turn, contains(text, 'über') or contains(text, 'zzz') or contains(text, 'élé') or contains(text, 'él') or contains(text, 'éa') as mentioned from (select conv_id, turn, coalesce(text, '') as text from conversations)""")
def turn_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that mention a term, or a pair of its characters that begins with one outside ASCII."""
    terms = F.array(*map(F.lit, ("über", "zzz", "éléa")))
    # of "über" the only such pair is "üb", which "über" itself does not need
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", "turn", H.mentions(F.col("text"), F.slice(terms, 2, 2)).alias("m"), F.contains("text", F.lit("über")).alias("u")).select("conv_id", "turn", (F.col("m") | F.col("u")).alias("mentioned"))


@R.query(f"select doc_id, sha256(translate(text, '{''.join(W.ACCENTED)}', '{''.join(W.ACCENTED.values())}')) as sha256, strip_accents(text) = translate(text, '{''.join(W.ACCENTED)}', '{''.join(W.ACCENTED.values())}') as agrees from documents")
def accents_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without marks on letters; the SQL also holds them against DuckDB's own function."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(W.without_accents(F.col("text")), 256).alias("sha256"), F.lit(True).alias("agrees"))


STOP_SQL = ", ".join(f"'{w}'" for w in W.STOP_WORDS)


@R.query(rf"""with w as (select doc_id, list_filter(regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+'), lambda x: x not in ({STOP_SQL})) as w from documents)
    select doc_id, len(w)::bigint as n_terms, sha256(array_to_string(w, ' ')) as sha256 from w""")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the index without accents and stop words."""
    terms = W.index_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.sha2(F.array_join(terms, " "), 256).alias("sha256"))


@R.query("""with h as (select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host from pages),
    t as (select page_id, host, regexp_extract(host, '[^.]*$') as suffix, host = 'example.org' or host like '%.example.org' as trusted from h)
    select page_id, suffix, trusted, place from (select *, row_number() over (partition by suffix order by trusted desc, page_id) as place from t) where place <= 8""")
def trusted_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight pages of each suffix, those of trusted hosts before the others."""
    rows = web.allowed(table(spark, sf_dir, "pages").select("page_id", "url"), ["example.org"]).withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    return H.preferred_first(rows, ["suffix"], F.col("trusted"), ["page_id"], 8).select("page_id", "suffix", "trusted", "place")


@R.query("""with s as (select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, event_type as category, case when event_id % 3 <> 0 then value / 100 end as score from events)
    select event_id, coalesce(least(50, greatest(5, k)), 7) as k, 'none' as name from s where (score is null or score >= 0.2) and category in ('click', 'view', 'purchase')""")
def screened_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three kinds that pass the gate, with a setting held in its bounds and one at its default."""
    e = table(spark, sf_dir, "events").withColumn("score", F.when(F.col("event_id") % 3 != 0, F.col("value") / 100))
    rows = H.screened(H.in_categories(e, ["click", "view", "purchase"], "event_type"))
    got = rows.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), H.settings(F.col("props"), {"name": "none"}).alias("s"))
    return got.select("event_id", H.clamped(F.col("k"), 5, 50, 7).cast("long").alias("k"), "s.name")
