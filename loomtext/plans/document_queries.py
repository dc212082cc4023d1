"""Queries over documents and pages: lines, chunks, structure, web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts
from ..operators import knowledge as K
from ..operators import markup as M
from ..operators import metadata as D
from ..operators import proofread as P
from ..operators import structure as S
from ..operators import web as H
from .registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

LINES_SQL = "l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as index, unnest(string_split(text, chr(10))) as text from documents)"


@R.query(f"with {LINES_SQL} select doc_id, index, text, coalesce(sum(length(text) + 1) over (partition by doc_id order by index rows between unbounded preceding and 1 preceding), 0)::bigint as char_start from l")
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lines(table(spark, sf_dir, "documents"))


@R.query("select doc_id, i as chunk_no, i * 400 as start, substr(text, i * 400 + 1, 400) as text from (select doc_id, text, unnest(range(0, (length(text) + 399) // 400)) as i from documents)")
def hard_cut_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hard_cuts(table(spark, sf_dir, "documents"))


def structured(docs: DataFrame) -> DataFrame:
    """The documents with headings put before some of their lines, by the line's number: chapters, sections, articles,
    items, attachments; every third document has carriage returns."""
    def line(x: Column, i: Column) -> Column:
        before = lambda *c: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in c), x)
        return (
            F.when(i % 24 == 12, before("第", i, "章 标题\n第", i, "节 小节\n"))
            .when(i % 12 == 0, before("第", i, "章 标题\n"))
            .when((i % 12 == 1) | (i % 12 == 7), before("一、要点\n"))
            .when(i % 12 == 9, before("附件", i, "\n"))
            .when(i % 4 == 2, before("第", i, "条 "))
            .otherwise(x)
        )

    lines = docs.select("doc_id", F.transform(F.split("text", "\n"), line).alias("l"))
    return lines.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array_join("l", "\r\n")).otherwise(F.array_join("l", "\n")).alias("text"))


#: The texts of structured(), and their lines; rank by the label, an item below an open article is text.
HEADS_SQL = r"""d as (select doc_id, replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: case when (k - 1) % 24 = 12 then '第' || (k - 1) || '章 标题' || chr(10) || '第' || (k - 1) || '节 小节' || chr(10) || x
            when (k - 1) % 12 = 0 then '第' || (k - 1) || '章 标题' || chr(10) || x when (k - 1) % 12 in (1, 7) then '一、要点' || chr(10) || x when (k - 1) % 12 = 9 then '附件' || (k - 1) || chr(10) || x
            when (k - 1) % 4 = 2 then '第' || (k - 1) || '条 ' || x else x end), chr(1)), chr(1), case when doc_id % 3 = 0 then chr(13) || chr(10) else chr(10) end) t from documents),
    l0 as (select doc_id, generate_subscripts(string_split(t, chr(10)), 1) i, unnest(string_split(t, chr(10))) raw from d),
    l1 as (select doc_id, i, raw, trim(raw, ' ' || chr(9) || chr(13)) x, coalesce(sum(length(raw) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint pos from l0),
    l2 as (select doc_id, i, x, pos + length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(13))) a, pos + length(rtrim(raw, ' ' || chr(9) || chr(13))) b,
        case when regexp_matches(x, '^附件\d+$') then 0 when regexp_matches(x, '^第\d+章') then 2 when regexp_matches(x, '^第\d+节') then 3 when regexp_matches(x, '^第\d+条') then 4 when regexp_matches(x, '^一、') then 5 end r from l1 where x <> ''),
    l3 as (select *, case when r = 5 and coalesce(last_value(case when r < 5 then r end ignore nulls) over (partition by doc_id order by i), 0) = 4 then null else r end h, case when r = 4 then regexp_extract(x, '^第\d+条') else x end title from l2),
    l4 as (select doc_id, i, a, b, h, lag(h) over (partition by doc_id order by i) above, lag(i) over (partition by doc_id order by i) is null first,
        list_filter([last_value(case when h <= 0 then {'h': h, 'x': title} end ignore nulls) over w, last_value(case when h <= 2 then {'h': h, 'x': title} end ignore nulls) over w, last_value(case when h <= 3 then {'h': h, 'x': title} end ignore nulls) over w,
            last_value(case when h <= 4 then {'h': h, 'x': title} end ignore nulls) over w, last_value(case when h <= 5 then {'h': h, 'x': title} end ignore nulls) over w], lambda p, k: p is not null and p.h = [0, 2, 3, 4, 5][k]) p from l3 window w as (partition by doc_id order by i)),
    l5 as (select *, sum(case when first or (h is not null and not coalesce(above <> 4 and above < h, false)) then 1 else 0 end) over (partition by doc_id order by i) seg from l4),
    segs as (select doc_id, seg, coalesce(arg_max(list_transform(p, lambda y: y.x), i) filter (where h is not null), []) path, min(a) a, max(b) b from l5 group by doc_id, seg),
    shared as (select doc_id, min(a) da, max(b) db, min(path) lo, max(path) hi from segs group by doc_id),
    whole as (select doc_id, da, db, list_transform(list_filter(range(1, len(lo) + 1), lambda k: lo[1 : k] = hi[1 : k]), lambda k: lo[k]) shared from shared)"""
SENTENCES_SQL, CLAUSES_SQL = ("[^{0}]*[{0}][{0}{1}]*|[^{0}]+$".format(ends, '”’"' + "''" + "」』）)】〕》") for ends in ("。！？；!?;", "，,、：:"))


def split_sql(name: str, source: str, most: int) -> str:
    """CTEs that cut the spans (doc_id, a, b) of a source as structure.spans does: name (doc_id, sa, a, b), sa the span's start."""

    def pieces(step: str, before: str, pattern: str) -> str:
        cond = f"where b - a > {most}" if step != "l" else ""
        return f"""{name}_{step}0 as (select doc_id, sa, a, generate_subscripts(regexp_extract_all(substr(t, a + 1, b - a), '{pattern}'), 1) k, unnest(regexp_extract_all(substr(t, a + 1, b - a), '{pattern}')) x from {before} join d using (doc_id) {cond}),
        {name}_{step}1 as (select doc_id, sa, x, a + coalesce(sum(length(x)) over (partition by doc_id, sa, a order by k rows between unbounded preceding and 1 preceding), 0) pos from {name}_{step}0),
        {name}_{step} as (select doc_id, sa, (pos + length(x) - length(ltrim(x, ws)))::bigint a, (pos + length(rtrim(x, ws)))::bigint b from {name}_{step}1, (select ' ' || chr(9) || chr(10) || chr(13) ws) where trim(x, ws) <> '')"""

    fold = lambda enough: f"""list_reduce(l, lambda x, y: case when x.b >= 0 and x.b - x.a < {enough} and y.b - x.a <= {most} then {{'a': x.a, 'b': y.b, 'g': x.g}}
        else {{'a': y.a, 'b': y.b, 'g': case when x.b >= 0 then list_append(x.g, {{'a': x.a, 'b': x.b}}) else x.g end}} end, {{'a': -1::bigint, 'b': -1::bigint, 'g': []::struct(a bigint, b bigint)[]}})"""  # noqa: E731
    return f"""{name}_z as (select doc_id, a sa, a::bigint a, b::bigint b from {source} where b - a > {most}),
        {pieces("l", f"{name}_z", "[^\n]*\n|[^\n]+$")}, {pieces("s", f"{name}_l", SENTENCES_SQL)}, {pieces("c", f"{name}_s", CLAUSES_SQL)},
        {name}_p as (select * from {name}_l where b - a <= {most} union all select * from {name}_s where b - a <= {most} union all select * from {name}_c where b - a <= {most}
            union all select doc_id, sa, x a, least(x + {most}, b) b from (select doc_id, sa, b, unnest(range(a, b, {most})) x from {name}_c where b - a > {most})),
        {name}_q as (select doc_id, sa, list({{'a': a, 'b': b, 'g': []::struct(a bigint, b bigint)[]}} order by a) l from {name}_p group by doc_id, sa),
        {name}_t as (select q.*, s.b - s.a size, {fold(most)} r from {name}_q q join {name}_z s using (doc_id, sa)),
        {name}_e as (select *, {fold("ceil(size / (len(r.g) + 1))")} e from {name}_t),
        {name} as (select doc_id, a sa, a::bigint a, b::bigint b from {source} where b - a <= {most}
            union all select doc_id, sa, g.a, g.b from (select doc_id, sa, unnest(case when len(e.g) <= len(r.g) then list_append(e.g, {{'a': e.a, 'b': e.b}}) else list_append(r.g, {{'a': r.a, 'b': r.b}}) end) g from {name}_e))"""


CHUNKS_SQL = f"""with {HEADS_SQL}, large as (select segs.* from segs join whole using (doc_id) where db - da > 1500),
    {split_sql("par", "large", 1500)},
    units as (select p.doc_id, p.a, p.b, path, path parent_path, p.a parent_start, p.b parent_end from par p join segs s on p.doc_id = s.doc_id and p.sa = s.a
        union all select segs.doc_id, a, b, path, shared, da, db from segs join whole using (doc_id) where db - da <= 1500),
    {split_sql("ch", "units", 400)}"""


@R.query(
    f"""{CHUNKS_SQL} select c.doc_id, dense_rank() over (partition by c.doc_id order by parent_start)::int - 1 parent_no, row_number() over (partition by c.doc_id order by c.a)::int - 1 chunk_no, array_to_string(path, ' > ') path,
        c.a::int as start, c.b::int as "end", parent_start::int parent_start, parent_end::int parent_end, array_to_string(parent_path, ' > ') parent_path, sha256(substr(t, c.a + 1, c.b - c.a)) sha256
        from ch c join units u on c.doc_id = u.doc_id and c.sa = u.a join d on d.doc_id = c.doc_id"""
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents with headings: paths, offsets, and the text that these have."""
    out = S.chunks(structured(table(spark, sf_dir, "documents")), texts=True)
    joined = {c: F.array_join(c, " > ") for c in ("path", "parent_path")}
    return out.withColumns(joined | {"sha256": F.sha2("text", 256)}).drop("text", "parent_text")


@R.query(
    f"""{CHUNKS_SQL}, t as (select c.doc_id, c.a, array_to_string(path, ' > ') p, substr(t, c.a + 1, c.b - c.a) x, parent_start, substr(t, parent_start + 1, parent_end - parent_start) y from ch c join units u on c.doc_id = u.doc_id and c.sa = u.a join d on d.doc_id = c.doc_id)
    select doc_id, a::int as start, sha256(case when p = '' then x else p || chr(10) || x end) embedded, sha256(y) parent, dense_rank() over (partition by doc_id order by parent_start)::bigint parent_no from t"""
)
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of each chunk, its path in front, and the parent's text; parents are told apart by their ids."""
    rows = K.chunk_table(structured(table(spark, sf_dir, "documents")))
    firsts = rows.groupBy("doc_id", "parent_id").agg(F.min("start").alias("_f"))
    numbered = firsts.withColumn("parent_no", F.row_number().over(W.partitionBy("doc_id").orderBy("_f")).cast("long"))
    return rows.join(numbered, ["doc_id", "parent_id"]).select("doc_id", "start", F.sha2("embedding_text", 256).alias("embedded"), F.sha2("parent_text", 256).alias("parent"), "parent_no")


@R.query("select doc_id, 0 as n_uncovered from documents")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character other than white space lies in a chunk."""
    docs = table(spark, sf_dir, "documents")
    return S.uncovered(docs, S.chunks(docs))


#: Heads and ends of official documents, put around the texts by their number; W is a word of the document's own.
FORMS = {
    0: ("某市人民政府文件\n某政发[2023]第0N号\n关于W工作的通知\n各区人民政府：", "某市人民政府\n（盖章）\n二〇二三年十月N日\n某市办公室 2024年1月1日印发"),
    1: ("特急\n某厅、某委关于进一步做好\nW工作的意见", "某省财政厅\n某市税务局（章）\n2022年3月N日"),
    2: ("W管理条例\n（2021年6月N日第十次会议通过）", "没有署名。"),
    3: ("某局关于W的方案\n发布日期：2024年2月N日", "某中心　　2020年5月N日"),
}


def official(docs: DataFrame) -> DataFrame:
    """The lines of the documents in four forms."""
    filled = lambda k: [F.replace(F.replace(F.lit(FORMS[k][i]), F.lit("N"), (F.col("doc_id") % 9 + 11).cast("string")), F.lit("W"), F.col("source")) for i in (0, 1)]
    text = F.coalesce(*(F.when(F.col("doc_id") % 4 == k, F.concat(filled(k)[0], F.lit("\n\n"), "text", F.lit("\n"), filled(k)[1])) for k in FORMS))
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("index", "text"))


@R.query("""select doc_id, case doc_id % 4 when 0 then '关于' || source || '工作的通知' when 1 then '某厅、某委关于进一步做好' || source || '工作的意见' when 2 then source || '管理条例' else '某局关于' || source || '的方案' end as title,
    case when doc_id % 4 = 0 then '某政发〔2023〕' || (doc_id % 9 + 11) || '号' else '' end as doc_number, case doc_id % 4 when 0 then '某市人民政府' when 1 then '某省财政厅 某市税务局' when 2 then '' else '某中心' end as issuer,
    case doc_id % 4 when 0 then '2023-10-' when 1 then '2022-03-' when 2 then '2021-06-' else '2020-05-' end || (doc_id % 9 + 11) as date from documents""")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents say about themselves, in the forms of official texts."""
    out = D.metadata(official(table(spark, sf_dir, "documents")))
    return out.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "doc_number", "issuer", "date")))


@R.query("select lang, sum(length(regexp_replace(text, '\\s', '', 'g')))::bigint as n_chars, count(*) as n_docs from documents group by 1")
def nonspace_chars_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.nonspace_chars(F.col("text"))).alias("n_chars"), F.count("*").alias("n_docs"))


@R.query("""with f as (select doc_id, case when length(text) > 60 then substr(text, 1, 60) || '…' else text end as head, ceil(length(text) / 4)::bigint as n_tokens from documents) select * from f""")
def clipped_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 60).alias("head"), T.estimate_tokens(F.col("text")).cast("long").alias("n_tokens"))


ENTITY_SQL = "{0}"
for _name, _char in sorted(H.PAGE_ENTITIES.items(), key=lambda x: x[0] == "amp"):
    ENTITY_SQL = f"replace({ENTITY_SQL}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"
NOISE_SQL = "regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<({0})\\b[^>]*>.*?</({0})\\s*>', ' ', 'gis')"
TAGS_SQL = "regexp_replace({0}, '<[^>]*>', ' ', 'gs')"
PAGE_SQL = "trim(regexp_replace(" + ENTITY_SQL.format(TAGS_SQL.format(NOISE_SQL.format(H.NOISE))) + ", '\\s+', ' ', 'g'))"


@R.query(f"select page_id, {PAGE_SQL} as text from pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.page_text(F.col("html")).alias("text"))


LINE_SQL = ENTITY_SQL.format(TAGS_SQL.format("regexp_replace(" + NOISE_SQL.format(H.FRAME) + ", '</(p|div|li|tr|h[1-6]|section|article|table|ul|ol|td)>|<br\\s*/?>', chr(10), 'gi')"))
ARTICLE_SQL = f"""r as (select page_id, html, list_filter(list_transform(string_split({LINE_SQL}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as l,
        coalesce(nullif(trim(regexp_replace({ENTITY_SQL.format(TAGS_SQL.format("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is')"))}, '\\s+', ' ', 'g')), ''),
            nullif(trim(regexp_replace({ENTITY_SQL.format(TAGS_SQL.format("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')"))}, '\\s+', ' ', 'g')), '')) as title from pages),
    d as (select page_id, html, title, list_filter(l, lambda x, i: i = 1 or x <> l[i - 1]) as l from r),
    a as (select page_id, html, title, array_to_string(l[coalesce(list_position(list_transform(l, lambda x: contains(x, title)), true), 0) + 1 :], chr(10)) as text from d)"""


@R.query(f"with {ARTICLE_SQL} select page_id, title, text from a")
def page_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.article(table(spark, sf_dir, "pages"))


@R.query(f"with {ARTICLE_SQL}, p as (select page_id, length(text) >= 50 as from_article, case when length(text) >= 50 then text else {PAGE_SQL} end as text from a) select page_id, from_article, text from p where length(text) >= 20")
def page_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.accepted(table(spark, sf_dir, "pages"))


#: Anchors that the pages do not have, put behind each.
ANCHORS = (
    '<a href="?p=2&amp;q=1">query</a><a href="../k.pdf">up</a><a href="./a/../b;x=1#f">dots</a><a title="named" href="//Other.org/x/./y"> </a><a href="../../../g/.">high</a><a href="#top">here</a>'
    '<a href="mailto:a@b.c">mail</a><a href="HTTPS://a.org/./z">whole</a><a href="g?y=a/../b">kept</a><a href="/r/..">root</a><a href="f.aspx?id=3">下载建设项目管理办法.docx）</a>'
)


def linked(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.concat("html", F.lit(ANCHORS)).alias("html"))


def dots_sql(path: str) -> str:
    kept = f"list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda a, x: case when x[1] = '.' then a when x[1] = '..' then case when len(a) > 1 then a[: -2] else a end else list_concat(a, x) end, []::varchar[])"
    return rf"case when regexp_matches({path}, '(^|/)\.{{1,2}}(/|$)') then array_to_string({kept}, '/') || case when regexp_matches({path}, '(^|/)\.{{1,2}}$') then '/' else '' end else {path} end"


REFERENCE_SQL = "(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)([?][^#]*)?(#.*)?$"
LINKS_SQL = rf"""with g as (select page_id, url, html || '{ANCHORS}' as html from pages),
    a as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')) as a, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>'), 1) - 1 as pos from g),
    p as (select page_id, url, pos, trim({ENTITY_SQL.format("regexp_extract(a, '(?is)" + chr(92) + "bhref" + chr(92) + "s*=" + chr(92) + "s*[" + chr(34) + chr(39) * 2 + "]([^" + chr(34) + chr(39) * 2 + "]*)', 1)")}) as href,
        coalesce(nullif(trim(regexp_replace({ENTITY_SQL.format(TAGS_SQL.format("a"))}, '\s+', ' ', 'g')), ''), regexp_extract(a, 'title="([^"]*)"', 1)) as text from a),
    r as (select *, {", ".join(f"regexp_extract(url, '{REFERENCE_SQL}', {i}) b{i}, regexp_extract(href, '{REFERENCE_SQL}', {i}) h{i}" for i in range(1, 6))} from p where href <> '' and not starts_with(href, '#')),
    m as (select *, case when starts_with(h3, '/') then h3 when b3 = '' then '/' || h3 else regexp_replace(b3, '[^/]*$', '') || h3 end as merged from r),
    f as (select page_id, pos, text, case when h1 <> '' then h1 || ':' || case when regexp_matches(href, '^[^/?#]*://') then '//' || h2 else '' end || {dots_sql("h3")} || h4 || h5
        when starts_with(href, '//') then b1 || '://' || h2 || {dots_sql("h3")} || h4 || h5
        when h3 = '' then b1 || '://' || b2 || b3 || coalesce(nullif(h4, ''), b4) || h5 else b1 || '://' || b2 || {dots_sql("merged")} || h4 || h5 end as url from m)
    select page_id, url, min_by(text, pos) as text, min(pos)::int as pos from f where regexp_matches(url, '(?i)^https?://') group by 1, 2"""


@R.query(LINKS_SQL)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.links(linked(table(spark, sf_dir, "pages")))


@R.query("""select page_id, '<' || chr((8000 + page_id % 500)::int) || chr((10240 + page_id % 97)::int) || '&lt; &bogus; &copy;' || chr((128512 + page_id % 60)::int) || ' &#55296; “' as text from pages""")
def decoded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric entities of both kinds, names, what is no entity, and one that is written as text, made from each page's id."""
    n = lambda first, size: (F.col("page_id") % size + first).cast("string")
    made = F.concat(F.lit("&lt;&#"), n(8000, 500), F.lit(";&#x"), F.hex(F.col("page_id") % 97 + 10240), F.lit(";&amp;lt; &bogus; &copy;&#"), n(128512, 60), F.lit("; &#55296; &ldquo;"))
    return table(spark, sf_dir, "pages").select("page_id", H.decode(made).alias("text"))


@R.query("""with r as (select l_orderkey, l_linenumber, l_quantity::bigint as q, l_partkey, l_returnflag as f from lineitem), c as (select l_orderkey from r group by 1),
    t as (select l_orderkey as doc_id, 0 as n, '表格列：项目 | 数量' as text from c union all select l_orderkey, 1, '项目；数量：件；数量：编号' from c
        union all select l_orderkey, row_number() over (partition by l_orderkey order by f, l_linenumber, l_partkey, q) + 1, '项目：' || f || '；数量：' || q || '；数量：<' || l_partkey from r) select doc_id::bigint as doc_id, 0 as tbl, n::int as n, text from t""")
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as HTML tables with merged cells, read back as labelled rows."""
    flags = W.partitionBy("l_orderkey", "l_returnflag")
    items = table(spark, sf_dir, "lineitem").withColumns({"_n": F.count("*").over(flags), "_r": F.row_number().over(flags.orderBy("l_linenumber", "l_partkey", "l_quantity"))})
    flag = F.when(F.col("_r") == 1, F.concat(F.lit("<td rowspan="), F.col("_n").cast("string"), F.lit("><b>"), "l_returnflag", F.lit("</b></td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), flag, F.lit("<td> "), F.col("l_quantity").cast("long").cast("string"), F.lit("<br></td><TD class='x'>&lt;"), F.col("l_partkey").cast("string"), F.lit("</TD></tr>"))
    rows = items.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_returnflag", "l_linenumber", "l_partkey", "l_quantity", row.alias("html")))), lambda x: x["html"]).alias("rows"))  # of one order
    head = '<p>x</p><table><tr><th rowspan="2">项目</th><th colspan="2">数量</th></tr><tr><td>件</td><td>编号</td></tr>'
    docs = rows.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit(head), F.array_join("rows", "\n"), F.lit("</table>")).alias("text"))
    return M.labelled_rows(M.html_cells(docs))


@R.query("""with p as (select page_id, url, page_id % 4 as k from pages) select page_id as query_id, 0 as pos, url, 'Page & ' || page_id as title, 'about ' || page_id as snippet from p where k < 2
    union all select page_id, 1, 'https://www.bing.com/ck/a?u=b1xyz', 'second', '' from p where k < 2 union all select page_id, 0, url, 'Page ' || page_id, 'in short' from p where k = 2
    union all select page_id, 0, 'https://www.baidu.com/link?url=' || page_id, 'Page ' || page_id, 'in short' from p where k = 3""")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of two engines that list the pages: behind a click counter, in an attribute, or as a redirect only."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").cast("string").alias("n"))
    code = F.rtrim(F.translate(F.base64(F.encode("url", "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    first = F.concat(F.lit('<ol><li class="b_algo x"><h2 class="">\n<a h="1" href="https://www.bing.com/ck/a?!&amp;&amp;p=1&amp;u=a1'), code, F.lit('&amp;ntb=1"><b>Page</b> &amp; '), "n", F.lit('</a></h2><p class="t">about\n '), "n", F.lit('</p></li><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=b1xyz">second</a></h2></li><li class="b_algo">none</li></ol>'))
    address = F.when(F.col("page_id") % 4 == 2, F.concat(F.lit(' mu="'), "url", F.lit('"'))).otherwise(' mu="http://x.baidu.com/"')
    second = F.concat(F.lit('<div id="1" class="result c-container new"'), address, F.lit('><h3 class="t"><a href="https://www.baidu.com/link?url='), "n", F.lit('">Page '), "n", F.lit('</a></h3><span class="content-right_1">in <em>short</em></span></div><div class="c-container">none</div>'))
    return H.result_links(p.select(F.col("page_id").alias("query_id"), F.when(F.col("page_id") % 4 < 2, first).otherwise(second).alias("html")))


@R.query(f"""with {LINES_SQL}, s as (select doc_id, index, source from l join documents using (doc_id)),
    f as (select doc_id, index, 'name' as fact, source || '工程' as value from s where index % 9 = 4 union all select doc_id, index, 'investment', (index + 1) || ',000.5 万元' from s where index % 7 = 3 and index % 9 <> 4 union all select doc_id, index, 'owner', source || '公司' from s where index % 11 = 5 and index % 9 <> 4
        union all select doc_id, index, 'place', source || '区' from s where index % 5 = 2 and index % 9 <> 4 union all select doc_id, index, 'period', (index + 6) || '个月' from s where index % 7 = 3 and index % 9 <> 4)
    select doc_id, fact, min_by(value, index) as value, min(index)::int as index from f group by 1, 2""")
def labelled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that some lines of the documents state, each where it is stated first."""
    rows = P.lines(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    i, at = F.col("index"), lambda n: (F.col("index") + n).cast("string")
    name = F.when(i % 9 == 4, F.concat(F.lit("项目名称： "), "source", F.lit("工程 。"))).otherwise(F.col("text"))
    more = F.concat(
        F.when((i % 7 == 3) & (i % 9 != 4), F.concat(F.lit("。总投资估算约为"), at(1), F.lit(",000.5 万元，建设工期为"), at(6), F.lit("个月。"))).otherwise(""),
        F.when((i % 11 == 5) & (i % 9 != 4), F.concat(F.lit("建设单位： "), "source", F.lit("公司，"))).otherwise(""),
        F.when((i % 5 == 2) & (i % 9 != 4), F.concat(F.lit("项目拟选址位于"), "source", F.lit("区，"))).otherwise(""),
    )
    return facts.labelled(rows.select("doc_id", "index", F.concat(name, more).alias("text")))


@R.query("""with h as (select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host from pages)
    select page_id, host, host = 'example.org' or host like '%.example.org' or host like '%.blog.example.net' or host = 'blog.example.net' as trusted from h""")
def host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.allowed(table(spark, sf_dir, "pages").select("page_id", "url"), ["https://example.org/x", "*.blog.example.net"]).select("page_id", "host", "trusted")


@R.query("""select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as varchar), '') as k, length(props) as n from events""")
def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column, empty where the text is no JSON or lacks it."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.length("props").alias("n"))
