"""Proofreading queries: marks, lists, figures, citations, issues, packs, differences."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import diff as D
from ..operators import proofread as P
from ..operators import search as S
from ..operators import sections as check
from ..operators.storage import shared_path, stored
from .document_queries import LINES_SQL
from .registry import Registry, table
from .search_queries import BM25_SQL, POSTINGS_SQL, TERMS_SQL, benchmark_terms, keyword

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

SPACES = r"[ \t]{2,}"
MARKS = r",{2,}|;{2,}|:{2,}|\?{2,}|!{2,}|\.{4,}"
#: Every match of a pattern in the lines, with offsets: lines are cut at the matches.
MATCH_SQL = """with {lines}, m as (select doc_id, index, unnest(regexp_extract_all(text, '{p}')) as original, unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) as gap,
        generate_subscripts(regexp_extract_all(text, '{p}'), 1) as n from l),
    o as (select doc_id, index, original, sum(length(gap) + length(original)) over (partition by doc_id, index order by n) as e from m)
    select doc_id, index, (e - length(original))::bigint as start, e::bigint as "end", original from o"""


#: Documents with double spaces, blank lines and brackets, some without a partner: commas open one, sentence ends close one.
DRAFTS_SQL = "d as (select doc_id, replace(replace(text, ', ', ' (  '), '. ', ')' || chr(10) || chr(10) || ' ' || chr(10)) as text from documents), l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as index, unnest(string_split(text, chr(10))) as text from d)"


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace("text", F.lit(", "), F.lit(" (  ")), F.lit(". "), F.lit(")\n\n \n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def draft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "text"))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "text"))


def marks(rows: DataFrame, pattern: str, severity: str, suggestion) -> DataFrame:
    return P.matches(rows, pattern, "format", severity, suggestion)


@R.query(MATCH_SQL.format(lines=DRAFTS_SQL, p=SPACES.replace(r"\t", "\t")))
def space_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(draft_rows(spark, sf_dir), SPACES, "warning", F.lit(" ")).select("doc_id", "index", "start", "end", "original")


@R.query(MATCH_SQL.format(lines=LINES_SQL, p=MARKS))
def dup_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(line_rows(spark, sf_dir), MARKS, "error", F.left("original", F.lit(1))).select("doc_id", "index", "start", "end", "original")


@R.query(f"""with {DRAFTS_SQL} select doc_id, (length(text) - length(translate(text, '([{{', '')))::bigint as n_open, (length(text) - length(translate(text, ')]}}', '')))::bigint as n_close from d
    where length(text) - length(translate(text, '([{{', '')) <> length(text) - length(translate(text, ')]}}', ''))""")
def bracket_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with more opening than closing brackets, or fewer."""
    count = lambda marks: (F.length("text") - F.length(F.translate("text", marks, ""))).cast("long")
    return drafts(spark, sf_dir).select("doc_id", count("([{").alias("n_open"), count(")]}").alias("n_close")).filter("n_open <> n_close")


@R.query(f"""with recursive {DRAFTS_SQL}, c as (select doc_id, index, unnest(range(0, length(text))) as i, unnest(string_split(text, '')) as c from l where regexp_matches(text, '[()]')),
    b as (select doc_id, index, i, c, row_number() over (partition by doc_id, index order by i) as n from c where c in ('(', ')')),
    s as (select doc_id, index, n, case when c = '(' then [i] else []::bigint[] end as o, case when c = '(' then []::bigint[] else [i] end as bad from b where n = 1
        union all select b.doc_id, b.index, b.n, case when c = '(' then list_append(o, i) else o[: len(o) - 1] end, case when c = ')' and len(o) = 0 then list_append(bad, i) else bad end
        from s join b on b.doc_id = s.doc_id and b.index = s.index and b.n = s.n + 1),
    e as (select doc_id, index, list_concat(o, bad) as x from s qualify row_number() over (partition by doc_id, index order by n desc) = 1)
    select doc_id, index, x::int as start, (x + 1)::int as "end" from (select doc_id, index, unnest(x) as x from e)""")
def bracket_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bracket_issues(draft_rows(spark, sf_dir), "()[]{}").select("doc_id", "index", "start", "end")


@R.query(f"""with {DRAFTS_SQL}, b as (select doc_id, index, index - row_number() over (partition by doc_id order by index) as i from l where trim(text, ' ' || chr(9) || chr(13)) = '')
    select doc_id, min(index) as first, count(*) as n from b group by doc_id, i having count(*) >= 2""")
def empty_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.empty_runs(draft_rows(spark, sf_dir).withColumn("in_table", F.lit(False)))


#: A word list and names that overlap each other.
WRONG = {"teh": "the", "recieve": "receive", "on on": "on", "the the": "the", "of of": "of", "le le": "le"}
NAMES = ("th", "the", "then", "ther", "her", "here", "on", "onth", "est")
WRONG_SQL = ", ".join(f"('{a}', '{b}')" for a, b in WRONG.items())


@R.query(f"""with {LINES_SQL}, w as (select * from (values {WRONG_SQL}) t(wrong, "right")), h as (select doc_id, index, text, wrong, "right", unnest(range(0, length(text) - length(wrong) + 1)) as start from l, w where contains(text, wrong))
    select doc_id, index, start, start + length(wrong) as "end", wrong as original, "right" as suggestion from h where substr(text, start + 1, length(wrong)) = wrong""")
def wordlist_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame(list(WRONG.items()), "wrong string, right string")
    return P.word_list_hits(line_rows(spark, sf_dir), words).select("doc_id", "index", "start", "end", "original", "suggestion")


@R.query("with {lines}, c as (select doc_id, index, unnest(regexp_extract_all(text, '{p}')) as name from l) select doc_id, name, count(*) as n from c group by 1, 2".format(lines=LINES_SQL, p="|".join(sorted(NAMES, key=len, reverse=True))))
def gazetteer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the lines, leftmost longest, counted a document."""
    rows = line_rows(spark, sf_dir)
    words = spark.createDataFrame([(n, n) for n in NAMES], "wrong string, right string")
    kept = P.leftmost_longest(P.word_list_hits(rows, words).withColumnRenamed("original", "name"), ["doc_id", "index"], "name")
    return kept.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


FIGURE = r"([A-Za-z]{2,}) ([0-9]+)([A-Za-z]*)"


@R.query(f"with {LINES_SQL}, f as (select doc_id, index, unnest(regexp_extract_all(text, '{FIGURE}', 1)) as metric, unnest(regexp_extract_all(text, '{FIGURE}', 2)) as value, unnest(regexp_extract_all(text, '{FIGURE}', 3)) as unit from l) select * from f")
def figure_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.figures(line_rows(spark, sf_dir), FIGURE)


@R.query("""with f as (select l_partkey as subject, l_returnflag as metric, l_orderkey * 10 + l_linenumber as index, l_quantity * case when l_linenumber % 2 = 0 then 1000 else 1 end as v from lineitem),
    g as (select subject, metric, min_by(v, index) as first from f group by 1, 2)
    select subject, metric, count(*) as n, count(*) filter (where abs(v - first) > 0.005 * greatest(abs(v), abs(first))) as n_far from f join g using (subject, metric) group by 1, 2 having n_far > 0""")
def figure_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of a part and flag, in two units, that differ from the first."""
    unit = F.when(F.col("l_linenumber") % 2 == 0, "千米").otherwise("米")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("metric"), F.expr("l_orderkey * 10 + l_linenumber").alias("index"), F.col("l_quantity").cast("string").alias("value"), unit.alias("unit"))
    units = spark.createDataFrame([(u, f, d) for u, (f, d) in P.UNITS.items()], "unit string, factor double, dimension string")
    return P.figure_conflicts(facts, F.broadcast(units)).drop("dimension")  # the fixed table of units


METRICS = ("建筑投资", "总投资", "设备投资", "项目投资额约", "占地面积", "面积", "备注量")


@R.query(
    f"""with recursive f as (select l_partkey as doc_id, ((l_orderkey * 10 + l_linenumber) * 1000 + l_quantity::bigint) * 10 + k as place, k, l_quantity as q from (select *, (l_orderkey + l_linenumber * 3) % 7 as k from lineitem)),
    n as (select doc_id, place, ['建筑投资', '投资', '设备投资', '投资', '占地面积', '面积', '备注量'][k + 1] as name, case when k < 4 then 'money' when k < 6 then 'area' else 'other' end as dimension, case when k = 6 then '台' else '' end as unit,
        q * case when k = 0 then 10000 when k = 5 then 10000 / 15.0::double else 1 end as v from f),
    m as (select doc_id, dimension, unit, name, min(place) as place from n group by all),
    o as (select *, row_number() over (partition by doc_id, dimension order by place) as i from m),
    g as (select doc_id, dimension, i, [{{'n': name, 'm': name}}] as a from o where i = 1
        union all select o.doc_id, o.dimension, o.i, list_append(a, {{'n': name, 'm': coalesce(list_filter(a, lambda x: x.n = x.m and (contains(x.m, name) or contains(name, x.m)))[1].m, name)}}) from g join o on g.doc_id = o.doc_id and g.dimension = o.dimension and o.i = g.i + 1),
    u as (select doc_id, dimension, unnest(arg_max(a, i)) as x from g group by doc_id, dimension),
    j as (select n.doc_id, n.dimension, unit, x.m as metric, place, v from n join u on n.doc_id = u.doc_id and n.dimension = u.dimension and n.name = x.n),
    t as (select doc_id, dimension, metric, min_by(v, place) as first from j group by all)
    select doc_id, '项目' as subject, metric, dimension, unit, count(*) as n, count(*) filter (where abs(v - first) > case when dimension = 'area' then 0.01 else 0.005 end * greatest(abs(v), abs(first), 1e-9)) as n_far
        from j join t using (doc_id, dimension, metric) group by all having n_far > 0"""
)
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of a part under names that contain each other, in several units, that differ from the first."""
    rows = table(spark, sf_dir, "lineitem").withColumn("k", (F.col("l_orderkey") + F.col("l_linenumber") * 3) % 7)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("k").cast("int"))
    place = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("long")) * 10 + F.col("k")
    value = F.concat(F.col("l_quantity").cast("string"), F.when(F.col("k") == 0, "万").otherwise(""))
    unit = pick(["", "元", "元", " 元", "㎡", "亩", "台"])
    return P.conflict_groups(rows.select(F.col("l_partkey").alias("doc_id"), place.alias("place"), F.lit("本 项目").alias("subject"), pick(METRICS).alias("metric"), value.alias("value"), unit.alias("unit")))


@R.query("""with recursive c as (select conv_id, turn, turn % 3 as list, turn % 3 = 1 as single, length(text) as size from conversations), o as (select *, row_number() over (partition by conv_id order by list, turn) as i from c),
    f as (select *, case when size <= 600 then size else 0 end as used, size <= 600 as admitted, case when size > 600 and not single then list end as ended from o where i = 1
        union all select o.*, case when (o.single or f.ended is distinct from o.list) and f.used + o.size <= 600 then f.used + o.size else f.used end, (o.single or f.ended is distinct from o.list) and f.used + o.size <= 600,
            case when (o.single or f.ended is distinct from o.list) and f.used + o.size <= 600 or o.single then f.ended else o.list end from f join o on o.conv_id = f.conv_id and o.i = f.i + 1)
    select conv_id, list::int as list, turn::bigint as turn, used::bigint as used, admitted from f""")
def admitted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as three lists under one budget of 600 characters, the second of single items."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("list"), (F.col("turn") % 3 == 1).alias("single"), F.length("text").alias("size"))
    return P.admitted(c, "conv_id", 600, order="turn")


#: What a line cites, by its number; L stands for the document's own word.
CITING = {
    0: "依据《L管理办法》（国发〔2017〕N号）执行，见《L技术导则》。",
    1: "按《L技术规范》 GB/T 3095-20N 设计。",
    2: "见国发[2017] 第N号，同时执行 GB 500N—2014。",
    3: "ＧＢ/T 3095—20N 同样适用。",
    4: "《L 管理办法》规定，HJ 2.2-2018《L公报》也适用。",
}


def cited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents, with a citation behind: the same titles and numbers come again within a document."""
    rows = line_rows(spark, sf_dir)
    text = F.coalesce(*(F.when(F.col("index") % 6 == k, F.lit(v)) for k, v in CITING.items()), F.lit(""))
    word = F.concat(F.get(F.split("source", " "), F.lit(0)), (F.floor(F.col("index") / 12) % 3).cast("string"))
    named = rows.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    made = F.replace(F.replace(text, F.lit("L"), word), F.lit("N"), (F.col("index") % 5 + 11).cast("string"))
    return named.select("doc_id", "index", F.concat("text", F.lit(" "), made).alias("text"))


#: The mentions of cited_rows, stated by the number of the line: loose, place in the line, title, kind, standard, number.
CITED_SQL = f"""{LINES_SQL}, n as (select doc_id, index, source || (index // 12 % 3) as w, (index % 5 + 11)::varchar as n, index % 6 as k from l join documents using (doc_id)),
    m as (select doc_id, index, 0 as loose, 0 as pos, w || '管理办法' as title, 'law' as kind, null as std, '国发〔2017〕' || n || '号' as num from n where k = 0
        union all select doc_id, index, 0, 1, w || '技术导则', 'standard', null, null from n where k = 0
        union all select doc_id, index, 0, 0, w || '技术规范', 'standard', 'GB/T 3095-20' || n, null from n where k = 1
        union all select doc_id, index, 1, 1, '国发〔2017〕' || n || '号', 'policy', null, '国发〔2017〕' || n || '号' from n where k = 2
        union all select doc_id, index, 1, 0, 'GB 500' || n || '-2014', 'standard', 'GB 500' || n || '-2014', null from n where k = 2
        union all select doc_id, index, 1, 0, 'GB/T 3095-20' || n, 'standard', 'GB/T 3095-20' || n, null from n where k = 3
        union all select doc_id, index, 0, 0, w || ' 管理办法', 'law', null, null from n where k = 4
        union all select doc_id, index, 0, 1, w || '公报', 'standard', 'HJ 2.2-2018', null from n where k = 4),
    o as (select *, row_number() over (partition by doc_id order by loose, index, pos) as i from m),
    f as (select doc_id, i, [{{'t': title, 'k': kind, 's': std, 'd': num, 'p': [index]}}] as c from o where i = 1
        union all select doc_id, i, case when hit is null then list_append(c, {{'t': title, 'k': kind, 's': std, 'd': num, 'p': [index]}})
            else list_transform(c, lambda x, k: case when k = hit then {{'t': x.t, 'k': x.k, 's': coalesce(x.s, std), 'd': coalesce(x.d, num), 'p': case when list_contains(x.p, index) then x.p else list_append(x.p, index) end}} else x end) end
            from (select o.*, f.c, list_position(list_transform(f.c, lambda x: coalesce(replace(x.t, ' ', '') = replace(title, ' ', '') or x.s = std or (title = num and x.d = num), false)), true) as hit from f join o on o.doc_id = f.doc_id and o.i = f.i + 1)),
    g as (select doc_id, arg_max(c, i) as c from f group by doc_id), found as (select doc_id, unnest(c) as x, generate_subscripts(c, 1) - 1 as no from g)"""


@R.query(f"with recursive {CITED_SQL} select doc_id, no::int as no, x.t as title, x.k as kind, coalesce(x.s, '') as standard_no, coalesce(x.d, '') as doc_no, array_to_string(x.p, ',') as paragraphs from found")
def citation_extract_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents cite, each once, with the paragraphs."""
    out = C.citations(cited_rows(spark, sf_dir))
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("standard_no", "doc_no")} | {"paragraphs": F.array_join(F.col("paragraphs").cast("array<string>"), ",")})


@R.query(
    f"""with recursive {CITED_SQL}, s as (select doc_id, x.t as title, x.s as std, unnest(x.p) as index, contains(x.t, '技术规范') as new from found where contains(x.t, '技术规范') or contains(x.t, '管理办法')),
    t as (select s.*, length(l.text) + 1 as base, n.n, n.k, n.w from s join l using (doc_id, index) join n using (doc_id, index)),
    u as (select *, k in (1, 3) and new and std = 'GB/T 3095-20' || n as numbered,
        case k when 1 then w || '技术规范' when 0 then w || '管理办法' when 4 then w || ' 管理办法' end as marked from t),
    v as (select *, case when k = 1 and numbered then '按《' || marked || '》 ' when k = 1 then '按' when k = 0 then '依据' else '' end as before,
        case when numbered and k = 1 then 'GB/T 3095-20' || n when numbered then 'ＧＢ/T 3095—20' || n when marked = title then '《' || marked || '》' end as original from u)
    select doc_id, index, case when new then 'warning' else 'error' end as severity, base + length(before) as start, base + length(before) + length(original) as "end", original,
        case when numbered then 'GB/T 3095-2030' when new then '《新标准》' else '' end as suggestion, '《' || title || '》' || case when new then '已有新版本，现行版本为《新标准》（GB/T 3095-2030）。旧' else '已废止' end as reason
        from v where original is not null"""
)
def citation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that are out of force, where the documents cite them: regulations are repealed, specifications replaced."""
    rows = cited_rows(spark, sf_dir)
    found = stored(C.citations(rows), "citations")  # read for the titles and for the places
    new = F.col("title").contains("技术规范")
    status = found.select("title").distinct().select("title", F.when(new, "superseded").when(F.col("title").contains("管理办法"), "repealed").otherwise("current").alias("status"), F.when(new, "新标准").alias("replacement_title"), F.when(new, "GB/T 3095-2030").alias("replacement_number"), F.when(new, "旧").alias("reason"))
    out = C.status_issues(found, status, rows)
    return out.select("doc_id", "index", "severity", "start", "end", "original", F.coalesce("suggestion", F.lit("")).alias("suggestion"), "reason")


RUNS = r"[ \t,;:.!?]{2,}"


def all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draft_rows(spark, sf_dir)
    found = marks(rows, SPACES, "warning", F.lit(" ")).unionByName(marks(rows, MARKS, "error", F.left("original", F.lit(1)))).withColumn("source", F.lit("rule"))
    return found.unionByName(marks(rows, RUNS, "warning", F.left("original", F.lit(1))).withColumn("source", F.lit("model")))


def found_sql(p: str, severity: str, source: str, weak: int) -> str:
    p = p.replace(r"\t", "\t")
    return f"""select doc_id, index, e - length(m) as start, e as "end", '{severity}' as severity, '{source}' as source, {weak} as weak from (
        select doc_id, index, m, sum(length(gap) + length(m)) over (partition by doc_id, index order by n)::bigint as e from (select doc_id, index, unnest(regexp_extract_all(text, '{p}')) as m,
        unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) as gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) as n from l))"""


@R.query(f"""with recursive {DRAFTS_SQL}, i as ({found_sql(SPACES, 'warning', 'rule', -1)} union all {found_sql(MARKS, 'error', 'rule', -3)} union all {found_sql(RUNS, 'warning', 'model', 0)}),
    r as (select *, case when start < max("end") over (partition by doc_id, index order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from i),
    g as (select *, sum(new) over (partition by doc_id, index order by start, "end" rows between unbounded preceding and current row) as run from r),
    q as (select *, row_number() over (partition by doc_id, index, run order by start, "end", weak) as n from g),
    t as (select doc_id, index, run, n, [{{'s': start, 'e': "end", 'w': weak, 'sev': severity, 'src': source}}] as taken from q where n = 1
        union all select q.doc_id, q.index, q.run, q.n, case when t.taken[-1].e <= q.start then list_append(t.taken, {{'s': q.start, 'e': q."end", 'w': q.weak, 'sev': q.severity, 'src': q.source}})
            when q.weak < t.taken[-1].w then list_append(t.taken[: -2], {{'s': q.start, 'e': q."end", 'w': q.weak, 'sev': q.severity, 'src': q.source}}) else t.taken end
            from t join q on q.doc_id = t.doc_id and q.index = t.index and q.run = t.run and q.n = t.n + 1),
    x as (select doc_id, index, unnest(arg_max(taken, n)) as x from t group by doc_id, index, run)
    select doc_id, index, x.s::int as start, x.e::int as "end", 'format' as category, x.sev as severity, x.src as source, concat_ws('-', 'format', index, x.s, x.e) as id from x""")
def issue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of three rules in the drafts: in order of place, a stronger one in place of the one that it overlaps."""
    return P.merge_issues(all_issues(spark, sf_dir).drop("original", "suggestion"))


@R.query(f"with {DRAFTS_SQL} select doc_id, index, regexp_replace(text, '{SPACES.replace(chr(92) + 't', chr(9))}', ' ', 'g') as text from l")
def apply_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draft_rows(spark, sf_dir)
    return P.apply_issues(rows, marks(rows, SPACES, "warning", F.lit(" ")))


def packed_sql(most_size: int, most_items: int) -> str:
    full = f"f.s + r.s > {most_size} or f.n >= {most_items}"
    return f"""with recursive {LINES_SQL}, r as (select doc_id, index, length(text) as s from l),
    f as (select doc_id, index, s, 0 as pack, 1 as n from r where index = 0
        union all select r.doc_id, r.index, case when {full} then r.s else f.s + r.s end, case when {full} then f.pack + 1 else f.pack end, case when {full} then 1 else f.n + 1 end from f join r on r.doc_id = f.doc_id and r.index = f.index + 1)
    select doc_id, index, pack from f"""


@R.query(packed_sql(1800, 1 << 30))
def pack_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document in sections of at most 1800 characters."""
    return P.packed(line_rows(spark, sf_dir).withColumn("size", F.length("text")), "doc_id", "index", "size", 1800)


@R.query(packed_sql(4000, 24))
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document in batches of at most 24 lines and 4000 characters."""
    return P.packed(line_rows(spark, sf_dir).withColumn("size", F.length("text")), "doc_id", "index", "size", 4000, 24)


@R.query(f"with {LINES_SQL}, t as (select doc_id, index, sum(ceil(length(text) / 4)::bigint) over (partition by doc_id order by index)::bigint as used from l) select * from t where used <= 200")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of each document that fit in 200 tokens."""
    rows = line_rows(spark, sf_dir).select("doc_id", "index", F.ceil(F.length("text") / 4).alias("size"))
    return P.within_budget(rows, "doc_id", "index", "size", 200).select("doc_id", "index", "used")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and an edited text: some words go, some are replaced by marks that stand nowhere else."""
    word = lambda x, i: F.when(i % 41 == 5, F.concat(F.lit("⟦"), i.cast("string"), F.lit("⟧"))).when(i % 67 != 3, x)
    words = F.filter(F.transform(F.split("text", " "), word), lambda x: x.isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"), F.array_join(words, " ").alias("new"))


EDITED_SQL = """e as (select doc_id, text as old, list_filter(list_transform(string_split(text, ' '), lambda x, i: case when (i - 1) % 41 = 5 then '⟦' || (i - 1) || '⟧' when (i - 1) % 67 <> 3 then x end), lambda x: x is not null) as w from documents),
    n as (select doc_id, length(old) as old, length(array_to_string(w, ' ')) as new, coalesce(list_sum(list_transform(list_filter(w, lambda x: starts_with(x, '⟦')), lambda x: length(x))), 0) as marks from e)"""


@R.query(f"with {EDITED_SQL} select doc_id, (old - new + marks)::int as n_deleted, marks::int as n_inserted from n")
def diff_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that a shortest edit deletes and inserts: all that both texts have in common stays, so it inserts the marks
    alone. A longer edit would count more."""
    return D.edit_counts(D.diff_spans(edited(spark, sf_dir), absorb=0)).select("doc_id", "n_deleted", "n_inserted")


@R.query("select doc_id, sha256(text) as old_sha256, true as restored from documents")
def diff_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal and deleted spans give the old text, equal and inserted ones the new."""
    rows = D.diff_spans(edited(spark, sf_dir))
    text = lambda other: F.array_join(F.transform(F.filter("spans", lambda s: s.kind != other), lambda s: s.text), "")
    return rows.select("doc_id", F.sha2(text("insert"), 256).alias("old_sha256"), (text("delete") == F.col("new")).alias("restored"))


@R.query(
    f"""with {TERMS_SQL}{POSTINGS_SQL}{BM25_SQL.format(where="")} h as (select query_id, doc_id from scores qualify row_number() over (partition by query_id order by score desc, doc_id) <= 3),
    w as (select query_id, list(term) as w from terms group by 1),
    s as (select query_id, doc_id, w, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)[:300]), lambda x: x <> '') as s from h join w using (query_id) join documents using (doc_id)),
    k as (select *, list_sort(list_filter(list_transform(s, lambda x, i: {{'k': -len(list_filter(w, lambda t: contains(x, t))), 'i': i, 'n': length(x), 'p': []::bigint[]}}), lambda y: y.k <= -2)) as l from s),
    r as (select *, list_sort(list_reduce(l, lambda a, x: case when a.n + x.n <= 600 then {{'k': a.k, 'i': a.i, 'n': a.n + x.n, 'p': list_append(a.p, x.i)}} else a end, {{'k': 0, 'i': 0::bigint, 'n': 0::bigint, 'p': []::bigint[]}}).p) as p from k)
    select query_id, doc_id, case when len(l) > 0 then array_to_string(list_transform(p, lambda i, k: case when k > 1 and p[k - 1] + 1 <> i then '…' else '' end || s[i]), '') else trim(text[:600]) end as excerpt from r"""
)
def excerpt_best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item, what the documents nearest to it say about its words."""
    hits = S.ranked(keyword(spark, sf_dir), 3, "doc_id").select("query_id", "doc_id")
    terms = benchmark_terms(spark, sf_dir).groupBy("query_id").agg(F.collect_list("term").alias("terms"))  # at most 128 of a query
    rows = hits.join(terms, "query_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return S.excerpts(rows).select("query_id", "doc_id", "excerpt")


def typo_model(texts: list[str]) -> list[str]:
    """Stands for a model: marks a word in each paragraph that has it."""
    found = [re.findall(r"^\[第(\d+)段\].*错字", t, re.M) for t in texts]
    return ["<think>…</think>```json\n" + json.dumps({"issues": [{"paragraph": int(n), "quote": "错字", "suggestion": "别字"} for n in ns]}) + "\n```" for ns in found]


def no_model(texts: list[str]) -> list[str]:
    if texts:
        raise ValueError("asked again")
    return []


@R.query(f"with {LINES_SQL} select doc_id, index::int as index, 4 as start, 6 as \"end\", '错字' as original, '别字' as suggestion from l where index % 3 = 0")
def section_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line has a wrong word. The second run finds all answers stored and asks nothing."""
    word = F.when(F.col("index") % 3 == 0, F.concat(F.lit("第"), (F.col("index") % 7).cast("string"), F.lit("段有错字。"), "text")).otherwise(F.col("text"))
    rows, path = line_rows(spark, sf_dir).withColumn("text", word), shared_path(spark, "answers")
    check.check(rows, typo_model, path)
    return check.check(rows, no_model, path)[0].select("doc_id", "index", "start", "end", "original", "suggestion")
