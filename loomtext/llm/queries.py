"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, fim, fingerprint, license, neardup, quality, substring, suffix, tokens, toxicity, url_filter
from .common import documents

#: Fixed by the contract.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
WORD_TOKENIZER, RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled document of the page's id is its outcome: good if of quality and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    out = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels, URL_RULES)
    return out.withColumns({c: F.round(c, 6) for c in ("good_mean", "good_upper")})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_records(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER)).drop("ids")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ledger(documents(spark, sf_dir), "v1")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("ids")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.arrange(documents(spark, sf_dir)))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_url_filter, op3_toxicity, op4_near_duplicates, op5_token_records, op6_packing, op7_quality_rules, op8_fingerprints,
        op9_suffix_dedup, op10_byte_bpe, op11_filter_audit, op12_fill_in_middle, op13_license_scan,
    )
}

def strength_sql(rows: str, good: str, n: str, prior: str) -> str:
    """A prior's strength over rows, as url_filter.strength has it."""
    p, q, (least, most) = prior, f"{good} / {n}", url_filter.STRENGTH
    return f"""(select case when coalesce(sum({n}), 0) = 0 or sum({n} * {p} * (1 - {p})) = 0 then {most} else
        least({most}, greatest({least}, 1 / greatest(1e-9, (sum({n} * ({q} - {p}) ** 2) - sum({p} * (1 - {p}))) / greatest(sum({n} * {p} * (1 - {p})) - sum({p} * (1 - {p})), 1e-9)) - 1)) end
        from {rows} where {n} > 1)"""


LISTED = ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)
RULE_CASES = {r: f"(host = '{r.split('/')[0]}' or ends_with(host, '.{r.split('/')[0]}')) and starts_with(path, '/{r.split('/', 1)[1]}')" for r in sorted(URL_RULES, key=len, reverse=True)}



def text_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


KNOWN = license.templates()
#: (t, label, base, words, first key phrase's place and words) and (t, place, phrase) of every key phrase.
TEMPLATE_ROWS = ", ".join(f"({t}, '{k.label}', {str(k.base).lower()}, {text_list(k.words)}, {k.keys[0][0]}, '{k.keys[0][1].split()[0]}')" for t, k in enumerate(KNOWN))
KEY_ROWS = ", ".join(f"({t}, {at}, {text_list(phrase.split())})" for t, k in enumerate(KNOWN) for at, phrase in k.keys)

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": rf"""
        with u as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end r from pages),
        p as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from u),
        m as (select doc_id page_id, count(*) m, count(*) filter (where quality = 1 and toxic = 0) g from labels where doc_id is not null and quality is not null and toxic is not null group by 1),
        c as (select host, coalesce(sum(m), 0)::double n, coalesce(sum(g), 0)::double g, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':\d*$', '') bare from p left join m using (page_id) group by host),
        l as (select *, case when regexp_full_match(bare, '\d{{1,3}}(\.\d{{1,3}}){{3}}|\[.*\]') or not contains(bare, '.') then [bare] else string_split(bare, '.') end l from c),
        k as (select *, case when len(l) >= 4 and array_to_string(l[-4:], '.') in ({LISTED}) then 4 when len(l) >= 3 and array_to_string(l[-3:], '.') in ({LISTED}) then 3
            when len(l) >= 2 and array_to_string(l[-2:], '.') in ({LISTED}) then 2 else 1 end k from l),
        h as (select host, n, g, array_to_string(l[-k:], '.') suffix, array_to_string(l[-least(k + 1, len(l)):], '.') as dom from k),
        top as (select (coalesce(sum(g), 0) + 1) / (coalesce(sum(n), 0) + 2) top from h),
        s as (select suffix, sum(n) sn, sum(g) sg, any_value(top) top from h, top group by suffix), ks as (select {strength_sql("s", "sg", "sn", "top")} ks),
        sr as (select suffix, (sg + ks * top) / (sn + ks) srate from s, ks),
        d as (select dom, suffix, sum(n) dn, sum(g) dg, any_value(srate) srate from h join sr using (suffix) group by dom, suffix), kd as (select {strength_sql("d", "dg", "dn", "srate")} kd),
        dr as (select dom, suffix, (dg + kd * srate) / (dn + kd) drate from d, kd),
        x as (select * from h join dr using (dom, suffix)), kh as (select {strength_sql("x", "g", "n", "drate")} kh),
        ab as (select host, g + kh * drate a, n - g + kh * (1 - drate) b from x, kh),
        post as (select host, a / (a + b) mean, a / (a + b) + 1.645 * sqrt(a * b / (a + b) / (a + b) / (a + b + 1)) upper from ab),
        j as (select page_id, host, path, case {" ".join(f"when {fits} then '{r}'" for r, fits in RULE_CASES.items())} end as rule, mean, upper, top from p join post using (host), top)
        select page_id, host, path, rule, case {" ".join(f"when rule = '{r}' then '{v}'" for r, v in URL_RULES.items())} when upper < top then 'block' else 'allow' end verdict,
            round(mean, 6) good_mean, round(upper, 6) good_upper from j""",
    "op1_substring_dedup": r"""
        with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        s as (select doc_id, w, unnest(range(1, len(w) - 48)) i from w where len(w) >= 50),
        h as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) h from s),
        f as (select h, min(doc_id) first from h group by h),
        c as (select distinct doc_id, unnest(range(i, i + 50)) p from h join f using (h) where first < doc_id),
        g as (select doc_id, list(p) gone from c group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
            sha256(array_to_string(list_filter(w, lambda x, k: not coalesce(list_contains(gone, k), false)), ' ')) kept_sha256
        from w left join g using (doc_id)""",
    "op7_quality_rules": r"""
        with w as (select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
        g as (select doc_id, i, list_value(w[i], w[i + 1], w[i + 2]) g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)),
        r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
        p as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from r) group by doc_id),
        m as (select w.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, len(l)::bigint n_lines,
            (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(p.n, 0)::bigint n_repeat_words from w left join p using (doc_id)),
        b as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
            + case when 10 * n_symbols > n_words then 4 else 0 end + case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end
            + case when word_chars > 15 * n_words or word_chars < 2 * n_words then 16 else 0 end
            + case when n_lines >= 20 and n_words < 2 * n_lines then 32 else 0 end)::bigint failed from m)
        select *, (failed & 3) <> 0 base_failed, (failed & 7) = 0 kept from b""",
    "op11_filter_audit": r"""
        with w as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        m as (select doc_id, part, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
            + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
            + case when min(doc_id) over (partition by t) < doc_id then 16 else 0 end mask from w),
        l as (select doc_id, max(coalesce(quality = 1, false)::int) good, max(coalesce(toxic = 1, false)::int) toxic from labels where doc_id is not null group by doc_id),
        c as (select part, mask, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from m left join l using (doc_id) group by part, mask),
        f as (select unnest(['A', 'B', 'C', 'D', 'E']) f),
        p as (select a.f || b.f || c.f || d.f || e.f o from f a, f b, f c, f d, f e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s as (select o filter_order, i step, substr(o, i, 1) f, 1 << (instr('ABCDE', substr(o, i, 1)) - 1) fbit, list_sum([0] || list_transform(range(1, i), lambda k: 1 << (instr('ABCDE', substr(o, k, 1)) - 1))) earlier
            from (select o, unnest(range(1, 6)) i from p)),
        r as (select part, filter_order, step::int step, f, sum(n) filter (where mask & (fbit | earlier::bigint) = 0) kept, sum(n) filter (where mask & fbit <> 0 and mask & earlier::bigint = 0) removed,
            sum(n) filter (where mask & fbit <> 0 and mask & earlier::bigint <> 0) redundant, sum(n) filter (where mask = fbit) unique_fails,
            sum(good) filter (where mask & fbit <> 0 and mask & earlier::bigint = 0) good_lost, sum(toxic) filter (where mask & fbit <> 0 and mask & earlier::bigint = 0) toxic_lost
            from c, s group by part, filter_order, step, f)
        select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails,
            coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost, coalesce(sum(removed) over (partition by part, f), 0)::bigint shapley from r""",
    "op12_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(doc_id::varchar, '')) h from documents),
        u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u, ('0x' || substr(h, 1, 8))::bigint h1, ('0x' || substr(h, 9, 8))::bigint h2,
            ('0x' || substr(h, 17, 8))::bigint h3, ('0x' || substr(h, 25, 8))::bigint h4 from d),
        c as (select *, len(u)::bigint n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from u),
        x as (select *, array_to_string(u[1 : a], '') p, array_to_string(u[a + 1 : b], '') m, array_to_string(u[b + 1 : n], '') s from c)
        select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from x""",
    "op13_license_scan": rf"""
        with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
        t(t, label, base, words, rel, first) as (values {TEMPLATE_ROWS}), k(t, rel, phrase) as (values {KEY_ROWS}),
        p as (select doc_id, w, unnest(range(len(w))) i from w),
        s as (select p.doc_id, w, t.t, label, base, words, i - rel as place from p join t on p.w[p.i + 1] = t.first where i - rel >= 0),
        v as (select s.* from s join k using (t) group by all having bool_and(w[place + k.rel + 1 : place + k.rel + len(phrase)] = phrase)),
        h as (select doc_id, label, base, place, len(list_filter(range(1, len(words) + 1), lambda j: coalesce(w[place + j] = words[j], false))) / len(words) share from v),
        g as (select doc_id, count(*) filter (where base) n_base, min(place) filter (where base) first_word, max(place) filter (where base) last_word, string_agg(distinct label, ',' order by label) filter (where base) base_labels,
            string_agg(distinct label, ',' order by label) labels, max(share) score from h where share >= {license.LEAST_SHARE} group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, round(coalesce(score, 0), 6) score from w left join g using (doc_id)""",
}
