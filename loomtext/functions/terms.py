"""Terms of the index and of queries: one rule for both, so that whatever is indexed under a form is asked for in it.

Document numbers and ordinals (第n条) have one canonical form; words are lower-cased, without marks on Latin letters, and
without stop words; a run of Han characters gives its overlapping pairs.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN, let, normalize, search_terms

#: Words that an index leaves out; fixed values.
STOP_WORDS = (
    "的 了 和 与 及 或 等 在 是 为 对 由 将 把 被 于 之 其 以 而 并 且 也 都 就 这 那 此 该 各 有 个 第 条 号 款 项 着 从 向 到 按 如 若 则 但 又 还 所 已 我 你 他 她 它 们 "
    "我们 你们 他们 吗 呢 吧 啊 及其 以及 或者 并且 关于 对于 一个 这个 那个 这些 那些 什么 怎么 如何 哪些 the a an of and or to in on for is are be with by as at"
).split()
#: Ordinals; a fixed pattern.
ORDINAL = "第([0-9一二三四五六七八九十百千零〇○两]+)(条|章|节|编|款|项|部分)"
#: Chinese digits and their values; fixed values.
DIGITS = ("〇○零一二两三四五六七八九", "0001223456789")
#: Document numbers: the issuer's code, a year in brackets of any kind, a count; a fixed pattern.
NUMBER = rf"([{HAN}]{{0,12}})\s*[〔\[【(（]\s*((?:19|20)[0-9]{{2}})\s*[〕\]】)）]\s*第?\s*([0-9]{{1,5}})\s*号"
#: What ends before an issuer's code: characters after which it begins, and words that lead up to it; fixed values.
CODE_BREAKS = "的号和及与或见将据照按依即在为由是了对"
CODE_LEADS = "根据 依据 按照 参照 遵照 对照 贯彻 落实 执行 印发 转发 现将 关于 通知 文件 精神 要求 规定 办法 附件".split()
#: Terms of a query, at most.
MOST_TERMS = 128
#: Precomposed Latin letters and the letter each is without its marks; marks of their own are dropped.
ACCENTED = {c: b for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and (b := d[0]).isascii()}
MARKS = "[̀-ͯ]"


def without_accents(text: Column) -> Column:
    """Latin letters without their marks, whether the marks are part of the letter or follow it."""
    plain = F.translate(text, "".join(ACCENTED), "".join(ACCENTED.values()))
    return let(plain, lambda x: F.when(x.rlike(MARKS), F.regexp_replace(x, MARKS, "")).otherwise(x))


def number_matches(text: Column) -> Column:
    """Document numbers in a normalised text, in order: an array of struct(number, context, whole, lead).

    number is canonical (issuer's code, year in 〔〕, count without zeros in front); context is the same with all that ran
    into the code; whole is what stands in the text, lead the part of it that belongs to no number. A number without a
    code is none.
    """
    part = lambda i: F.regexp_extract_all(text, F.lit(NUMBER), F.lit(i))
    both = F.arrays_zip(part(0).alias("whole"), part(1).alias("raw"), part(2).alias("year"), part(3).alias("count"))
    code = lambda raw: F.regexp_replace(F.regexp_replace(raw, f"^.*[{CODE_BREAKS}]", ""), f"^(?:{'|'.join(CODE_LEADS)})+", "")
    tail = lambda m: F.concat(F.lit("〔"), m["year"], F.lit("〕"), m["count"].cast("int").cast("string"), F.lit("号"))
    one = lambda m, c: F.struct(F.concat(c, tail(m)).alias("number"), F.concat(m["raw"], tail(m)).alias("context"), m["whole"].alias("whole"), F.left(m["raw"], F.length(m["raw"]) - F.length(c)).alias("lead"))
    each = F.transform(both, lambda m: let(code(m["raw"]), lambda c: one(m, c)))
    none = F.array().cast("array<struct<number:string,context:string,whole:string,lead:string>>")
    return F.when(text.contains("号"), F.filter(each, lambda m: ~m["number"].startswith("〔"))).otherwise(none)


def doc_numbers(text: Column) -> Column:
    """Canonical document numbers in a text, in order, each once."""
    return F.array_distinct(F.transform(number_matches(normalize(text)), lambda m: m["number"]))


def numeral(text: Column) -> Column:
    """The number of an Arabic or Chinese numeral below ten thousand; digits alone are read one by one."""
    digits = F.translate(text, *DIGITS)
    place = lambda unit, n: F.coalesce(F.when(digits.contains(unit), F.coalesce(F.nullif(F.regexp_extract(digits, f"([0-9]){unit}", 1), F.lit("")).cast("int"), F.lit(1)) * n), F.lit(0))
    units = place("千", 1000) + place("百", 100) + place("十", 10) + F.coalesce(F.nullif(F.regexp_extract(digits, "([1-9])$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(digits.rlike("[千百十]"), units).otherwise(digits.try_cast("int"))


def special_terms(plain: Column) -> Column:
    """Canonical document numbers and ordinals of a normalised text; most texts have neither mark and are not searched."""
    none = F.array().cast("array<string>")
    numbers = F.when(plain.contains("号"), F.transform(doc_numbers(plain), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))).otherwise(none)
    both = F.arrays_zip(F.regexp_extract_all(plain, F.lit(ORDINAL), 1).alias("n"), F.regexp_extract_all(plain, F.lit(ORDINAL), 2).alias("u"))
    ordinals = F.filter(F.transform(both, lambda x: F.concat(F.lit("第"), numeral(x["n"]).cast("string"), x["u"])), lambda x: x.isNotNull())
    return F.concat(numbers, F.when(plain.contains("第"), ordinals).otherwise(none))


def words(text: Column) -> Column:
    """Words and Han pairs of a text without marks and stop words, in order, repeats included."""
    return F.filter(search_terms(without_accents(text)), lambda w: ~w.isin(*STOP_WORDS))


def index_terms(text: Column) -> Column:
    """Terms that a text is indexed under, repeats included. A null text gives null, an empty one none."""
    return F.concat(let(normalize(text), special_terms), words(text))


def query_terms(text: Column, most: int = MOST_TERMS) -> Column:
    """Distinct terms of a query, the first `most`. What a canonical term covers gives no words: a query for an article
    does not ask for every number in its name."""
    plain = normalize(text)
    without = F.aggregate(number_matches(plain), plain, lambda t, m: F.replace(t, m["whole"], F.concat(m["lead"], F.lit(" "))))
    rest = F.when(plain.rlike("[号第]"), F.regexp_replace(without, ORDINAL, " ")).otherwise(plain)
    return F.slice(F.array_distinct(F.concat(special_terms(plain), words(rest))), 1, most)


def is_han(text: Column) -> Column:
    return text.rlike(f"[{HAN}]")
