"""Text functions on columns: normalising, tokens, lengths, clips. All built on Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han characters: basic block, extension A, compatibility, U+3007, plane 2; fixed ranges.
HAN = "〇㐀-䶿一-鿿豈-﫿\U00020000-\U0002ffff"
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "
WORD = r"[\p{L}\p{N}]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value worked out once however often it is used, inside other functions of arrays too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalize(text: Column) -> Column:
    """Full-width ASCII and the ideographic space become their half-width forms; offsets stay."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def search_terms(text: Column) -> Column:
    """Words without Han, and overlapping pairs (or a single one) of each run of Han characters; texts without Han, the
    usual case, are only searched for words."""
    pairs = lambda run: F.when(
        run.rlike(f"^[{HAN}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    ).otherwise(F.array(run))
    runs = lambda low: F.regexp_extract_all(low, F.lit(f"[{HAN}]+|[\\p{{L}}\\p{{N}}&&[^{HAN}]]+"), 0)
    return let(F.lower(normalize(text)), lambda low: F.when(low.rlike(f"[{HAN}]"), F.flatten(F.transform(runs(low), pairs))).otherwise(F.regexp_extract_all(low, F.lit(WORD), 0)))


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{HAN}]"))


def worth_reading(text: Column) -> Column:
    return han_count(text) >= 3


def nonspace_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def estimate_tokens(text: Column) -> Column:
    """One for each character from U+2E80 on, and one for four others."""
    wide = F.regexp_count(text, F.lit("[⺀-\U0010ffff]"))
    return wide + F.ceil((F.length(text) - wide) / 4)


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def clip_around(text: Column, needle: Column, radius: int) -> Column:
    """The text within `radius` characters of the needle; from the start where it does not occur."""
    at = F.greatest(F.instr(text, needle), F.lit(1))
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + F.length(needle) - 1 + radius, F.length(text))
    body = F.substring(text, start, end - start + 1)
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; the text itself if it has only one."""
    return F.when(F.length(text) < 2, F.filter(F.array(text), lambda x: x != "")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))
    )


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two arrays of distinct values; 0 for two empty ones."""
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def occurrences(text: Column, needle: Column) -> Column:
    """Offsets (from 0) of every occurrence of the needle, overlapping ones included; none for an empty needle.

    The text is cut before each occurrence, so the offsets are sums of lengths, in one pass over the text.
    """
    parts = F.split(text, F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")))
    none = F.array().cast("array<int>")
    ends = F.aggregate(F.transform(parts, lambda p: F.length(p)), none, lambda a, n: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), F.lit(-1)), F.lit(0)) + n)))
    starts = F.concat(F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(none), F.slice(ends, 1, F.size(ends) - 1))
    return F.when(text.isNull() | (F.length(needle) == 0) | needle.isNull(), none).otherwise(starts)


def safe_file_name(name: Column, default: str = "file") -> Column:
    """Control and reserved characters become "_", outer dots go, stem and extension are cut to 90 and 10."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+$", ""))
    stem, ext = F.regexp_extract(clean, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(clean, r"^.*?(\.[^.]*)?$", 1)
    out = F.concat(F.left(stem, F.lit(90)), F.left(ext, F.lit(11)))
    return F.when(F.coalesce(clean, F.lit("")) == "", default).otherwise(out)


def hash_like(name: Column) -> Column:
    return name.rlike(r"^[0-9a-fA-F]{16,}(?=[ (.]|$)")


def highlight(text: Column, pattern: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Mark the terms of a query, given by words parted with spaces."""
    import re

    terms = sorted((re.escape(t) for t in pattern.split()), key=len, reverse=True)
    return F.regexp_replace(text, "(?i)(" + "|".join(terms) + ")", f"{before}$1{after}") if terms else text


def xml_clean(text: Column) -> Column:
    """Drop what XML 1.0 does not allow."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f￾￿]", "")
