"""Numbers and dates in Chinese and Arabic writing, and the number formats of lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Digits, units and circled numbers; fixed values.
DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "○": 0, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000}
CHINESE = "零一二三四五六七八九"


def number(text: str | None) -> int | None:
    """A whole number in Arabic digits, or in Chinese ones up to ten thousands; digit by digit where it has no unit."""
    if not text or not text.strip():
        return None
    t = text.strip().translate({0xFF10 + i: str(i) for i in range(10)})
    if t.isascii() and t.isdigit():
        return int(t)
    if "万" in t:
        high, low = t.split("万", 1)
        a, b = number(high), number(low.lstrip("零〇")) if low else 0
        return None if a is None or b is None else a * 10_000 + b
    if all(c in DIGITS for c in t):
        return int("".join(str(DIGITS[c]) for c in t))
    total, last = 0, None
    for c in t:
        if c in DIGITS:
            last = DIGITS[c]
        elif c in UNITS:
            if last is None and (c != "十" or total % 100 and c == "十"):
                return None
            total += (1 if last is None else last) * UNITS[c]
            last = None
        else:
            return None
    return total + (last or 0)


@F.pandas_udf(LongType())
def parse_number(texts: pd.Series) -> pd.Series:
    return texts.map(number).astype("Int64")


def chinese(n: int) -> str:
    """1 to 9999 in Chinese."""
    if not 0 < n < 10_000:
        return str(n)
    out, zero = "", False
    for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d, n = divmod(n, unit)
        if d:
            out += ("零" if zero and out else "") + CHINESE[d] + name
            zero = False
        else:
            zero = True
    return out[1:] if out.startswith("一十") else out


def roman(n: int) -> str:
    out = ""
    for value, mark in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += mark * (n // value)
        n %= value
    return out


def formatted(n: int, style: str) -> str:
    """A list number in a named style; decimal for styles that are not known."""
    if style in ("upperLetter", "lowerLetter"):
        letter = chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1) if n > 0 else ""
        return letter if style[0] == "u" else letter.lower()
    if style in ("upperRoman", "lowerRoman"):
        return roman(n) if style[0] == "u" else roman(n).lower()
    if style in ("chineseCounting", "chineseCountingThousand", "japaneseCounting", "ideographDigital"):
        return chinese(n)
    if style in ("decimalEnclosedCircle", "decimalEnclosedCircleChinese") and 0 < n <= 20:
        return chr(0x245F + n)
    if style == "decimalZero":
        return f"{n:02d}"
    if style == "decimalFullWidth":
        return str(n).translate({48 + i: 0xFF10 + i for i in range(10)})
    return "" if style in ("none", "bullet") else str(n)


DATE = re.compile(r"([0-9〇○零一二三四五六七八九]{4})\s*[年/.-]\s*([0-9]{1,2}|[一二三四五六七八九十]{1,3})\s*[月/.-]\s*([0-9]{1,2}|[一二三四五六七八九十]{1,3})")


def date(text: str | None) -> str | None:
    """The first date of a text as year-month-day; days are checked against 31 only."""
    for m in DATE.finditer(text or ""):
        y, mo, d = (number(g) for g in m.groups())
        if y and mo and d and 1900 <= y <= 2100 and mo <= 12 and d <= 31:
            return f"{y:04d}-{mo:02d}-{d:02d}"
    return None


@F.pandas_udf(StringType())
def parse_date(texts: pd.Series) -> pd.Series:
    return texts.map(date)


def probability(value: Column) -> Column:
    """A probability written as a number, a percentage or a truth value, held between 0 and 1; null for other texts."""
    t = F.lower(F.trim(value))
    n = F.when(t.endswith("%"), F.try_to_number(F.regexp_replace(t, "[^0-9.]", ""), F.lit("999999.999999")).cast("double") / 100)
    n = F.coalesce(n, F.when(t.isin("true", "yes", "是"), 1.0).when(t.isin("false", "no", "否"), 0.0), t.try_cast("double"))
    return F.when(n.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), n)))
