"""Numbers at the beginning of paragraphs, and the labels that numbered lists show."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import formatted, parse_number

#: Families of numbers: name and pattern, tried in this order; the first group is the number. Fixed values.
FAMILIES = (
    ("chapter", r"^第([一二三四五六七八九十百零〇0-9]+)章"),
    ("section", r"^第([一二三四五六七八九十百零〇0-9]+)节"),
    ("article", r"^第([一二三四五六七八九十百零〇0-9]+)条(?![第规的之、，和或至])"),
    ("chinese", r"^([一二三四五六七八九十]{1,3})、"),
    ("chinese_paren", r"^[（(]([一二三四五六七八九十]{1,3})[）)]"),
    ("dotted", r"^(?:[0-9]{1,2}[.．])+([0-9]{1,2})(?![0-9.．%％])(?!\s*(?:米|公里|万|亿|元|年|月|日|%|个))"),
    ("arabic", r"^([0-9]{1,2})[.．、](?![0-9])"),
    ("arabic_paren", r"^[（(]([0-9]{1,2})[）)]"),
    ("half_paren", r"^([0-9]{1,2})[）)]"),
    ("circled", r"^([①-⑳])"),
)


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (text) with family, value, parent (what stands before the last part of a dotted number), token and variant (the
    marks around the number; "mixed" where an opening and a closing one are of two widths); rows without a number go."""
    text = F.regexp_replace("text", r"^[\s　]+", "")
    family = token = None
    for name, pattern in reversed(FAMILIES):
        fits = text.rlike(pattern)
        family = F.when(fits, name) if family is None else F.when(fits, name).otherwise(family)
        got = F.struct(F.regexp_extract(text, pattern, 1).alias("n"), F.regexp_extract(text, pattern, 0).alias("t"))
        token = F.when(fits, got) if token is None else F.when(fits, got).otherwise(token)
    found = rows.withColumns({"family": family, "_t": token}).filter("family is not null")
    value = F.when(F.col("family") == "circled", F.ascii("_t.n").cast("long") - 0x245F).otherwise(parse_number("_t.n"))
    parent = F.when(F.col("family") == "dotted", F.regexp_replace("_t.t", r"[0-9]+$", "")).otherwise("")
    token = F.col("_t.t")
    marks = F.regexp_replace(token, r"[0-9一二三四五六七八九十百零〇第章节条①-⑳\s]+", "")
    variant = F.when(token.rlike(r"^（.*\)$|^\(.*）$"), "mixed").otherwise(F.substring(marks, 1, 2))
    return found.withColumns({"value": value.cast("int"), "parent": parent, "token": token, "variant": variant}).drop("_t").filter("value is not null")


def list_labels(rows: DataFrame) -> DataFrame:
    """doc_id, index, label of list paragraphs (doc_id, index, list, level, start, style, pattern), where %k in a pattern
    is the number of level k.

    Counters run for each list and level, and start again below a level that went on. A fold over one document.
    """
    schema = "doc_id long, index int, label string"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        counters: dict = {}
        styles: dict = {}
        out = []
        for r in pdf.sort_values("index").itertuples(index=False):
            own = counters.setdefault(r.list, {})
            level = int(r.level)
            own[level] = own[level] + 1 if level in own else int(r.start)
            styles[r.list, level] = r.style
            for deeper in [k for k in own if k > level]:
                del own[deeper]
            label = re.sub(r"%([1-9])", lambda m: formatted(own.get(int(m[1]) - 1, 1), styles.get((r.list, int(m[1]) - 1), "decimal")), r.pattern or "")
            out.append((r.doc_id, r.index, label))
        return pd.DataFrame(out, columns=["doc_id", "index", "label"])

    return rows.groupBy("doc_id").applyInPandas(fold, schema)
