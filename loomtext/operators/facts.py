"""Labelled facts of a project in a document: for each, the first paragraph that states it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How facts are stated, the value in the first group; fixed patterns.
STATED: dict[str, str] = {
    "name": r"^\s*(?:项目|工程)名称\s*[:：]\s*(.+?)\s*[。；;]?\s*$",
    "location": r"(?:建设地点|项目地点|项目选址|建设地址|项目地址)\s*[:：]\s*([^。；;\n]+)",
    "place": r"(?:项目|工程|场地|地块)(?:拟)?(?:位于|选址于|选址位于|地处|坐落于|建设地点位于|建于|选址在)([^，,。；;]+)",
    "owner": r"(?:建设单位|项目单位|项目法人|业主单位|项目业主|项目建设单位)\s*[:：为]\s*([^。；;，,\n]+)",
    "investment": r"总投资(?:估算|概算)?(?:额)?(?:为|约|约为|共计|合计|:|：|\s)*([0-9][0-9,.]*\s*(?:亿元|万元|元))",
    "period": r"(?:建设工期|建设周期|计划工期|施工工期)(?:为|约|:|：|\s)*([^，,。；;]{1,20})",
    "scale": r"建设规模(?:为|:|：|\s)*([^。；;]{2,60})",
}


def labelled(rows: DataFrame, stated: Mapping[str, str] = STATED) -> DataFrame:
    """doc_id, fact, value, index: the first paragraph (doc_id, index, text) that states a fact, and what it says, trimmed.
    A paragraph states it where its first match is not blank; a null text states nothing."""
    found = F.array(*(F.struct(F.lit(name).alias("fact"), F.regexp_replace(F.regexp_extract("text", pattern, 1), r"(?U)^\s+|\s+$", "").alias("value")) for name, pattern in stated.items()))
    each = rows.filter("text is not null").select("doc_id", "index", F.explode(F.filter(found, lambda x: x["value"] != "")).alias("x"))
    return each.groupBy("doc_id", "x.fact").agg(F.min_by("x.value", "index").alias("value"), F.min("index").alias("index"))
