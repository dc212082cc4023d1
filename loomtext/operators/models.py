"""Model calls as injected functions over batches, and readers of what models answer.

No model is called here: a function from a list of inputs to a list of outputs is a parameter, run batch by batch where
the rows are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped(rows: DataFrame, function: Callable[[list], list], column: str, out: str, kind: str, batch: int = 32) -> DataFrame:
    """rows with `out`, the function's answers for `column`, asked `batch` at a time; another number of answers raises."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = part[column].tolist()
            answers: list = []
            for i in range(0, len(values), batch):
                got = function(values[i : i + batch])
                if len(got) != len(values[i : i + batch]):
                    raise ValueError("the model gave another number of answers")
                answers += got
            yield part.assign(**{out: pd.Series(answers, index=part.index, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` {kind}"
    return rows.mapInPandas(run, schema)


def embed(chunks: DataFrame, function: Callable[[list[str]], list[list[float]]], column: str = "text") -> DataFrame:
    return mapped(chunks, function, column, "vector", "array<float>")


def rerank(hits: DataFrame, function: Callable[[list[tuple[str, str]]], list[float | None]], query: str = "query", text: str = "text") -> DataFrame:
    """hits with score, null where the model gives none."""
    pairs = hits.withColumn("_pair", F.struct(query, text))
    return mapped(pairs, lambda xs: function([(x[query], x[text]) if isinstance(x, dict) else (x[0], x[1]) for x in xs]), "_pair", "score", "double").drop("_pair")


def bucket_embedder(size: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for tests: characters counted in `size` buckets by hash, to unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for c in t or "":
                v[hashlib.md5(c.encode()).digest()[0] % size] += 1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm if norm else 0.0 for x in v])
        return out

    return run


def overlap_reranker(pairs: list[tuple[str, str]]) -> list[float]:
    """A stand-in for tests: the share of the query's characters that the text has."""
    return [sum(c in t for c in set(q)) / len(set(q)) if q else 0.0 for q, t in pairs]


# ---- readers -----------------------------------------------------------------------------------------------------
def answer_body(answer: Column) -> tuple[Column, Column]:
    """(thought, rest): what stands in think tags, and the answer without it."""
    thought = F.regexp_extract(answer, r"(?s)<think>(.*?)</think>", 1)
    return thought, F.trim(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))


def json_of(answer: Column) -> Column:
    """The JSON text in an answer: within a code fence, else from the first bracket to the last; null if none parses."""
    _, body = answer_body(answer)
    fenced = F.nullif(F.trim(F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.lit(""))
    bare = F.nullif(F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1), F.lit(""))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(fenced), valid(bare))


def field(json: Column, *names: str) -> Column:
    """The first of the named fields that is there, as text."""
    return F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names))


def items(json: Column, name: str) -> Column:
    """The elements of an array field, each as JSON text; a bare array stands for the field."""
    array = F.when(F.startswith(F.trim(json), F.lit("[")), json).otherwise(F.get_json_object(json, f"$.{name}"))
    return F.coalesce(F.from_json(array, "array<string>"), F.array().cast("array<string>"))


def check_answers(answers: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, facts) of answers (doc_id, answer).

    An issue counts if its quote stands in its paragraph as it is; its place is the quote's first one. Facts come as
    objects or as arrays of paragraph, subject, metric, value and unit.
    """
    json = answers.select("doc_id", json_of(F.col("answer")).alias("j")).filter("j is not null")
    raw = json.select("doc_id", F.explode(items(F.col("j"), "issues")).alias("x"))
    found = raw.select("doc_id", field(F.col("x"), "paragraph", "index", "p").try_cast("int").alias("index"), field(F.col("x"), "quote", "original", "text").alias("original"), field(F.col("x"), "suggestion", "fix").alias("suggestion"), field(F.col("x"), "reason", "why").alias("reason"))
    placed = found.join(paragraphs.select("doc_id", "index", "text"), ["doc_id", "index"]).withColumn("start", F.instr("text", F.col("original")) - 1).filter("start >= 0 and original <> ''")
    issues = placed.select("doc_id", "index", "start", (F.col("start") + F.length("original")).alias("end"), "original", "suggestion", "reason")
    facts = json.select("doc_id", F.explode(items(F.when(F.startswith(F.trim("j"), F.lit("{")), F.col("j")), "facts")).alias("x"))
    compact = F.from_json("x", "array<string>")
    get = lambda i, *names: F.when(F.startswith("x", F.lit("[")), F.get(compact, F.lit(i))).otherwise(field(F.col("x"), *names))
    rows = facts.select("doc_id", get(0, "paragraph", "p").try_cast("int").alias("index"), get(1, "subject").alias("subject"), get(2, "metric").alias("metric"), get(3, "value").alias("value"), get(4, "unit").alias("unit"))
    return issues, rows.filter("index is not null and value is not null").join(paragraphs.select("doc_id", "index"), ["doc_id", "index"], "left_semi")


def confirmed_groups(answers: DataFrame) -> DataFrame:
    """doc_id, group (from 0), reason: the groups of figures that answers (doc_id, n_groups, answer) confirm as contradictions;
    numbers that are no group's do not count."""
    json = answers.select("doc_id", "n_groups", json_of(F.col("answer")).alias("j")).filter("j is not null")
    each = json.select("doc_id", "n_groups", F.explode(items(F.col("j"), "groups")).alias("x"))
    told = F.lower(field(F.col("x"), "conflict", "contradiction")) == "true"
    rows = each.filter(told).select("doc_id", "n_groups", field(F.col("x"), "id", "group").try_cast("int").alias("id"), F.coalesce(field(F.col("x"), "reason", "理由"), F.lit("")).alias("reason"))
    return rows.filter("id between 1 and n_groups").select("doc_id", (F.col("id") - 1).alias("group"), "reason")


#: Words for the state of a cited document; fixed values.
STATES = {"current": ["current", "现行", "有效"], "repealed": ["repealed", "废止", "已废止"], "superseded": ["superseded", "replaced", "替代", "已替代"]}


def citation_statuses(answers: DataFrame) -> DataFrame:
    """title, status, replacement_title, replacement_number, reason of answers (title, answer); a replacement counts for what is
    superseded only; answers without a status are left out, unknown words are the status unknown."""
    json = answers.select("title", json_of(F.col("answer")).alias("j"))
    word = F.lower(F.trim(field(F.col("j"), "status", "状态")))
    status = F.coalesce(*(F.when(word.isin(words), name) for name, words in STATES.items()), F.when(word.isNotNull(), F.lit("unknown")))
    new = F.get_json_object("j", "$.replacement")
    named = F.nullif(F.regexp_replace(field(new, "title", "name"), "^《+|》+$", ""), F.lit(""))
    rows = json.select("title", status.alias("status"), named.alias("_t"), field(new, "number", "no", "code").alias("_n"), F.coalesce(field(F.col("j"), "reason", "理由"), F.lit("")).alias("reason")).filter("status is not null")
    only = lambda c: F.when((F.col("status") == "superseded") & F.col("_t").isNotNull(), F.col(c))
    return rows.select("title", "status", only("_t").alias("replacement_title"), only("_n").alias("replacement_number"), "reason")


def decisions(answers: DataFrame) -> DataFrame:
    """question_id, value of answers (question_id, kind, options, answer): yes/no and score as numbers, a choice as the
    index of its option, given by name or number; probabilities by option count as their largest; null if unreadable."""
    from ..functions.numbers import probability

    json = F.coalesce(json_of(F.col("answer")), F.lit("{}"))
    raw = F.coalesce(field(json, "value", "answer", "choice", "score", "probability"), F.trim("answer"))
    by_name = F.array_position("options", raw).cast("int")
    by_number = F.when(raw.rlike(r"^\d+$"), raw.cast("int") + 1)
    chances = F.from_json(field(json, "probabilities"), "map<string,double>")
    likeliest = F.array_position(F.transform("options", lambda o: F.coalesce(F.element_at(chances, o), F.lit(0.0))), F.array_max(F.map_values(chances))).cast("int")
    choice = F.coalesce(F.nullif(by_name, F.lit(0)), by_number, F.nullif(likeliest, F.lit(0))) - 1
    choice = F.when((choice >= 0) & (choice < F.size("options")), choice)
    return answers.select("question_id", F.when(F.col("kind") == "choice", choice.cast("double")).otherwise(probability(raw)).alias("value"))
