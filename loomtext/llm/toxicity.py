"""Toxicity by cumulative-link ordinal regression: sparse word features, one weight vector, ordered thresholds.

P(grade <= j) = sigmoid(cut[j] - w.x). The grades of the labelled documents: 0 not toxic; toxic documents are graded
1 to 3 by how many words they have that stand out in toxic documents (none; up to the median; above it). The fit uses a
bounded sample of labelled documents; scoring is one pass over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, blocks, id_text, stored

#: Documented bound of the fit: labelled documents.
SAMPLE = 12_000
GRADES = 4
#: Features are words, and their beginnings of these lengths (marked by "-"), which stand for a stem.
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    cuts: tuple[float, ...]

    def grades(self, text: str) -> tuple[float, ...]:
        """Probability of each grade."""
        weights, counts = self.weights, Counter()
        for word, n in Counter(WORD.findall(text.lower())).items():
            for f in (word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)):
                if f in weights:
                    counts[f] += n
        return probabilities(sum(feature(n) * weights[f] for f, n in counts.items()), self.cuts)


def feature(n: int) -> float:
    return 1 + math.log(n)


def probabilities(score: float, cuts: tuple[float, ...]) -> tuple[float, ...]:
    below = [1 / (1 + math.exp(min(700.0, score - c))) for c in cuts]
    return tuple(b - a for a, b in zip([0.0, *below], [*below, 1.0], strict=True))


def unlike(rows: DataFrame, rounds: int = 3) -> DataFrame:
    """One row of each group of copies and near copies (nearly all of them): the least hash of a three-word run agrees."""
    words = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    rows = rows.withColumn("_w", words)
    for seed in range(rounds):
        key = F.when(F.size("_w") < 3, F.xxhash64("text")).otherwise(F.array_min(F.expr(f"transform(sequence(0, greatest(size(_w), 3) - 3), i -> xxhash64({seed}, _w[i], _w[i + 1], _w[i + 2]))")))
        rows = rows.groupBy(key.alias("_k")).agg(F.min_by(F.struct("doc_id", "y", "text", "_w"), "doc_id").alias("r")).select("r.*")
    return rows.drop("_w")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_docs: int = 6, least_z: float = 6.0, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Fit on at most `sample` labelled documents, those of the least hashed ids, without their near copies.

    Words with a weight are those in at least least_docs documents whose share of toxic ones lies least_z standard
    deviations above the share of all. Where none stands out so far, as with few labels, the model has no weights and every
    document stays: too few signs are no ground to drop one. Labels without an id or value, of unknown documents, or repeated ones do not
    count. Without toxic or without other labelled documents, the model has no weights and gives every document grade 0.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(toxic_col).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stored(unlike(id_text(docs, id_col, text_col).join(F.broadcast(marks), "doc_id")), "labelled")  # at most `sample` rows
    words = rows.select("doc_id", "y", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    features = F.concat(F.array("word"), *(F.when(F.length("word") > k, F.array(F.concat(F.left("word", F.lit(k)), F.lit("-")))).otherwise(F.array()) for k in PREFIXES))
    counts = words.groupBy("doc_id", "y", "word").count().select("doc_id", "y", "count", F.explode(features).alias("word")).groupBy("doc_id", "y", "word").agg(F.sum("count").alias("count"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Model({}, tuple(20.0 + j for j in range(GRADES - 1)))
    if not toxic or not clean:
        return nothing
    rate = toxic / (toxic + clean)
    table = counts.groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("n")).filter(F.col("n") >= least_docs)
    z = (F.col("t") - rate * F.col("n")) / F.sqrt(F.col("n") * rate * (1 - rate))
    scored = table.select("word", z.alias("z")).filter(F.col("z") > least_z)
    names = sorted(r["word"] for r in scored.collect())  # of the sample's words
    if not names:
        return nothing
    column = {w: i for i, w in enumerate(names)}
    # one row a sampled document, with its few words that have a column
    mine = F.col("word").isin(names)
    got = counts.groupBy("doc_id", "y").agg(F.collect_list(F.when(mine, F.struct("word", "count"))).alias("words")).collect()
    x = np.zeros((len(got), len(names)))
    for i, r in enumerate(got):
        for w in r["words"]:
            x[i, column[w["word"]]] = feature(w["count"])
    y = np.array([r["y"] for r in got])
    amount = x.sum(axis=1)
    some = (y == 1) & (amount > 0)
    middle = np.median(amount[some]) if some.any() else 0.0
    w, cuts = ordinal(x, np.where(y == 0, 0, np.where(amount == 0, 1, np.where(amount <= middle, 2, 3))))
    return Model({n: float(v) for n, v in zip(names, w, strict=True) if abs(v) > 1e-3}, cuts)


def ordinal(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, tuple[float, ...]]:
    """Weights and cuts by maximum penalised likelihood (Adam on the whole sample; cuts ordered by their gaps' logs)."""
    n, d = x.shape
    k = GRADES - 1
    share = np.clip([(y <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    rows = np.arange(n)
    for t in range(1, steps + 1):
        w, gaps = p[:d], np.exp(p[d + 1 :])
        cuts = p[d] + np.concatenate([[0], np.cumsum(gaps)])
        below = np.column_stack([np.zeros(n), sigmoid(cuts - (x @ w)[:, None]), np.ones(n)])
        slope = below * (1 - below)
        prob = np.maximum(below[rows, y + 1] - below[rows, y], 1e-9)
        up, down = slope[rows, y + 1] / prob, slope[rows, y] / prob  # derivative of log prob by the cut above and below
        g_cut = np.zeros(k + 2)
        np.add.at(g_cut, y + 1, up)
        np.add.at(g_cut, y, -down)
        g_cut = g_cut[1:-1] / n
        g = np.concatenate([-(x.T @ (up - down)) / n - penalty * w, [g_cut.sum()], [g_cut[j + 1 :].sum() * gaps[j] for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[:d] = np.maximum(p[:d], 0)  # the features were chosen as signs of toxicity; none speaks against it
    return p[:d], tuple(float(c) for c in p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))]))


def score(docs: DataFrame, model: Model, threshold: float = 0.2, **cols: str) -> DataFrame:
    """doc_id, p0 to p3, expected_severity, toxic (P(grade > 0) >= threshold), kept: one row a row with an id.

    A null or empty text has no words and is scored so. Repeated rows are scored each.
    """
    schema = "doc_id long, " + ", ".join(f"p{j} double" for j in range(GRADES)) + ", expected_severity double, toxic boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in blocks(batches):
            p = [model.grades(x) for x in batch.column("text").to_pylist()]
            toxic = [1 - q[0] >= threshold for q in p]
            cols = [batch.column("doc_id"), *(pa.array(c) for c in zip(*p, strict=True)), pa.array([sum(j * q for j, q in enumerate(r)) for r in p]), pa.array(toxic), pa.array([not x for x in toxic])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"p{j}" for j in range(GRADES)), "expected_severity", "toxic", "kept"])

    return id_text(docs, **cols).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.2, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not toxic.

    A null or empty text is not toxic; rows without an id and repeated rows are judged each; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in blocks(batches, text_col=text_col):
            yield batch.filter(pa.array([not x or 1 - model.grades(x)[0] < threshold for x in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
