"""The ordinal model against plain statements of its features, probabilities and likelihood; odd rows through the byte
encoder and the pipeline's stages."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from loomtext.llm import bpe, queries, toxicity

from .test_tokens import encoding  # noqa: F401


def plain_features(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(re.findall(r"[^\W\d_]+", text.lower())).items():
        for f in (word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k)):
            out[f] += n
    return out


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z))


def plain_grades(text: str, weights: dict, cuts) -> list[float]:
    score = sum((1 + math.log(n)) * weights[f] for f, n in plain_features(text).items() if f in weights)
    below = [sigmoid(c - score) for c in cuts] + [1.0]
    return [b - a for a, b in zip([0.0, *below], below, strict=False)]


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(6)
    clean, bad = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)], ["grobian", "schurke", "schurkisch"]
    rows = []
    for i in range(400):
        toxic = r.random() < 0.25
        words = r.choices(clean, k=r.randrange(20, 60)) + (r.choices(bad, k=r.randrange(1, 6)) if toxic and r.random() < 0.9 else r.choices(bad, k=1) if r.random() < 0.02 else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_ordinal_model_against_plain(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int"))
    # features: those in at least 6 documents whose share of toxic ones is 6 deviations above the whole
    rate = sum(y for *_, y in labelled) / len(labelled)
    seen, hit = Counter(), Counter()
    for _, t, y in labelled:
        for f in plain_features(t):
            seen[f] += 1
            hit[f] += y
    names = {f for f, n in seen.items() if n >= 6 and (hit[f] - rate * n) / math.sqrt(n * rate * (1 - rate)) > 6}
    assert {"grobian", "schu-", "schurkisch"} <= names and set(model.weights) <= names
    # probabilities and expected severity of every document
    texts = {i: t for i, t, _ in labelled} | {1000: "", 1001: None, 1002: "Schurke SCHURKE, grobian? Schürze"}
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(texts.items()), docs.schema), model).collect()}
    for i, t in texts.items():
        p = plain_grades(t or "", model.weights, model.cuts)
        assert [got[i][f"p{j}"] for j in range(4)] == pytest.approx(p) and got[i]["expected_severity"] == pytest.approx(sum(j * q for j, q in enumerate(p)))
        assert got[i]["toxic"] == (1 - p[0] >= 0.2) and list(model.cuts) == sorted(model.cuts)
    # the likelihood of the grades, over dictionaries: no step from the fitted values makes it clearly better
    amounts = {i: sum(1 + math.log(n) for f, n in plain_features(t).items() if f in names) for i, t, _ in labelled}
    some = sorted(amounts[i] for i, _, y in labelled if y and amounts[i] > 0)
    middle = (some[(len(some) - 1) // 2] + some[len(some) // 2]) / 2
    grade = {i: 0 if not y else 1 if not amounts[i] else 2 if amounts[i] <= middle else 3 for i, _, y in labelled}

    def goodness(weights, cuts):
        return sum(math.log(max(plain_grades(t, weights, cuts)[grade[i]], 1e-9)) for i, t, _ in labelled) / len(labelled) - 3e-4 / 2 * sum(w * w for w in weights.values())

    best = goodness(model.weights, model.cuts)
    for step in (-0.2, 0.2):
        for f in model.weights:
            assert goodness(model.weights | {f: max(0.0, model.weights[f] + step)}, model.cuts) < best + 2e-3
        for j in range(3):
            cuts = [c + step * (k == j) for k, c in enumerate(model.cuts)]
            assert cuts != sorted(cuts) or goodness(model.weights, cuts) < best + 2e-3


ODD = [(1, None), (2, ""), (3, " \n"), (4, "wort " * 40), (4, "wort " * 40), (None, "x"), (5, "ä😀퟿ z" * 300), (6, "a" * 5000)]


def test_byte_encoder_on_odd_rows(spark, encoding):
    """Null, empty, repeated and very long texts, rows without an id, columns of clashing names, an empty table."""
    rows = spark.createDataFrame([(i, t, "x", [1], 2) for i, t in ODD], "doc_id long, text string, n_tokens string, ids array<int>, row int")
    run = lambda df: bpe.encode_decode(df, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    got = defaultdict(list)
    for r in run(rows).collect():
        got[r["doc_id"]].append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    for i, t in ODD:
        if i is not None:
            ids = encoding.encode_ordinary(t or "")
            want = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
            assert set(got[i]) == {want}, i
    assert run(rows.filter("false")).collect() == []


def test_stages_keep_columns_of_clashing_names(spark, sf_dir):
    """Further columns go through the four filtering stages unchanged, whatever their names."""
    more = ["row", "kept", "_w", "rep", "n_words", "failed", "h", "component_id"]
    text = " ".join(f"wort{i}" for i in range(120))
    rows = [(1, text, "de", "s", len(text)), (2, text + " mehr", "de", "s", len(text)), (3, " ".join(f"anders{i}" for i in range(90)), "de", "s", 5), (4, None, "de", "s", 0)]
    docs = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in more)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *more]
    got = {r["doc_id"]: [r[c] for c in more] for r in docs.collect()}
    assert got == {i: [f"{c}{i}" for c in more] for i in (1, 3)}
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()} == {1, 3}
