"""The corpus pipeline: each stage on its own input, against plain versions."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomtext.llm import common, quality, queries, tokens

from . import brute
from .test_tokens import check_pieces


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents, then what each stage but the last has written."""
    out = [common.documents(spark, sf_dir)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(common.stored(stage(spark, out[-1], sf_dir), name))
    return out


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "minhash_near_dedup", "substring_dedup", "packing"]
    assert all(df.columns == stages[0].columns and df.dtypes == stages[0].dtypes for df in stages)


def test_quality_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    m = {i: brute.measures(t) for i, t in before.items()}
    assert "v1" in quality.POLICIES
    assert after == {i: before[i] for i, x in m.items() if x[0] >= 50 and 100 * x[4] <= 50 * x[0] and 10 * x[2] <= x[0]}


def test_toxicity_stage(stages, spark, sf_dir):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) <= set(before) and len(after) > 0.7 * len(before)


def test_near_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert after == {i: before[i] for i, x in brute.near(before).items() if x[2]}


def test_substring_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    want = brute.substring(before)
    assert set(before) == set(after)
    for i, (_, n_removed, sha) in want.items():
        if n_removed:
            assert brute.sha(after[i].encode()) == sha
        else:
            assert after[i] == before[i]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_stage(stages, spark, sf_dir):
    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    last = corpus_pipeline.STAGES[-1][1](spark, stages[-1], sf_dir).collect()
    sizes: dict = {}
    for r in last:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert all(v == 2048 for k, v in sizes.items() if k != max(sizes))
    check_pieces(tokens.pack(stages[-1], path).collect(), list(texts(stages[-1]).items()), Tokenizer.from_file(path))
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in whole} == {r["doc_id"]: r["doc_tokens"] for r in last}


def test_odd_rows(spark, sf_dir):
    """Nulls, empty texts, repeated rows and an empty table go through all stages."""
    schema = stages_schema(spark, sf_dir)
    rows = [(1, None, "en", None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (3, "w1 " + " ".join(f"word{i}" for i in range(80)), "en", "s", 10), (3, "w1 " + " ".join(f"word{i}" for i in range(80)), "en", "s", 10)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, sf_dir), name)
            assert docs.columns == [f.name for f in schema]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert {r["doc_id"] for r in out} == ({3} if data else set())


def stages_schema(spark, sf_dir):
    return common.documents(spark, sf_dir).schema
