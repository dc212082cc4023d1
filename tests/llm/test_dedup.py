"""Substring, suffix and near-duplicate operators against their plain versions."""

from __future__ import annotations

import random

import pytest

from loomtext.llm import neardup, substring, suffix

from . import brute

SCHEMA = "text string, doc_id long, row string, h long, rep long, keys string, at string, n_docs string, starts long"


def table(spark, docs: list[tuple]):
    """Rows (id, text) among columns whose names clash with those used inside."""
    return spark.createDataFrame([(t, i, "r", 1, 2, "k", "a", "n", 3) for i, t in docs], SCHEMA)


def odd(words: str = "abcd", n: int = 60, seed: int = 1, most: int = 40) -> list[tuple]:
    """Random texts over few words, copies, null, empty, blank, odd space, wide characters."""
    r = random.Random(seed)
    docs = [(i * 3, " ".join(r.choice(words) for _ in range(r.randint(0, most)))) for i in range(n)]
    docs += [(i, docs[i % 7][1]) for i in (1, 4, 7, 10)]
    docs += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "ä\u00a0b 𠀀 \x1c x"), (1004, docs[5][1] + " " + docs[6][1]), (-5, docs[8][1])]
    return docs


def by_id(df, cols: list[str]) -> dict:
    rows = df.select("doc_id", *cols).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_small_windows(spark, seed):
    docs = odd(seed=seed)
    got = substring.dedup(table(spark, docs + docs[:5]), window=9, cover=(0, 1, 3), period=7)
    assert by_id(got, ["n_words", "n_removed", "kept_sha256"]) == brute.substring(dict(docs), 9)


def test_substring_long_texts(spark):
    r = random.Random(5)
    names = [f"w{i}" for i in range(500)]
    base = [" ".join(r.choice(names) for _ in range(r.choice([10, 49, 50, 51, 400, 9000]))) for _ in range(12)]
    docs = list(enumerate(base))
    for k in range(30):
        a, b = r.choice(base).split(), r.choice(base).split()
        i, j = r.randint(0, len(a)), r.randint(0, len(b))
        docs.append((100 + k, " ".join(a[i : i + r.randint(1, 200)] + b[j : j + r.randint(1, 200)])))
    got = substring.dedup(table(spark, docs))
    assert by_id(got, ["n_words", "n_removed", "kept_sha256"]) == brute.substring(dict(docs))


def test_substring_empty_and_no_id(spark):
    assert substring.dedup(table(spark, [])).collect() == []
    assert by_id(substring.dedup(table(spark, [(None, "a b"), (1, None)])), ["n_words", "n_removed"]) == {1: (0, 0)}


def test_cover():
    assert substring.is_cover(substring.COVER, substring.PERIOD)
    assert not substring.is_cover((0, 1), 5)


@pytest.mark.parametrize(("seed", "most"), [(1, 50_000), (2, 3), (3, 1)])
def test_suffix_small_runs(spark, seed, most):
    """most: so few occurrences of a gram that the hot way is taken too."""
    docs = odd("ab", seed=seed)
    got = suffix.dedup(table(spark, docs + docs[:5]), length=14, gram=7, most=most)
    assert by_id(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.suffix(dict(docs), 14)


def test_suffix_long_runs(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh äé𠀀") for _ in range(r.choice([50, 399, 400, 401, 3000]))) for _ in range(12)]
    docs = list(enumerate(base))
    for k in range(25):
        a, b = r.choice(base), r.choice(base)
        i, j = r.randint(0, len(a)), r.randint(0, len(b))
        docs.append((100 + k, a[i : i + 700] + b[j : j + 450]))
    docs += [(200, "x" * 5000), (201, "ab" * 700), (202, None), (203, "")]
    got = suffix.dedup(table(spark, docs))
    assert by_id(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.suffix(dict(docs))


def test_suffix_kept_bytes(spark):
    row = suffix.dedup(table(spark, [(1, "a" * 400 + "b"), (2, "c" + "a" * 400)])).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in row] == [b"b", b"c"]
    assert row[0]["spans"][0]["end"] == 400
    assert suffix.dedup(table(spark, [])).collect() == []


def near_copies(seed: int, n: int = 150) -> list[tuple]:
    """Texts with copies at similarities around the threshold, chains, and large groups of copies."""
    r = random.Random(seed)
    names = [f"w{i}" for i in range(2000)]
    docs = [(i, " ".join(r.choice(names) for _ in range(r.choice([1, 3, 4, 5, 6, 30, 100, 400])))) for i in range(40)]
    for i in range(40, n):
        w = r.choice(docs)[1].split()
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = r.choice(names)
        docs.append((i * 7 % 1009 + 1000, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    return docs + [(5000 + i, docs[3][1]) for i in range(40)] + [(9000, None), (9001, ""), (9002, " \n"), (9003, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = near_copies(seed)
    got = neardup.near_duplicates(table(spark, docs + docs[:5]))
    assert by_id(got, ["n_shingles", "component_id", "kept"]) == brute.near(dict(docs))


def test_near_duplicates_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    assert by_id(neardup.near_duplicates(docs), ["n_shingles", "component_id", "kept"]) == brute.near(texts)


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(table(spark, [])).collect() == []


def test_components(spark):
    """A long path, a star and a ring."""
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    got = {r[0]: r[1] for r in neardup.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 240)]} | {i: 300 for i in range(300, 309)}
