"""Encoders, record files and packing against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomtext.llm import bpe, common, queries, tokens

PATH = public_tokenizers.path(queries.WORD_TOKENIZER)
RANKS = public_tokenizers.path(queries.RANKS)
TEXTS = st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2028", "Été", "don't", "we'LL", "İ", "ß", "ﬁ", "e\u0301", " \u0301", "<|endoftext|>", "<|startoftext|>", "x<|endoftext|>y", "</w>", "123", "１２", "中文字", "...", "?!", "a,b", "foo;", "\x00", "𠀀"])), max_size=30).map("".join)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(tokenizer, text: str | None) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def u32(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_word_encoder(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_word_encoder, "t") else test_word_encoder.t
    test_word_encoder.t = t
    assert tokens.Encoder.of(PATH).encode_all(texts) == [u32(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_letters_that_normalise_to_marks(tokenizer):
    """Every letter whose lower-cased, composed form has a mark, before, between and behind punctuation and letters."""
    odd = [c for c in map(chr, range(128, 0x110000)) if c.isalpha() and any(unicodedata.category(x)[0] == "M" for x in unicodedata.normalize("NFC", c).lower())]
    assert len(odd) >= 50 and "İ" in odd and "ड़" not in odd and "\u095c" in odd
    texts = [t for c in odd for m in ".,;:!?#-" for t in (f"ab{c}{m}", f"{c}{m}", f"{m}{c}", f"A{c}b{m} x{c}", f"é{c}{m}{c}")]
    texts += ["GAZİ. ANKARA", "EVİ, x", "ड़.", "ড়, a", *(a + b for a in tokens.MARKS for b in tokens.MARKS), *(f"aÉ{m}" for m in tokens.MARKS)]
    assert tokens.Encoder.of(PATH).encode_all(texts) == [u32(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_random_texts(tokenizer):
    r = random.Random(11)
    chars = [*"aZbéÜßÿªµ'st1²½.,;:!?#$%<|> \n\t\u3000ΣσςЖ中", "\u0130", "\u095c", "\u0301", "\u09bc", "\u1e9e", "\u212b", "\ufb01"]
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(30))) for _ in range(20_000)]
    assert tokens.Encoder.of(PATH).encode_all(texts) == [u32(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_full_table_of_words(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    encoder = tokens.Encoder(PATH)
    texts = [f"Word{i} w{i}, again" for i in range(60)]
    for i in range(0, 60, 7):
        assert encoder.encode_all(texts[i : i + 7]) == [u32(e.ids) for e in tokenizer.encode_batch_fast(texts[i : i + 7], add_special_tokens=False)]


def test_other_tokenizer_goes_whole():
    """A file whose pieces reach over spaces is not cut into words."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["the cat  sat\non the mat.", "", " x"]
    assert tokens.Encoder.of(path).encode_all(texts) == [u32(e.ids) for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]


def test_bases_over_runs_of_parts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PARTS_AT_ONCE", 3)
    rows = spark.createDataFrame([(p, p * 7 % 5) for p in (0, 1, 2, 5, 6, 9, 10, 11, 30)], "part long, n long")
    got = {r["part"]: r["base"] for r in tokens.with_bases(rows, "part", "n").collect()}
    total, want = 0, {}
    for p in sorted(got):
        want[p] = total
        total += p * 7 % 5
    assert got == want


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_byte_encoder(texts):
    if not hasattr(test_byte_encoder, "e"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        test_byte_encoder.e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
    got = codec.encode_all(texts)
    assert got == [u32(test_byte_encoder.e.encode_ordinary(x)) for x in texts]
    assert [codec.decode(x) for x in got] == [x.encode() for x in texts]


def test_long_pre_tokens(encoding):
    r = random.Random(3)
    codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 50_000, "ab" * 9_000 + "c", "".join(r.choice("aeinst") for _ in range(30_000)), "é" * 7_001, "-=" * 5_000, "1" * 4_000, " " * 3_000 + "x"):
        assert codec.encode(text) == u32(encoding.encode_ordinary(text))


def test_queue_order():
    q = bpe.RankQueue()
    for rank in (70_000, 5, 64, 4095, 4096, 5, 262_143):
        q.push(rank, [rank])
    assert [q.pop() for _ in range(6)] == [(5, [5, 5]), (64, [64]), (4095, [4095]), (4096, [4096]), (70_000, [70_000]), (262_143, [262_143])]
    assert not q.top


def test_byte_query(spark, sf_dir, encoding):
    docs = common.documents(spark, sf_dir)
    want = {}
    for doc, text in docs.select("doc_id", "text").collect():
        ids = encoding.encode_ordinary(text or "")
        want[doc] = (len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = queries.op10_byte_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_records_query(spark, sf_dir, tokenizer):
    docs = {r[0]: r[1] for r in common.documents(spark, sf_dir).select("doc_id", "text").collect()}
    want, start = {}, 0
    for doc in sorted(docs):
        ids = ids_of(tokenizer, docs[doc])
        want[doc] = (start, len(ids), zlib.crc32(u32(ids)))
        start += len(ids)
    got = queries.op5_token_records(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def odd_docs(spark):
    rows = [(5, "b c d", "x"), (3, None, None), (9, "", "y"), (1, "A long text. " * 2000, "z"), (7, "tie", "z"), (7, "tie", "z"), (None, "no id", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, part string")


def test_records_over_files(spark, tokenizer):
    """Several files; the index leads to each record in any order; a broken byte is noticed."""
    path = common.shared_path(spark, "records")
    docs = odd_docs(spark)
    tokens.write_records(docs, PATH, path, file_bytes=4000)
    index = tokens.read_index(spark, path)
    assert index.select("file").distinct().count() > 1
    starts = [(r["doc_id"], r["start"], r["n_tokens"]) for r in index.orderBy("start").collect()]
    assert [x[0] for x in starts] == [1, 3, 5, 7, 7, 9]
    assert [x[1] for x in starts[1:]] == [a[1] + a[2] for a in starts[:-1]]
    wanted = index.filter("doc_id in (9, 1, 3)").orderBy("ids_crc32")
    got = {r["doc_id"]: r["ids"] for r in tokens.read_ids(spark, path, wanted).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {i: ids_of(tokenizer, texts[i]) for i in (9, 1, 3)}
    record = tokens.framed(b"payload") + b"\n"
    assert [bytes(p) for _, p in tokens.records(record * 2)] == [b"payload"] * 2
    for k in (0, 9, 14, 20):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(tokens.records(bytes(bad)))


def test_records_of_nothing(spark):
    assert tokens.token_records(odd_docs(spark).filter("false"), PATH).collect() == []


def check_pieces(pieces, texts: list[tuple], tokenizer, length: int = 2048) -> None:
    """pieces: rows; texts: (doc_id, text), each row a document."""
    want = sorted((d, len(ids), zlib.crc32(u32(ids))) for d, ids in ((d, ids_of(tokenizer, t)) for d, t in texts))
    placed: dict = {}
    docs = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    got, ids, doc = [], b"", None
    at = 0
    for r in docs:
        assert (r["sequence_id"], r["offset"]) == divmod(at, length)
        at += r["length"]
        assert r["offset"] + r["length"] <= length and r["length"] > 0
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        if r["start"] == 0:
            ids, doc = b"", r["doc_id"]
        assert doc == r["doc_id"] and len(ids) == 4 * r["start"]
        ids += r["ids"]
        if len(ids) == 4 * r["doc_tokens"]:
            got.append((doc, len(ids) // 4, zlib.crc32(ids)))
        placed[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(got) == want
    assert all(v == length for k, v in placed.items() if k != max(placed))


def test_packing(spark, sf_dir, tokenizer):
    docs = common.documents(spark, sf_dir)
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_pieces(tokens.pack(docs.repartition(5), PATH).collect(), texts, tokenizer)
    assert queries.op6_packing(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_packing_odd(spark, tokenizer):
    docs = odd_docs(spark)
    check_pieces(tokens.pack(docs.repartition(3), PATH, length=64).collect(), [tuple(r) for r in docs.filter("doc_id is not null").select("doc_id", "text").collect()], tokenizer, 64)
    assert tokens.pack(docs.filter("false"), PATH).collect() == []
