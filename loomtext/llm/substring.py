"""Substring dedup over words: difference-cover anchors find shared runs, window hashes settle what is removed.

A difference cover D modulo v holds, for any two positions i and j, a shift below v that moves both to positions whose
remainder is in D. So two equal runs of `window` words share an aligned run of window - v + 1 words that starts at a
cover position in either document: only those are hashed and shuffled, about |D| / v of all positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BASES, blocks, id_text, merged, prefix_hashes, tagged, window_hashes

#: A perfect difference set; fixed values.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D, which is what bytes.split() cuts at."""
    return text.encode("utf-8", "surrogatepass").split()


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def together(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """(values of all words, end of each document among them, words of each document)."""
    words = [words_of(x) for x in batch.column("text").to_pylist()]
    return word_values([w for x in words for w in x]), np.cumsum([len(x) for x in words]), words


def shared_anchors(texts: DataFrame, window: int, cover: tuple[int, ...], period: int) -> DataFrame:
    """doc_id, at: cover positions in different texts where the aligned run of words is the same."""
    k = window - period + 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            values, ends, _ = together(batch)
            lengths = np.diff(ends, prepend=0)
            h = window_hashes(prefix_hashes(values), k)
            local = np.arange(len(values)) - np.repeat(ends - lengths, lengths)
            left = np.repeat(ends, lengths) - np.arange(len(values))
            long = np.repeat(lengths, lengths) >= window
            at = np.flatnonzero(np.isin(local % period, cover) & (left >= k) & long)
            ids = np.repeat(batch.column("doc_id").to_numpy(), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[at]), pa.array(local[at].astype(np.int32))], ["h", "doc_id", "at"])

    rows = texts.select("doc_id", "text").mapInArrow(anchors, "h long, doc_id long, at int")
    by = W.partitionBy("h")
    return rows.withColumns({"lo": F.min("doc_id").over(by), "hi": F.max("doc_id").over(by)}).filter("lo < hi").select("doc_id", "at")


def dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", cover: tuple[int, ...] = COVER, period: int = PERIOD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a run of `window` words that also starts in a document with a smaller id.

    doc_id, n_words, n_removed, kept_text (kept words joined by a space), kept_sha256: one row a document. Runs are
    judged on the input. A null or empty text has no words. A row repeated with its id counts once; rows without an id
    are left out. Of equal texts only the one with the smallest id takes part, the others follow from it. Columns of the
    input named in carry come first, as a struct, row.
    """
    if not is_cover(cover, period) or period >= window:
        raise ValueError("the positions do not cover all differences, or the period is not below the window")
    docs = tagged(id_text(docs, id_col, text_col, carry))
    texts = docs.filter("own")
    at = shared_anchors(texts, window, cover, period).groupBy("doc_id").agg(F.collect_set("at").alias("at"))  # of one text

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of `window` words that contain a shared anchor, by two hashes."""
        for batch in blocks(batches):
            values, ends, _ = together(batch)
            lengths = np.diff(ends, prepend=0)
            begins = ends - lengths
            inside = np.zeros(len(values) + 1, np.int32)
            for b, e, a in zip(begins, ends, batch.column("at"), strict=True):
                a = a.values.to_numpy() + b
                lo, hi = np.maximum(a - period + 1, b), np.minimum(a, e - window)
                np.add.at(inside, lo[hi >= lo], 1)
                np.add.at(inside, hi[hi >= lo] + 1, -1)
            starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            h1, h2 = (window_hashes(prefix_hashes(values, b), window, b)[starts].view(np.int64) for b in BASES)
            ids = np.repeat(batch.column("doc_id").to_numpy(), lengths)
            local = starts - np.repeat(begins, lengths)[starts]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids[starts]), pa.array(local.astype(np.int32))], ["h1", "h2", "doc_id", "start"])

    runs = texts.join(at, "doc_id").select("doc_id", "text", "at").mapInArrow(windows, "h1 long, h2 long, doc_id long, start int")
    # the first text of each run is found by a partial count; ~h1 makes the join deal out its keys anew, so that
    # both sides come straight from a shuffle, which adaptive execution needs to split a hot key
    lowest = runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    lowest = lowest.select(F.bitwise_not("h1").alias("key"), "h2", "lo")
    first = runs.withColumn("key", F.bitwise_not("h1")).join(lowest, ["key", "h2"]).filter("lo < doc_id")
    starts = first.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in blocks(batches):
            out, at = [], []
            for k, (doc, rep, text, starts) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("rep").to_pylist(), batch.column("text").to_pylist(), batch.column("starts"), strict=True)):
                if doc in seen:
                    continue
                seen.add(doc)
                at.append(k)
                words = words_of(text)
                if doc != rep:
                    kept = words if len(words) < window else []
                elif not starts.is_valid:
                    kept = words
                else:
                    kept, last = [], 0
                    a = starts.values.to_numpy().astype(np.int64)
                    for s, e in merged(a, a + window):
                        kept += words[last:s]
                        last = e
                    kept += words[last:]
                data = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), data.decode("utf-8", "surrogatepass"), hashlib.sha256(data).hexdigest()))
            if out:
                kept_row = [batch.column("row").take(pa.array(at))] if carry else []
                yield pa.RecordBatch.from_arrays([*kept_row, *(pa.array(c) for c in zip(*out, strict=True))], [*names, "doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    names = ["row"] if carry else []
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    if carry:
        schema = f"row {docs.schema['row'].dataType.simpleString()}, {schema}"
    return docs.join(starts, "doc_id", "left").select(*names, "doc_id", "rep", "text", "starts").mapInArrow(keep, schema)
