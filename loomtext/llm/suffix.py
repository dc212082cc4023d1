"""Byte-exact dedup of long repeats: contexts of shared anchors, sorted as suffixes whose comparisons use hashes.

1. Of each run of `length` bytes, the anchor is the start of its least hashed run of GRAM bytes; equal runs have their
   anchor at the same place. Anchors whose gram occurs once in the corpus are done.
2. Around each other anchor up to length - GRAM bytes on either side are gathered. Contexts of one gram meet in a task;
   they are sorted by what follows, and by what comes before in reverse, with a mergesort whose comparisons find the
   common extension by binary search over prefix hashes, checked on the bytes of neighbours.
3. A run that starts i bytes before an anchor is repeated if another context agrees in i bytes before and in
   length - GRAM - i bytes after. What such runs cover is one interval around the anchor.
Grams with more than MOST occurrences don't meet in a task: all their runs are hashed and counted by Spark instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, id_text, merged, prefix_hashes, tagged, window_hashes

GRAM = 200
#: Most contexts of one gram that a task gathers.
MOST = 50_000
#: Rows that a task sorts at once, besides the contexts of one gram.
CHUNK = 8_192


def least_positions(h: np.ndarray, w: int) -> np.ndarray:
    """For each s, the first position of the least value in h[s : s + w]."""
    n = len(h)
    if n < w:
        return np.empty(0, np.int64)
    best = np.arange(n)
    span = 1
    while 2 * span <= w:  # doubling: best[s] is the first least position in h[s : s + span]
        a, b = best[: len(best) - span], best[span:]
        best = np.where(h[b] < h[a], b, a)
        span *= 2
    a, b = best[: n - w + 1], best[w - span : w - span + n - w + 1]
    return np.where(h[b] < h[a], b, a)


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the anchors of all runs of `length` bytes that lie in one document."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = window_hashes(prefix_hashes(data.astype(np.uint64) + np.uint64(1)), gram)
    at = least_positions(h, length - gram + 1)
    lengths = np.diff(ends, prepend=0)
    left = np.repeat(ends, lengths)[: len(at)] - np.arange(len(at))
    at = np.unique(at[left >= length])
    return at, h[at]


def suffix_order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted within their groups (which are ascending), and for each sorted row how many bytes it
    has in common with the row before, -1 at the start of a group.

    A bottom-up mergesort of all groups at once: an element's rank in the other run of its pair is found by binary
    search, and two rows are compared at the end of their common prefix, found by binary search over prefix hashes.
    """
    m, width = rows.shape
    base = np.uint64(0x9E3779B97F4A7C15)
    hashes = np.zeros((m, width + 1), np.uint64)
    powers = np.cumprod(np.full(width, base, np.uint64))
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=hashes[:, 1:])

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), width)
        for _ in range(int(width).bit_length()):
            mid = (lo + hi + 1) // 2
            same = hashes[a, mid] == hashes[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = common(a, b)
        inside = np.minimum(at, width - 1)
        return (at < width) & (rows[a, inside] < rows[b, inside])

    order = np.arange(m)
    first = np.searchsorted(group, group)
    size = np.searchsorted(group, group, side="right") - first
    place, run = np.arange(m) - first, 1
    while run < size.max(initial=0):
        # the other run of the pair, as positions in order
        own = place // run
        other = own ^ 1
        lo = np.minimum(first + other * run, first + size)
        hi = np.minimum(lo + run, first + size)
        start, at = lo.copy(), np.arange(m)
        active = np.flatnonzero(lo < hi)
        right = own % 2 == 1
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            x, y = order[at[active]], order[mid]
            # ties: the left run goes first
            before = np.where(right[active], ~less(x, y), less(y, x))
            lo[active] = np.where(before, mid + 1, lo[active])
            hi[active] = np.where(before, hi[active], mid)
            active = active[lo[active] < hi[active]]
        to = first + (own - own % 2) * run + place % run + (lo - start)
        merged_order = np.empty_like(order)
        merged_order[to] = order
        order, run = merged_order, 2 * run
    lcp = np.full(m, -1, np.int64)
    if m > 1:
        a, b = order[:-1], order[1:]
        near = group[a] == group[b]
        differs = rows[a] != rows[b]
        exact = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        inside = np.minimum(exact, width - 1)
        wrong = near & (exact < width) & (rows[a, inside] > rows[b, inside])
        if wrong.any():  # a hash collision spoilt the order: sort by the bytes
            order = np.lexsort((*rows.T[::-1], group))
            a, b = order[:-1], order[1:]
            differs = rows[a] != rows[b]
            exact = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        lcp[1:] = np.where(near, exact, -1)
    return order, lcp


def repeated(group: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the least and the largest i such that another of its group has the same i bytes before the gram
    and width - i after it; (1, 0) where there is none. before holds the bytes from the gram backwards."""
    m, width = before.shape
    orders = [suffix_order(group, before), suffix_order(group, after)]
    lo, hi = np.full(m, width + 1), np.full(m, -1)

    def classes(k: int, least: int) -> np.ndarray:
        order, lcp = orders[k]
        out = np.empty(m, np.int64)
        out[order] = np.cumsum(lcp < least)
        return out

    for i in range(width + 1):
        fits = np.flatnonzero((n_before >= i) & (n_after >= width - i))
        if len(fits) < 2:
            continue
        key = classes(0, i)[fits] * (m + 1) + classes(1, width - i)[fits]
        o = np.argsort(key, kind="stable")
        same = key[o][1:] == key[o][:-1]
        twice = np.zeros(len(fits), bool)
        twice[o[1:]] |= same
        twice[o[:-1]] |= same
        got = fits[twice]
        hi[got] = i
        lo[got] = np.minimum(lo[got], i)
    return np.where(hi < 0, 1, lo), np.where(hi < 0, 0, hi)


def dedup(docs: DataFrame, length: int = 400, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a run of `length` bytes that also starts anywhere else, in this or another document.

    doc_id, n_bytes, n_removed, n_spans, spans (start, end), kept (binary), kept_sha256: one row a document. Runs are
    judged on the input and never cross documents. A null or empty text has no bytes. A row repeated with its id counts
    once; rows without an id are left out. A text that several documents share is removed whole if it is long enough,
    and takes part once.
    """
    width = length - gram
    docs = tagged(id_text(docs, id_col, text_col))
    texts = docs.filter("own")

    def raw(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        out = [x.encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
        return out, np.frombuffer(b"".join(out), np.uint8), np.cumsum([len(x) for x in out])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each gram of a document: its places in it."""
        for batch in blocks(batches):
            _, data, ends = raw(batch)
            at, h = anchors_of(data, ends, length, gram)
            doc = np.searchsorted(ends, at, side="right")
            at = at - np.concatenate([[0], ends])[doc]
            o = np.lexsort((at, h, doc))
            at, h, doc = at[o].astype(np.int32), h[o], doc[o]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(at)])
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(at))
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[doc[new]]), places], ["h", "doc_id", "at"])

    rows = texts.select("doc_id", "text").mapInArrow(anchors, "h long, doc_id long, at array<int>")
    often = rows.withColumn("n", F.sum(F.size("at")).over(W.partitionBy("h"))).filter("n > 1")
    often = often.groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", (F.col("n") > most).alias("hot"))).alias("grams"))  # of one text

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each anchor with a shared gram. Anchors of one document with equal surroundings give one row, and
        another (done) for each of them that needs no partner any more."""
        for batch in blocks(batches):
            out = []
            for doc, text, grams in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for g in grams:
                    seen: dict[bytes, list[int]] = {}
                    for a in g["at"]:
                        seen.setdefault(data[max(0, a - width) : a + length] if width <= a <= len(data) - length else b"%d" % a, []).append(a)
                    for places in seen.values():
                        a = places[0]
                        digest = int.from_bytes(hashlib.blake2b(data[a : a + gram], digest_size=8).digest(), "little", signed=True)
                        out.append((g["h"], digest, doc, a, g["hot"], False, data[max(0, a - width) : a][::-1], data[a + gram : a + length]))
                        if len(places) > 1:
                            out += [(g["h"], digest, doc, a, g["hot"], True, b"", b"") for a in places]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    names = ["h", "digest", "doc_id", "at", "hot", "done", "before", "after"]
    found = texts.join(often, "doc_id").select("doc_id", "text", "grams").mapInArrow(contexts, "h long, digest long, doc_id long, at long, hot boolean, done boolean, before binary, after binary")

    def padded(values: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.column_stack([batch.column("h").to_numpy(), batch.column("digest").to_numpy()])
        group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        before, after = batch.column("before").to_pylist(), batch.column("after").to_pylist()
        lo, hi = repeated(group, padded(before), np.array([len(x) for x in before]), padded(after), np.array([len(x) for x in after]))
        some = lo <= hi
        at = batch.column("at").to_numpy()[some]
        return pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[some]), pa.array(at - hi[some]), pa.array(at - lo[some] + length)], ["doc_id", "start", "end"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches arrive sorted by gram; whole grams are settled, about CHUNK contexts at once."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = both.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if (h[1:] >= h[:-1]).all() else int(np.flatnonzero(h != h[-1])[-1] + 1) if (h != h[-1]).any() else 0
            held = [both.slice(cut)]
            if cut:
                yield settle(both.slice(0, cut))
        if held and sum(b.num_rows for b in held):
            yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    spans = "doc_id long, start long, end long"
    mild = found.filter("not hot and not done").drop("hot", "done").repartition("h").sortWithinPartitions("h", "digest").mapInArrow(meet, spans)
    done = found.filter("done").select("doc_id", (F.col("at") - width).alias("start"), (F.col("at") + length).alias("end"))
    # hot grams: each run around the anchor by a hash, counted before the shuffle, joined back
    run = F.explode(F.expr(f"""transform(filter(sequence(0, {width}), i -> i <= octet_length(before) and {width} - i <= octet_length(after)),
        i -> named_struct('i', i, 'w', xxhash64(h, digest, i, substring(before, 1, i), substring(after, 1, {width} - i)), 'v', xxhash64(substring(after, 1, {width} - i), substring(before, 1, i), i, digest)))"""))
    runs = found.filter("hot and not done").select("doc_id", "at", run.alias("r")).select("doc_id", "at", "r.*")
    twice = runs.groupBy("w", "v").count().filter("count > 1").select("w", "v")
    hot = runs.join(twice, ["w", "v"], "left_semi").select("doc_id", (F.col("at") - F.col("i")).alias("start"), (F.col("at") - F.col("i") + length).alias("end"))
    covered = mild.union(done).union(hot).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("covered"))  # of one text

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in blocks(batches):
            out = []
            for doc, n, text, got in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_docs", "text", "covered")), strict=True):
                if doc in seen:
                    continue
                seen.add(doc)
                data = text.encode("utf-8", "surrogatepass")
                if n > 1:
                    gone = [(0, len(data))] if len(data) >= length else []
                else:
                    gone = merged(np.array([x["start"] for x in got or []], np.int64), np.array([x["end"] for x in got or []], np.int64))
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(gone), [{"start": s, "end": e} for s, e in gone], kept, hashlib.sha256(kept).hexdigest()))
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string"
    return docs.join(covered, "doc_id", "left").select("doc_id", "n_docs", "text", "covered").mapInArrow(keep, schema)
