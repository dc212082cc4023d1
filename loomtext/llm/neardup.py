"""MinHash near-duplicates with tensored banding: table keys are pairs from two small collections of hashes.

Collection A has N_A single minhashes, collection B has N_B pairs of minhashes; each of the N_A * N_B tables is keyed by
one of A with one of B. So 84 tables of three minhashes each need 31 minhashes instead of 252. A pair of similarity s
meets in some table with probability (1 - (1 - s)**N_A) * (1 - (1 - s**2)**N_B); at 0.75 that is 0.9999.

Pairs that meet are compared by sketches, a short one of the minhashes and a long one of the set, then confirmed on the
full sets. Only pairs that can join two components are looked at: members of a bucket are held against its least
document and the one before, and what then still lies in different components of a bucket is held against each other,
in the first table where the two meet, inside the join: only pairs whose long sketches are close leave it. Documents
with equal sets are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import alone, blocks, id_text, stored

N_A, N_B = 7, 12
#: All minhashes; those after the tables' serve the sketch, which holds two bits of each.
N_HASHES = 64
#: A pair goes on if at most so many of the sketch's values differ. At a similarity of 0.75, 12 of 64 differ on average
#: with a deviation of 3.1; more than 28 in about one pair of a million.
MOST_DIFFERENT = 28
#: Bins of the long sketch: the set's hashes are dealt out to them, and four bits of the least one in each are kept, 0 for
#: none. For sets that are small beside the number of bins it holds nearly all of the set.
N_BINS = 512
#: A pair goes on unless its long sketches speak against it by more than so many standard deviations, and one bin.
DEVIATIONS = 4.5
#: The long sketch's outline: so many 64-bit integers of which bins are used, and as many of the lowest bit of each.
WORDS = N_BINS // 64
SKETCH = ["n_shingles", "s1", "s2", "n_used", "outline", "bins"]
PARTS = [f"p{i}" for i in range(N_A + N_B)]
#: Odd multipliers and addends of the minhashes, drawn once by a fixed seed.
_DRAW = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, (2, N_HASHES), dtype=np.uint64)
MULTIPLY, ADD = _DRAW[0] | np.uint64(1), _DRAW[1]
#: Multipliers of the words of a shingle.
STEPS = _DRAW[0, :16] * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words, ascending; of the whole sequence if it is shorter; none without words."""
    return split_shingles([text], n)[0]


def split_shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """The same for many texts at once."""
    words = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts]  # bytes.lower() changes A-Z alone
    values = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in words for w in x), np.uint64, sum(map(len, words)))
    out, at = [], 0
    for x in words:
        v = values[at : at + len(x)]
        at += len(x)
        k = min(n, len(x))
        if not k:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(len(x) - k + 1, len(x) if k < n else 0, np.uint64)
        for j in range(k):
            h = h + v[j : len(x) - k + 1 + j] * STEPS[j]
            h = h ^ (h >> np.uint64(29))
        out.append(np.unique(h))
    return out


def minhashes(h: np.ndarray) -> np.ndarray:
    """The least values of N_HASHES permutations of the hashes, by pieces of bounded size."""
    least = np.full(N_HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096, None] * MULTIPLY + ADD
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0))
    return least


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def collections(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of collection A and of collection B."""
    b = m[N_A : N_A + 2 * N_B].reshape(N_B, 2)
    return mix(m[:N_A] + np.arange(N_A, dtype=np.uint64)), mix(b[:, 0] * np.uint64(3) + mix(b[:, 1]) + np.arange(N_B, dtype=np.uint64))


def table_keys(m: np.ndarray) -> np.ndarray:
    """Keys of all tables of a document; table i * N_B + j has one of A, i, and one of B, j."""
    a, b = collections(m)
    return mix(a[:, None] * np.uint64(5) + b[None, :]).ravel()


def parts_of(m: np.ndarray) -> np.ndarray:
    return np.concatenate(collections(m)).astype(np.uint32).view(np.int32)


def sketch_of(m: np.ndarray) -> tuple[int, int]:
    """Two bits of each minhash, in two 64-bit integers."""
    bits = np.unpackbits((mix(m) & np.uint64(3)).astype(np.uint8)[:, None], axis=1)[:, 6:].ravel()
    s = np.packbits(bits).view("<i8")
    return int(s[0]), int(s[1])


def bins_of(h: np.ndarray) -> np.ndarray:
    """The long sketch of distinct hashes: 16 bins in each 64-bit integer."""
    g = np.sort(mix(h * np.uint64(0x9FB21C651E98DF25)))
    at = (g >> np.uint64(64 - N_BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros(N_BINS, np.uint8)
    out[at[first]] = 1 + (g[first] >> np.uint64(16)) % np.uint64(15)
    return (out[0::2] | out[1::2] << 4).view("<i8")


def outline_of(bins: np.ndarray) -> np.ndarray:
    """Of a long sketch: which bins are used, and their lowest bits."""
    b = bins.view(np.uint8)
    four = np.column_stack([b & 15, b >> 4]).ravel()
    return np.packbits(np.concatenate([four > 0, four & 1])).view("<i8")


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (hash of the set), s1, s2 (short sketch), bins (long one), outline, ab (32 bits of the hashes of
    both collections), keys (of the tables)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in blocks(batches):
            rows = []
            for doc, h in zip(batch.column("doc_id").to_pylist(), split_shingles(batch.column("text").to_pylist(), shingle), strict=True):
                digest = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), "<i8")
                m = minhashes(h)
                bins = bins_of(h)
                rows.append((doc, len(h), int(digest[0]), int(digest[1]), *sketch_of(m), bins, outline_of(bins), parts_of(m), table_keys(m).view(np.int64)))
            cols = list(zip(*rows, strict=True))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(c[0])), pa.array(np.concatenate(c))) for c in cols[6:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), *lists], ["doc_id", "n_shingles", "k1", "k2", "s1", "s2", "bins", "outline", "ab", "keys"])

    found = docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, s1 long, s2 long, bins array<long>, outline array<long>, ab array<int>, keys array<long>")
    used = reduce(lambda x, y: x + y, (F.bit_count(F.col("outline")[i]) for i in range(WORDS)))
    return found.withColumn("n_used", used)


def different(a: str, b: str) -> str:
    """SQL: how many of the 64 values of two sketches differ."""
    def half(s: str) -> str:
        x = f"({a}.{s} ^ {b}.{s})"
        return f"bit_count(({x} | shiftrightunsigned({x}, 1)) & 6148914691236517205)"  # every other bit

    return f"{half('s1')} + {half('s2')}"


def close_bins(percent: int) -> str:
    """SQL on rows a and b: their long sketches allow the similarity.

    Of n bins that either uses, d differ. Bins are a sample, without replacement, of the u elements of both sets, of
    which at most 1 - s lie in one alone: d exceeds that share of n by some deviations of the hypergeometric law only.
    """
    s = percent / 100

    def filled(x: str) -> str:
        return f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)"  # a bit for each four

    counts = f"aggregate(zip_with(a.bins, b.bins, (x, y) -> {filled('(x | y)')} * 65536L + {filled('(x ^ y)')}), 0L, (t, x) -> t + x)"
    u = f"((a.n_shingles + b.n_shingles) / {1 + s}D)"
    bound = f"{1 - s}D * n + {DEVIATIONS}D * sqrt({s * (1 - s)}D * n * greatest(0D, 1D - n / {u})) + 1D"
    return f"exists(array({counts}), v -> v % 65536L <= {bound.replace(' n ', ' (v div 65536L) ')})"


def close_outlines(percent: int) -> str:
    """SQL on rows a and b: the outlines of their long sketches allow the similarity.

    A bin that both use and whose elements differ shows with probability 1/2. So with x bins that differ in any way and
    m used by one alone, 2 x - m estimates how many differ, out of (used by a + used by b + m) / 2.
    """
    s = percent / 100
    unlike = [f"(a.outline[{i}] ^ b.outline[{i}])" for i in range(2 * WORDS)]
    m = " + ".join(f"bit_count({u})" for u in unlike[:WORDS])
    x = " + ".join(f"bit_count({u} | {v})" for u, v in zip(unlike[:WORDS], unlike[WORDS:], strict=True))
    n, u = f"((a.n_used + b.n_used) / {1 + s}D)", f"((a.n_shingles + b.n_shingles) / {1 + s}D)"
    spread = f"sqrt({s * (1 - s)}D * {n} * greatest(0.02D, 1D - {n} / {u}) + {(1 - s) / N_BINS}D * {n} * {n})"
    return f"2 * ({x}) - {1 + (1 - s) / 2}D * ({m}) <= {(1 - s) / 2}D * (a.n_used + b.n_used) + {DEVIATIONS}D * {spread} + 1D"


def alike(percent: int, also: str = "true") -> str:
    """SQL on rows a and b: their sizes and sketches allow the similarity; also: a further condition, tried in between."""
    return f"100 * least(a.n_shingles, b.n_shingles) >= {percent} * greatest(a.n_shingles, b.n_shingles) and {different('a', 'b')} <= {MOST_DIFFERENT} and {also} and {close_outlines(percent)} and {close_bins(percent)}"


def meet_first() -> str:
    """SQL on rows a and b of a bucket: its table, a.t, is the first where the two meet."""

    def first(parts: list[str]) -> str:
        return f"case {' '.join(f'when a.{p} = b.{p} then {i}' for i, p in enumerate(parts))} else 0 end"

    return f"a.t = {N_B} * {first(PARTS[:N_A])} + {first(PARTS[N_A:])}"


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those (x, y) of the pairs whose full shingle sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        last, own = None, None
        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = []
            for i in range(0, len(xs), 64):
                others = split_shingles(batch.column("text_x").slice(i, 64).to_pylist(), shingle)
                for j, h in enumerate(others, i):
                    if ys[j] != last:
                        last, own = ys[j], shingle_hashes(batch.column("text").slice(j, 1).to_pylist()[0], shingle)
                    both = len(np.intersect1d(h, own, assume_unique=True))
                    if 100 * both >= percent * (len(h) + len(own) - both):
                        good.append(j)
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([xs[j] for j in good], pa.int64()), pa.array([ys[j] for j in good], pa.int64())], ["x", "y"])

    left = pairs.join(docs.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x")), "x")
    return left.join(docs.select(F.col("doc_id").alias("y"), "text"), "y").select("x", "y", "text_x", "text").mapInArrow(check, "x long, y long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """doc_id, component_id (the smallest reachable id) of all ids in the links (x, y).

    Alternating large-star and small-star steps; each round's edges are written to the shared folder, so that a round
    does not depend on the executors that made the one before. The rounds grow with the logarithm of the longest path.
    """
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u > v").distinct()
    edges = stored(edges, "edges")
    for _ in range(most_rounds):
        # large star: a node's larger neighbours are tied to its least neighbour (or itself)
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        many = large.join(low.filter("n > 1"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        new = stored(many.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        sums = [(r[0], r[1]) for r in (e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for e in (edges, new))]
        edges = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 * intersection >= percent * union.

    Sets of distinct runs of `shingle` lower-cased words; a text with fewer words is one run; a null, empty or blank
    text has none and is linked with nothing. component_id is the smallest id reachable by links, kept tells whether
    it is the document's own. A row repeated with its id counts once; rows without an id are left out.
    """
    docs = id_text(docs, id_col, text_col)
    found = stored(signatures(docs, shingle), "signatures")
    some = found.drop("keys").dropDuplicates(["doc_id"])
    sketch = some.select("doc_id", "ab", *SKETCH)
    groups = found.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    sets = found.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = sets.select("doc_id", F.posexplode("keys").alias("t", "key"))
    ordered = W.partitionBy("key").orderBy("doc_id")
    bucket = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    buckets = rows.withColumns({"first": F.min("doc_id").over(bucket), "last": F.max("doc_id").over(bucket), "previous": F.lag("doc_id").over(ordered)}).filter("first < last")
    buckets = stored(buckets.select("doc_id", "t", "key", "first", "previous"), "buckets")

    def plausible(pairs: DataFrame) -> DataFrame:
        a = pairs.join(sketch.select(F.col("doc_id").alias("x"), F.struct(*SKETCH).alias("a")), "x")
        return a.join(sketch.select(F.col("doc_id").alias("y"), F.struct(*SKETCH).alias("b")), "y").filter(alike(percent)).select("x", "y")

    near = buckets.select(F.col("doc_id").alias("x"), F.explode(F.array("first", "previous")).alias("y")).filter("y < x").distinct()
    tried = stored(plausible(near), "pairs")
    links = stored(confirmed(tried, docs, shingle, percent), "links")
    parts = components(links)
    # what is left: pairs of a bucket in different components
    placed = buckets.select("doc_id", "t", "key").join(parts, "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id"))
    by = W.partitionBy("key")
    mixed = placed.withColumns({"lo": F.min("c").over(by), "hi": F.max("c").over(by)}).filter("lo < hi").select("doc_id", "t", "key", "c")
    mixed = stored(mixed.join(sketch, "doc_id"), "mixed")
    # none of these is null; where Spark knows it, the join's condition compiles to much less
    sure = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    parts_ = [F.coalesce(F.col("ab")[i], F.lit(0)).alias(p) for i, p in enumerate(PARTS)]
    mixed = mixed.select("key", *map(sure, ("doc_id", "c", "t", "n_shingles", "s1", "s2", "n_used")), *parts_, "outline", "bins")
    a, b = mixed.alias("a"), mixed.alias("b")
    across = a.join(b, F.expr(f"a.key = b.key and a.c <> b.c and a.doc_id > b.doc_id and {alike(percent, meet_first())}")).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"))
    across = stored(across.join(tried, ["x", "y"], "left_anti"), "pairs")
    if not across.isEmpty():
        more = stored(confirmed(across, docs, shingle, percent), "links")
        if not more.isEmpty():
            parts = components(links.union(more))
    reps = some.filter("n_shingles > 0").join(groups, ["k1", "k2"]).select("doc_id", "rep")
    placed = reps.join(parts.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    out = some.select("doc_id", "n_shingles").join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))
