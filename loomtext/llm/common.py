"""Small shared helpers: reading the corpus, shared storage, distinct texts, polynomial hashes over arrays.

Conventions of every operator in this subpackage: only the id and the text column are read, so further columns of the
input can have any name; a null text counts as empty unless an operator says otherwise; an empty table gives an empty
result with the same columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds at once, besides the longest single document.
BLOCK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return (path or tempfile.mkdtemp(prefix="loomtext-")).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) with a null text as empty, and a struct, row, of the columns in carry, if any; rows without an id
    cannot be addressed and are left out."""
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more).filter("doc_id is not null")


def tagged(texts: DataFrame) -> DataFrame:
    """doc_id, text, rep (the smallest id of those with an equal text, by a 128-bit hash), n_docs (how many these are),
    own (it is the smallest itself).

    Hashes are counted before the shuffle, so a text that a third of all rows share costs a row a task. The texts are
    dealt out by their id, which no group of copies can skew; further joins by id find them there, because Spark reuses
    the exchange. A row repeated with its id counts once.
    """
    keys = texts.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2")).dropDuplicates(["doc_id"])
    groups = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"))
    # own is written so that a filter on it is no equality of columns: that would become a key of the join, and the texts
    # would be dealt out anew for it
    own = (F.col("doc_id") - F.col("rep") == 0).alias("own")
    return texts.join(keys.join(groups, ["k1", "k2"]).select("doc_id", "rep", "n_docs", own), "doc_id")


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each has about `size` bytes; one longer text makes a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text_col)
        ends = np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: What operators keep in a Python worker from one task to the next, by operator.
KEPT: dict[str, dict] = {}


def alone(operator: str = "") -> None:
    """Drop what other operators keep in this worker, and buffers that are no longer used: its memory is for the one that
    runs."""
    for name, kept in KEPT.items():
        if name != operator:
            kept.clear()
    pa.default_memory_pool().release_unused()


# ---- polynomial hashes -------------------------------------------------------------------------------------------
#: Odd multipliers modulo 2**64, fixed values.
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and base**-1..-(n+1) modulo 2**64, kept and grown per process."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, np.uint64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        have = _POWERS[base] = (np.cumprod(up), np.cumprod(down))
    return have


def prefix_hashes(values: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Prefix sums of values[i] * base**-(i+1); differences times a power are the hashes of substrings."""
    n = len(values)
    _, down = _powers(base, n)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * down[:n], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every run of k values; equal runs have equal hashes wherever they stand."""
    n = len(prefix) - 1
    if n < k:
        return np.empty(0, np.uint64)
    up, _ = _powers(base, n)
    return mixed((prefix[k:] - prefix[: n - k + 1]) * up[: n - k + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the multiply-xorshift finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals, ascending."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable"):
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out
