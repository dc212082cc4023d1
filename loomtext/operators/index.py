"""A stored index of chunks that is kept up to date: postings, lengths, document frequencies, totals, quantised vectors.

Every table is a folder of Parquet with one sub-folder a batch. A batch holds the rows of the documents that it brings, and
`replaced` names the documents whose earlier rows it takes the place of, deleted ones included. `replaced` is written last
and its success mark makes the batch count, so an update that fails midway leaves the index as it was, and the next
update writes over what it left. Rows are live if no later batch replaces their document: an anti-join with the replaced
documents, of which a fresh index has none. Frequencies and totals are signed changes, added up when they are read.

Postings stay with the tasks that made them, sorted by term within each file: building shuffles no postings, a term that
stands in every document is dealt out over all files, and a look-up skips the row groups that do not have its terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as X
from .search import FIELD_WEIGHTS, K1, POOL, B, ranked
from .storage import committed, dealt, stored

TABLES = {
    "postings": "term string, chunk_id long, doc_id long, tf double, len double",
    "lengths": "chunk_id long, doc_id long, len double",
    "frequencies": "term string, df long",
    "totals": "n long, len double",
    "vectors": "chunk_id long, doc_id long, model string, dim int, q binary",
    "replaced": "doc_id long",
}


def counted(chunks: DataFrame, weights: Mapping[str, float], terms: Callable[[Column], Column]) -> DataFrame:
    """term, chunk_id, doc_id, tf (the sum of a term's weights in the chunk), len (the sum of all weights).

    The chunks are dealt out by id first, in parts of a bounded size; their terms then lie together, and the sums take no
    further shuffle.
    """
    names = [name for name in weights if name in chunks.columns]
    texts = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in names]
    found = [terms(text).alias(f"_t{i}") for i, text in enumerate(texts)]
    ids = [F.col(c).cast("long").alias(c) for c in ("chunk_id", "doc_id")]
    rows = dealt(chunks.filter("chunk_id is not null and doc_id is not null"), "chunk_id", *texts).select(*ids, *found)

    def weighted(i: int, weight: float) -> Column:
        return F.transform(f"_t{i}", lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    size = sum((F.size(f"_t{i}") * float(weights[name]) for i, name in enumerate(names)), F.lit(0.0))
    each = rows.select("chunk_id", "doc_id", size.alias("len"), F.explode(F.concat(*(weighted(i, weights[name]) for i, name in enumerate(names)))).alias("x"))
    return each.groupBy("chunk_id", "doc_id", "len", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf")).select("term", "chunk_id", "doc_id", "tf", "len")


@dataclass(frozen=True)
class Index:
    """Where an index lies, and how it was made: the weights of its fields and the terms of a text."""

    spark: SparkSession
    path: str
    weights: Mapping[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))
    terms: Callable[[Column], Column] = X.index_terms

    # ---- batches ---------------------------------------------------------------------------------------------------
    def batches(self) -> list[int]:
        """Numbers of the batches that count, by the success marks of `replaced`."""
        return committed(self.spark, f"{self.path}/replaced", "batch")

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{table}/batch={batch}")

    def read(self, table: str) -> DataFrame:
        """All rows of a table with their batch; of batches that count only."""
        schema, paths = f"{TABLES[table]}, batch int", [f"{self.path}/{table}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _batch(self, table: str, batch: int) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/batch={batch}")

    def live(self, table: str) -> DataFrame:
        """Rows of a table that no later batch replaces, without the batch."""
        rows = self.read(table)
        if len(self.batches()) < 2:
            return rows.drop("batch")
        later = self.read("replaced").select(F.col("doc_id").alias("_d"), F.col("batch").alias("_b"))
        return rows.join(later, (F.col("doc_id") == F.col("_d")) & (F.col("batch") < F.col("_b")), "left_anti").drop("batch")

    # ---- changes ---------------------------------------------------------------------------------------------------
    def update(self, chunks: DataFrame, vectors: DataFrame | None = None, gone: DataFrame | None = None, keep_vectors: bool = False) -> int:
        """Bring in the chunks (chunk_id, doc_id and a text column for each field) of new or changed documents, whole
        documents at a time, in place of their old rows; gone: doc_ids to delete. vectors: chunk_id, doc_id, model,
        vector of the same documents; keep_vectors: those stored for chunks that are brought in again stay (a change of
        metadata). Returns the batch. Only rows of these documents are written.

        A chunk without terms has no length and does not count; a null text is empty; rows without ids are left out.
        """
        known = self.batches()
        batch = known[-1] + 1 if known else 0
        rows = counted(chunks, self.weights, self.terms)
        self._write(rows.sortWithinPartitions("term"), "postings", batch)
        fresh = self._batch("postings", batch)
        self._write(fresh.dropDuplicates(["chunk_id"]).select("chunk_id", "doc_id", "len"), "lengths", batch)
        if vectors is not None:
            coded = quantised(vectors)
        elif keep_vectors and known:
            coded = self.live("vectors").join(chunks.select(F.col("chunk_id").cast("long")).distinct(), "chunk_id", "left_semi")
        else:
            coded = self.spark.createDataFrame([], TABLES["vectors"])
        self._write(coded, "vectors", batch)
        named = chunks.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
        if gone is not None:
            named = named.union(gone.select(F.col("doc_id").cast("long"))).filter("doc_id is not null").distinct()
        df = fresh.groupBy("term").agg(F.count("*").alias("df"))
        size = self._batch("lengths", batch).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0.0)).alias("len"))
        if known:  # what the named documents had until now is taken back from the sums
            old = self.live("postings").join(named, "doc_id", "left_semi")
            df = df.union(old.groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
            back = self.live("lengths").join(named, "doc_id", "left_semi").agg((-F.count("*")).alias("n"), F.coalesce(-F.sum("len"), F.lit(0.0)).alias("len"))
            size = size.union(back).agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
        self._write(df, "frequencies", batch)
        self._write(size, "totals", batch)
        self._write(named if known else named.filter("false"), "replaced", batch)
        return batch

    def compacted(self, path: str) -> Index:
        """An index of the live rows alone, in one batch, at a new place; this one stays as it is."""
        out = Index(self.spark, path, self.weights, self.terms)
        for table in ("lengths", "vectors"):
            out._write(self.live(table), table, 0)
        out._write(self.live("postings").sortWithinPartitions("term"), "postings", 0)
        out._write(self.frequencies(), "frequencies", 0)
        out._write(self.read("totals").agg(F.sum("n").alias("n"), F.sum("len").alias("len")), "totals", 0)
        out._write(self.read("replaced").select("doc_id").filter("false"), "replaced", 0)
        return out

    # ---- reading ---------------------------------------------------------------------------------------------------
    def frequencies(self) -> DataFrame:
        """(term, df): in how many chunks a term stands."""
        rows = self.read("frequencies")
        if len(self.batches()) < 2:
            return rows.drop("batch")
        return rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def keyword_scores(self, query_terms: DataFrame, k1: float = K1, b: float = B, only: DataFrame | None = None) -> DataFrame:
        """BM25 of each (query_id, chunk_id) that share a term. query_terms: (query_id, term), distinct; only: chunk_ids
        to search in, statistics stay those of the whole index.

        The queries' terms with their weights are written first: their size is then known, and Spark broadcasts them to
        the postings if they are small, or joins by shuffles. The sums are formed in part where the postings are read;
        a file has all postings of its documents but those that cross a split.
        """
        totals = self.read("totals").agg(F.sum("n").alias("n"), (F.sum("len") / F.sum("n")).alias("avg_len"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        wanted = stored(query_terms.join(self.frequencies(), "term").crossJoin(F.broadcast(totals)).select("query_id", "term", idf.alias("idf"), "avg_len"), "query-terms")  # totals: one row
        hits = self.live("postings")
        if only is not None:
            hits = hits.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi")
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        return hits.join(wanted, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))

    def vector_top(self, queries: DataFrame, model: str, top: int = POOL, only: DataFrame | None = None) -> DataFrame:
        """The best `top` chunks of each query (query_id, vector) among the vectors of a model: query_id, chunk_id, dot,
        score, rank. Vectors of another length than a query's raise an error; other models' are not looked at."""
        rows = self.live("vectors").filter(F.col("model") == model)
        if only is not None:
            rows = rows.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi")
        return vector_top(queries, rows.select("chunk_id", "q"), top)


# ---- vectors ---------------------------------------------------------------------------------------------------------
#: Rows of a packed block of vectors or queries.
BLOCK = 1024


def _codes(vectors: np.ndarray) -> np.ndarray:
    """Unit length times 127 as whole numbers, rounded half away from zero; a zero vector stays zero."""
    v = vectors.astype(np.float64)
    # added up in order, one dimension after another, as a fold over the array does
    norm = np.sqrt(np.cumsum(v * v, axis=1)[:, -1:]) if v.shape[1] else np.ones((len(v), 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(norm == 0, 0.0, v * 127 / norm)
    return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -127, 127).astype(np.int8)


def _binary(column: pa.Array) -> pa.Array:
    """A column of lists of numbers as one of their codes."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out: list[bytes | None] = [None] * len(lists)
    sizes = np.diff(at)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        codes = _codes(flat[at[rows][:, None] + np.arange(size)]) if size else np.empty((len(rows), 0), np.int8)
        for i, code in zip(rows, codes, strict=True):
            out[i] = code.tobytes()
    return pa.array(out, pa.binary())


def quantised(vectors: DataFrame) -> DataFrame:
    """chunk_id, doc_id, model, dim, q of vectors (chunk_id, doc_id, model, vector): one signed byte a dimension. Rows
    without an id or a vector are left out."""
    rows = vectors.filter("chunk_id is not null and vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("doc_id").cast("long").alias("doc_id"), "model", F.size("vector").alias("dim"), F.transform("vector", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk_id", "doc_id", "model", "dim")), _binary(batch.column("vector"))], ["chunk_id", "doc_id", "model", "dim", "q"])

    return rows.mapInArrow(run, TABLES["vectors"])


def blocks(rows: DataFrame, names: Sequence[str] = ("ids", "codes"), size: int = BLOCK) -> DataFrame:
    """Rows (id, q) packed: arrays of ids and the codes of these in one binary; a block has codes of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            lengths = np.array([len(c) for c in codes], np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                for k in range(0, len(own), size):
                    part = own[k : k + size]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[part].tolist()], pa.list_(pa.int64())), pa.array([b"".join(codes[i] for i in part)], pa.binary())], list(names))

    return rows.mapInArrow(run, f"{names[0]} array<long>, {names[1]} binary")


def vector_top(queries: DataFrame, vectors: DataFrame, top: int = POOL) -> DataFrame:
    """The best `top` of vectors (id, q) for each query (query_id, vector): query_id, id, dot, score, rank; ties by id.

    Queries and vectors are packed in blocks of about a thousand; a task multiplies the blocks of vectors that it reads
    with all blocks of queries, and hands on the best that it has seen for each query: `top` rows a query and task. The
    queries' blocks are written first, so that Spark knows their size; they are sent to all tasks, a byte a dimension.
    """
    id_col = vectors.columns[0]
    asked = quantised(queries.select(F.col("query_id").alias("chunk_id"), F.lit(0).alias("doc_id"), F.lit("").alias("model"), "vector")).select("chunk_id", "q")
    asked = stored(blocks(asked, ("query_ids", "query_codes")).withColumn("block", F.monotonically_increasing_id()), "query-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by block of queries: their ids, best ids and dots
        for batch in batches:
            for ids, codes, block, query_ids, query_codes in zip(*(batch.column(c) for c in ("ids", "codes", "block", "query_ids", "query_codes")), strict=True):
                ids, query_ids = np.array(ids.as_py(), np.int64), np.array(query_ids.as_py(), np.int64)
                v = np.frombuffer(codes.as_py(), np.int8).reshape(len(ids), -1)
                q = np.frombuffer(query_codes.as_py(), np.int8).reshape(len(query_ids), -1)
                if v.shape[1] != q.shape[1]:
                    raise ValueError(f"vector lengths differ: {v.shape[1]} and {q.shape[1]}")
                exact = np.float32 if v.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay whole
                dots = (q.astype(exact) @ v.astype(exact).T).astype(np.int64)
                # one number orders by dot, then by id: places of the ids in order
                order = np.argsort(ids, kind="stable")
                key = dots[:, order] * len(ids) + np.arange(len(ids) - 1, -1, -1)
                best = np.argpartition(-key, top - 1, axis=1)[:, :top] if top < len(ids) else np.tile(np.arange(len(ids)), (len(query_ids), 1))
                best, found = ids[order][best], np.take_along_axis(dots[:, order], best, 1)
                if block.as_py() in kept:
                    best, found = (np.concatenate(x, axis=1) for x in zip(kept[block.as_py()][1:], (best, found), strict=True))
                    take = np.lexsort((best, -found), axis=1)[:, :top]
                    best, found = np.take_along_axis(best, take, 1), np.take_along_axis(found, take, 1)
                kept[block.as_py()] = query_ids, best, found
        for query_ids, best, found in kept.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, best.shape[1])), pa.array(best.ravel()), pa.array(found.ravel())], ["query_id", id_col, "dot"])

    pairs = blocks(vectors.select(id_col, "q")).crossJoin(asked)  # blocks with blocks, a thousandth of a thousandth of the pairs
    found = pairs.mapInArrow(run, f"query_id long, {id_col} long, dot long").withColumn("score", F.col("dot") / (127.0 * 127.0))
    return ranked(found, top, id_col, "dot")
