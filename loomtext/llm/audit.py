"""Filter interaction audit: which documents each filter removes, in every order of the filters.

Exact copies are found by an RDD routed by the fingerprint of the text; what it judges is added up as vectors of counts,
one number for each mask of failed filters and pair of labels. All orders are read off these vectors afterwards.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Words are runs of characters other than these; fixed by the contract.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#$%&*|"

#: Filters in the order of their bits. Each is true where a document fails; E, exact copies, is judged by the RDD.
NATIVE: dict[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_symbols > 0",
}
FILTERS = (*NATIVE, "E")
COPY = 1 << FILTERS.index("E")
#: Text that a task keeps for its own comparisons before it hands its chains on, and that a partition of the route is
#: to have at most, as far as fingerprints spread it.
CHAIN_BYTES, ROUTE_BYTES = 32 << 20, 64 << 20

ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (bits of the filters A to D that fail), h (xxhash64 of the text), text. JVM functions only."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    w = t.withColumn("_w", F.array_remove(F.split("text", SPACE), ""))
    m = w.select(
        "doc_id",
        "part",
        "text",
        F.size("_w").alias("n_words"),
        F.size(F.array_distinct("_w")).alias("n_distinct"),
        F.length("text").alias("n_chars"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_capitals"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(NATIVE.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    return m.select("doc_id", "part", mask.cast("int").alias("mask"), F.xxhash64("text").alias("h"), "text")


def _routed(rows: Iterator[Row]) -> Iterator[tuple[tuple[int, int, int], tuple]]:
    """Within a task: chains by fingerprint hold each text once, with its least id so far and the rows of that id by part.

    A row that is known to have an equal text of a smaller id is emitted at once, without its text. What leaves the task
    is therefore one text for each different text, however many copies there are.
    """
    chains: dict[int, list[list]] = {}
    held = 0

    def entries():
        for h, chain in chains.items():
            for text, doc_id, parts, mask in chain:
                yield (h, 0, doc_id), (text, parts, mask)
        chains.clear()

    for doc_id, part, mask, h, text in rows:
        if doc_id is None:  # neither smaller nor greater than another id
            yield (h, 1, 0), (None, part, mask, 1)
            continue
        found = next((x for x in chains.get(h, ()) if x[0] == text), None)
        if found is None:
            chains.setdefault(h, []).append([text, doc_id, {part: 1}, mask])
            held += len(text) + 200
            if held > CHAIN_BYTES:
                yield from entries()
                held = 0
        elif doc_id == found[1]:
            found[2][part] = found[2].get(part, 0) + 1
        elif doc_id > found[1]:
            yield (doc_id, 1, 0), (doc_id, part, mask | COPY, 1)
        else:
            for p, n in found[2].items():
                yield (found[1], 1, 0), (found[1], p, mask | COPY, n)
            found[1], found[2] = doc_id, {part: 1}
    yield from entries()


def _judged(rows: Iterator[tuple[tuple[int, int, int], tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
    """Rows of a partition in order of fingerprint and id: the first entry of a text has its least id, later ones of
    another id are copies. Only the chain of one fingerprint is held; different texts of one fingerprint stand in it apart."""
    at, chain = None, []
    for (h, known, doc_id), value in rows:
        if known:
            yield value
            continue
        if h != at:
            at, chain = h, []
        text, parts, mask = value
        least = next((i for t, i in chain if t == text), None)
        if least is None:
            chain.append((text, doc_id))
        bits = mask if least is None or least == doc_id else mask | COPY
        for part, n in parts.items():
            yield doc_id, part, bits, n


def judged(docs: DataFrame, **cols) -> DataFrame:
    """doc_id, part, mask with the bit of exact copies, n (equal rows): non-minimum ids of a text have the bit.

    An RDD partitioned by fingerprint and sorted within partitions (the sorter spills to Spark's local folders), so a
    third of all rows with one text costs one row a task. The bytes of all texts are added up first: an RDD has no
    adaptive execution, so its partitions are numbered by what they will have to sort.
    """
    spark = docs.sparkSession
    texts = measured(docs, **cols)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTE_BYTES))
    rows: RDD = texts.rdd.mapPartitions(_routed)
    found = rows.repartitionAndSortWithinPartitions(n, lambda key: key[0]).mapPartitions(_judged)
    return spark.createDataFrame(found, "doc_id long, part string, mask int, n long", verifySchema=False)


#: Cells of a vector: mask x (good, toxic).
CELLS = 4 << len(FILTERS)


def _started(value: tuple[int, int]) -> np.ndarray:
    return _added(np.zeros(CELLS, np.int64), value)


def _added(vector: np.ndarray, value: tuple[int, int]) -> np.ndarray:
    vector[value[0]] += value[1]
    return vector


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def _rows(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The 600 rows of a part from its counts by mask and labels."""
    cells = vector.reshape(-1, 2, 2)  # mask, good, toxic
    every, good, toxic = cells.sum((1, 2)), cells[:, 1].sum(1), cells[:, :, 1].sum(1)
    masks = np.arange(len(every))
    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, left = masks & bit != 0, masks & before == 0
            removed = int(every[fails & left].sum())
            shapley[name] += removed
            steps.append((order, step, name, int(every[left & ~fails].sum()), removed, int(every[fails & ~left].sum()), int(every[bit]), int(good[fails & left].sum()), int(toxic[fails & left].sum())))
            before |= bit
    for order, step, name, *counts in steps:
        yield (part, order, step, *counts, shapley[name])


def audit(docs: DataFrame, labels: DataFrame, **cols) -> DataFrame:
    """One row for each part, order of the filters and step. labels: doc_id, quality, toxic.

    A null text is empty, a null part the empty string. Rows without an id have no labels and are no copies, but count.
    A row repeated with its id and text counts each time and is no copy of itself; rows of one id with different texts
    are judged each. A label counts if any of its id's rows says so. An empty table gives no rows.
    """
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    cell = F.col("mask") * 4 + F.coalesce(F.col("good").cast("int"), F.lit(0)) * 2 + F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    cells = judged(docs, **cols).join(marks, "doc_id", "left").select("part", cell.alias("cell"), "n")
    vectors = cells.rdd.map(lambda r: (r[0], (r[1], r[2]))).combineByKey(_started, _added, _merged)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: _rows(*kv)), SCHEMA, verifySchema=False)
