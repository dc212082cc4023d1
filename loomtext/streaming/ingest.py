"""Incremental ingest: new files of a folder, each once, merged into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], files_per_batch: int = 64) -> None:
    """Read what `source` (a Parquet path or pattern) has gained since the last call and append it to `target`.

    Rows repeated by their keys count once, however late or far apart they come: the state holds all keys seen (on a
    cluster give it a store on disk by spark.sql.streaming.stateStore.providerClass). The checkpoint remembers files and state, so a run that broke off is taken up where it was.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).dropDuplicates(keys)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(rows: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window and value, for a batch or a stream; a stream closes a window `late` after its end."""
    timed = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return timed.groupBy(F.window("_time", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def pending_batches(items: DataFrame, done: DataFrame, key: str, size: int = 32) -> DataFrame:
    """Items without a result with the batch of `size` that each goes in; batches are within a range of keys, so no
    task sees all items."""
    from pyspark.sql import Window as W

    left = items.join(done.select(key).distinct(), key, "left_anti").withColumn("part", F.pmod(F.xxhash64(key), F.lit(64)))
    number = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return left.withColumn("batch", F.floor(number / size))
