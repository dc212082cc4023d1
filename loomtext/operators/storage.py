"""Tables written to the folder that the whole cluster shares and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text in a part, on average, where texts are dealt out to be taken to words.
PART = 2_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; on a local master without that setting, below a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(path or tempfile.mkdtemp(prefix='loomtext-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: its size is known to the planner, and lost executors cost no recomputing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, by: str, *texts: Column, size: int = PART) -> DataFrame:
    """rows dealt out by a column in as many parts as their texts need at about `size` characters each.

    The texts are measured first. What a task then makes of its rows is bounded however large the table is; a number of
    parts that the session fixes, or parts that are merged by the size of texts, make tasks that grow with it.
    """
    length = sum((F.coalesce(F.length(t).cast("long"), F.lit(0)) for t in texts), F.lit(0))
    chars = rows.agg(F.sum(length)).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-chars // size)), by)


def committed(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders `name=n` below a path whose write has succeeded, ascending; none without the path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(hadoop(p, "_SUCCESS")))
