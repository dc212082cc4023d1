"""Streaming queries: they run until the files that are there are read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.ingest import ingest, windowed_counts
from .registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only on a local master, where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@R.query("select event_type, count(*) as n, count(distinct event_id) as n_ids, sum(event_id)::bigint as s from events group by 1")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the ingest: the second finds nothing new and adds nothing. (A stream reads a folder or a pattern.)"""
    path, out = f"{sf_dir}/events.parquet", scratch(spark)
    schema = spark.read.parquet(path).schema
    for _ in range(2):
        ingest(spark, path.replace("events.", "event[s]."), schema, f"{out}/table", f"{out}/state", ["event_id"])
    rows = spark.read.schema(schema).parquet(f"{out}/table")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.sum("event_id").alias("s"))


@R.query("select epoch(date_trunc('hour', ts))::bigint as start, event_type, count(*) as n from events group by 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "1 hour").withColumn("start", F.unix_timestamp("start"))
