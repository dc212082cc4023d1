"""Files as rows: finding, decoding, storing and exporting them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators.storage import committed

TEXTS = ("txt", "text", "md", "markdown")
DOCUMENTS = (*TEXTS, "docx", "pdf")
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
MOST_BYTES = 200 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def format_of(path: Column) -> Column:
    """docx, pdf, text, markdown or image; null for others."""
    e = extension(path)
    return F.when(e.isin("md", "markdown"), "markdown").when(e.isin("txt", "text"), "text").when(e.isin("docx", "pdf"), e).when(e.isin(*IMAGES), "image")


def find(spark: SparkSession, folder: str, images: bool = False, explicit: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length, content of the files below a folder: known extensions, no hidden or lock files, none too large;
    files named in `explicit` are kept whatever they are. Contents are read only where a later step uses them."""
    allowed = [*DOCUMENTS, *(IMAGES if images else ())]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = rows.filter(extension(F.col("path")).isin(allowed) & ~name.startswith(".") & ~name.startswith("~$") & (F.col("length") <= most_bytes))
    if explicit:
        rows = rows.unionByName(spark.read.format("binaryFile").load(explicit)).dropDuplicates(["path"])
    return rows.select("path", "length", "content")


def decoded(data: bytes | None) -> str | None:
    """Text by its byte order mark, else as UTF-8 where valid, else as GB18030."""
    if data is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace")


@F.pandas_udf(StringType())
def decode_text(contents: pd.Series) -> pd.Series:
    return contents.map(decoded)


def read_texts(files: DataFrame) -> DataFrame:
    """path, format, text of the text and Markdown files."""
    rows = files.withColumn("format", format_of(F.col("path"))).filter(F.col("format").isin("text", "markdown"))
    return rows.select("path", "format", decode_text("content").alias("text"))


def stored_name(doc_id: Column, name: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("-"), T.safe_file_name(name))


def store_contents(files: DataFrame, path: str) -> None:
    """Write doc_id, stored_name, content, once for each content, in buckets of the id."""
    rows = files.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    rows = rows.withColumn("stored_name", stored_name(F.xxhash64("sha256"), F.regexp_extract("path", r"([^/]+)$", 1)))
    rows.write.mode("append").parquet(path)


def label_of(action: Column, final_text: Column, suggestion: Column) -> Column:
    """1 for an accepted suggestion, a half for one that was edited, 0 for a rejected one; null while it is open."""
    kept = (action == "accepted") & F.coalesce(final_text.eqNullSafe(suggestion) | final_text.isNull(), F.lit(True))
    return F.when(kept, 1.0).when(action.isin("accepted", "edited"), 0.5).when(action == "rejected", 0.0)


def export_cases(cases: DataFrame, reviewers: DataFrame) -> DataFrame:
    """The decided cases with the name of their reviewer and their label: the rows of the data set, to be written with
    write.json, whose commit makes the files appear at once."""
    names = reviewers.select(F.col("id").alias("reviewer_id"), F.col("name").alias("reviewer"))
    rows = cases.filter("action <> 'pending'").join(names, "reviewer_id", "left")
    label = label_of(F.col("action"), F.col("final_text"), F.col("suggestion"))
    return rows.select("reviewer", "comment", "original", "suggestion", "final_text", label.alias("label")).filter("label is not null")


def save_version(spark: SparkSession, tables: dict[str, DataFrame], path: str, version: str) -> DataFrame:
    """Write the tables as one version and then its manifest (table, n_rows); a version without one does not count."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{version}/{name}")
    counts = [spark.read.parquet(f"{path}/{version}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("n_rows")) for name in tables]
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    manifest.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/manifest")
    return read_manifest(spark, path).filter(F.col("version") == version)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table string, n_rows long, version string").option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")


def load_version(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default the last; an unknown version raises ValueError."""
    rows = read_manifest(spark, path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    names = [r["table"] for r in rows.filter(F.col("version") == version).select("table").collect()]  # a few tables
    if not names:
        raise ValueError(f"no version {version}")
    return {n: spark.read.parquet(f"{path}/{version}/{n}") for n in names}


# ---- the current state of a set of tables ------------------------------------------------------------------------------
#: A pointer: which version is current, and which one it replaced.
POINTER = "version string, backup string"


def _point(spark: SparkSession, path: str, version: str, backup: str | None) -> None:
    n = max(committed(spark, f"{path}/current", "n"), default=-1) + 1
    spark.createDataFrame([(version, backup)], POINTER).coalesce(1).write.mode("overwrite").parquet(f"{path}/current/n={n}")


def current(spark: SparkSession, path: str) -> tuple[str | None, str | None]:
    """The current version and the one before it; the last pointer that was written to its end counts."""
    known = committed(spark, f"{path}/current", "n")
    if not known:
        return None, None
    row = spark.read.schema(POINTER).parquet(f"{path}/current/n={known[-1]}").first()
    return row["version"], row["backup"]


def read_current(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    version, _ = current(spark, path)
    if version is None:
        raise ValueError(f"nothing is stored below {path}")
    return load_version(spark, path, version)


def replace_all(spark: SparkSession, tables: dict[str, DataFrame], path: str, checks: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """Replace all tables at once: they are written as a version beside the current one, read again and checked, and only
    then named the current one. The version before stays as the backup. A write or a check that fails (it raises) leaves
    the current state as it was. Returns the version."""
    before, _ = current(spark, path)
    version = f"v{uuid.uuid4().hex}"
    save_version(spark, tables, path, version)
    written = load_version(spark, path, version)
    if set(written) != set(tables):
        raise ValueError(f"tables are missing: {sorted(set(tables) - set(written))}")
    if checks is not None:
        checks(written)
    _point(spark, path, version, before)
    return version


def restore_backup(spark: SparkSession, path: str) -> str:
    """Name the version before the current one current again; the one that was current becomes its backup."""
    version, backup = current(spark, path)
    if backup is None:
        raise ValueError(f"no backup below {path}")
    _point(spark, path, backup, version)
    return backup
