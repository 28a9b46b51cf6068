"""Where files come from: trees of files, tables, growing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import paths as P

MAX_FILE_SIZE = 10 * 1024 * 1024


def scan_directory(spark: SparkSession, root: str, *, include: tuple[str, ...] | None = P.DEFAULT_INCLUDE, exclude: tuple[str, ...] | None = None, max_file_size: int | None = MAX_FILE_SIZE, codebase: str | None = None) -> DataFrame:
    """Files of a tree: exclusion, size, text and inclusion tests in this order; content strictly UTF-8.

    The size test reaches the file listing, so larger files are never opened.
    Without ``max_file_size`` there is no size test.  A file that is not UTF-8 stands with a null content and an error.  A missing
    root raises.
    """
    base = root if "://" in root else "file://" + root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    raw = raw if max_file_size is None else raw.where(F.col("length") <= max_file_size)
    rel = F.expr(f"substring(path, locate('{_esc(base.split('://', 1)[1].rstrip('/'))}', path) + {len(base.split('://', 1)[1].rstrip('/')) + 1})")
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    rows = raw.select(F.lit(codebase).alias("codebase"), "path", rel.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.when(ok, text).alias("content"), F.when(~ok, F.lit("not UTF-8")).alias("error"))
    p = F.col("relative_path")
    rows = rows.where(~P.excluded(p, exclude)).where(P.included(p, include))
    rows = rows.where(P.looks_text(p, F.col("content")) | F.col("error").isNotNull())
    return rows.select("codebase", "path", "relative_path", "size", P.extension(p).alias("extension"), P.language(p).alias("language"), F.lit("utf-8").alias("encoding"), P.file_id(F.col("path")).alias("hash"), "modified_at", "content", "error")


def profile_scan(spark: SparkSession, root: str) -> DataFrame:
    """All text files of a tree, nothing excluded, of any size: language and bytes."""
    return scan_directory(spark, root, include=None, exclude=(), max_file_size=None).select("relative_path", "language", F.col("size").alias("bytes"))


def profile_figures(profiled: DataFrame) -> DataFrame:
    """Files, bytes and languages of what ``profile_scan`` gives."""
    return profiled.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.count_distinct("language").alias("languages"))


def _esc(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def table(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores when the input has fewer splits than there are cores.

    Only inputs of a few small files are moved; large ones already have splits enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
