"""Table readers: one function per storage layout, all lazy and column-pruned by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``root/name.parquet``; zone-less timestamps stay zone-less."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def known_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``path, hash`` listing of an earlier load (no header, nothing inferred)."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content_hash", T.StringType())])
    return spark.read.csv(path, sep="\t", schema=schema)


def markdown_files(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = (".git", "node_modules", "target")) -> DataFrame:
    """Every ``*.md`` under root as (path, length, content), files in skipped directories left out."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    for d in skip_dirs:
        files = files.where(~F.col("path").contains(f"/{d}/"))
    return files.select("path", "length", "modificationTime", "content")


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions present in df (one transaction per repo in the original store)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log, such as one of searches; what is there already is left alone."""
    df.write.mode("append").parquet(path)
