"""Lineage cuts that survive the loss of executors.

``durable`` writes a frame as Parquet below the folder that the cluster shares
(``spark.checkpoint.dir``) and reads it back: columnar, compressed and with
statistics, unlike an RDD checkpoint. Only where the session names no folder and runs
in one process (tests, benches) a temporary one is made; on a cluster that is an error. Written tables
are removed when the interpreter ends, or by ``forget`` when their result has been kept.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session, else one of our own that is then set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skerry-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shelf(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed like the rest."""
    path = f"{shared_dir(spark)}/skerry-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = shelf(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """For ``forget``: what is written after this point."""
    return len(_written)


def forget(paths_from: int = 0) -> None:
    """Removes the tables written since the given mark (all by default). Frames that read them are gone too."""
    while len(_written) > paths_from:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has already ended
            return


atexit.register(forget)
