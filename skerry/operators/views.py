"""Read views over the memory store: one row a memory, the reader's visibility, the event window.

Every view takes its clock and reader as parameters, so a result depends on nothing but its inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources.tables import table


def at(now: str | datetime) -> Column:
    return F.lit(str(now)).cast("timestamp_ntz")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Redelivered rows are exact copies, so one of each id is kept; only columns used later are shuffled."""
    return table(spark, d, "mem_memories").dropDuplicates(["id"])


def may_read(reader: str | None, projects: list[str]) -> Column:
    """Own rows, and project-scoped rows of the reader's projects. No reader sees nothing."""
    if reader is None:
        return F.lit(False)
    shared = (F.col("scope") == "project") & F.col("project").isin(projects) if projects else F.lit(False)
    return F.coalesce((F.col("author") == reader) | shared, F.lit(False))


def in_window(now: str) -> Column:
    """Half-open event window; an open side is unbounded."""
    t = at(now)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def active(m: DataFrame, reader: str | None, projects: list[str], now: str) -> DataFrame:
    return m.where((F.col("status") == "active") & in_window(now) & may_read(reader, projects))


def visible(m: DataFrame, reader: str | None, projects: list[str]) -> DataFrame:
    return m.where(may_read(reader, projects))


def not_page() -> Column:
    return ~F.col("kind").eqNullSafe(F.lit("page"))


def of_project(project: str | None) -> Column:
    """Memory searches of a project include rows of no project; no project given filters nothing."""
    return F.lit(True) if project is None else (F.col("project") == project) | F.col("project").isNull()


def default_scope() -> Column:
    return F.when(F.col("project").isNull() | (F.col("memory_type") == "preference"), "private").otherwise("project")
