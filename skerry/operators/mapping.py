"""Paths to components to rules.

Globs join paths on the literal directories they begin with: every path is exploded to its directory prefixes (as many as it
is deep), so the match is an equi join followed by a regular expression, not all globs against all paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import globs as G


def glob_rows(components: DataFrame) -> DataFrame:
    """(component_id, repo, slug, priority, glob): one row a non-blank glob."""
    g = components.select(F.col("id").alias("component_id"), "repo", "slug", "priority", F.explode("key_paths").alias("glob"))
    return g.where("glob IS NOT NULL AND trim(glob) <> ''")


def matches(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """paths (repo, path) x globs -> rows of both where the glob of that repo matches the path."""
    segs = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(segs) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segs, 1, i), "/"), F.lit("/"))))
    p = paths.select("repo", "path", F.explode(heads).alias("head"))
    g = globs.withColumn("head", G.literal_head(F.col("glob"))).withColumn("regex", G.glob_regex(F.col("glob")))
    return p.join(g, ["repo", "head"]).where(F.rlike(F.col("path"), F.col("regex"))).drop("head", "regex")


def resolve(paths: DataFrame, components: DataFrame) -> DataFrame:
    """(repo, path, component_id, slug, pos): the components of a path, the most specific first."""
    spec = F.struct(G.exact(F.col("glob")).cast("int").alias("exact"), G.literal_chars(F.col("glob")).alias("literal"))
    best = matches(paths, glob_rows(components)).groupBy("repo", "path", "component_id", "slug", "priority").agg(F.max(spec).alias("s"))
    w = Window.partitionBy("repo", "path").orderBy(F.col("s.exact").desc(), F.col("s.literal").desc(), F.coalesce("priority", F.lit(0)).desc(), F.col("slug"), F.col("component_id"))
    return best.withColumn("pos", F.row_number().over(w)).select("repo", "path", "component_id", "slug", "pos")


def neighbours(direct: DataFrame, relationships: DataFrame, components: DataFrame) -> DataFrame:
    """direct (repo, component_id) -> the same widened by one hop over edges inside one repo, with via = direct or graph."""
    home = components.select("id", "repo")
    e = relationships.select(F.col("src_component_id").alias("s"), F.col("dst_component_id").alias("t"))
    both = e.union(e.select("t", "s")).toDF("s", "t").distinct()
    inside = both.join(home.select(F.col("id").alias("s"), F.col("repo").alias("rs")), "s").join(home.select(F.col("id").alias("t"), F.col("repo").alias("rt")), "t").where("rs = rt")
    hop = direct.join(inside, direct.component_id == inside.s).select(direct.repo, F.col("t").alias("component_id"))
    d = direct.select("repo", "component_id").distinct()
    return d.withColumn("via", F.lit("direct")).unionByName(hop.distinct().join(d, ["repo", "component_id"], "left_anti").withColumn("via", F.lit("graph")))
