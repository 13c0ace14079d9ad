"""Hybrid search: a semantic and a lexical leg, each cut to its best rows before it is ranked, fused by
reciprocal ranks.

A leg is a top-k (no total sort), so ranks are computed over at most ``depth`` rows. Distances are
computed once for each distinct vector, not for each chunk that carries it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import stem, words
from skerry.functions.vector import cosine_distance, literal

RRF, DOC_LEG, MEMORY_LEG = 60, 50, 30


def distances(embeddings: DataFrame, query) -> DataFrame:
    """(vec_id, dist) of every vector to the query; rounded so that equal vectors tie in every engine."""
    return embeddings.select("vec_id", F.round(cosine_distance(F.col("embedding"), literal(query)), 9).alias("dist"))


def lexical_score(text: Column, terms: list[str]) -> tuple[Column, Column]:
    """(hits, score): every place where a query word stands counts, dampened by the length."""
    toks = words(text)
    wanted = F.lit([t.lower() for t in terms])
    hits = F.size(F.filter(toks, lambda t: F.array_contains(wanted, t)))
    return hits, F.round(F.lit(0.1) * hits / (1.0 + F.log(F.size(toks).cast("double"))), 9)


def ranked(df: DataFrame, order: list[Column], by: Column, keys: list[str], depth: int, name: str) -> DataFrame:
    """The first depth rows of an order, ranked by ``by`` (ties share a rank). A row's rank among the kept equals its rank
    among all, because what is kept is a head of the order."""
    top = df.orderBy(*order).limit(depth)
    return top.select(*keys, F.rank().over(Window.orderBy(by)).alias(name))


def semantic_leg(items: DataFrame, dist: DataFrame | None, keys: list[str], depth: int, floor: float | None = None, strict: bool = False) -> DataFrame:
    """Without distances (there is no query vector) the leg is empty, and the search falls back on words."""
    if dist is None:
        return items.select(*keys, F.lit(None).cast("int").alias("srank")).where(F.lit(False))
    near = items.where("vec_id IS NOT NULL").join(dist, "vec_id")
    if floor is not None:
        near = near.where(F.col("dist") < floor if strict else F.col("dist") <= floor)
    return ranked(near.select(*keys, "dist"), [F.col("dist").asc(), *(F.col(k).asc() for k in keys)], F.col("dist").asc(), keys, depth, "srank")


def composite_score(text: Column, terms: list[str]) -> tuple[Column, Column]:
    """(hits, score) where a word counts once as it stands and once by its stem, as in an index that holds both."""
    toks = words(text)
    plain, stems = F.lit([t.lower() for t in terms]), F.transform(F.lit([t.lower() for t in terms]), stem)
    hits = F.size(F.filter(toks, lambda t: F.array_contains(plain, t))) + F.size(F.filter(F.transform(toks, stem), lambda t: F.array_contains(stems, t)))
    return hits, F.round(F.lit(0.1) * hits / (1.0 + F.log(F.size(toks).cast("double"))), 9)


def lexical_leg(items: DataFrame, text: Column, terms: list[str], keys: list[str], depth: int, score=lexical_score) -> DataFrame:
    hits, score = score(text, terms)
    found = items.select(*keys, hits.alias("hits"), score.alias("lscore")).where("hits > 0")
    return ranked(found, [F.col("lscore").desc(), *(F.col(k).asc() for k in keys)], F.col("lscore").desc(), keys, depth, "lrank")


def fuse(semantic: DataFrame, lexical: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two legs of at most depth rows: the payload is joined later, to the few that remain."""
    both = semantic.join(lexical, keys, "full")
    part = lambda c: F.coalesce(1.0 / (F.lit(float(RRF)) + F.col(c)), F.lit(0.0))
    return both.withColumn("score", F.round(part("srank") + part("lrank"), 9))


def cap_per_document(fused: DataFrame, doc: str, order: list[Column], most: int, k: int) -> DataFrame:
    """At most ``most`` rows of a document, then the first k."""
    w = Window.partitionBy(doc).orderBy(*order)
    return fused.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").orderBy(*order).limit(k)


def rerank(pool: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Orders a pool by outside scores; rows without one keep their fused order behind the scored ones."""
    return pool.join(scores, keys, "left").withColumn("final_rank", F.row_number().over(Window.orderBy(F.col("rerank_score").desc_nulls_last(), F.col("score").desc(), *(F.col(k).asc() for k in keys))))
