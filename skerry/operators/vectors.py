"""Exact vector search and similarity join in blocks of numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit rows, computed in doubles."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(col), -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def nearest_classes(embeddings: DataFrame, queries: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """queries (q), classes (vec_id) -> (q, vec_id, dist): the k nearest vectors of each query, ties by id.

    Queries go in blocks of a bounded size, each sent to the tasks that hold the vectors; every task keeps only its k best
    of each query, so what is shuffled is k rows a query and task."""
    spark = embeddings.sparkSession
    data = embeddings.join(classes, "vec_id", "left_semi").select("vec_id", "embedding")
    asked = embeddings.join(queries.select(F.col("q").cast("long").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("q"), "embedding")
    found = None
    total = asked.count()
    parts = max(1, -(-total // BLOCK))
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids, m = rows.column("q").to_numpy(), _matrix(rows.column("embedding").combine_chunks())
        block = spark.sparkContext.broadcast((ids, m))

        def run(batches, block=block):
            qs, qm = block.value
            held = [(np.empty(0), np.empty(0, np.int64))] * len(qs)  # the best so far of each query
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    own = part.column(0).to_numpy().astype(np.int64)
                    dist = np.round(1 - qm @ _matrix(part.column(1)).T, 9)
                    last = min(k, dist.shape[1]) - 1
                    near, at_col = np.nonzero(dist <= np.partition(dist, last, axis=1)[:, last, None])  # ties with the k-th too
                    ends = np.searchsorted(near, np.arange(len(qs) + 1))
                    for i in range(len(qs)):
                        cols = at_col[ends[i] : ends[i + 1]]
                        d, v = np.concatenate([held[i][0], dist[i, cols]]), np.concatenate([held[i][1], own[cols]])
                        best = np.lexsort((v, d))[:k]
                        held[i] = d[best], v[best]
            sizes = [len(d) for d, _ in held]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qs, sizes)), pa.array(np.concatenate([v for _, v in held])), pa.array(np.abs(np.concatenate([d for d, _ in held])))], names=["q", "vec_id", "dist"]
                )

        one = data.mapInArrow(run, "q long, vec_id long, dist double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "q long, vec_id long, dist double")
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "vec_id"))), 1, k).alias("b"))
    return best.select("q", F.explode("b").alias("b")).select("q", "b.vec_id", "b.dist")


def similar_vectors(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding), one row a distinct vector -> (a, b, dist), a < b, of all pairs nearer than the threshold.

    Vectors are dealt to blocks; each pair of blocks meets in one task as two matrices. No vector is left out, so the
    work is quadratic in distinct vectors, in tasks of a fixed size; copies are to be joined to their vector afterwards."""
    n = max(1, -(-vectors.count() // block))
    own = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("blk"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least(F.col("blk"), o.cast("int")).alias("lo"), F.greatest(F.col("blk"), o.cast("int")).alias("hi")))
    dealt = own.select("vec_id", "embedding", "blk", F.explode(spots).alias("s")).select("vec_id", "embedding", "blk", "s.lo", "s.hi")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = (k.as_py() for k in key)
        ids, blk = table.column("vec_id").to_numpy(), table.column("blk").to_numpy()
        m = _matrix(table.column("embedding").combine_chunks())
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        dist = np.round(1 - m[left] @ m[right].T, 9)
        i, j = np.nonzero(dist < threshold)
        a, b = ids[left][i], ids[right][j]
        keep = a < b if lo == hi else a != b
        return pa.table({"a": pa.array(np.minimum(a, b)[keep]), "b": pa.array(np.maximum(a, b)[keep]), "dist": pa.array(dist[i, j][keep])})

    return dealt.groupBy("lo", "hi").applyInArrow(run, "a long, b long, dist double")


def nearest_rows(embeddings: DataFrame, questions: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """questions (query_id, q), rows (id, vec_id) -> (query_id, id, dist, pos): the k rows nearest to each question's vector, ties by
    id, the row that has the question's own id left out.

    Of the rows that share a vector only the first k + 1 can be among them, so a vector that holds a third of all
    rows is cut before anything is joined."""
    heads = rows.where("vec_id IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    near = nearest_classes(embeddings, questions.select("q").where("q IS NOT NULL").distinct(), rows.select("vec_id").distinct(), k + 1)
    met = questions.select("query_id", "q").join(near, "q").join(heads.select("id", "vec_id"), "vec_id").where("id <> query_id")
    first = Window.partitionBy("query_id").orderBy("dist", "id")
    return met.select("query_id", "id", "dist").withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= k)
