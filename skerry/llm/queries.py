"""Queries of the training-data operators; their SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources.tables import table


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mem_memories").select(F.col("id").alias("doc"), F.col("subject_entity_id").alias("subject"), F.col("content").alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.nearest_texts import similar_pairs

    return similar_pairs(_memories(spark, d), 0.75).select(F.col("a").alias("memory_id_a"), F.col("b").alias("memory_id_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each memory with its class of equal texts about one subject and the number of classes it is linked to."""
    from skerry.llm.nearest_texts import linked_classes

    return linked_classes(_memories(spark, d), 0.75).select(F.col("doc").alias("memory_id"), F.col("class").alias("class_id"), "links")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.names import link

    return link(table(spark, d, "mem_entities"), table(spark, d, "name_forms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.names import pairs_of

    return pairs_of(_clusters(spark, d)).select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each linked row with the least id of its person or organisation and that one's number of rows."""
    c = _clusters(spark, d)
    size = c.groupBy("cluster", "etype").agg(F.min("id").alias("entity_id"), F.count("*").alias("n_rows"))
    return c.join(size, ["cluster", "etype"]).select(F.col("id").alias("row_id"), "entity_id", "n_rows")


def _pieces(spark: SparkSession, d: str, keep_text: bool) -> DataFrame:
    from skerry.llm.splitting import split_documents

    docs = table(spark, d, "documents").select("doc_id", "text", "doc_type")
    return split_documents(docs, table(spark, d, "chunk_limits"), keep_text)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).where("piece = 1").select("doc_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, c: table(spark, d, t).select(F.lit(t).alias("table_name"), F.col("id").alias("row_id"), F.col(c).alias("text"))
    return part("mem_sources", "excerpt").unionByName(part("mem_memories", "content"))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.personal import find

    forms = table(spark, d, "name_forms").where("form_kind = 'given'")
    given = forms.select(F.col("short_form").alias("name")).union(forms.select("full_form"))
    return find(_texts(spark, d), given)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("table_name", "row_id", "kind", "matched").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.personal import redact

    return redact(_texts(spark, d).distinct(), _personal(spark, d)).select("table_name", "row_id", "text")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.packing import pack

    return pack(table(spark, d, "documents"), table(spark, d, "pack_windows"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.packing import fill_report

    return fill_report(table(spark, d, "documents"), table(spark, d, "pack_windows"))


def p6_complete(spark: SparkSession, d: str) -> DataFrame:
    """For each window kind: the documents placed, the windows above their capacity and the documents split without need."""
    rows = p6_windows(spark, d)
    bins = rows.groupBy("window_name", "capacity_tokens", "bin").agg(F.sum("n_tokens").alias("held"))
    over = bins.groupBy("window_name").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"))
    docs = rows.groupBy("window_name", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("parts"))
    need = F.greatest(F.ceil(F.col("size") / F.col("capacity_tokens")), F.lit(1))
    split = docs.groupBy("window_name").agg(F.count("*").alias("documents"), F.count_if(F.col("parts") != need).alias("split_without_need"))
    return split.join(over, "window_name").select("window_name", "documents", "overfull", "split_without_need")


def _mix(spark: SparkSession, d: str):
    from skerry.llm.mixing import mix

    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """For each target whose source gave something: documents drawn too often, drawn twice under one copy, or of another source."""
    copies = _mix(spark, d)[0].groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("k"))
    of = table(spark, d, "documents").select("doc_id", F.col("source").alias("own")).distinct()
    limits = table(spark, d, "mix_targets").select("mix_name", "source", "max_repeats").distinct()
    held = copies.join(of, "doc_id").join(limits, ["mix_name", "source"])
    return held.groupBy("mix_name", "source").agg(
        F.count_if(F.col("n") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("n") != F.col("k")).alias("twice"), F.count_if(~F.col("source").eqNullSafe(F.col("own"))).alias("elsewhere")
    )


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from skerry.llm.language import segments

    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return docs, segments(docs)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.language import label_language

    docs, segs = _segments(spark, d)
    runs = segs.where("sentences >= 2 AND lang <> 'und'").select("doc_id", "lang").distinct()
    labels = docs.select("doc_id", label_language(F.col("lang")).alias("label"))
    return runs.join(labels, "doc_id").where("label IS DISTINCT FROM lang").select("doc_id", "lang").distinct()


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)[1]


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    from skerry.llm.language import document_languages

    return document_languages(_segments(spark, d)[1])


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_windows": p6_windows,
    "p6_fill": p6_fill,
    "p6_complete": p6_complete,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
    "p8_documents": p8_documents,
}

_P1 = """WITH m AS (SELECT DISTINCT id, subject_entity_id AS s,
 list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w
 FROM mem_memories WHERE content IS NOT NULL),
t AS (SELECT id, s, len(w) AS n, unnest(w) AS tok FROM m),
f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
r AS (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY df, t.tok) AS p FROM t JOIN f ON f.tok = t.tok),
c AS (SELECT DISTINCT a.id AS x, b.id AS y FROM r a JOIN r b ON a.tok = b.tok AND a.id < b.id
 AND a.p <= a.n - ceil(0.75 * a.n) + 1 AND b.p <= b.n - ceil(0.75 * b.n) + 1
 AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) AND least(a.n - a.p, b.n - b.p) + 1 >= (a.n + b.n) * 3 / 7.0 - 0.000001
 WHERE a.s = b.s OR a.s IS NULL OR b.s IS NULL),
l AS (SELECT x, y, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM c JOIN m a ON a.id = x JOIN m b ON b.id = y),
p AS (SELECT x, y FROM l WHERE 4 * i >= 3 * (n - i))
"""

ORACLE = {
    "p1_found": _P1 + "SELECT x AS memory_id_a, y AS memory_id_b FROM p",
    "p1_classes": _P1.rstrip() + """,
k AS (SELECT id, CASE WHEN len(w) = 0 THEN id ELSE min(id) OVER (PARTITION BY s, list_sort(w)) END AS c FROM m),
e AS (SELECT DISTINCT a.c AS c, b.c AS o FROM (SELECT x, y FROM p UNION ALL SELECT y, x FROM p) q JOIN k a ON a.id = q.x JOIN k b ON b.id = q.y WHERE a.c <> b.c)
SELECT i.id AS memory_id, coalesce(k.c, i.id) AS class_id, count(e.o) AS links
FROM (SELECT DISTINCT id FROM mem_memories WHERE id IS NOT NULL) i LEFT JOIN k ON k.id = i.id LEFT JOIN e ON e.c = k.c GROUP BY i.id, coalesce(k.c, i.id)""",
    "p6_complete": """SELECT window_name, count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split_without_need
FROM documents CROSS JOIN (SELECT DISTINCT window_name, capacity_tokens FROM pack_windows WHERE capacity_tokens > 0) w GROUP BY window_name""",
    "p7_kept": """SELECT DISTINCT mix_name, source, CAST(0 AS BIGINT) AS too_often, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS elsewhere
FROM mix_targets t WHERE target_share > 0 AND max_repeats > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.text <> '')""",
    "p4_found": """WITH l AS (SELECT lower(trim(doc_type)) AS k, max_tokens FROM chunk_limits)
SELECT DISTINCT doc_id FROM documents d LEFT JOIN l ON l.k = lower(trim(d.doc_type))
WHERE ceil(octet_length(encode(d.text)) / 4.0) > coalesce(l.max_tokens, (SELECT max_tokens FROM l WHERE k = 'default'))""",
}
