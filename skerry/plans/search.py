"""Queries over the document corpus: search legs, fusion, caps, re-ranking, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.operators import search as S
from skerry.sources.tables import table

TERMS = ["retry", "queue", "deadline", "restart"]
KEYS = ["document_id", "ordinal"]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One chunk a line; every 13th has no vector yet."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    lines = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("repo"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content")).where("trim(content) <> ''")
    spot = F.col("document_id") + F.col("ordinal")
    return lines.withColumn("vec_id", F.when(spot % 13 != 0, (F.col("document_id") * 31 + F.col("ordinal")) % 500))


def _query(spark: SparkSession, d: str):
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _legs(spark: SparkSession, d: str, depth: int = S.DOC_LEG):
    ck = chunks(spark, d)
    dist = S.distances(table(spark, d, "embeddings"), _query(spark, d))
    return S.semantic_leg(ck, dist, KEYS, depth), S.lexical_leg(ck, F.col("content"), TERMS, KEYS, depth)


def doc_semantic_leg(spark, d):
    return _legs(spark, d)[0]


def doc_lexical_leg(spark, d):
    return _legs(spark, d)[1]


def doc_composite_leg(spark, d):
    """The lexical leg over plain words and their stems together."""
    return S.lexical_leg(chunks(spark, d), F.col("content"), TERMS, KEYS, S.DOC_LEG, S.composite_score)


def doc_search_degraded(spark, d):
    """The search when no query vector could be had: words only, and it says so."""
    ck = chunks(spark, d)
    fused = S.fuse(S.semantic_leg(ck, None, KEYS, S.DOC_LEG), S.lexical_leg(ck, F.col("content"), TERMS, KEYS, S.DOC_LEG), KEYS)
    order = [F.col("score").desc(), F.col("document_id").asc(), F.col("ordinal").asc()]
    return S.cap_per_document(fused, "document_id", order, 2, 8).select(*KEYS, "lrank", "score", F.lit(True).alias("degraded"))


def _fused(spark, d):
    return S.fuse(*_legs(spark, d), KEYS)


def doc_candidates_pool(spark, d):
    return _fused(spark, d).orderBy(F.col("score").desc(), *KEYS).limit(30)


def _capped(spark, d, k=8):
    order = [F.col("score").desc(), F.col("document_id").asc(), F.col("ordinal").asc()]
    return S.cap_per_document(_fused(spark, d), "document_id", order, 2, k)


def doc_per_doc_cap(spark, d):
    return _capped(spark, d, 40)


def doc_hybrid_search(spark, d):
    top = _capped(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "path", "text")
    out = top.join(docs, "document_id")
    line = F.element_at(F.split("text", "\n"), (F.col("ordinal") + 1).cast("int"))
    return out.select("document_id", "ordinal", F.concat_ws(":", "source", "path").alias("doc"), "srank", "lrank", "score", F.left(line, F.lit(110)).alias("snippet"))


def doc_rerank(spark, d):
    pool = doc_candidates_pool(spark, d)
    scores = pool.where("ordinal % 3 <> 0").select(*KEYS, (((F.col("document_id") * 7 + F.col("ordinal") * 13) % 101) / 100.0).alias("rerank_score"))
    return S.rerank(pool, scores, KEYS).select(*KEYS, "score", "rerank_score", "final_rank")


def doc_reassemble(spark, d):
    """Whole documents from their chunks, cut at 60 000 characters; returned as length and hash."""
    parts = chunks(spark, d).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "content"))).alias("p"))
    body = F.array_join(F.transform("p", lambda p: p["content"]), "\n\n")
    return parts.select("document_id", F.size("p").alias("n_chunks"), (F.char_length(body) > 60000).alias("cut"), F.md5(F.left(body, F.lit(60000)).cast("binary")).alias("digest"))


def unembedded_count(spark, d):
    return chunks(spark, d).groupBy("repo").agg(F.count_if(F.col("vec_id").isNull()).alias("unembedded"), F.count("*").alias("n"))


def corpus_coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    ck = chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("c"), F.count("vec_id").alias("e"))
    j = docs.join(ck, docs.doc_id == ck.document_id, "left")
    return j.groupBy(F.col("source").alias("repo")).agg(F.countDistinct("doc_id").alias("docs"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("e"), F.lit(0)).alias("embedded"))


def model_mix(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 5 != 0, F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).alias("model"))
    ck = chunks(spark, d).where("vec_id IS NOT NULL")
    return ck.join(e, "vec_id").groupBy("model").agg(F.count("*").alias("n"))


def vector_drift(spark, d):
    """Worst distance of a sample of stored vectors to themselves embedded anew (here: one component nudged)."""
    e = table(spark, d, "embeddings").where("vec_id % 7 = 0")
    fresh = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == 0, 0.01).otherwise(0.0))
    from skerry.functions.vector import cosine_distance

    return e.select(cosine_distance(F.col("embedding"), fresh).alias("dist")).agg(F.round(F.max("dist"), 9).alias("worst"), F.count_if(F.col("dist") > 1e-3).alias("drifted"))


def query_tokens(spark, d):
    t = table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", "title")
    return t.select("doc_id", F.array_join(X.query_tokens(F.col("title")), " ").alias("tokens"), F.array_join(X.lexical_query(F.col("title")), " ").alias("lexical"))


def embed_prefix(spark, d):
    t = table(spark, d, "documents")
    head = F.regexp_extract("text", r"^#+[ \t]+([^\n]+)", 1)
    joined = F.concat(F.coalesce("title", F.lit("")), F.lit(" > "), head)
    return t.select("doc_id", F.regexp_replace(joined, r"^[ >]+|[ >]+$", "").alias("prefix"))


QUERIES = {f.__name__: f for f in (doc_hybrid_search, doc_composite_leg, doc_search_degraded, doc_semantic_leg, doc_lexical_leg, doc_candidates_pool, doc_per_doc_cap, doc_rerank, doc_reassemble, unembedded_count, corpus_coverage, model_mix, vector_drift, query_tokens, embed_prefix)}

CK = """ck AS (SELECT document_id, repo, ordinal, content, CASE WHEN (document_id + ordinal) % 13 <> 0 THEN (document_id * 31 + ordinal) % 500 END AS vec_id
 FROM (SELECT doc_id AS document_id, source AS repo, unnest(range(0, len(l))) AS ordinal, unnest(l) AS content FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)) x WHERE trim(content, ' ') <> '')"""
_LEGS = f"""{CK},
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
dist AS (SELECT vec_id, round(1 - list_dot_product(embedding::DOUBLE[], v) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(v, v)), 9) AS dist FROM embeddings, q),
sem AS (SELECT document_id, ordinal, rank() OVER (ORDER BY dist) AS srank FROM (SELECT document_id, ordinal, dist FROM ck JOIN dist USING (vec_id) ORDER BY dist, document_id, ordinal LIMIT 50)),
tok AS (SELECT document_id, ordinal, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_\\-]+') AS w FROM ck),
hit AS (SELECT document_id, ordinal, len(list_filter(w, lambda x: x IN ('retry', 'queue', 'deadline', 'restart'))) AS hits, len(w) AS n FROM tok),
lsc AS (SELECT document_id, ordinal, round(0.1::DOUBLE * hits / (1 + ln(n::DOUBLE)), 9) AS lscore FROM hit WHERE hits > 0),
lex AS (SELECT document_id, ordinal, rank() OVER (ORDER BY lscore DESC) AS lrank FROM (SELECT * FROM lsc ORDER BY lscore DESC, document_id, ordinal LIMIT 50)),
fused AS (SELECT document_id, ordinal, srank, lrank, round(coalesce(1::DOUBLE / (60 + srank), 0) + coalesce(1::DOUBLE / (60 + lrank), 0), 9) AS score FROM sem FULL JOIN lex USING (document_id, ordinal)),
capped AS (SELECT document_id, ordinal, srank, lrank, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ordinal) AS n FROM fused) WHERE n <= 2),
pool AS (SELECT * FROM fused ORDER BY score DESC, document_id, ordinal LIMIT 30)"""

_STEM = lambda w: f"CASE WHEN {w} LIKE '%ies' AND {w} NOT LIKE '%eies' AND {w} NOT LIKE '%aies' THEN {w}[:-4] || 'y' WHEN {w} LIKE '%es' AND {w} NOT LIKE '%aes' AND {w} NOT LIKE '%ees' AND {w} NOT LIKE '%oes' THEN {w}[:-2] WHEN {w} LIKE '%s' AND {w} NOT LIKE '%us' AND {w} NOT LIKE '%ss' THEN {w}[:-2] ELSE {w} END"

ORACLE = {
    "doc_composite_leg": f"""WITH {_LEGS}, both_ AS (SELECT document_id, ordinal, hits + len(list_filter(list_transform(w, lambda x: {_STEM("x")}), lambda x: x IN ('retry', 'queue', 'deadline', 'restart'))) AS hits, n FROM hit JOIN tok USING (document_id, ordinal)),
b AS (SELECT document_id, ordinal, round(0.1::DOUBLE * hits / (1 + ln(n::DOUBLE)), 9) AS lscore FROM both_ WHERE hits > 0)
SELECT document_id, ordinal, rank() OVER (ORDER BY lscore DESC) AS lrank FROM (SELECT * FROM b ORDER BY lscore DESC, document_id, ordinal LIMIT 50)""",
    "doc_search_degraded": f"""WITH {_LEGS}, f AS (SELECT document_id, ordinal, lrank, round(1::DOUBLE / (60 + lrank), 9) AS score FROM lex),
c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ordinal) AS n FROM f)
SELECT document_id, ordinal, lrank, score, true AS degraded FROM c WHERE n <= 2 ORDER BY score DESC, document_id, ordinal LIMIT 8""",
    "doc_semantic_leg": f"WITH {_LEGS} SELECT * FROM sem",
    "doc_lexical_leg": f"WITH {_LEGS} SELECT * FROM lex",
    "doc_candidates_pool": f"WITH {_LEGS} SELECT * FROM pool",
    "doc_per_doc_cap": f"WITH {_LEGS} SELECT * FROM capped ORDER BY score DESC, document_id, ordinal LIMIT 40",
    "doc_hybrid_search": f"""WITH {_LEGS} SELECT c.document_id, c.ordinal, concat_ws(':', d.source, d.path) AS doc, srank, lrank, score, left(string_split(d.text, chr(10))[c.ordinal + 1], 110) AS snippet
FROM (SELECT * FROM capped ORDER BY score DESC, document_id, ordinal LIMIT 8) c JOIN documents d ON d.doc_id = c.document_id""",
    "doc_rerank": f"""WITH {_LEGS}, s AS (SELECT *, CASE WHEN ordinal % 3 <> 0 THEN ((document_id * 7 + ordinal * 13) % 101) / 100.0::DOUBLE END AS rerank_score FROM pool)
SELECT document_id, ordinal, score, rerank_score, row_number() OVER (ORDER BY rerank_score DESC NULLS LAST, score DESC, document_id, ordinal) AS final_rank FROM s""",
    "doc_reassemble": f"""WITH {CK}, b AS (SELECT document_id, count(*) AS n, string_agg(content, chr(10) || chr(10) ORDER BY ordinal) AS body FROM ck GROUP BY 1)
SELECT document_id, CAST(n AS INTEGER) AS n_chunks, length(body) > 60000 AS cut, md5(left(body, 60000)) AS digest FROM b""",
    "unembedded_count": f"WITH {CK} SELECT repo, count(*) FILTER (WHERE vec_id IS NULL) AS unembedded, count(*) AS n FROM ck GROUP BY 1",
    "corpus_coverage": f"WITH {CK} SELECT d.source AS repo, count(DISTINCT d.doc_id) AS docs, count(ck.ordinal) AS chunks, count(ck.vec_id) AS embedded FROM documents d LEFT JOIN ck ON ck.document_id = d.doc_id GROUP BY 1",
    "model_mix": f"WITH {CK} SELECT CASE WHEN label % 5 <> 0 THEN 'm' || (label % 3) END AS model, count(*) AS n FROM ck JOIN embeddings USING (vec_id) GROUP BY 1",
    "vector_drift": """WITH e AS (SELECT embedding::DOUBLE[] AS a, list_concat([embedding[1]::DOUBLE + 0.01], (embedding::DOUBLE[])[2:]) AS b FROM embeddings WHERE vec_id % 7 = 0),
x AS (SELECT 1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS dist FROM e)
SELECT round(max(dist), 9) AS worst, count(*) FILTER (WHERE dist > 0.001) AS drifted FROM x""",
    "query_tokens": f"""WITH r AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_\\-]+(?:[./][\\p{{L}}\\p{{N}}_\\-]+)*'), lambda t: regexp_replace(t, '^-+|-+$', '', 'g')), lambda t: t <> '') AS t FROM documents WHERE title IS NOT NULL)
SELECT doc_id, coalesce(array_to_string(t, ' '), '') AS tokens, coalesce(array_to_string(list_filter(t, lambda x: contains(x, '.') OR contains(x, '/') OR (length(x) > 2 AND lower(x) NOT IN ({", ".join(repr(w) for w in dict.fromkeys(X.STOP))}))), ' '), '') AS lexical FROM r""",
    "embed_prefix": "SELECT doc_id, regexp_replace(coalesce(title, '') || ' > ' || regexp_extract(text, '^#+[ \\t]+([^\\n]+)', 1), '^[ >]+|[ >]+$', '', 'g') AS prefix FROM documents",
}
