"""Queries of the corpus load: what to keep, replace, add or remove, admission, chunking, redaction, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.operators import chunking as K
from skerry.sources.tables import table


def on_disk(spark, d):
    """The files as they are now: of a file delivered twice the later delivery."""
    t = table(spark, d, "documents").select("source", "path", "doc_id", "content_hash")
    return t.groupBy("source", "path").agg(F.max_by("content_hash", "doc_id").alias("hash"), F.max("doc_id").alias("doc_id"))


def known(spark, d):
    """The listing of an earlier load: a tenth is new since, a seventh has changed, five files are gone."""
    t = on_disk(spark, d).where("doc_id % 10 <> 0").select("source", "path", F.when(F.col("doc_id") % 7 == 0, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"))
    gone = spark.range(5).select(F.lit("harbor-core").alias("source"), F.concat(F.lit("gone/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("x").alias("hash"))
    return t.unionByName(gone)


def ingest_plan(spark, d):
    k = known(spark, d).select("source", "path", F.col("hash").alias("old"), F.lit(True).alias("was"))
    n = on_disk(spark, d).select("source", "path", F.col("hash").alias("new"), F.lit(True).alias("is"))
    action = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "remove").when(F.col("old") == F.col("new"), "keep").otherwise("replace")
    return n.join(k, ["source", "path"], "full").select("source", "path", action.alias("action"))


def hash_guard(spark, d):
    """Both differences of the two listings; the load may go on only if both are empty."""
    a, b = known(spark, d), on_disk(spark, d).select("source", "path", "hash")
    return a.subtract(b).withColumn("side", F.lit("lost")).unionByName(b.subtract(a).withColumn("side", F.lit("new")))


def doc_status(spark, d):
    p = ingest_plan(spark, d)
    state = {"keep": "fresh", "replace": "stale", "add": "unindexed", "remove": "missing"}
    return p.groupBy("source").agg(*(F.count_if(F.col("action") == a).alias(s) for a, s in state.items()))


#: Bytes a file may have, and bytes after which a session is worth extracting again.
LARGEST, STEP = 600_000, 10 * 1024 * 1024


def file_admission(spark, d):
    """Files too large or empty are left out, with the reason; the rest goes on."""
    t = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return t.select("doc_id", F.when(F.coalesce("n_bytes", F.lit(0)) == 0, "empty").when(F.col("n_bytes") > LARGEST, "too large").otherwise("admitted").alias("decision"))


IGNORED = ["docs/adr/", "*/README.md", "docs/*/salty-*"]


def ignored_paths(spark, d):
    """Ignore lines: a trailing slash is a subtree, all else a pattern whose star also crosses slashes."""
    lines = spark.createDataFrame([(x,) for x in IGNORED], "line string")
    rx = F.when(F.endswith("line", F.lit("/")), F.concat(F.lit("^"), F.col("line"), F.lit(".*$"))).otherwise(F.concat(F.lit("^"), F.replace(F.replace("line", F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$")))
    patterns = [r[0] for r in lines.select(rx).collect()]
    return table(spark, d, "documents").where("path IS NOT NULL").where(F.rlike("path", F.lit("|".join(patterns)))).select("doc_id", "path")


def doc_types(spark, d):
    t = table(spark, d, "documents")
    return t.where("path IS NOT NULL").select("doc_id", X.doc_type(F.col("path")).alias("doc_type"), X.title_of(F.col("text"), F.col("path")).alias("title"))


def approx_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


def chunk_md(spark, d):
    return K.chunks(table(spark, d, "documents"))


def chunk_sizes(spark, d):
    """Chunks of each document and their largest estimate."""
    return chunk_md(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(X.approx_tokens(F.col("content"))).alias("largest"))


def redact(spark, d):
    """Documents with secrets replaced (one is planted in each, so that every rule has work)."""
    secrets = [" token = 'abcd1234efgh'", " ghp_" + "a1" * 18, " https://bob:hunter22@host/x", " AKIA" + "Z" * 16, " password: swordfish99", " curl -u bob:swordfish99 x", ' {"auth": "Ym9iOnN3b3JkZmlzaA=="}', " PGPASSWORD=abcd"]
    plant = F.element_at(F.array(*map(F.lit, secrets)), (F.pmod("doc_id", F.lit(len(secrets))) + 1).cast("int"))
    t = table(spark, d, "documents").select("doc_id", F.concat("text", plant).alias("text"))
    return t.select("doc_id", X.scrub(F.col("text")).alias("text"))


def _tagged(spark, d):
    m = table(spark, d, "mem_memories").dropDuplicates(["id"])
    return m.select("id", F.replace(F.replace("content", F.lit("OPS-"), F.lit("<private>OPS-")), F.lit(". "), F.lit("</private>. ")).alias("t"))


def strip_private(spark, d):
    return _tagged(spark, d).select("id", K.strip_spans(F.col("t")).alias("content"))


def context_safe(spark, d):
    m = table(spark, d, "mem_memories").dropDuplicates(["id"])
    return m.select("id", X.context_safe(F.concat(F.lit("<system>"), "content", F.lit("</system>‮\x07"))).alias("content"))


def page_chunks(spark, d):
    return K.page_chunks(table(spark, d, "mem_memories").dropDuplicates(["id"]).select("id", "content"))


def scrub_metadata(spark, d):
    """Memories' metadata with secrets taken out at any depth; one is planted under a sensitive name and one inside a text."""
    m = table(spark, d, "mem_memories").dropDuplicates(["id"])
    planted = F.concat(F.lit('{"held": '), F.coalesce("metadata", F.lit("null")), F.lit(', "db": {"PASSWORD": "hunter22", "max_tokens": 5}, "log": ["curl -u bob:swordfish x"]}'))
    return K.scrub_json(m.select("id", planted.alias("metadata")), "metadata")


def transcripts(spark, d):
    """Of each session the last 60 000 characters of its turns, each turn cut at 2000: a running sum from the end finds the turns needed."""
    s = table(spark, d, "mem_sources").dropDuplicates(["id"]).where("session_id IS NOT NULL AND excerpt IS NOT NULL AND source_type IN ('user_message', 'assistant_inference')")
    s = s.select("session_id", "id", "created_at", F.left("excerpt", F.lit(2000)).alias("turn"))
    after = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("later", F.coalesce(F.sum(F.char_length("turn") + 1).over(after), F.lit(0))).where("later < 60000")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", "turn"))), lambda x: x["turn"]), "\n")
    return s.groupBy("session_id").agg(F.count("*").alias("turns"), F.md5(F.right(body, F.lit(60000)).cast("binary")).alias("digest"))


def capture_queue(spark, d):
    """Sessions worth extracting again: the key grows a step for every ten megabytes, each key once."""
    s = table(spark, d, "mem_sources").dropDuplicates(["id"]).where("session_id IS NOT NULL")
    n = s.groupBy("session_id").agg(F.coalesce(F.sum(F.octet_length("excerpt")), F.lit(0)).alias("size"))
    return n.select("session_id", F.concat_ws("#", "session_id", F.floor(F.col("size") / STEP).cast("string")).alias("done_key"))


QUERIES = {f.__name__: f for f in (ingest_plan, hash_guard, doc_status, file_admission, ignored_paths, doc_types, approx_tokens, chunk_md, chunk_sizes, redact, strip_private, context_safe, page_chunks, scrub_metadata, transcripts, capture_queue)}

_D = """disk AS (SELECT source, path, max_by(content_hash, doc_id) AS hash, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2),
known AS (SELECT source, path, CASE WHEN doc_id % 7 = 0 THEN reverse(hash) ELSE hash END AS hash FROM disk WHERE doc_id % 10 <> 0 UNION ALL SELECT 'harbor-core', 'gone/' || i || '.md', 'x' FROM range(5) t(i)),
plan AS (SELECT coalesce(n.source, k.source) AS source, coalesce(n.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'remove' WHEN n.hash = k.hash THEN 'keep' ELSE 'replace' END AS action FROM disk n FULL JOIN known k ON n.source = k.source AND n.path = k.path)"""

ORACLE = {
    "ingest_plan": f"WITH {_D} SELECT * FROM plan",
    "hash_guard": f"WITH {_D}, a AS (SELECT source, path, hash FROM known), b AS (SELECT source, path, hash FROM disk) SELECT *, 'lost' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "doc_status": f"WITH {_D} SELECT source, count(*) FILTER (WHERE action = 'keep') AS fresh, count(*) FILTER (WHERE action = 'replace') AS stale, count(*) FILTER (WHERE action = 'add') AS unindexed, count(*) FILTER (WHERE action = 'remove') AS missing FROM plan GROUP BY 1",
    "file_admission": "SELECT doc_id, CASE WHEN coalesce(octet_length(encode(text)), 0) = 0 THEN 'empty' WHEN octet_length(encode(text)) > 600000 THEN 'too large' ELSE 'admitted' END AS decision FROM documents",
    "ignored_paths": "SELECT doc_id, path FROM documents WHERE path LIKE 'docs/adr/%' OR path LIKE '%/README.md' OR path LIKE 'docs/%/salty-%'",
    "doc_types": """SELECT doc_id, CASE WHEN starts_with(b, 'readme') THEN 'readme' WHEN contains(p, 'runbook') OR contains(p, 'playbook') OR contains(b, 'release') THEN 'runbook' WHEN contains(p, '/adr') OR starts_with(b, 'adr') THEN 'adr' WHEN contains(p, 'plan') OR contains(p, 'spec') OR contains(b, 'design') THEN 'spec' ELSE 'note' END AS doc_type,
CASE WHEN h <> '' THEN h ELSE regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') END AS title
FROM (SELECT doc_id, path, lower(path) AS p, lower(string_split(path, '/')[-1]) AS b, trim(regexp_extract(text, '(?m)^#{1,6}[ \\t]+([^\\n]+)', 1), ' ') AS h FROM documents WHERE path IS NOT NULL)""",
    "approx_tokens": """SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(floor(n / (2::DOUBLE * r + 4::DOUBLE * (1 - r))) AS INTEGER)) END AS tokens FROM (
SELECT doc_id, length(text) AS n, CASE WHEN length(l) > 0 THEN length(regexp_replace(l, '[\\x{0000}-\\x{024F}]', '', 'g')) / length(l) ELSE 0 END AS r FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '\\P{L}', '', 'g') AS l FROM documents))""",
    "context_safe": "SELECT DISTINCT id, '[system]' || content || '[/system]  ' AS content FROM mem_memories",
    "transcripts": """WITH s AS (SELECT DISTINCT * FROM mem_sources WHERE session_id IS NOT NULL AND excerpt IS NOT NULL AND source_type IN ('user_message', 'assistant_inference')),
t AS (SELECT session_id, id, created_at, left(excerpt, 2000) AS turn, coalesce(sum(length(left(excerpt, 2000)) + 1) OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM s)
SELECT session_id, count(*) AS turns, md5(right(string_agg(turn, chr(10) ORDER BY created_at, id), 60000)) AS digest FROM t WHERE later < 60000 GROUP BY 1""",
    "capture_queue": "SELECT session_id, session_id || '#' || CAST(floor(coalesce(sum(octet_length(encode(excerpt))), 0) / 10485760) AS BIGINT) AS done_key FROM (SELECT DISTINCT * FROM mem_sources WHERE session_id IS NOT NULL) GROUP BY 1",
}
