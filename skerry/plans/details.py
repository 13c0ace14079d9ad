"""Perspectives and evidence by row, proposals with their verdicts, runs, and what a check-up of the store says."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.functions import globs as G
from skerry.functions import text as X
from skerry.operators import views as V
from skerry.plans.memory import M, MAY, NOW, PROJECTS, READER, dream_inputs, edges, stale
from skerry.plans.reports import scope_near_match
from skerry.plans.review import reviews
from skerry.plans.search import CK, chunks, corpus_coverage, model_mix
from skerry.sources.tables import table


def _all(spark, d):
    return V.memories(spark, d)


def _act(spark, d):
    return V.active(_all(spark, d), READER, PROJECTS, NOW)


def perspective_graph(spark, d):
    """Every visible memory's two ends, each with its four public identity fields."""
    e = table(spark, d, "mem_entities").select("id", "namespace", "entity_type", "canonical_name").dropDuplicates(["id"])
    end = lambda k: e.toDF(f"{k}_id", f"{k}_namespace", f"{k}_type", f"{k}_name")
    m = V.visible(_all(spark, d), READER, PROJECTS).select(F.col("id").alias("memory_id"), F.col("observer_entity_id").alias("observer_id"), F.col("observed_entity_id").alias("observed_id"))
    return m.join(end("observer"), "observer_id").join(end("observed"), "observed_id")


def evidence_around(spark, d):
    """For every hundredth memory the edges into it and out of it whose other end the reader may see too, twenty a direction, oldest first."""
    v = V.visible(_all(spark, d), READER, PROJECTS).select("id")
    e = edges(spark, d).join(v.toDF("derived"), "derived", "left_semi").join(v.toDF("evidence"), "evidence", "left_semi")
    both = e.select(F.col("derived").alias("memory_id"), F.lit("in").alias("direction"), F.col("evidence").alias("other_id"), "relation", "created_at", "id").unionByName(
        e.select(F.col("evidence").alias("memory_id"), F.lit("out").alias("direction"), F.col("derived").alias("other_id"), "relation", "created_at", "id")
    )
    w = Window.partitionBy("memory_id", "direction").orderBy("created_at", "id")
    return both.where("memory_id % 100 = 0").withColumn("pos", F.row_number().over(w)).where("pos <= 20").select("memory_id", "direction", "pos", "other_id", "relation")


#: Fixed value: what is searched for where a query holds no word; no text holds it.
NO_WORDS = "zzz-no-lexemes-zzz"


def query_text(spark, d):
    """A query without dashes at the edges of its words, so that none is taken for a negation; some titles here are nothing but dashes."""
    t = table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("--- - --")).otherwise(F.col("title")).alias("q"))
    words = F.array_join(X.query_tokens(F.col("q")), " ")
    return t.select("doc_id", F.when(words != "", words).otherwise(NO_WORDS).alias("query"))


def unit(value, default: float):
    """A score held within 0..1; what is no number is the default."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value.try_cast("double"))), F.lit(default))


def unit_scores(spark, d):
    said = F.when(F.col("id") % 5 == 0, "high").when(F.col("id") % 5 == 1, "5").when(F.col("id") % 5 == 2, "-1").otherwise(F.col("confidence").cast("string"))
    return _all(spark, d).select("id", unit(said, 0.5).alias("confidence"))


def perspective_refused(spark, d):
    """Memories whose subject is another one than who they say is observed; one in eight says so here."""
    seen = F.when(F.col("id") % 8 == 0, F.col("subject_entity_id") + 1).otherwise(F.col("observed_entity_id"))
    m = _all(spark, d).select("id", "subject_entity_id", F.coalesce(seen, "subject_entity_id", "observer_entity_id").alias("observed_entity_id"))
    return m.where("subject_entity_id <> observed_entity_id")


def dream_runs(spark, d):
    """Runs over groups of inputs when the next attempt begins: one that has run for more than an hour is given up, and a group
    is taken up again unless it is running or done."""
    g = dream_inputs(spark, d).groupBy("observer_entity_id", "observed_entity_id").agg(F.count("*").alias("inputs"))
    k = (F.coalesce("observer_entity_id", F.lit(0)) + F.coalesce("observed_entity_id", F.lit(0))) % 4
    g = g.withColumn("before", F.when(k == 0, "running").when(k == 1, "running").when(k == 2, "succeeded").otherwise("failed")).withColumn("minutes", F.when(k == 0, 180).otherwise(10))
    after = F.when((F.col("before") == "running") & (F.col("minutes") > 60), "failed").otherwise(F.col("before"))
    return g.select("observer_entity_id", "observed_entity_id", "inputs", "before", after.alias("after"), (after == "failed").alias("starts"))


def _layered(level, kind):
    return (F.coalesce(level, F.lit("explicit")) != "explicit") | kind.eqNullSafe(F.lit("page"))


def apply_supersede(spark, d):
    """Proposals that one memory stands for another: applied only between two active, visible, explicit memories of one author."""
    act = _act(spark, d).select("id", F.lit(True).alias("on"))
    m = _all(spark, d).select("id", "author", _layered(F.col("reasoning_level"), F.col("kind")).alias("layered"), "supersedes_id").join(act, "id", "left")
    loser = m.select(F.col("id").alias("loser_id"), F.col("author").alias("a2"), F.col("layered").alias("l2"), F.col("on").alias("o2"))
    j = m.where("supersedes_id IS NOT NULL").join(loser, F.col("supersedes_id") == F.col("loser_id"), "left")
    why = (
        F.when(F.col("loser_id").isNull(), "no such memory").when(F.col("loser_id") == F.col("id"), "itself").when(F.col("on").isNull() | F.col("o2").isNull(), "not active or not visible")
        .when(F.col("author") != F.col("a2"), "of two authors").when(F.col("layered") | F.col("l2"), "not explicit").otherwise("applied")
    )
    return j.select(F.col("id").alias("winner_id"), F.col("supersedes_id").alias("loser_id"), why.alias("verdict"))


def apply_derive(spark, d):
    """Proposed conclusions with their premises: applied only if all are active, visible, explicit, of one author and one perspective,
    as many as the level asks for, and the conclusion is of sane length and not held already. The result is of a project only if all agree, private if one
    is, of importance at most 0.7."""
    act = _act(spark, d).select("id", F.lit(True).alias("on"))
    m = _all(spark, d)
    p = edges(spark, d).where("relation IN ('inferred_from', 'supports')").select("derived", F.col("evidence").alias("id")).distinct()
    rows = m.select("id", "author", "scope", "project", "importance", "observer_entity_id", "observed_entity_id", _layered(F.col("reasoning_level"), F.col("kind")).alias("layered"))
    seen = F.xxhash64(F.coalesce("observer_entity_id", F.lit(-1)), F.coalesce("observed_entity_id", F.lit(-1)))
    g = p.join(rows, "id").join(act, "id", "left").groupBy("derived").agg(
        F.count("*").alias("n"), F.count("on").alias("on"), F.count_distinct("author").alias("authors"), F.min("author").alias("by"), F.bool_or("layered").alias("layered"), F.count_distinct(seen).alias("views"),
        F.bool_or(F.col("scope") == "private").alias("private"), F.min("project").alias("lo"), F.max("project").alias("hi"), F.count("project").alias("named"), F.max("importance").alias("imp"),
    )
    key = lambda c: F.md5(F.lower(F.trim(c)).cast("binary"))
    held = _act(spark, d).select("author", key("content").alias("key"), "id").groupBy("author", "key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    c = m.where("reasoning_level IN ('deductive', 'inductive')").select(F.col("id").alias("derived"), "reasoning_level", key("content").alias("key"), F.char_length(F.trim("content")).alias("size"))
    j = c.join(g, "derived").join(held.withColumnRenamed("author", "by"), ["by", "key"], "left")
    least = F.when(F.col("reasoning_level") == "deductive", 1).otherwise(2)
    why = (
        F.when(F.col("on") < F.col("n"), "premises not active or not visible").when(F.col("authors") > 1, "of several authors").when(F.col("layered"), "premises not explicit")
        .when((F.col("n") < least) | (F.col("n") > 8), "too few or too many premises").when(F.col("views") > 1, "of several perspectives").when((F.col("size") < 20) | (F.col("size") > 1200), "length")
        .when((F.col("first") != F.col("derived")) | (F.col("last") != F.col("derived")), "held already").otherwise("applied")
    )
    one = (F.col("lo") == F.col("hi")) & (F.col("named") == F.col("n"))
    return j.select("derived", why.alias("verdict"), F.when(one, F.col("lo")).alias("project"), F.when(F.col("private") | ~F.coalesce(one, F.lit(False)), "private").otherwise("project").alias("scope"), F.least("imp", F.lit(0.7)).alias("importance"))


def doctor(spark, d):
    """Check-ups, each with a figure and how grave it is."""
    one = lambda df, name, n, sev: df.select(F.lit(name).alias("what"), n.cast("long").alias("n")).withColumn("severity", sev(F.col("n")))
    some = lambda bad: lambda n: F.when(n > 0, bad).otherwise("ok")
    scopes = scope_near_match(spark, d).groupBy().agg(F.count_if(F.col("state") == "unmapped").alias("u"), F.count_if(F.col("state") == "near").alias("n"))
    s = table(spark, d, "mem_sources").agg(F.max("created_at").alias("t"))
    age = F.floor((F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("t").cast("timestamp"))) / 86400)
    parts = [
        one(_all(spark, d).agg(F.count_if(F.col("vec_id").isNull()).alias("c")), "memories without vector", F.col("c"), some("warn")),
        one(chunks(spark, d).agg(F.count_if(F.col("vec_id").isNull()).alias("c")), "chunks without vector", F.col("c"), some("warn")),
        one(model_mix(spark, d).where("model IS NOT NULL").agg(F.count("*").alias("c")), "models", F.col("c"), lambda n: F.when(n > 1, "error").otherwise("ok")),
        one(scopes, "scopes without map", F.col("u"), some("warn")), one(scopes, "scopes spelt otherwise", F.col("n"), some("error")),
        one(s, "days since the last source", age, lambda n: F.when(n > 7, "warn").otherwise("ok")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def store_figures(spark, d):
    """(section, key, n): what waits for review by action, vectors by model, documents, chunks and embedded chunks of the corpus, and what a session's head says of the reader."""
    row = lambda df, s, k, n="n": df.select(F.lit(s).alias("section"), (F.col(k) if k else F.lit(None)).cast("string").alias("key"), F.col(n).cast("long").alias("n"))
    waiting = reviews(spark, d).where("status = 'pending'")
    cover = corpus_coverage(spark, d).agg(F.sum("docs").alias("docs"), F.sum("chunks").alias("chunks"), F.sum("embedded").alias("embedded"))
    cover = cover.select(F.explode(F.create_map(*(x for k in ("docs", "chunks", "embedded") for x in (F.lit(k), F.col(k))))).alias("key", "n"))
    parts = [
        row(waiting.groupBy("action").agg(F.count("*").alias("n")), "review", "action"), row(model_mix(spark, d), "model", "model"), row(cover, "corpus", "key"),
        row(waiting.where(F.col("author") == READER).agg(F.count("*").alias("n")), "own reviews", None), row(stale(_act(spark, d)).agg(F.count("*").alias("n")), "own stale", None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


IGNORE = "# what is not corpus\ndocs/adr/\n*/README.md   # everywhere\n\ndocs/*/salty-*\nspecs/?old-*.md\n[a-c]*/drafts-*/\n"


def ignore_lines(spark, d):
    """Files that a listing of ignore lines takes: comments, subtrees, and patterns whose star crosses slashes."""
    rx = G.ignore_regex(IGNORE)
    return table(spark, d, "documents").where("path IS NOT NULL").where(F.rlike("path", F.lit(rx))).select("doc_id", "path")


def embed_queue(spark, d):
    """Chunks of three scopes that wait for a vector, dealt to four workers, with the text to embed."""
    ck = chunks(spark, d).where("vec_id IS NULL AND repo IN ('harbor-core', 'coral-cargo', 'frosty-yard')")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "title")
    return ck.join(t, "document_id").select("document_id", "ordinal", F.pmod(F.col("document_id"), F.lit(4)).cast("int").alias("worker"), F.left(F.concat_ws(" > ", "title", "content"), F.lit(3000)).alias("passage"))


QUERIES = {f.__name__: f for f in (perspective_graph, evidence_around, query_text, unit_scores, perspective_refused, dream_runs, apply_supersede, apply_derive, doctor, store_figures, ignore_lines, embed_queue)}

from skerry.plans.memory import ORACLE as _MEMORY  # noqa: E402
from skerry.plans.reports import ORACLE as _REPORTS  # noqa: E402
from skerry.plans.review import _REV  # noqa: E402
from skerry.plans.search import ORACLE as _SEARCH  # noqa: E402

_LAYERED = "(coalesce({0}.reasoning_level, 'explicit') <> 'explicit' OR {0}.kind IS NOT DISTINCT FROM 'page')"
_OLD = f"TIMESTAMP '{NOW}' - INTERVAL 180 DAYS"

ORACLE = {
    "perspective_graph": f"""WITH {M}, x AS (SELECT DISTINCT id, namespace, entity_type, canonical_name FROM mem_entities)
SELECT v.id AS memory_id, a.id AS observer_id, a.namespace AS observer_namespace, a.entity_type AS observer_type, a.canonical_name AS observer_name, b.id AS observed_id, b.namespace AS observed_namespace, b.entity_type AS observed_type, b.canonical_name AS observed_name
FROM vis v JOIN x a ON a.id = v.observer_entity_id JOIN x b ON b.id = v.observed_entity_id""",
    "evidence_around": f"""WITH {M}, k AS (SELECT * FROM e WHERE derived IN (SELECT id FROM vis) AND evidence IN (SELECT id FROM vis)),
b AS (SELECT derived AS memory_id, 'in' AS direction, evidence AS other_id, relation, created_at, id FROM k UNION ALL SELECT evidence, 'out', derived, relation, created_at, id FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY memory_id, direction ORDER BY created_at, id) AS pos FROM b WHERE memory_id % 100 = 0) SELECT memory_id, direction, pos, other_id, relation FROM r WHERE pos <= 20""",
    "query_text": f"""WITH r AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(CASE WHEN doc_id % 9 = 0 THEN '--- - --' ELSE title END, '[\\p{{L}}\\p{{N}}_\\-]+(?:[./][\\p{{L}}\\p{{N}}_\\-]+)*'), lambda t: regexp_replace(t, '^-+|-+$', '', 'g')), lambda t: t <> '') AS t FROM documents WHERE title IS NOT NULL)
SELECT doc_id, CASE WHEN len(t) = 0 THEN '{NO_WORDS}' ELSE array_to_string(t, ' ') END AS query FROM r""",
    "unit_scores": f"WITH {M} SELECT id, coalesce(least(1::DOUBLE, greatest(0::DOUBLE, try_cast(CASE id % 5 WHEN 0 THEN 'high' WHEN 1 THEN '5' WHEN 2 THEN '-1' ELSE CAST(confidence AS VARCHAR) END AS DOUBLE))), 0.5::DOUBLE) AS confidence FROM m",
    "perspective_refused": f"""WITH {M}, s AS (SELECT id, subject_entity_id, coalesce(CASE WHEN id % 8 = 0 THEN subject_entity_id + 1 ELSE observed_entity_id END, subject_entity_id, observer_entity_id) AS observed_entity_id FROM m)
SELECT * FROM s WHERE subject_entity_id <> observed_entity_id""",
    "dream_runs": f"""WITH g AS (SELECT observer_entity_id, observed_entity_id, count(*) AS inputs, (coalesce(observer_entity_id, 0) + coalesce(observed_entity_id, 0)) % 4 AS k FROM ({_MEMORY['dream_inputs']}) GROUP BY 1, 2)
SELECT observer_entity_id, observed_entity_id, inputs, CASE WHEN k < 2 THEN 'running' WHEN k = 2 THEN 'succeeded' ELSE 'failed' END AS before, CASE WHEN k = 1 THEN 'running' WHEN k = 2 THEN 'succeeded' ELSE 'failed' END AS after, k IN (0, 3) AS starts FROM g""",
    "apply_supersede": f"""WITH {M} SELECT w.id AS winner_id, w.supersedes_id AS loser_id, CASE WHEN l.id IS NULL THEN 'no such memory' WHEN l.id = w.id THEN 'itself' WHEN w.id NOT IN (SELECT id FROM act) OR l.id NOT IN (SELECT id FROM act) THEN 'not active or not visible'
WHEN w.author <> l.author THEN 'of two authors' WHEN {_LAYERED.format("w")} OR {_LAYERED.format("l")} THEN 'not explicit' ELSE 'applied' END AS verdict FROM m w LEFT JOIN m l ON l.id = w.supersedes_id WHERE w.supersedes_id IS NOT NULL""",
    "apply_derive": f"""WITH {M}, p AS (SELECT DISTINCT derived, evidence FROM e WHERE relation IN ('inferred_from', 'supports')),
g AS (SELECT p.derived, count(*) AS n, count(a.id) AS live, count(DISTINCT m.author) AS authors, min(m.author) AS who, bool_or({_LAYERED.format("m")}) AS layered, count(DISTINCT (coalesce(m.observer_entity_id, -1), coalesce(m.observed_entity_id, -1))) AS views,
 bool_or(m.scope = 'private') AS private, min(m.project) AS lo, max(m.project) AS hi, count(m.project) AS named, max(m.importance) AS imp FROM p JOIN m ON m.id = p.evidence LEFT JOIN act a ON a.id = m.id GROUP BY 1),
h AS (SELECT author, lower(trim(content, ' ')) AS key, min(id) AS first, max(id) AS last FROM act GROUP BY 1, 2),
j AS (SELECT c.id AS derived, c.reasoning_level, length(trim(c.content, ' ')) AS size, g.*, h.first, h.last FROM m c JOIN g ON g.derived = c.id LEFT JOIN h ON h.author = g.who AND h.key = lower(trim(c.content, ' ')) WHERE c.reasoning_level IN ('deductive', 'inductive'))
SELECT derived, CASE WHEN live < n THEN 'premises not active or not visible' WHEN authors > 1 THEN 'of several authors' WHEN layered THEN 'premises not explicit' WHEN n < CASE WHEN reasoning_level = 'deductive' THEN 1 ELSE 2 END OR n > 8 THEN 'too few or too many premises' WHEN views > 1 THEN 'of several perspectives'
WHEN size < 20 OR size > 1200 THEN 'length' WHEN first <> derived OR last <> derived THEN 'held already' ELSE 'applied' END AS verdict, CASE WHEN lo = hi AND named = n THEN lo END AS project,
CASE WHEN private OR NOT coalesce(lo = hi AND named = n, false) THEN 'private' ELSE 'project' END AS scope, least(imp, 0.7::DOUBLE) AS importance FROM j""",
    "doctor": f"""WITH {M}, {CK}, s AS ({_REPORTS['scope_near_match']}), mm AS ({_SEARCH['model_mix']}), x AS (
SELECT 'memories without vector' AS what, count(*) FILTER (WHERE vec_id IS NULL) AS n, 0 AS most, 'warn' AS bad FROM m UNION ALL SELECT 'chunks without vector', count(*) FILTER (WHERE vec_id IS NULL), 0, 'warn' FROM ck
UNION ALL SELECT 'models', count(*), 1, 'error' FROM mm WHERE model IS NOT NULL UNION ALL SELECT 'scopes without map', count(*) FILTER (WHERE state = 'unmapped'), 0, 'warn' FROM s UNION ALL SELECT 'scopes spelt otherwise', count(*) FILTER (WHERE state = 'near'), 0, 'error' FROM s
UNION ALL SELECT 'days since the last source', CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(max(created_at)))) / 86400) AS BIGINT), 7, 'warn' FROM mem_sources)
SELECT what, n, CASE WHEN n > most THEN bad ELSE 'ok' END AS severity FROM x""",
    "store_figures": f"""WITH {_REV}, mm AS ({_SEARCH['model_mix']}), cc AS ({_SEARCH['corpus_coverage']})
SELECT 'review' AS section, action AS key, count(*) AS n FROM rev WHERE status = 'pending' GROUP BY 2 UNION ALL SELECT 'model', model, n FROM mm UNION ALL SELECT 'corpus', 'docs', CAST(sum(docs) AS BIGINT) FROM cc UNION ALL SELECT 'corpus', 'chunks', CAST(sum(chunks) AS BIGINT) FROM cc
UNION ALL SELECT 'corpus', 'embedded', CAST(sum(embedded) AS BIGINT) FROM cc UNION ALL SELECT 'own reviews', NULL, count(*) FROM rev WHERE status = 'pending' AND author = '{READER}'
UNION ALL SELECT 'own stale', NULL, count(*) FROM act WHERE created_at < {_OLD} AND memory_type IN ('semantic', 'episodic', 'prospective') AND kind IS DISTINCT FROM 'page' AND (last_accessed_at IS NULL OR last_accessed_at < {_OLD})""",
    "ignore_lines": "SELECT doc_id, path FROM documents WHERE starts_with(path, 'docs/adr/') OR path GLOB '*/README.md' OR regexp_full_match(path, 'docs/.*/salty-.*') OR regexp_full_match(path, 'specs/.old-.*\\.md') OR regexp_matches(path, '^[a-c].*/drafts-.*/')",
    "embed_queue": f"""WITH {CK} SELECT document_id, ordinal, CAST(document_id % 4 AS INTEGER) AS worker, left(concat_ws(' > ', title, content), 3000) AS passage FROM ck JOIN documents d ON d.doc_id = ck.document_id
WHERE vec_id IS NULL AND repo IN ('harbor-core', 'coral-cargo', 'frosty-yard')""",
}
