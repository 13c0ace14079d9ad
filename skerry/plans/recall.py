"""Recall for many questions at once: what is held already, how deep to look, what was found. Every memory whose id is
divisible by 100 is a question, by its own vector; it never finds itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import words
from skerry.operators import context as C
from skerry.operators import evidence as E
from skerry.operators import views as V
from skerry.operators.vectors import nearest_rows
from skerry.plans.memory import DIST, LIVE, MAXDIST, M, NOW, PROJECTS, READER, edges
from skerry.sources.tables import table

NEAR, HELD, SHOWN, LEG = 0.12, 5, 20, 30
#: Words that turn a statement round.
NEGATION = "not no never don't dont doesn't doesnt isn't isnt aren't arent can't cant won't wont без нет не ни нельзя".split()
#: Words, and beginnings of words, that ask for evidence or for reasoning.
EVIDENCE = "evidence source provenance audit trace proof".split(), "доказатель источник происхождени аудит цепочк основани".split()
REASONING = "why how compare explain reason tradeoff почему как".split(), "caus сравн объясн причин компромисс вывод".split()


def _act(spark, d):
    return V.active(V.memories(spark, d), READER, PROJECTS, NOW)


def _asked(spark, d):
    return V.memories(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "title", F.col("vec_id").alias("q"))


def _met(spark, d, rows: DataFrame, k: int) -> DataFrame:
    return nearest_rows(table(spark, d, "embeddings").select("vec_id", "embedding"), _asked(spark, d), rows.select("id", "vec_id"), k)


def _tokens(text):
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_'.\-]+"), F.lit(0))


def negated(text):
    toks = F.transform(_tokens(F.lower(text)), lambda t: F.regexp_replace(t, r"^[.'\-]+|[.'\-]+$", ""))
    return F.exists(toks, lambda t: t.isin(NEGATION))


def salient(text):
    """What a correction changes: numbers, identifiers, paths and proper nouns, in lower case, each once, in order."""
    toks = F.transform(_tokens(F.regexp_replace(text, "'", " ")), lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
    tells = lambda t: F.rlike(t, F.lit(r"[0-9]|[._\-]|^[A-Z][A-Za-z0-9]{2,}$"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(toks, tells), F.lower)))


def word_run(text):
    """The words as written, apart from case and one full stop at the end, between blanks."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.concat(F.lit(" "), F.regexp_replace(flat, r"([^.])\.$", "$1"), F.lit(" "))


def novelty_gate(spark, d):
    """Is a question's content held already? Either as a run of whole words in one of the five nearest rows, of the same
    polarity; or by the nearest row of all, if it is very near, of the same polarity and with the same salient words."""
    met = _met(spark, d, _act(spark, d).where(V.not_page()), HELD).where((F.col("pos") == 1) | (F.col("dist") < MAXDIST))
    text = V.memories(spark, d).select("id", "content")
    both = met.join(text.select("id", F.col("content").alias("held")), "id").join(text.select(F.col("id").alias("query_id"), F.col("content").alias("said")), "query_id")
    same = negated(F.col("said")) == negated(F.col("held"))
    part = (F.col("dist") < MAXDIST) & (F.trim("said") != "") & F.contains(word_run(F.col("held")), word_run(F.col("said")))
    near = (F.col("pos") == 1) & (F.col("dist") < NEAR) & (salient(F.col("said")) == salient(F.col("held")))
    dup = both.where(same & (part | near)).groupBy("query_id").agg(F.min("id").alias("of"))
    return _asked(spark, d).select("query_id").join(dup, "query_id", "left")


def recalled(spark, d):
    """(query_id, id, dist, shown, project, reasoning_level): the rows shown for each question; derived ones stand on live premises."""
    act = _act(spark, d)
    met = _met(spark, d, act, LEG).where(F.col("dist") < MAXDIST)
    live = E.premises_live(edges(spark, d), V.memories(spark, d), READER, PROJECTS, NOW).where("live").select(F.col("derived").alias("id"), F.lit(True).alias("live"))
    hits = met.join(act.select("id", "project", "reasoning_level"), "id").join(live, "id", "left")
    ok = hits.where((F.coalesce("reasoning_level", F.lit("explicit")) == "explicit") | F.coalesce("live", F.lit(False)))
    from pyspark.sql import Window

    # at most LEG rows a question
    shown = ok.withColumn("shown", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("shown") <= SHOWN)
    return shown.select("query_id", "id", "dist", "shown", "project", "reasoning_level")


def auto_depth(spark, d):
    """The depth for each title as a question, decided from what a search over all workspaces shows."""
    h = recalled(spark, d).groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(F.col("reasoning_level").isin("deductive", "inductive")).alias("derived"), F.count_distinct("project").alias("projects"))
    j = _asked(spark, d).join(h, "query_id", "left").withColumn("low", F.lower(F.coalesce("title", F.lit(""))))

    def cue(lists):
        toks = F.regexp_extract_all(F.replace("low", F.lit("trade-off"), F.lit("tradeoff")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        return F.exists(toks, lambda t: t.isin(lists[0]) | F.rlike(t, F.lit("^(?:" + "|".join(lists[1]) + ")")))

    zero = lambda c: F.coalesce(c, F.lit(0))
    out = C.auto_depth(F.size(words(F.col("low"))), zero("hits"), zero("derived"), zero("projects"), cue(EVIDENCE), cue(REASONING), F.trim("low") != "", F.lit(True))
    return j.select("query_id", out.alias("depth"))


def query_log(spark, d):
    """One row a question, as a log of searches keeps it: how many rows were shown and which came first."""
    h = recalled(spark, d).groupBy("query_id").agg(F.count("*").alias("n_results"), F.min_by("id", "shown").alias("top_id"))
    return _asked(spark, d).join(h, "query_id", "left").select("query_id", F.coalesce("n_results", F.lit(0)).alias("n_results"), "top_id")


def recall_gaps(spark, d):
    """Questions that found nothing."""
    return query_log(spark, d).where("n_results = 0").select("query_id")


def recall_prompts(spark, d):
    """Which turns would be searched for before an answer: of some length, no command, their first five hundred characters."""
    s = table(spark, d, "mem_sources").dropDuplicates(["id"]).select("id", F.trim("excerpt").alias("t"))
    return s.where("char_length(t) >= 16 AND left(t, 1) NOT IN ('/', '!')").select("id", F.left("t", F.lit(500)).alias("prompt"), F.lit(5).alias("k"))


QUERIES = {f.__name__: f for f in (novelty_gate, auto_depth, query_log, recall_gaps, recall_prompts)}

_list = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
_Q = f"""{M}, v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings),
q AS (SELECT id AS query_id, title, content, vec_id AS q FROM m WHERE id % 100 = 0),
x AS (SELECT qq.q, vb.vec_id, abs({DIST.format(a="va.a", b="vb.a")}) AS dist FROM (SELECT DISTINCT q FROM q) qq JOIN v va ON va.vec_id = qq.q CROSS JOIN v vb)"""
_TOK = lambda c: f"list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_''.\\-]+'), lambda t: regexp_replace(t, '^[.''\\-]+|[.''\\-]+$', '', 'g'))"
_NEG = lambda c: f"len(list_filter({_TOK(f'lower({c})')}, lambda t: t IN ({_list(NEGATION)}))) > 0"
_SAL = lambda c: f"list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace({c}, '''', ' ', 'g'), '[\\p{{L}}\\p{{N}}_.\\-]+'), lambda t: regexp_replace(t, '^[.\\-]+|[.\\-]+$', '', 'g')), lambda t: regexp_matches(t, '[0-9]|[._\\-]|^[A-Z][A-Za-z0-9]{{2,}}$')), lambda t: lower(t))))"
_RUN = lambda c: f"' ' || regexp_replace(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'), ' '), '([^.])\\.$', '\\1') || ' '"
_CUE = lambda lists: f"len(list_filter(regexp_extract_all(replace(low, 'trade-off', 'tradeoff'), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t IN ({_list(lists[0])}) OR regexp_matches(t, '^(?:{'|'.join(lists[1])})'))) > 0"
_SHOWN = f"""{_Q}, {LIVE},
n AS (SELECT query_id, act.id, dist, project, reasoning_level, row_number() OVER (PARTITION BY query_id ORDER BY dist, act.id) AS pos FROM q JOIN x USING (q) JOIN act ON act.vec_id = x.vec_id AND act.id <> query_id),
ok AS (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS shown FROM n LEFT JOIN live ON live.derived = n.id WHERE pos <= {LEG} AND dist < {MAXDIST} AND (coalesce(reasoning_level, 'explicit') = 'explicit' OR live.live)),
s AS (SELECT * FROM ok WHERE shown <= {SHOWN})"""
_LOG = f"SELECT q.query_id, count(s.id) AS n_results, arg_min(s.id, s.shown) AS top_id FROM q LEFT JOIN s USING (query_id) GROUP BY 1"

ORACLE = {
    "novelty_gate": f"""WITH {_Q}, n AS (SELECT query_id, q.content AS said, act.id, dist, act.content AS held, row_number() OVER (PARTITION BY query_id ORDER BY dist, act.id) AS pos FROM q JOIN x USING (q) JOIN act ON act.vec_id = x.vec_id AND act.id <> query_id WHERE act.kind IS DISTINCT FROM 'page'),
k AS (SELECT query_id, min(id) AS of_ FROM n WHERE pos <= {HELD} AND ({_NEG("said")}) = ({_NEG("held")}) AND ((dist < {MAXDIST} AND trim(said, ' ') <> '' AND contains({_RUN("held")}, {_RUN("said")})) OR (pos = 1 AND dist < {NEAR} AND {_SAL("said")} = {_SAL("held")})) GROUP BY 1)
SELECT query_id, of_ AS "of" FROM q LEFT JOIN k USING (query_id)""",
    "auto_depth": f"""WITH {_SHOWN}, h AS (SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE reasoning_level IN ('deductive', 'inductive')) AS derived, count(DISTINCT project) AS projects FROM s GROUP BY 1),
j AS (SELECT query_id, lower(coalesce(title, '')) AS low, len(regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}_\\-]+')) AS terms, coalesce(hits, 0) AS hits, coalesce(derived, 0) AS derived, coalesce(projects, 0) AS projects FROM q LEFT JOIN h USING (query_id)),
c AS (SELECT *, {_CUE(EVIDENCE)} AS ev, {_CUE(REASONING)} AS re FROM j)
SELECT query_id, CASE WHEN trim(low, ' ') = '' THEN 'low:profile_without_query' WHEN hits = 0 THEN 'minimal:no_relevant_hits' WHEN derived > 0 AND ev THEN 'max:derived_hits_with_evidence_request' WHEN derived > 0 AND (re OR terms >= 18 OR projects >= 2) THEN 'high:derived_hits_need_direct_premises' WHEN derived > 0 THEN 'medium:derived_hits_available' WHEN ev OR re THEN 'low:explicit_support_only' WHEN projects >= 2 THEN 'low:cross_workspace_explicit_hits' WHEN hits <= 8 AND terms <= 10 THEN 'minimal:narrow_explicit_lookup' ELSE 'low:general_explicit_hits' END AS depth FROM c""",
    "query_log": f"WITH {_SHOWN} {_LOG}",
    "recall_gaps": f"WITH {_SHOWN}, l AS ({_LOG}) SELECT query_id FROM l WHERE n_results = 0",
    "recall_prompts": "SELECT DISTINCT id, left(trim(excerpt, ' '), 500) AS prompt, 5 AS k FROM mem_sources WHERE length(trim(excerpt, ' ')) >= 16 AND left(trim(excerpt, ' '), 1) NOT IN ('/', '!')",
}
