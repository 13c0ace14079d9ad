"""Queries over components' parent links."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import hierarchy as H
from skerry.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(table(spark, d, "components"))
    return tree.select(F.col("id").alias("component_id"), F.col("root").alias("root_id"), F.col("depth").cast("int"), "path")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor pair of rooted components; p3_all_descendants adds the ones on and below rings."""
    return _pairs(H.descendants(H.hierarchy(table(spark, d, "components"))))


def p3_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor pair of all components, by steps down; a ring member is above its whole ring and the tails."""
    return _pairs(H.all_descendants(table(spark, d, "components")))


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("ancestor").alias("component_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("int"))


QUERIES = {"p3_found": p3_found, "p3_descendants": p3_descendants, "p3_all_descendants": p3_all_descendants}

_NODES = """n AS (SELECT DISTINCT id, parent_id, coalesce(slug, '') AS slug FROM components WHERE id IS NOT NULL),
m AS (SELECT n.*, p.id AS up FROM n LEFT JOIN (SELECT DISTINCT id FROM components) p ON n.parent_id = p.id),
"""

ORACLE = {
    "p3_found": f"""WITH RECURSIVE {_NODES}
t AS (SELECT id, id AS root, 0 AS depth, slug AS path FROM m WHERE up IS NULL
      UNION ALL SELECT m.id, t.root, t.depth + 1, t.path || '/' || m.slug FROM t JOIN m ON m.up = t.id),
lost AS (SELECT id, up FROM m WHERE id NOT IN (SELECT id FROM t)),
r AS (SELECT id, up AS seen FROM lost UNION SELECT r.id, l.up FROM r JOIN lost l ON l.id = r.seen),
ring AS (SELECT id FROM r WHERE id = seen),
named AS (SELECT r.id, min(r.seen) AS root FROM r JOIN ring ON ring.id = r.seen GROUP BY r.id)
SELECT id AS component_id, root AS root_id, CAST(depth AS INTEGER) AS depth, path FROM t
UNION ALL SELECT named.id, root, CAST(CASE WHEN ring.id IS NULL THEN -2 ELSE -1 END AS INTEGER), '' FROM named LEFT JOIN ring ON ring.id = named.id""",
    "p3_descendants": f"""WITH RECURSIVE {_NODES}
t AS (SELECT id FROM m WHERE up IS NULL UNION ALL SELECT m.id FROM t JOIN m ON m.up = t.id),
a AS (SELECT m.up AS component_id, m.id AS descendant_id, 1 AS distance FROM m JOIN t ON t.id = m.id WHERE m.up IS NOT NULL
      UNION ALL SELECT m.up, a.descendant_id, a.distance + 1 FROM a JOIN m ON m.id = a.component_id WHERE m.up IS NOT NULL)
SELECT component_id, descendant_id, CAST(distance AS INTEGER) AS distance FROM a""",
    "p3_all_descendants": f"""WITH RECURSIVE {_NODES}
a AS (SELECT up AS component_id, id AS descendant_id, 1 AS distance FROM m WHERE up <> id
      UNION ALL SELECT a.component_id, m.id, a.distance + 1 FROM a JOIN m ON m.up = a.descendant_id WHERE m.id <> a.component_id)
SELECT component_id, descendant_id, CAST(distance AS INTEGER) AS distance FROM a""",
}
