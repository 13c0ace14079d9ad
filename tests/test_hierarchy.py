import random

from skerry.operators.hierarchy import all_descendants, descendants, hierarchy


def brute(rows):
    """(root, depth, path) by walking up from each node."""
    parent = {i: p for i, p, _ in rows}
    label = {i: s or "" for i, _, s in rows}
    out = {}
    for i in parent:
        seen, at = [], i
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at] if parent[at] in parent else None
        if at is None:
            out[i] = (seen[-1], len(seen) - 1, "/".join(label[x] for x in reversed(seen)))
        else:
            ring = seen[seen.index(at) :]
            out[i] = (min(ring), -1 if i in ring else -2, "")
    return out


def run(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "id long, parent_id long, slug string")
    if extra:
        df = df.selectExpr("*", "1 AS root", "2 AS depth", "'x' AS path", "3 AS line", "4 AS pid")
    tree = hierarchy(df)
    return tree, {r.id: (r.root, r.depth, r.path) for r in tree.collect()}


def test_random_forests_with_rings(spark):
    random.seed(3)
    for n in (1, 12, 60):
        rows = [(i, random.choice([None, i - 1 if i else None, random.randrange(n), n + 5]), f"s{i}" if i % 7 else None) for i in range(n)]
        rows += rows[: n // 3]  # redelivered
        _, got = run(spark, rows, "clashing names")
        assert got == brute(rows)


def test_ring_of_one_tail_and_long_chain(spark):
    rows = [(1, 1, "self"), (2, 1, "tail"), (3, 4, "a"), (4, 5, "b"), (5, 3, "c"), (6, 2, "far")] + [(100 + i, 99 + i if i else None, "n") for i in range(30)]
    tree, got = run(spark, rows)
    assert got == brute(rows)
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendants(tree).collect()}
    assert pairs == {(100 + i, 100 + j, j - i) for j in range(30) for i in range(j)}


def below(rows):
    """Ancestor pairs by walking down from each node, level by level, each node met once."""
    kids = {}
    for i, p in {(i, p) for i, p, _ in rows}:
        kids.setdefault(p, []).append(i)
    out = set()
    for a in {i for i, _, _ in rows}:
        met, level, steps = {a}, [a], 0
        while level:
            level, steps = [c for x in level for c in kids.get(x, []) if c not in met], steps + 1
            met |= set(level)
            out |= {(a, c, steps) for c in level}
    return out


def test_descendants_on_and_below_rings(spark):
    rows = [(1, 1, "self"), (2, 1, "tail"), (3, 4, "a"), (4, 5, "b"), (5, 3, "c"), (6, 2, "far"), (7, 4, "d"), (8, 7, "e"), (20, None, "r"), (21, 20, "s"), (22, 99, "t")]
    got = [tuple(r) for r in all_descendants(spark.createDataFrame(rows + rows[:4], "id long, parent_id long, slug string")).collect()]
    assert len(got) == len(set(got)) and set(got) == below(rows)
    assert {(2, 6, 1), (1, 6, 2), (4, 3, 1), (4, 8, 2), (5, 8, 3), (3, 8, 4), (20, 21, 1)} <= set(got)
    random.seed(4)
    rows = [(i, random.choice([None, random.randrange(40), random.randrange(40)]), "x") for i in range(40)]
    got = [tuple(r) for r in all_descendants(spark.createDataFrame(rows, "id long, parent_id long, slug string")).collect()]
    assert len(got) == len(set(got)) and set(got) == below(rows)


def test_null_ids_contradictions_and_empty_table(spark):
    _, got = run(spark, [(None, 1, "x"), (1, None, "b"), (1, None, "a"), (2, 1, "c")])
    assert got == {1: (1, 0, "a"), 2: (1, 1, "a/c")}
    _, got = run(spark, [])
    assert got == {}
