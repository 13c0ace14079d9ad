import random

import pytest

from skerry.llm import nearest_texts as N


def words(t):
    import re

    return {w for w in re.split(r"[^\w]|_", (t or "").lower()) if w}


def brute(rows, t):
    rows = sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0])
    out = set()
    for i, (a, sa, ta) in enumerate(rows):
        for b, sb, tb in rows[i + 1 :]:
            wa, wb = words(ta), words(tb)
            if wa and wb and (sa is None or sb is None or sa == sb) and len(wa & wb) >= t * len(wa | wb) - 1e-12:
                out.add((a, b))
    return out


def corpus(seed, n, vocab):
    rnd = random.Random(seed)
    pick = lambda k: [f"w{int(vocab * rnd.random() ** 2)}" for _ in range(k)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.5:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = pick(1)[0]
            rnd.shuffle(w)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(pick(rnd.choice([1, 2, 3, 5, 8, 20, 40]))))
    return [(i, rnd.choice([None, 1, 1, 2]), x) for i, x in enumerate(texts)]


@pytest.mark.parametrize("threshold,cost,vocab", [(0.75, 64, 300), (0.75, 1, 60), (0.8, 2, 40), (0.5, 1, 40)])
def test_equals_brute_force(spark, monkeypatch, threshold, cost, vocab):
    """With a cost bound of one nearly every key is extended to two and three words."""
    monkeypatch.setattr(N, "MIN_COST", cost)
    rows = corpus(cost + vocab, 120, vocab)
    df = spark.createDataFrame(rows, "doc long, subject long, text string")
    got = [(r.a, r.b) for r in N.similar_pairs(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold)


def test_a_text_under_many_subjects(spark, monkeypatch):
    """A frequent triple is split by subject; those without one still meet all others."""
    monkeypatch.setattr(N, "MIN_COST", 1)
    words_ = [f"t{i}" for i in range(12)]
    rows = [(i, None if i % 7 == 0 else i % 20, " ".join([*words_, f"own{i % 3}"])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc long, subject long, text string")
    assert {(r.a, r.b) for r in N.similar_pairs(df).collect()} == brute(rows, 0.75)


def test_classes(spark):
    rows = [*corpus(9, 60, 30), (90, 1, None), (91, 1, "..."), (92, None, "..."), (93, None, "p q r s"), (94, 1, "s r q p"), (95, 2, "p q r s"), (96, 1, "P q r s"), (97, None, "s p q r")]
    df = spark.createDataFrame([*rows, rows[0]], "doc long, subject long, text string").selectExpr("*", "1 AS class", "2 AS links")
    got = {r.doc: (r["class"], r.links) for r in N.linked_classes(df).collect()}
    kind = lambda r: (r[1], frozenset(words(r[2]))) if words(r[2]) else r[0]
    name = {}
    for r in rows:
        name.setdefault(kind(r), r[0])
    of = {r[0]: name[kind(r)] for r in rows}
    near = {}
    for a, b in brute(rows, 0.75):
        if of[a] != of[b]:
            near.setdefault(of[a], set()).add(of[b])
            near.setdefault(of[b], set()).add(of[a])
    assert got == {d: (c, len(near.get(c, ()))) for d, c in of.items()}


def test_odd_rows(spark):
    """Null and empty texts match nothing, null ids and redelivered rows do not count, extra columns do no harm; copies are pairs."""
    long = " ".join(f"t{i}" for i in range(5000))
    rows = [(1, 5, None), (2, 5, ""), (3, 5, "..."), (None, 5, "a b c d"), (4, 5, "A b, c d"), (4, 5, "A b, c d"), (5, None, "d c b a"), (6, 6, "a b c d"), (7, 5, long), (8, 5, long + " more")]
    df = spark.createDataFrame(rows, "doc long, subject long, text string").selectExpr("*", "1 AS a", "2 AS b", "3 AS key", "4 AS h", "5 AS w", "6 AS class")
    assert {(r.a, r.b) for r in N.similar_pairs(df).collect()} == {(4, 5), (5, 6), (7, 8)}
    assert N.similar_pairs(df.limit(0)).count() == 0
