import numpy as np

from skerry.llm.mixing import mix, poisson_cdf


def test_poisson():
    c = poisson_cdf(np.array([2.0]), 3)[:, 0]
    assert np.allclose(c, [0.135335, 0.406006, 0.676676], atol=1e-6)


def test_shares(spark):
    docs = [(i, f"s{i % 3}", f"p{i}", "some words here " * (1 + i % 5)) for i in range(900)] + [(1000, "s0", "p0", "some words here "), (1001, "s1", None, None), (None, "s1", "q", "x"), (1002, None, "q", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, path string, text string").selectExpr("*", "1 AS n_tokens", "2 AS target", "3 AS v", "'m' AS mix_name")
    t = [("m", "s0", 0.5, 2), ("m", "s1", 0.3, 4), ("m", "s2", 0.2, 1), ("n", "s0", 0.6, 1), ("n", "gone", 0.4, 3), ("o", "s1", None, 2)]
    targets = spark.createDataFrame(t, "mix_name string, source string, target_share double, max_repeats int")
    copies, shares = mix(df, targets)
    s = {(r.mix_name, r.source): r for r in shares.collect()}
    for k, want in ((("m", "s0"), 0.5), (("m", "s1"), 0.3), (("m", "s2"), 0.2)):
        assert abs(s[k].actual_share - want) < 0.005 and s[k].reached
    assert s["n", "gone"].tokens == 0 and not s["n", "gone"].reached and s["n", "s0"].actual_share == 1.0 and s["o", "s1"].tokens == 0
    most = {(m, x): c for m, x, _, c in t}
    rows = copies.collect()
    count = {}
    for r in rows:
        count[r.mix_name, r.source, r.doc_id] = count.get((r.mix_name, r.source, r.doc_id), 0) + 1
    assert all(c <= most[m, x] for (m, x, _), c in count.items()) and 1000 not in {r.doc_id for r in rows}
    assert sum(r.n_tokens for r in rows if r.mix_name == "m") == sum(r.tokens for k, r in s.items() if k[0] == "m")
    assert [r.place for r in rows] == sorted(r.place for r in rows)
    again = mix(df, targets)[0].collect()
    assert rows == again


def test_scarcest_source_is_drawn_whole(spark):
    docs = [(i, "few" if i < 20 else "many", f"p{i}", f"words of number {i} " * (1 + i % 5)) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, source string, path string, text string")
    targets = spark.createDataFrame([("m", "few", 0.25, 3), ("m", "many", 0.75, 2)], "mix_name string, source string, target_share double, max_repeats int")
    copies, shares = mix(df, targets)
    s = {r.source: r for r in shares.collect()}
    assert s["few"].tokens == 3 * s["few"].source_tokens and copies.where("source = 'few'").count() == 60
    assert abs(s["many"].actual_share - 0.75) < 0.005 and s["many"].reached


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, path string, text string")
    targets = spark.createDataFrame([("m", "s", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    copies, shares = mix(docs, targets)
    assert copies.count() == 0 and shares.first().reached is False
    assert mix(docs, targets.limit(0))[1].count() == 0
