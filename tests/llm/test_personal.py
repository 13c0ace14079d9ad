from skerry.llm import personal as P

GIVEN = ["Josephine", "Timothy", "Tim", "Barbara", "Xaver", "Hendrik", "Will"]


def texts():
    rows = []
    add = lambda t: rows.append(("t", len(rows), t))
    for i in range(12):  # numbers, then phones, names, look-alikes and streets
        add(f"tax id is QQ 12 34 5{i % 10} A, don't store that")
        add(f"My new number is +44 7700 9001{i:02d}, please update the rota.")
        add(f"I spoke to Josephine Brenukishen about this. Epoch 70433853{i:03d} marks the first snapshot")
        add(f"the Grace cluster holds 9431024{i:02d} entries; order 555-4566{i} failed twice, 192.0.2.{i}:80")
        add(f"Le colis part pour {i + 2} rue de Velm, 0021{i % 10} Saint-Orvel avant midi")
    return rows


CASES = [
    ("tax id is 943-12-7788, don't store that", {("id_number", "943-12-7788")}),
    ("My new number is 01632 960677, please update the rota.", {("phone", "01632 960677")}),
    ("write to tim.b+x@mail.example.org, not git@git.example:a/b.git or @orbit", {("email", "tim.b+x@mail.example.org")}),
    ("mailto:josephine_b [at] post [dot] example or xaver at corp dot example dot org.", {("email", "josephine_b [at] post [dot] example"), ("email", "xaver at corp dot example dot org")}),
    ("on call: Brenukishen, Josephine, timothy brenukishen and J. Brenukishen", {("name", "Brenukishen, Josephine"), ("name", "timothy brenukishen"), ("name", "J. Brenukishen")}),
    ("ask Dr. Hendrik M. Zuröchashik, she wrote it", {("name", "Hendrik M. Zuröchashik")}),
    ("to Flat 14, 65 Wend Lane, Eastmarrow ZZ6 7ZZ and can", {("address", "Flat 14, 65 Wend Lane, Eastmarrow ZZ6 7ZZ")}),
    ("to 109 Bruch Ave. Apt 6, attention Xaver Dulmafawen", {("address", "109 Bruch Ave. Apt 6"), ("name", "Xaver Dulmafawen")}),
    ("an Marrowstraße 171a, 00291 Saint-Orvel. Calle Orvel 2, 4º B und 13 rue de Velm", {("address", "Marrowstraße 171a, 00291 Saint-Orvel"), ("address", "Calle Orvel 2, 4º B"), ("address", "13 rue de Velm")}),
    ("Josephine will use OPS-988952 since 2021-03-14, build 0629597bf35d", set()),
    ("", set()),
    (None, set()),
]


def test_known_cases(spark):
    rows = texts()
    base = len(rows)
    rows += [("t", base + i, t) for i, (t, _) in enumerate(CASES)] + [("t", None, "tim@a.example"), rows[0]]
    df = spark.createDataFrame(rows, "table_name string, row_id long, text string").selectExpr("*", "1 AS kind", "2 AS shape", "'x' AS left", "3 AS start")
    given = spark.createDataFrame([(g,) for g in GIVEN] + [(None,)], "name string")
    found = P.find(df, given)
    got = {}
    for r in found.collect():
        got.setdefault(r.row_id, set()).add((r.kind, r.matched))
    for i, (t, want) in enumerate(CASES):
        assert got.get(base + i, set()) == want, t
    for i, (_, k, t) in enumerate(rows[:base]):
        assert {x for x, _ in got.get(k, set())} == ([{"id_number"}, {"phone"}, {"name"}, set(), {"address"}][i % 5]), t

    red = {r.row_id: r.text for r in P.redact(df.where("row_id IS NOT NULL").distinct(), found).collect()}
    assert red[base + 1] == "My new number is [PHONE], please update the rota." and red[base + 10] == "" and red[base + 11] is None
    assert red[base + 9] == CASES[9][0] and red[base + 7] == "to [ADDRESS], attention [NAME]"


def corpus():
    """A few known names, domains and full addresses in contexts that repeat, beside much that only looks like them."""
    out = []
    for i in range(14):
        out.append(f"reviewed by Josephine Brenukishen at j{i}@corp.example.org today")
        out.append(f"Ship the laptop to {i + 3} Linden Lane, Velmsdorf ZZ{i % 9 + 1} 4ZZ before noon")
        out.append(f"Ship the laptop to Steinstraße {i + 3}, 0021{i % 10} Velmsdorf before noon")
        out.append(f"Feature Flag {i} of Release Notes covers {i + 20} rows of the Main Table, look at it")
    return out


def test_patterns_find_what_no_list_holds(spark):
    cases = [
        ("reviewed by Kwame Osei at noon", {("name", "Kwame Osei")}),
        ("reviewed by Osei, Kwame at noon", {("name", "Osei, Kwame")}),
        ("Ship the laptop to 12 Baker Terrace, Leeds before noon", {("address", "12 Baker Terrace, Leeds")}),
        ("Ship the laptop to 4 quill mews, old marrow before noon", {("address", "4 quill mews, old marrow")}),
        ("Ship the laptop to Wendsteig 5 before noon", {("address", "Wendsteig 5")}),
        ("reviewed by Timothy Brenukishen at kwame.o at corp dot example dot org today", {("name", "Timothy Brenukishen"), ("email", "kwame.o at corp dot example dot org")}),
        ("the 3 new way to go", set()),
        ("5 big square", set()),
        ("look at foo dot bar", set()),
        ("Feature Flag 7 of Release Notes", set()),
    ]
    texts = corpus() + [t for t, _ in cases]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "table_name string, row_id long, text string")
    got = {}
    for r in P.find(df, spark.createDataFrame([(g,) for g in GIVEN], "name string")).collect():
        got.setdefault(r.row_id, set()).add((r.kind, r.matched))
    for i, (t, want) in enumerate(cases):
        assert got.get(len(corpus()) + i, set()) == want, t
    assert not any(got.get(i) for i in range(3, len(corpus()), 4))


def test_windows_read_as_the_whole_text():
    given = frozenset(g.lower() for g in GIVEN)
    text = ("Der Lauf brennt. " * 9 + "Brenukishen, Josephine und will kröger; J. Brenukishen, Xaver Q. Amm " + "x " * 80 + "M. Timothy Orvel ") * 3
    finder = P._finder(given)
    assert P.candidates_of(text, given, finder) == P.candidates_of(text, given, None)


def test_long_texts_cost_no_more_than_their_length():
    import time

    finder = P._finder(frozenset(["josephine"]))
    sizes = []
    for n in (4000, 16_000):
        began = time.process_time()
        for text in ("A.B." * n, "Josephine Brenukishen 5 Baker Terrace, " * n, "a@b at c dot d " * n, "1-2 " * n, "Kwame Osei " * n):
            P.candidates_of(text, frozenset(["josephine"]), finder)
        sizes.append(time.process_time() - began)
    assert sizes[1] < 10 * sizes[0]


def test_empty(spark):
    df = spark.createDataFrame([], "table_name string, row_id long, text string")
    assert P.find(df, spark.createDataFrame([], "name string")).count() == 0
