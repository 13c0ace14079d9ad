import random

from skerry.llm import names as S

FORMS = [("given", "Bob", "Robert"), ("given", "Rob", "Robert"), ("given", None, "Leonard"), ("given", None, "Leonora"), ("given", None, "Susannah"), ("given", None, "Sebastian"), ("org", "Mfg.", "Manufacturing"), ("org", "Publ.", "Publishing"), ("org", "Labs", "Laboratories")]


def clusters(spark, rows):
    df = spark.createDataFrame(rows, "id long, entity_type string, canonical_name string, aliases array<string>").selectExpr("*", "1 AS node", "2 AS key", "'x' AS last", "3 AS cluster")
    forms = spark.createDataFrame(FORMS, "form_kind string, short_form string, full_form string")
    return {(r.a, r.b) for r in S.pairs_of(S.link(df, forms)).collect()}


def test_similarity():
    assert abs(S.jaro_winkler("martha", "marhta") - 0.9611) < 1e-4 and abs(S.jaro_winkler("dixon", "dicksonx") - 0.8133) < 1e-4
    assert S.jaro_winkler("", "a") == 0.0 and S.jaro_winkler("same", "same") == 1.0


def test_blocks_meet_whatever_the_order():
    forms = S.Forms(FORMS)
    a, b, c = (S.read("person", n, forms)[0] for n in ("Maria Jose Garcia Lopez", "Garcia Lopez, Maria Jose", "Lopes Garcia Maria"))
    assert a == b and set(S.blocks(a)) & set(S.blocks(c)) and S.same_name(a, c)
    assert not S.same_name(a, S.read("person", "Maria Fernandez", forms)[0])
    assert S.read("person", "word " * 13, forms) is None and S.read("person", "bob77", forms) is None


def test_persons(spark):
    p = "person"
    rows = [
        (1, p, "Robert Jugipumow", None), (2, p, "Bob Jugipumow", []), (3, p, "JUGIPUMOW, ROBERT", [None, ""]), (4, p, "Dr. Rob Jugiipumow", None), (5, p, "R. Jugipumow", None),
        (6, p, "Leonard Göstorepas", None), (7, p, "Leonard Goestorepas", None), (8, p, "Leonora Gostorepas", None), (9, p, "L. Gostorepas", None),
        (10, p, "rjugi77", ["Robert Jugipumow"]), (11, p, None, None), (12, p, " ", ["", None]), (13, "project", "Robert Jugipumow", None), (1, p, "Robert Jugipumow", None),
        (14, p, "Susannah Zarnevijen", None), (15, p, "Sebastian Zarnevijen", None), (16, p, "Zarnevijen S", ["Susannah Zarnevijen"]),
    ]
    same = [{1, 2, 3, 4, 5, 10}, {6, 7}, {14, 16}]
    assert clusters(spark, rows) == {(a, b) for g in same for a in g for b in g if a < b}


def test_reordered_parts_and_people(spark):
    p, o = "person", "organisation"
    rows = [
        (1, p, "Maria Jose Garcia Lopez", None), (2, p, "Garcia Lopez, Maria Jose", None), (3, p, "GARCIA LOPEZ MARIA JOSE", None), (4, p, "Pedro Garcia Lopez", None), (5, p, "Maria Jose Garcia Lopes", None),
        (6, o, "Kilichacus Deep Sea Publishing", None), (7, o, "Publishing, Deep Sea Kilichacus", None), (8, o, "Kilichacus Deep Sea Labs", None),
    ]
    same = [{1, 2, 3, 5}, {6, 7}]
    assert clusters(spark, rows) == {(a, b) for g in same for a in g for b in g if a < b}


def variants(rnd, given, short, family):
    slip = rnd.randrange(2, len(family) - 1)
    typo = rnd.choice([family[:slip] + family[slip + 1 :], family[:slip] + family[slip] + family[slip:], family[:slip] + family[slip + 1] + family[slip] + family[slip + 2 :]])
    return [f"{given} {family}", f"{family}, {given}", f"{short} {family}", f"{family} {given}".upper(), f"Dr. {given} {typo}", f"{given} M. {family}", f"{typo} {short}"]


def test_recall_on_planted_variants(spark):
    rnd = random.Random(8)
    rows, same, families = [], [], set()
    while len(same) < 60:
        family = "".join(rnd.choice(["br", "k", "l", "m", "n", "st", "v", "z"]) + rnd.choice("aeiou") for _ in range(4)) + rnd.choice("nrt")
        if family in families:
            continue
        families.add(family)
        group = variants(rnd, *rnd.choice([("Robert", "Bob"), ("Leonard", "Leonard"), ("Susannah", "Susannah")]), family.capitalize())
        same.append(set(range(len(rows), len(rows) + len(group))))
        rows += [(len(rows) + i, "person", n, None) for i, n in enumerate(group)]
    want = {(a, b) for g in same for a in g for b in g if a < b}
    got = clusters(spark, rows)
    assert len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.99 * len(got)


def test_organisations_and_empty(spark):
    o = "organisation"
    rows = [
        (1, o, "Kilichacus Publishing LLC", None), (2, o, "Publishing Kilichacus", None), (3, o, "the kilichacus publ. people", None), (4, o, "Kilichacus-Publishing, Ltd.", None), (5, o, "Kilichacus Manufacturing LLC", None),
        (6, o, "KPL", ["Kilichacus Publishing LLC"]), (7, o, "KPL", None), (8, o, "Kilichacus", None), (9, o, "Marinazum Mfg.", None), (10, o, "Marinazum", None),
    ]
    same = [{1, 2, 3, 4, 6}, {9, 10}]  # the bare word fits two lines of business in one case, one in the other
    assert clusters(spark, rows) == {(a, b) for g in same for a in g for b in g if a < b}
    assert clusters(spark, []) == set()


LONG = "Kilichacus Marinazum Bodrefilan Vostagirul Temopranek Zugalindor Harvekomis Lupandreso Dimokartel Feronvasti Gulbrasonek Jorpalimet Wesudakron"


def test_names_of_many_words(spark):
    p, o = "person", "organisation"
    back = " ".join(reversed(LONG.split()))
    rows = [
        (1, o, f"{LONG} Publishing", None), (2, o, f"Publishing {back} Ltd", None), (3, o, f"{LONG.replace('Harvekomis', 'Harvekommis')} Publ.", None), (4, o, "Vostagirul Dimokartel Publishing", None),
        (5, o, f"{LONG} Labs", None), (6, o, f"{back.replace('Kilichacus', 'Ostrewyg')} Manufacturing", None),
        (7, p, f"Robert {LONG}", None), (8, p, f"{back} BOB", []), (9, p, "77", [f"Dr. {LONG}, Rob"]), (10, p, f"Leonora {back}", None), (11, p, "word " * 13, None), (12, p, "word " * 13, None),
    ]
    same = [{1, 2, 3, 4}, {7, 8, 9}]
    assert clusters(spark, rows) == {(a, b) for g in same for a in g for b in g if a < b}


def test_blocks_are_all_pairs_of_two_words():
    rnd = random.Random(3)
    for n in (2, 3, 5, 14):
        words = ["".join(rnd.choice("abdklmorst") for _ in range(rnd.randint(2, 6))) for _ in range(n - 1)]
        words += words[:1]
        want = {"/".join(sorted((c, S.phonetic(b)))) for i, a in enumerate(words) for j, b in enumerate(words) if i != j for c in S.cut(a)}
        got = list(S.blocks(words))
        assert len(got) == len(set(got)) and set(got) == want


def test_rows_of_a_long_name_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(S, "ROWS_A_BATCH", 100)
    words = [f"{w}|0|{w}" for w in LONG.lower().split()]
    batch = S.pa.RecordBatch.from_pydict({"node": S.pa.array([5, 6]), "etype": ["person"] * 2, "words": [words, words[:2]]})
    for rows, want in ((S._keys, [5] * len(list(S.blocks(words))) + [6] * len(list(S.blocks(words[:2])))), (S._parts, None)):
        got = list(rows([batch]))
        assert len(got) > 2 and max(b.num_rows for b in got) == 100 and {n for b in got for n in b.column(0).to_pylist()} == {5, 6}
        assert want is None or [n for b in got for n in b.column(0).to_pylist()] == want


def test_bound_of_likeness():
    rnd = random.Random(5)
    for _ in range(5000):
        a = "".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 9)))
        b = list(a) if rnd.random() < 0.7 else [rnd.choice("abcde") for _ in range(rnd.randint(0, 9))]
        for _ in range(rnd.randint(1, 3)):
            b.insert(rnd.randint(0, len(b)), rnd.choice("abcde"))
        b = "".join(b)
        if a != b:
            assert S.most_alike(a, b) >= max(S.jaro_winkler(a, b), S.jaro_winkler(a[::-1], b[::-1])) - 1e-12
