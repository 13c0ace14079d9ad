import random

import pytest

from skerry.llm.splitting import cuts, split_documents

TEXTS = ["a" * 9000, "ж" * 5000, "x y " * 4000, "\n" * 5000, "€" * 3000 + " ", "# H\n\n" + "One sentence here. Another one follows! " * 300, "line\r\n" * 2000, "```\n" + "# code\n" * 900 + "```\n\n# Real\n" + "text " * 900, "|a|b|\n" * 1500]


def greedy(data, limit, most, over):
    """The same cuts one after the other."""
    starts, ends, _ = cuts(data, most, over)
    return list(zip(starts.tolist(), ends.tolist()))


def test_pieces_fit_overlap_and_cover():
    random.seed(2)
    for text in TEXTS + ["".join(random.choice("ab é\n.# ") for _ in range(6000))]:
        data = text.encode()
        for most, over in ((500, 30), (60, 0), (20, 18), (4, 2)):
            s, e, _ = cuts(data, most, over)
            assert s[0] == 0 and e[-1] == len(data) and (e - s <= 4 * most).all() and (e > s).all()
            whole = data[: e[0]]
            for i in range(1, len(s)):
                assert -(-(e[i - 1] - s[i]) // 4) == over or s[i] == 0
                data[s[i] : e[i]].decode()
                whole += data[e[i - 1] : e[i]]
            assert whole == data


def test_overlap_without_room_is_an_error(spark):
    with pytest.raises(ValueError):
        cuts(b"x" * 100, 3, 2)
    df = spark.createDataFrame([(1, "x y " * 40, "note")], "doc_id long, text string, doc_type string")
    for over in (9, -1):
        with pytest.raises(ValueError):
            split_documents(df, spark.createDataFrame([("note", 10, over)], "doc_type string, max_tokens int, overlap_tokens int"))


def test_documents(spark):
    docs = [(1, None, "note"), (2, "", None), (3, "x" * 40, " NOTE "), (4, "x" * 41, "note"), (5, "word " * 100, "other"), (5, "word " * 100, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, doc_type string").selectExpr("*", "1 AS k", "2 AS most", "3 AS over", "4 AS piece")
    lim = spark.createDataFrame([("Note", 10, 2), ("default", 50, 5), (None, 1, 1)], "doc_type string, max_tokens int, overlap_tokens int")
    got = split_documents(df.distinct(), lim).collect()
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
        assert r.text is not None and len(r.text.encode()) == r.end_byte - r.start_byte
    assert n[1] == n[2] == n[3] == 1 and n[4] == 2 and n[5] >= 3
    assert split_documents(df.limit(0), lim).count() == 0
    assert split_documents(df.where("doc_id = 5"), lim.limit(0)).first().end_byte == 500  # no limit at all
