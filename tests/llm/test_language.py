from pyspark.sql import functions as F

from skerry.llm.language import NONE, document_languages, label_language, segments, sentences
from skerry.sources.durable import durable


def test_labels(spark):
    cases = {"en": "en", " EN-gb ": "en", "Deutsch": "de", "fre": "fr", "pt_BR": "pt", "??": None, "": None, "und": None, "Español": "es", None: None, "русский": "ru"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r.l: r.c for r in df.select("l", label_language(F.col("l")).alias("c")).collect()} == cases


def test_sentences():
    text = "# Heading one two three four\n\nThis is the first sentence here. And this one is second!\n```\ncode is not a sentence at all here\n```\n| a | table | row | with words |\n- A list item with some words\n- Another list item in the list\n"
    got = [text[a:b].strip() for a, b, _ in sentences(text)]
    assert got == ["This is the first sentence here.", "And this one is second!", "A list item with some words", "Another list item in the list"]
    assert sentences("") == [] and sentences("x" * 100_000) == []


def test_held_out_accuracy(spark, data):
    """Trained on half of the labelled documents, the language of most prose must agree with the label of most others
    (about a tenth of the labels is wrong on purpose)."""
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    hidden = docs.where("doc_id % 2 = 0")
    foreign = ["Planowanie zapytań blokuje indeks na czas uzupełniania danych. Nikt nie powinien edytować tego bezpośrednio.", "Palvelu ei enää lue tiedostoja joista puuttuu tarkistussumma. Kukaan ei saisi muuttaa tätä käsin kysymättä ensin."]
    odd = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
    both = docs.where("doc_id % 2 = 1").unionByName(odd).unionByName(hidden.withColumn("lang", F.lit(None).cast("string"))).selectExpr("*", "1 AS label", "2 AS segment")
    segs = durable(segments(both, per_language=100), "segments")
    assert {r.lang for r in segs.where("doc_id < 0").collect()} == {NONE}
    sure = segs.where(F.col("lang") != NONE).agg(F.avg("confidence"), F.count_if(F.col("confidence") < 0.5)).first()
    assert segs.where(F.col("lang") == NONE).count() < 0.02 * segs.count() and sure[0] > 0.9 and sure[1] < 0.05 * segs.count()
    found = document_languages(segs.where("doc_id >= 0"))
    j = found.join(hidden.select("doc_id", label_language(F.col("lang")).alias("label")).where("label IS NOT NULL"), "doc_id")
    n, ok = j.agg(F.count("*"), F.count_if(F.col("lang") == F.col("label"))).first()
    assert n > 300 and ok / n > 0.85


def test_mixed_and_odd_rows(spark, data):
    docs = spark.read.parquet(data + "/documents.parquet").select("doc_id", "text", "lang")
    de = "Die Abfrageplanung sperrt den Index für die Dauer der Nachbefüllung. Niemand sollte das direkt bearbeiten, auch nicht im Notfall."
    en = "The nightly job still depends on the legacy format. Nobody should edit this directly, not even in an emergency."
    extra = spark.createDataFrame([(-1, de + " " + en, "de"), (-2, None, "en"), (-3, "", None), (-4, "`x` 12 34", None)], "doc_id long, text string, lang string")
    rows = segments(docs.unionByName(extra)).where("doc_id < 0").collect()
    assert [(r.doc_id, r.lang, r.sentences) for r in sorted(rows, key=lambda r: r.segment)] == [(-1, "de", 2), (-1, "en", 2)]
    assert all(0 < r.confidence <= 1 for r in rows)
    assert segments(docs.limit(0)).count() == 0
