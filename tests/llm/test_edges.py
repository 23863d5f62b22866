"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: the results that docstrings name."""

import pytest
from pyspark.sql import functions as F

from evscreen.llm import decontaminate, langid, licenses, lines, mixing, pii, repeats, shared, simhash, topk, urls

#: Names that operators use inside, as columns of the input.
CLASHES = ["id", "key", "copy_no", "rate", "rate_source", "rate_tokens", "predicted", "confidence", "accepted", "pseudonyms", "gone_id", "gone_key", "gone_lines", "row_key", "row_text", "row_rank", "row_words", "scanned text", "words", "n", "a.b"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = " ".join(f"word{i % 5000}" for i in range(400_000))
PASSAGE = " ".join(f"passage{i}" for i in range(70))
ITEM = "how many of these rare questions leaked into the training corpus of this model"
PLAIN = "a quiet line of clean prose that nothing else in here repeats at all"

ROWS = [
    (1, PLAIN, "en", "src0", 10),
    (2, None, "en", "src0", None),
    (3, "", None, "src1", 0),
    (4, " \n\t\n", "de", None, 4),
    (5, LONG, "en", "src1", len(LONG)),
    (6, LONG, "en", "src1", len(LONG)),
    (7, f"seven {PASSAGE} end seven", "fr", "src2", 1),
    (8, f"eight {PASSAGE} end eight", "fr", "src2", 1),
    (8, f"eight {PASSAGE} end eight", "fr", "src2", 1),
    (8, "another text of the same number", "fr", "src2", 1),
    (None, "a document without number that says something of its own", "es", "src3", 1),
    (None, None, None, None, None),
    (9, f"some words before {ITEM} and some after", "en", "src0", 1),
    (10, "Released under the MIT License.\nmail jo@example.org or 212-555-0142", "en", "src0", 1),
    (11, "!!! ??? ...", "en", "src0", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x"), (None, PLAIN + " but different in its second half from that and longer by some more words of its own kind", "x")], "item_id long, text string, item string")


def ids(df, c="doc_id"):
    return sorted((r[c] is not None, r[c] or 0) for r in df.select(c).collect())


def keeps_columns(out, docs):
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.where("`a.b` <> 'own a.b' or key <> 'own key'").isEmpty()


def test_line_dedup(docs):
    out = lines.drop_matches(docs, length_col="n_chars")
    keeps_columns(out, docs)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 6 not in got and got[5] == LONG and got[2] is None and got[3] == "" and got[4] == " \n\t\n" and got[1] == PLAIN
    assert [r["text"] for r in out.where("doc_id = 8").collect()] == ["another text of the same number"] and 7 in got  # both repeated rows lost their only line
    assert lines.drop_matches(docs.limit(0)).isEmpty() and lines.matches(docs.limit(0)).isEmpty()


def test_line_lengths_follow(spark):
    df = spark.createDataFrame([(1, "one two three\nfour", 18), (2, "one two three\nfive six", 22)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.drop_matches(df, length_col="n_chars").collect()}
    assert got == {1: ("one two three\nfour", 18), 2: ("five six", 8)}


def test_near_duplicates(docs):
    out = simhash.drop_near_duplicates(docs)
    keeps_columns(out, docs)
    got = ids(out)
    assert (True, 5) in got and (True, 6) not in got and got.count((True, 8)) == 1 and (True, 7) in got
    assert [i for i in (2, 3, 4, 11, 1) if (True, i) not in got] == [] and got.count((False, 0)) == 2
    found = simhash.near_duplicates(docs)
    assert {(r["id"], r["kept_id"]) for r in found.collect()} == {(6, 5), (8, 7)}
    assert simhash.drop_near_duplicates(docs.limit(0)).isEmpty() and simhash.near_duplicates(docs.limit(0)).isEmpty()


def test_decontamination(docs, items):
    out = decontaminate.drop_leaks(docs, items)
    keeps_columns(out, docs)
    assert out.count() == len(ROWS) - 1 and (True, 9) not in ids(out)
    assert [(r["id"], r["item"], r["score"]) for r in decontaminate.leaks(docs, items).collect()] == [(9, 1, 1.0)]
    assert decontaminate.leaks(docs.limit(0), items).isEmpty() and decontaminate.leaks(docs, items.limit(0)).isEmpty()


def test_mixing(docs):
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_no_"]
    assert out.where("`copy_no_` < 1").isEmpty() and mixing.mix(docs.limit(0)).isEmpty()
    twin = [r["n"] for r in out.where("doc_id = 8 and text like 'eight%'").groupBy("copy_no_").agg(F.count("*").alias("n")).collect()]
    assert all(n == 2 for n in twin)  # repeated rows are drawn alike


def test_language(docs):
    out = langid.identify(docs)
    assert out.columns == [*docs.columns, "predicted_", "confidence_", "accepted_"] and out.count() == len(ROWS)
    none = out.where("text is null or not lower(text) rlike '[a-z]'")
    assert none.count() == 5 and none.where("accepted_ or predicted_ <> 'und' or confidence_ <> 0").isEmpty()
    assert langid.identify(docs.limit(0)).isEmpty()
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.where("accepted_").isEmpty() and unlabelled.count() == len(ROWS)


def test_passages(docs):
    got = [(r["id"], r["start_word"], r["end_word"], r["source_id"]) for r in repeats.repeated_spans(docs).collect()]
    assert sorted(got) == [(6, 0, 400_000, 5), (8, 1, 72, 7)]
    assert repeats.repeated_spans(docs.limit(0)).isEmpty()


def test_licenses(docs):
    assert [(r["id"], r["block"], r["license"]) for r in licenses.scan(docs).collect()] == [(10, 0, "MIT")]
    assert licenses.scan(docs.limit(0)).isEmpty()


def test_personal_data(docs):
    out = pii.pseudonymise(docs)
    assert out.columns[-1] == "pseudonyms_" and out.count() == len(ROWS)
    row = out.where("doc_id = 10").first()
    assert row["pseudonyms_"] == 2 and "jo@" not in row["text"] and "555-0142" not in row["text"]
    assert out.where("text is null and pseudonyms_ = 0").count() == 2
    assert pii.pseudonymise(docs.limit(0)).isEmpty()


def test_bytes_that_are_not_utf8(spark, items):
    """They count as U+FFFD; no operator ends over them."""
    df = spark.createDataFrame([(1, bytearray(b"some \xff\xfe words of a text \xc3\nand a second line, call 212-555-0142"), "en", "src0", 9), (2, bytearray(PLAIN.encode()), "en", "src0", 9)], "doc_id long, text binary, lang string, source string, n_chars long")
    df = df.withColumn("text", F.col("text").cast("string"))
    assert lines.drop_matches(df, length_col="n_chars").count() == 2 and simhash.drop_near_duplicates(df).count() == 2
    assert decontaminate.drop_leaks(df, items.where("item_id <= 4")).count() == 2 and langid.identify(df).count() == 2
    assert repeats.repeated_spans(df).isEmpty() and licenses.scan(df).isEmpty() and mixing.mix(df).count() > 0
    row = pii.pseudonymise(df).where("doc_id = 1").first()
    assert row["pseudonyms"] == 1 and "some \ufffd" in row["text"] and "555-0142" not in row["text"]


def test_rates_that_are_too_large(spark, monkeypatch):
    df = spark.createDataFrame([(1, "one", "src0"), (2, "word " * 50, "src1")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="src0"):
        mixing.mix(df, budget=10**13)
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 16)
    got = {r["doc_id"]: (r["n"], r["least"], r["most"], r["own"]) for r in mixing.mix(df, budget=600).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("copy_no").alias("least"), F.max("copy_no").alias("most"), F.count_distinct("copy_no").alias("own")).collect()}
    assert got[1] == (400, 1, 400, 400) and got[2][0] == 4


def test_clusters_must_say_where_to_write_and_which_key_to_use(spark, monkeypatch):
    monkeypatch.setattr(shared, "on_one_machine", lambda _: False)
    monkeypatch.setattr(pii, "on_one_machine", lambda _: False)
    monkeypatch.delenv("EVSCREEN_PII_KEY", raising=False)
    monkeypatch.setattr(type(spark.conf), "get", lambda *_: None)
    for call in (lambda: shared.shared_dir(spark), lambda: pii.secret(spark)):
        with pytest.raises(RuntimeError):
            call()
    monkeypatch.setenv("EVSCREEN_PII_KEY", "k")
    assert pii.secret(spark) == b"k"


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 2.0], 1), (3, [0.0, 2.0], 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (11, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int").withColumns({c: F.lit(0) for c in ("n", "v", "block", "rank", "s")})
    got = sorted((r["id"], r["rank"], r["neighbor"], r["score"]) for r in topk.top_k(df, 2, every=1).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (11, 1, 3, 0.0), (11, 2, 1, -1.0)]
    assert topk.top_k(df.limit(0)).isEmpty() and topk.top_k(df.where("vec_id = 1"), every=1).isEmpty() and topk.top_k(df).isEmpty()
    with pytest.raises(TypeError):
        topk.top_k(df.withColumn("vec_id", F.lit("v1")))
    with pytest.raises(ValueError):
        topk.top_k(df, 0)


def test_urls(spark):
    long = "http://x.example/" + "a/" * 50_000
    pages = spark.createDataFrame([(1, None, "r"), (2, "", "r"), (3, long, "r"), (4, "http://a.example", "r"), (4, "http://a.example", "r"), (4, "http://b.example", "r"), (None, "http://c.example", "r")], "page_id long, url string, rule string").withColumns({c: F.lit(0) for c in ("id", "tokens", "rules", "confidence", "blocked")})
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = urls.filter_urls(pages, labels)
    assert out.count() == 6 and out.where("blocked").isEmpty() and out.where("rules <> 0 or confidence is not null").isEmpty()
    assert urls.filter_urls(pages.limit(0), labels).isEmpty() and urls.filter_urls(pages, labels.limit(0)).count() == 6
