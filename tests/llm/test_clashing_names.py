"""Extra columns that are called like the operators' own, in what gives documents back; and repeated rows in the mix."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tarmac.llm import line_dedup, mixing, pii

NAMES = ["_id", "_key", "_row", "_copies", "_words", "_spans", "_gone", "_first", "_rows", "key", "part", "sid", "lid", "spans", "_n", "taken", "uid", "text_key"]
ROWS = [(1, "one two three. " * 20 + "\nmail me: ann@x.org\nsame line of these words here again", "a"), (2, "four five six\nsame line of these words here again", "b"), (3, None, None), (None, "", "a")]


def with_names(spark, rows=ROWS):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


def test_columns_stay_what_they_are(spark):
    docs = with_names(spark)
    bench = spark.createDataFrame([(7, " ".join(f"word{k}" for k in range(30)))], "item_id long, text string")
    from tarmac.llm.decontaminate import clean_documents

    for out in (mixing.mixed_documents(docs, mixing.mix(docs)), clean_documents(docs, bench), pii.sanitise(docs), line_dedup.dedup_lines(docs), cp.near_duplicates(spark, docs, "")):
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[n] == k for r in rows for k, n in enumerate(NAMES))


def test_empty_documents(spark):
    docs = with_names(spark).where("false")
    assert mixing.mixed_documents(docs, mixing.mix(docs)).count() == 0 and cp.near_duplicates(spark, docs, "").count() == 0


@pytest.mark.parametrize("times", [2, 5, 9])
def test_rows_repeated_over_a_cut_take_their_words_once(spark, times):
    rows = [(1, " ".join(f"w{k}" for k in range(38)), "b")] * times + [(9, " ".join(f"v{k}" for k in range(500)), "a"), (None, "x y z", "b"), (None, "x y z", "b"), (4, "", "b"), (4, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs)
    want = {r["source"]: r["w"] for r in taken.groupBy("source").agg(F.sum("taken").alias("w")).collect()}
    mixed = mixing.mixed_documents(docs, taken)
    got = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != ""))).alias("w")).collect()}
    assert got == want
    assert mixed.where("text = ''").count() == 2
