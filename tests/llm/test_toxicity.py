"""Held-out accuracy, and the rules of the result."""

import zlib

import pytest

from tarmac.llm import toxicity as t

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    rows = {r.doc_id: r for r in t.toxicity_scores(docs, labels).collect()}
    return rows, {r.doc_id: r.toxic for r in labels.collect()}, docs.count()


def test_held_out_accuracy(scored):
    rows, labels, n = scored
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    pairs = [(rows[i].predicted, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    hit = sum(p and y for p, y in pairs)
    assert hit / sum(y for _, y in pairs) >= 0.75 and hit / max(1, sum(p for p, _ in pairs)) >= 0.7


def test_held_out_rows_follow_the_crc(scored):
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scored[0].items())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "words", 0), (2, "", 0), (3, "x" * 100_000, 1), (4, "word " * 50_000, 1)], "doc_id bigint, text string, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    rows = t.toxicity_scores(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert t.toxicity_scores(docs.where("false"), labels.where("false")).count() == 0
    assert len(t.toxicity_scores(docs, labels.where("false")).collect()) == 6


def test_held_out_labels_do_not_train(spark):
    docs = spark.createDataFrame([(i, f"text number {i} says {'vile' if i % 3 else 'kind'} things") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id bigint, toxic int")
    turned = spark.createDataFrame([(i, int(i % 3 > 0) if zlib.crc32(str(i).encode()) % 4 != 2 else 0) for i in range(200)], "doc_id bigint, toxic int")
    assert t.train(docs, labels) == t.train(docs, turned)


def test_harmless_documents_keep_their_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = t.harmless_documents(docs, labels)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in t.toxicity_scores(docs, labels).where("predicted = 1").collect()}
    assert bad and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad
