"""Exact dedup against grouping by the whole text."""

from collections import defaultdict

from pyspark.sql import functions as F

from tarmac.llm import exact_dedup as e

LOW = str.maketrans(e.lower_ascii.__globals__["UPPER"], e.lower_ascii.__globals__["LOWER"])


def plain(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[(t or "").translate(LOW)].append(d)
    out = []
    for g in groups.values():
        keep = max(g, key=lambda d: (d is not None, d or 0))
        stays = [True] + [False] * (g.count(keep) - 1)
        out += [(d, keep, len(g), stays.pop(0) if d == keep else False) for d in g]
    return sorted(out, key=str)


def got(df, **how):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in e.exact_dedup(df, **how).collect()), key=str)


LONG = "Some sentence of the text. " * 300
DOCS = [(1, "a"), (2, "A"), (2, "A"), (None, "a"), (3, None), (4, ""), (5, LONG), (6, LONG.upper()), (7, LONG + "x"), (8, "É"), (9, "é"), (None, None),
        (10, "no break " * 9000), (11, "no break " * 9000), (12, "x\n" * 5000), (13, "\U0001f600" * 700), (14, "\U0001f600" * 700)]


def test_groups(spark):
    df = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id bigint, text string, kept int")
    assert got(df) == plain(DOCS)


def test_colliding_hashes_are_told_apart(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    assert got(df, hash_of=lambda c: F.xxhash64(c) % 3) == plain(DOCS)


def test_chunks_join_to_the_text(spark):
    df = spark.createDataFrame([(t,) for _, t in DOCS if t], "t string")
    for r in df.select("t", e.chunks(F.col("t")).alias("c")).collect():
        assert "".join(r.c) == r.t and all(len(c) <= e.MAX_CHUNK for c in r.c)


def test_empty(spark):
    assert e.exact_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
