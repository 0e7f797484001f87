"""Targets by plain water-filling, and what the mix takes."""

from collections import Counter

import pytest

from tarmac.llm import mixing as m


def water(sizes, weights=m.WEIGHTS, most=m.MAX_EPOCHS):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


DOCS = ([(i, "b", "word " * (i % 7)) for i in range(200)] + [(i, None, "x y\tz") for i in range(200, 230)] + [(i, "a", f"t{i} w") for i in range(230, 236)]
        + [(300, "z", None), (301, "é", ""), (302, "c", "long " * 3000), (303, "c", "long " * 3000), (303, "c", "long " * 3000), (None, "c", "q")])


def frame(spark, docs=DOCS):
    return spark.createDataFrame([(d, s, t, 1, 2) for d, s, t in docs], "doc_id bigint, source string, text string, size int, budget int")


def test_targets_and_taken(spark):
    rows = m.mix(frame(spark)).collect()
    sizes = Counter()
    for _, s, t in DOCS:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    assert len(rows) == len(DOCS)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in sizes)


def test_reruns_and_partitions_agree(spark):
    key = lambda df: sorted(map(str, m.mix(df).collect()))
    assert key(frame(spark)) == key(frame(spark).repartition(7)) == key(frame(spark, DOCS[::-1]))


def test_mixed_documents(spark):
    df = frame(spark, DOCS[:235]).withColumn("n_chars", m.F.length("text"))
    taken = m.mix(df).select("doc_id", "source", "size", "target", "taken", "text_key")
    out = m.mixed_documents(df, taken)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(words[r.doc_id] == r.taken for r in taken.collect())


def test_empty(spark):
    assert m.mix(frame(spark, [])).count() == 0
    assert [(r.taken, r.target) for r in m.mix(frame(spark, [(1, "a", None), (2, None, "")])).collect()] == [(0, 0.0)] * 2
