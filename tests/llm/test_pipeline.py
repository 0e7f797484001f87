"""Each stage on its own input against a plain version, and the whole run."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from tarmac.llm import queries as q
from tarmac.llm.common import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = q.read(spark, SF, "documents"), []
    for name, apply in cp.STAGES:
        done = stage(apply(spark, docs, SF), f"test-{name}")
        out.append((name, docs, done))
        docs = done
    return out


def test_columns_and_order(stages, spark):
    assert [n for n, *_ in stages] == ["toxicity", "near_duplicates", "decontamination", "source_mix", "token_output"]
    assert all(done.columns == docs.columns for _, docs, done in stages[:-1])


def test_toxicity_keeps_what_is_not_predicted(stages, spark):
    _, docs, done = stages[0]
    bad = {r.doc_id for r in q.op8_toxicity(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in done.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_one_of_each_group_stays(stages):
    _, docs, done = stages[1]
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    sets = {d: {tuple(w[i:i + cp.WORDS]) for i in range(max(1, len(w) - cp.WORDS + 1))} if w else set() for d, w in rows}
    least = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and cp.DEN * len(sets[a] & sets[b]) >= cp.NUM * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert links and sorted(r.doc_id for r in done.collect()) == sorted(d for d in ids if least[d] == d)


def test_no_benchmark_text_stays_and_clean_ones_do(stages, spark):
    _, docs, done = stages[2]
    grams = lambda t: {tuple(w[i:i + 13]) for w in [(t or "").lower().split()] for i in range(len(w) - 12)}
    known = set().union(*(grams(r.text) for r in q.read(spark, SF, "benchmark").collect()))
    kept = {r.doc_id for r in done.collect()}
    assert all((r.doc_id in kept) == (not grams(r.text) & known) for r in docs.collect())


def test_mix_meets_its_budgets(stages):
    _, docs, done = stages[3]
    from test_mixing import water

    words = lambda df: Counter({r.source: r.n for r in df.selectExpr("source", "size(filter(split(text, '[ \\t\\n]+'), x -> x != '')) AS n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()})
    had, has = words(docs), words(done)
    assert all(abs(has[s] - t) <= 0.5 + 1e-9 for s, t in water(had).items())


def test_tokens_are_those_of_the_mix(stages):
    from tokenizers import Tokenizer

    _, docs, done = stages[4]
    tok = Tokenizer.from_file(q.tokenizer_file())
    ids = [[*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.select("text").collect()]
    assert sorted((r.n_tokens, r.ids_crc32) for r in done.collect()) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)


def test_run(spark, stages):
    assert cp.ORACLE_SQL is None and sorted(map(str, cp.run(spark, SF).drop("shard").collect())) == sorted(map(str, stages[-1][2].drop("shard").collect()))


def test_null_and_repeated_ids_are_no_copies(spark):
    say = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, say("a")), (None, say("b")), (None, say("c")), (None, say("c") + " more"),  # the last two: one group
            (7, say("d")), (7, say("e")), (7, say("e")),  # two texts of one id, one of them repeated
            (3, say("f")), (None, say("f")), (None, say("f") + " more"), (9, say("f") + " more"),  # copies of document 3
            (5, say("g")), (4, say("g") + " more"), (5, say("h")),  # 5 has a copy of 4, and another text
            (None, ""), (None, None), (6, ""), (6, ""), (8, " ")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row int")
    done = cp.near_duplicates(spark, docs, SF)
    assert done.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in done.collect()), key=str)
    c = min((t for _, t in rows[2:4]), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = [*rows[:2], (None, c), *rows[4:6], rows[7], *rows[12:14], (None, ""), (None, None), (6, ""), (8, " ")]
    assert got == sorted(want, key=str)
