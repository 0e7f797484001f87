"""Losses against a plain computation, token by token."""

import math
import random
from collections import Counter

import pytest

from tarmac.llm import lm_score as lm

DATA = "/root/testdata/sf0.001"


def plain(docs, target, word_share, pair_share):
    split = lambda t: [w for w in (t or "").encode().lower().split()]  # noqa: E731  (ASCII texts only)
    uni, bi = (Counter(), Counter()), (Counter(), Counter())
    for i, text in docs:
        uni[i in target].update(split(text))
    n = [sum(u.values()) for u in uni]
    known = {w for w in uni[0] | uni[1] if uni[0][w] + uni[1][w] >= max(1, word_share * sum(n))}
    for i, text in docs:
        w = split(text)
        bi[i in target].update((a, b) for a, b in zip(w, w[1:]) if a in known and b in known)
    often = {p for p in bi[0] | bi[1] if bi[0][p] + bi[1][p] >= max(1, pair_share * sum(n))}
    out = []
    for i, text in docs:
        w, loss = split(text), [0.0, 0.0]
        for m in (0, 1):
            count = lambda x: uni[m][x] if x in known else n[m] - sum(uni[m][y] for y in known)  # noqa: B023, E731
            for k, x in enumerate(w):
                p = (count(x) + 1) / (n[m] + len(known) + 1)
                if k:
                    pair = (w[k - 1], x)
                    p = ((bi[m][pair] if pair in often else 0) + lm.MU * p) / (count(w[k - 1]) + lm.MU)
                loss[m] -= math.log(p)
        out.append((i, len(w), *(x / len(w) if w else 0.0 for x in (loss[1], loss[0]))))
    return sorted(out, key=str)


TEXTS = [(1, "The cat sat on the mat"), (2, "the dog sat on the log " * 5), (3, None), (4, ""), (None, "a cat and a dog"), (5, "zebra"), (5, "zebra"), (6, "cat " * 3000)]


@pytest.mark.parametrize("shares", [(1e-5, 1e-6), (0.005, 0.002)])
def test_losses_match(spark, shares):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in TEXTS], "doc_id bigint, text string, target double")
    target = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 1)], "doc_id bigint, quality int")
    rows = lm.cross_entropy_difference(docs, target, *shares).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.loss_target, r.loss_background) for r in rows), key=str)
    for a, b in zip(got, plain(TEXTS, {1, 2}, *shares), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)
    assert all(r.score == pytest.approx(r.loss_target - r.loss_background) for r in rows)


@pytest.mark.parametrize("frequent", [(1e-5, 1e-6), (0.001, 0.0005), (0.5, 0.5)])
def test_rare_words_and_bigrams_count(spark, monkeypatch, frequent):
    """However many words and bigrams count as frequent, the losses are those of all."""
    monkeypatch.setattr(lm, "WORD_SHARE", frequent[0])
    monkeypatch.setattr(lm, "PAIR_SHARE", frequent[1])
    rnd = random.Random(5)
    filler = [(100 + i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 9000}" for _ in range(rnd.choice([1, 2, 300])))) for i in range(400)]
    rows = TEXTS + filler + [(7, "cat " * 200_000)] + filler[:3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    chosen = {1, 2, *range(100, 200)}
    got = lm.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in chosen], "doc_id bigint")).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.loss_target, r.loss_background) for r in got), key=str)
    for a, b in zip(got, plain(rows, chosen, 0, 0), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.cross_entropy_difference(docs, docs).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert lm.cross_entropy_difference(some, docs).count() == 2


def test_target_text_scores_lower(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    target = docs.where("lang = 'de'").select("doc_id")
    scores = {r.doc_id: r.score for r in lm.cross_entropy_difference(docs, target).collect()}
    langs = {r.doc_id: r.lang for r in docs.where("n_chars > 200").collect()}
    de = sorted(scores[i] for i, x in langs.items() if x == "de")
    rest = sorted(scores[i] for i, x in langs.items() if x != "de")
    assert de[int(len(de) * 0.9)] < rest[int(len(rest) * 0.1)]


def test_batches_meet_by_range_of_hashes(spark, monkeypatch):
    """What tasks exchange does not grow with how often a batch says a word; the losses are those of all texts, however they are batched."""
    monkeypatch.setattr(lm, "BATCH_TOKENS", 70)
    monkeypatch.setattr(lm, "BUCKETS", 3)
    rnd = random.Random(6)
    rows = TEXTS + [(100 + i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 500}" for _ in range(rnd.choice([0, 1, 2, 90])))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = lm.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in range(100, 200)], "doc_id bigint")).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.loss_target, r.loss_background) for r in got), key=str)
    for a, b in zip(got, plain(rows, set(range(100, 200)), 0, 0), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)
    loud = spark.createDataFrame([(1, "1", "cat dog " * 100_000, False)], "uid bigint, doc_id string, text string, target boolean")
    assert lm.named(loud).count() <= 1 + 2 + 2  # a head, and two words and two bigrams in a block each at most
