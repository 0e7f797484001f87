"""Periodic runs against a plain search over all periods."""

import hashlib
import zlib

import numpy as np
import pytest

from tarmac.llm import periodic_runs as p
from tarmac.llm import queries as q


def plain_runs(words):
    n, best = len(words), {}
    for period in range(1, n // 4 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            if j > i and j - i + period >= max(6, 4 * period):
                best.setdefault((i, j - i + period), period)
            i = max(j, i) + 1
    return sorted((s, length, period) for (s, length), period in best.items())


def arrays(texts):
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return np.array([v for k, t in enumerate(texts) for v in (*t, -1 - k)], np.int64), bounds


def split(runs, bounds):
    at = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    return [sorted(map(tuple, (runs[at == k] - (bounds[k], 0, 0)).tolist())) for k in range(len(bounds) - 1)]


def some_text(rng, n):
    """Words with repeats of repeats, so that periods nest and differ from scale to scale."""
    text = []
    while len(text) < n:
        piece = rng.integers(0, rng.integers(1, 6) + 1, rng.integers(1, 60)).tolist()
        for _ in range(rng.integers(0, 3)):
            piece = (piece * int(rng.integers(1, 7)))[:int(rng.integers(1, 250))]
            if rng.random() < 0.3:
                piece[int(rng.integers(len(piece)))] = 99
        text += piece
    return text[:n]


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_of_random_texts(seed):
    rng = np.random.default_rng(seed)
    texts = [some_text(rng, int(n)) for n in rng.integers(0, 700, 14)]
    x, bounds = arrays(texts)
    assert split(p.find_runs(x, bounds), bounds) == [plain_runs(t) for t in texts]


def test_long_periods_and_powers():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 10**6, 997).tolist()
    word = [0, 1]
    for _ in range(9):  # Fibonacci word: many overlapping short runs
        word = word + word[:len(word) * 5 // 8]
    texts = [base * 4 + base[:100], [7] * 3000, ([1] * 30 + [2]) * 60, word, [], [5] * 5, [5] * 6, list(range(50))]
    x, bounds = arrays(texts)
    assert split(p.find_runs(x, bounds), bounds) == [plain_runs(t) for t in texts]


def test_one_word_many_times_is_quick():
    x, bounds = arrays([[3] * 300_000, [1, 2, 3] * 100_000])
    assert p.find_runs(x, bounds).tolist() == [[0, 300_000, 1], [300_001, 300_000, 3]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    if h % 10 == 0 and n:
        g = h // 10
        a, per = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % per] for i in range(n)]
    runs = plain_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    kept = [w for i, w in enumerate(words) if not any(s + per <= i < s + length for s, length, per in runs)]
    told = "".join(f"{s},{length},{per}\n" for s, length, per in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_on_whole_texts(spark):
    docs = q.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    want = sorted(expected(r.doc_id, r.text) for r in docs if len((r.text or "").split()) < 1500)
    got = {r.doc_id: tuple(r) for r in q.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    assert [got[w[0]] for w in want] == want and any(w[1] for w in want)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 9), (4, "a " * 9), (None, "b b b b b b"), (5, "A a " * 6), (6, "a\x0bb\x0cc\x1fd\x85 " * 5), (7, "é É " * 4)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_runs int, period string")
    key = lambda r: tuple(str(v) for v in r)
    got = sorted(map(tuple, p.periodic_runs(docs, p.planted).collect()), key=key)
    assert got == sorted((expected(i, t) for i, t in rows), key=key)
    assert p.periodic_runs(docs.limit(0)).collect() == []
