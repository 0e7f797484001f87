"""The Jaccard join against all pairs, on fixtures."""

import random

import pytest

from tarmac.llm import ngram_join as nj
from tarmac.llm.components import components


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().decode().translate(low).encode().split()
        out.append((doc_id, {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()))
    return out


def plain(rows, num=90, den=100):
    s = sets_of(rows)
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, e) in enumerate(s):
        ids = [s[j][0] for j in range(len(s)) if find(j) == find(i) and s[j][0] is not None]
        out.append((d, len(e), (min(ids) if ids else None) if e else d))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, sid string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.similar_sets(df, **kw).collect()), key=str)


def corpus(seed, n, hot=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rnd.choice(words) for _ in range(12))
    rows = []
    for _ in range(n):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                at = rnd.randrange(len(w))
                rnd.choice([lambda: w.insert(at, rnd.choice(words)), lambda: w.pop(at) if len(w) > 1 else None,
                            lambda: w.__setitem__(at, rnd.choice(words).upper())])()
        else:
            w = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 11, 12, 13, 20, 25, 31, 40, 90]))]
        rows.append((len(rows) + 1, " ".join(w) + ("\n" + passage if rnd.random() < hot else "")))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = corpus(seed, 220, hot=0.3)
    assert got(spark, rows) == plain(rows)


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(nj, "LONG_LIST", 3)
    rows = corpus(5, 200, hot=0.6)
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n\t "), (8, "one"), (3, "One"), (9, "one two"), (None, "one"), (None, None), (10, "a b c"), (10, "a b c"),
            (10, "z y x w"), (11, " ".join(f"q{i}" for i in range(30_000))), (12, " ".join(f"q{i}" for i in range(29_990)))]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_boundary_follows_cost():
    assert nj.boundary({12: 10_000, 200: 10_000}, 1.0, 90, 100) < nj.boundary({12: 10_000}, 500.0, 90, 100)
    assert nj.boundary({25: 10}, 2.0, 90, 100) <= 25


def test_packing_and_subsets():
    import numpy as np

    e = nj.shingles("a b c d e f g h i j k l")
    assert (nj.unpack(nj.pack(e)) == e).all() and len(e) == 10
    less = np.delete(e, 4)
    assert set(nj.light_keys(e, 90, 100).tolist()) & set(nj.light_keys(less, 90, 100).tolist())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_rounds_of_pivots_give_the_same_components(spark, monkeypatch):
    """A group whose members mostly link with others than the smallest; with rounds, few pairs are left to compare."""
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.choice([2, 2, 3])):
            w[rnd.randrange(90)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += corpus(3, 60)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    compared = []
    verify = nj.verified

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(nj, "verified", counting)
    monkeypatch.setattr(nj, "PAIRS_EACH", 10**9)
    plainly, by_pairs = got(spark, rows), compared[-1]
    compared.clear()
    monkeypatch.setattr(nj, "PAIRS_EACH", 0)
    assert got(spark, rows) == plainly == plain(rows)
    assert len(compared) > 2 and sum(compared[1:]) < max(by_pairs, 200)


def test_words_of_one_text_stay_out_of_lists_and_small_tables_are_one_file(spark, monkeypatch):
    rows, files, stage = {}, {}, nj.stage

    def noted(df, name, *how):
        table = stage(df, name, *how)
        rows[name], files[name] = table.count(), len(table.inputFiles())
        return table

    monkeypatch.setattr(nj, "stage", noted)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0] + " more", texts[0]])], "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in nj.similar_sets(docs).collect()}
    assert found == {i: 0 if i > 39 else i for i in range(42)}
    assert 0 < rows["entries"] <= 2 * 7 and max(files.values()) == 1
