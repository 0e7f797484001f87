"""The edit join against all pairs of lines, on fixtures."""

import random

import pytest

from tarmac.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs, tau=ld.TAU):
    every = [(d, u, no, x) for u, (d, t) in enumerate(docs) for no, x in enumerate(ld.lines(t))]
    texts = sorted({x for *_, x in every if x})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= ld.SHORT and abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
                root[find(a)] = find(b)
    seen, out = set(), {}
    for d, u, no, x in sorted(every, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        gone = out.setdefault(u, [])
        if x and find(x) in seen:
            gone.append(no)
        if x:
            seen.add(find(x))
    return sorted(((d, len(ld.lines(t)), len(out[u]), ",".join(map(str, out[u]))) for u, (d, t) in enumerate(docs)), key=str)


def got(spark, docs):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, line int").coalesce(1)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.dropped) for r in ld.line_report(df).collect()), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([5, 18, 20, 21, 25, 40, 60]))) for _ in range(25)]
    docs = []
    for i in range(n):
        out = []
        for _ in range(rnd.randrange(1, 6)):
            x = list(rnd.choice(pool))
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
                at = rnd.randrange(len(x))
                rnd.choice([lambda: x.insert(at, rnd.choice("abxyz")), lambda: x.pop(at), lambda: x.__setitem__(at, rnd.choice("ABxyz"))])()
            out.append("".join(x))
            if rnd.random() < 0.3:
                pool.append(out[-1])
        docs.append((i, "\n".join(out)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    docs = corpus(seed, 90)
    assert got(spark, docs) == plain(docs)


def test_edges(spark):
    same = "The same long line in several documents"
    docs = [(3, None), (4, ""), (5, same + "\n\n" + same.upper()), (None, same + "!"), (6, "x" * 200_000 + "\nshort\nShort "), (6, "x" * 200_000 + "\nshort\nShort "), (7, "\n\n")]
    assert got(spark, docs) == plain([(d, t) for d, t in docs if not t or len(t) < 1000] + [(6, "x" * 300 + "\nshort\nShort ")] * 2)
    assert got(spark, []) == []


def test_banded_distance():
    rnd = random.Random(7)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 9)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 9)))
        d = distance(a, b)
        assert all(ld.edit_distance(a, b, t) == (d if d <= t else None) for t in (0, 1, 2, 3))


def test_dedup_lines(spark):
    docs = [(1, "Alpha beta gamma delta epsilon\nkeep me please"), (2, "alpha beta gamma delta epsilom\nother line"), (2, "alpha beta gamma delta epsilom\nother line")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(r.text for r in ld.dedup_lines(df).collect()) == ["Alpha beta gamma delta epsilon\nkeep me please", "other line", "other line"]


def test_keys_and_sketches_of_many_lines_are_those_of_each():
    """Keys stand for (length, segment, substring); sketches for the bigrams' parities."""
    rnd = random.Random(5)
    said = ["".join(rnd.choice("abcdé 😀") for _ in range(rnd.randrange(1, 60))) for _ in range(150)] + ["a" * 40, "a" * 41, ""]
    tau, want = 2, []
    for k, x in enumerate(said):
        for size in range(max(ld.SHORT, len(x) - tau), len(x) + 1):
            more, at = len(x) - size, 0
            for i in range(tau + 1):
                part = size // (tau + 1) + (i >= tau + 1 - size % (tau + 1))
                for p in range(max(0, at - i, at + more - (tau - i)), min(len(x) - part, at + i, at + more + (tau - i)) + 1):
                    want.append((k, (size, i, x[p:p + part]), more == 0 and p == at))
                at += part
    codes = ld.Codes([x.encode("utf-32-le") for x in said])
    line, key, own = ld.keys(codes, tau)
    assert sorted((k, o) for k, _, o in want) == sorted(zip(line.tolist(), own.tolist()))
    names = {}  # one key for each (length, segment, substring), and the other way round
    for k in range(len(said)):
        mine = sorted(key[line == k].tolist())
        count = lambda values: sorted(values.count(v) for v in set(values))
        assert count(mine) == count([s for q, s, _ in want if q == k])
        names.setdefault(k, mine)
    assert len(set(key.tolist())) == len({s for _, s, _ in want})
    one = [ld.sketches(ld.Codes([x.encode("utf-32-le")]))[0].tolist() for x in said]
    assert ld.sketches(codes).tolist() == one


def test_lines_fold_only_ascii_letters():
    assert ld.lines("AbZ  É\tİΣß\ud800😀\n\x85Q ") == ["abz É İΣß\ud800😀", "q"]
    assert ld.lines("@[AZ`{") == ["@[az`{"] and ld.lines(None) == [""]


def test_lines_are_taken_faster_than_characters_are_looked_up():
    import time

    text = "Some words of É line\n" * 20_000
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def took(f):
        times = []
        for _ in range(3):
            start = time.process_time()
            f()
            times.append(time.process_time() - start)
        return min(times)

    assert took(lambda: ld.lines(text)) < took(lambda: text.translate(table))
