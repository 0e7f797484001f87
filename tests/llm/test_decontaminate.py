"""Spaced-seed overlaps against a scan of every alignment."""

import random

from tarmac.llm import decontaminate as d

WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return (text or "").lower().split()


def plain(docs, items, least=d.MIN_OVERLAP, equal=d.MIN_EQUAL):
    """doc_id -> whether any alignment has a good stretch."""
    out = {}
    for doc_id, text in docs:
        w, bad = words(text), False
        for _, item in items:
            v = words(item)
            need = min(least, len(v))
            for shift in range(-len(v) + 1, len(w)) if v else ():
                lo, hi = max(0, shift), min(len(w), shift + len(v))
                same = [w[p] == v[p - shift] for p in range(lo, hi)]
                bad = bad or any(same[i] and same[j - 1] and sum(same[i:j]) >= equal * (j - i) - 1e-9
                                 for i in range(len(same)) for j in range(i + need, len(same) + 1))
        out[doc_id] = bad
    return out


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id bigint, text string, item_id int"),
            spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string"))


def corpus():
    rnd = random.Random(3)
    say = lambda n: [rnd.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(say(rnd.choice([14, 20, 30, 40])))) for i in range(12)]
    docs = []
    for i in range(70):
        w = say(rnd.choice([5, 30, 80]))
        if i % 2:
            v = words(rnd.choice(items)[1])
            part = v[:rnd.choice([8, 13, 14, len(v)])]
            for at in rnd.sample(range(1, len(part) - 1), rnd.choice([0, 1, 2])):
                part[at] = "other"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, " ".join(w).title() if i % 3 else "\n".join(w)))
    return docs, items


def test_matches_every_alignment(spark):
    docs, items = corpus()
    got = {r.doc_id: r.contaminated for r in d.contamination(*frames(spark, docs, items)).collect()}
    assert got == plain(docs, items) and 10 < sum(got.values()) < 50


def fewest_that_block(masks, longest):
    """For each length, the fewest substitutions of an aligned stretch that keep every mask from hitting it.

    The state is what the last places were; a step appends an equal or a substituted one."""
    span = max(map(len, masks))
    states = {(0,) * (span - 1): 0}  # before the stretch nothing is equal
    out = []
    for _ in range(longest):
        ahead = {}
        for last, cost in states.items():
            for equal in (0, 1):
                window = (*last, equal)
                if equal and any(m[-1] == "1" and all(window[span - len(m) + i] for i, c in enumerate(m) if c == "1") for m in masks):
                    continue
                c = cost + 1 - equal
                if c < ahead.get(window[1:], 99):
                    ahead[window[1:]] = c
        states = ahead
        out.append(min(states.values()))
    return out


def test_masks_reach_what_they_state():
    """No pattern of substitutions that the share of equal places allows hides from all masks, at any length."""
    allowed = lambda n: int(n * (1 - d.MIN_EQUAL) + 1e-9)
    for masks, lengths in ((d.MASKS, range(d.LONG_ITEM, 120)), (d.SHORT_MASKS, range(d.SHORT_ITEM, d.LONG_ITEM))):
        blocked = fewest_that_block(masks, lengths[-1])
        assert [n for n in lengths if blocked[n - 1] <= allowed(n)] == []


def test_search_finds_every_overlap_that_a_scan_finds():
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([1, 2, 4, 5, 6, 9, 10, 11, 12, 13, 15, 16, 20, 31])))) for i in range(60)]
    docs = []
    for i in range(400):
        w = [rnd.choice(WORDS) for _ in range(rnd.randrange(0, 25))]
        part = words(items[rnd.randrange(60)][1])
        inner = range(1, len(part) - 1)
        for at in rnd.sample(inner, min(len(inner), rnd.randrange(0, len(part) // 4 + 1))):
            part[at] = "other"
        at = rnd.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + part + w[at:])))
    block = d.Block(items, d.MASKS, d.MIN_OVERLAP, d.MIN_EQUAL)
    got = {i: bool(f) for (i, _), f in zip(docs, block.search([d.tokens(t) for _, t in docs]))}
    assert got == plain(docs, items) and sum(got.values()) > 200


def test_blocks_give_the_same(spark):
    docs, items = corpus()
    a, b = frames(spark, docs, items)
    key = lambda r: str(r)
    assert sorted(d.contamination(a, b).collect(), key=key) == sorted(d.contamination(a, b, block_tokens=60).collect(), key=key)


def test_edges(spark):
    item = " ".join(WORDS[:20])
    items = [(1, item), (2, None), (3, ""), (4, "tiny item"), (0, item), (None, " ".join(WORDS[50:70]))]
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, "x " + item), (5, "a tiny ITEM here"), (6, " ".join(WORDS[100:120]) * 1000), (7, " ".join(WORDS[50:70])), (8, "tiny")]
    a, b = frames(spark, docs, items)
    got = [(r.doc_id, r.contaminated, r.n_items, r.item_id, r.start, r.end) for r in d.contamination(a, b).collect()]
    assert sorted(got, key=str) == sorted([(1, False, 0, None, None, None), (2, False, 0, None, None, None), (3, True, 1, 0, 0, 20), (3, True, 1, 0, 0, 20),
                                           (None, True, 1, 0, 1, 21), (5, True, 1, 4, 1, 3), (6, False, 0, None, None, None), (7, True, 1, None, 0, 20),
                                           (8, False, 0, None, None, None)], key=str)
    assert sorted(r.doc_id for r in d.clean_documents(a, b).collect()) == [1, 2, 6, 8]
    assert d.contamination(a, b.where("false")).where("contaminated").count() == 0
    assert d.contamination(a.where("false"), b).count() == 0
