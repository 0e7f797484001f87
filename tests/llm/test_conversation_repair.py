"""Conversation repair against a plain search over all edit sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tarmac.llm import conversation_repair as c
from tarmac.llm import queries as q

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Cheapest (cost, audit) over every sequence of edits, by the grammar's states; and the repaired lines."""
    @lru_cache(maxsize=None)
    def best(i, state, room):
        found = [] if i < len(rows) or state in ("s", "u") else [(0, "")]
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if room:  # never more than a few inserts between two turns
            found.append(step(2, "I", best(i, after, room - 1)))
        if i < len(rows):
            found.append(step(3, "D", best(i + 1, state, 3)))
            if faults[i] not in ("blank", "duplicate"):
                extra, first = int(faults[i] == "truncated"), rows[i][0][:1]
                found.append(step(2 + extra, "R", best(i + 1, after, 3)))
                if first == after or (first == "s" and state == ""):
                    found.append(step(extra, "K", best(i + 1, first, 3)))
        return min((f for f in found if f), default=None)

    def step(cost, edit, rest):
        return rest and (cost + rest[0], edit + rest[1])

    for i in range(len(rows), 0, -1):  # from the end, so that the recursion stays shallow
        for state in "sua":
            best(i, state, 3)
        best(i, "", 3)
    cost, audit = best(0, "", 3)
    lines, i, state, names = [], 0, "", {"u": "user", "a": "assistant"}
    for edit in audit:
        after = "a" if state == "u" else "u"
        if edit == "K":
            state = rows[i][0][0]
            lines.append(f"{rows[i][0]}:{rows[i][1]}")
        elif edit != "D":
            state = after
            lines.append(f"{names[after]}:{rows[i][1] if edit == 'R' else ''}")
        i += edit != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return cost, audit, lines


def report(conv, rows):
    """Expected row; ``rows`` are (turn, role, text) in order."""
    turns = [t for t, *_ in rows if t is not None]
    faults = plain_faults([r[1:] for r in rows])
    cost, audit, lines = plain_repair([r[1:] for r in rows], faults)
    roles = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if h == 4 else said(role), "" if h == 1 else re.sub("[.!?]", "", said(text)) if h == 2 else said(text)
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def expected(rows, ids):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return [report(conv, sorted(of[conv], key=key)) for conv in ids]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_on_whole_conversations(spark):
    rows = [tuple(r) for r in q.read(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = q.op12_conversation_repair(spark, SF)
    assert got.columns == c.REPORT
    assert order(got.collect()) == order(expected(plain_damage(rows), {r[0] for r in rows}))


@pytest.mark.parametrize("seed", range(4))
def test_tables_of_random_codes(seed):
    rng = random.Random(seed)
    for _ in range(60):
        codes = "".join(rng.choice("suax" if rng.random() < 0.2 else "uaua01SUAX23") for _ in range(rng.randrange(1, 9)))
        roles = [x.translate(c._ROLES) for x in codes]
        faults = ["blank" if x in "SUAX" else "truncated" if x in "0123" else None for x in codes]
        want = plain_repair([(r, "t") for r in roles], faults)
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randrange(3))))
        parts = [codes[i:j] for i, j in zip([0, *cuts], [*cuts, len(codes)])]
        for tables in ([c.table(codes)], [c.joined([c.table(p) for p in parts])], [c.table(p) for p in parts]):
            found = c.chain(tables)
            assert "".join(a for _, a in found) == want[1]
        tail = len(found[-1][1]) - len(found[-1][1].rstrip("I"))
        assert sum(c.written(x, audit, part)[1] for (x, audit), part in zip(found, parts)) == want[0] and tail < 3


def test_one_conversation_with_most_turns(spark):
    """A conversation over several segments and partitions, and small ones around it."""
    rng, rows = random.Random(7), []
    for turn in range(2600):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[turn % 2]
        rows.append((5, turn, role, rng.choice(["", "Same.", f"t{turn}", f"t{turn}.", f"t{turn}?"])))
    rows += [(k, t, r, f"{k} {t}!") for k in (1, 2, 9) for t, r in enumerate(["system", "user", "assistant"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = c.repair_report(turns).collect()
    assert order(got) == order(expected(rows, {r[0] for r in rows}))


def test_edge_rows(spark):
    rows = [(1, None, "user", "a."), (1, 0, None, "b."), (1, 2**40, "assistant", None), (2, None, "user", "x"), (2, None, "user", "x"),
            (None, 1, "user", "q?"), (None, 2, "assistant", "w " * 50_000), (3, 0, "tool", "t."), (3, 1, "system", "s."), (4, 0, "", "r."),
            (4, 1, "user", "u.\n \x0b"), (4, 1, "user", "other."), (5, 0, "system", "only."), (6, 0, "assistant", " "), (6, 0, "assistant", " ")]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, uid int, edit string")
    of = spark.createDataFrame([(7,), (1,), (None,)], "conv_id long")
    nothing = (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    plain = [(a, t, " " if r is None else r or "?", " " if x is None else x) for a, t, r, x in rows]
    assert order(c.repair_report(turns, of).collect()) == order([*expected(plain, {r[0] for r in rows}), nothing])
    assert c.repair_report(turns.limit(0)).collect() == [] and c.repaired_turns(turns.limit(0)).collect() == []
    damaged = [r for r in c.damaged(turns).collect()]
    assert sorted(map(str, map(tuple, damaged))) == sorted(map(str, plain_damage(rows)))


def test_repaired_turns_follow_the_grammar(spark):
    turns = c.damaged(q.read(spark, SF, "conversations"))
    said = defaultdict(list)
    for r in sorted(c.repaired_turns(turns).collect(), key=lambda r: r.place):
        assert (r.edit == "insert") == (r.turn is None)
        said[r.conv_id].append(f"{r.role}:{r.text}")
    assert said and all(re.fullmatch("s?(ua)+", "".join(x[0] for x in lines)) for lines in said.values())
    shas = {r.conv_id: r.repaired_sha256 for r in c.repair_report(turns).collect() if r.audit.strip("D")}
    assert shas == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in said.items()}
