"""Personal data spans against a plain scan of every text."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import Row

from tarmac.llm import pii
from tarmac.llm.pii import pii_report, sanitise

# The result's definition, searched as written.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
            "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def plain(text):
    out = []
    for place, (kind, pattern) in enumerate(KINDS.items()):
        out += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "") if holds(kind, m[0])]
    out = sorted(out)
    base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in out)
    counts = [sum(k == kind for _, _, k, _ in out) for kind in KINDS]
    return (*counts, hashlib.sha256(base.encode()).hexdigest()), base


def check(docs):
    rows = pii_report(docs).collect()
    given = docs.select("doc_id", "text").collect()
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows), key=str)
    assert got == sorted(((r.doc_id, *plain(r.text)[0]) for r in given), key=str)
    for r in rows:
        kept = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f, x@y", "a@b.c.@d.e.f me@x.y.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1.", "001.002.003.0004 9.9.9",
    "4111 1111 1111 1111", "4111-1111 11111111x", "4111  1111 1111 1111", "41111111111111111111111", "5 4111111111111111 7",
    "+1 (555) 123-4567 and +44.20.7946.0958x +12", "+1 555+1 5551234567 +", "né\U0001f600 é a.b@c.de ü 10.0.0.1 \U0001f600+49 30 1234567",
    "4111111111111111" * 30, "x" * 30_000 + "@y.z " + "1 " * 20_000, "a@b.c " * 2_000, "1.1.1.1@x.y +1.234.567.8901", "..@..", "@a.b",
]


def test_spans_match_the_plain_scan_on_edges(spark):
    rows = [(i if i % 5 else None, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string, kind int"))


def test_spans_match_the_plain_scan_on_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_empty_table(spark):
    assert pii_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.fixture(scope="module")
def linked(spark):
    rows = [Row(doc_id=i, text=f"Filler {'ab' + chr(97 + i)}word talk. Holder Zanthippe writes zan@x.org about {'cd' + chr(97 + i)}thing.") for i in range(5)]
    rows += [Row(doc_id=100 + i, text=f"Another writes about things, number {i}.") for i in range(60)]
    return spark.createDataFrame(rows)


def test_revealing_terms_are_spans(linked):
    got = {r.doc_id: r for r in pii_report(linked).collect()}
    assert all(f"term:{linked.where(f'doc_id = {i}').first().text.index('Zanthippe')}:" in got[i].spans for i in range(5))
    assert all(got[100 + i].spans == "" for i in range(60))
    assert got[0].n_email == 1 and got[0].n_term >= 1


WORD = re.compile(r"(?<!\S)[^\W\d_]{4,}(?=[,.;:!?]*(?:\s|$))")


def plain_terms(rows):
    """doc_id -> term spans, by counting documents for every identifier and word."""
    said = {i: {m[0].lower() for m in WORD.finditer(t or "")} for i, t in rows}
    named = {i: {f"{k}:{(t or '')[s:e].lower()}" for s, _, k, e in [(m.start(), 0, kind, m.end()) for kind, p in KINDS.items() for m in re.finditer(p, t or "") if holds(kind, m[0])]}
             for i, t in rows}
    text, n, found = dict(rows), len(rows), set()
    for e in set().union(*named.values()):
        docs = [i for i in named if e in named[i]]
        for term in set().union(*(said[i] for i in docs)):
            both = [i for i in docs if term in said[i]]
            if len({text[i] for i in both}) < 3 or len(docs) == n:
                continue
            with_term = sum(term in w for w in said.values())
            if math.log2(len(both) * n / (len(docs) * with_term)) / -math.log2(len(docs) / n) >= 0.8:
                found.add(term)
    return {i: [f"term:{m.start()}:{m.end()}" for m in WORD.finditer(t or "") if m[0].lower() in found] for i, t in rows}


def test_terms_match_counting(spark):
    """Words far from the identifier, mentions in documents without it, copies, and words that are said everywhere."""
    rnd = random.Random(2)
    common = [f"word{chr(97 + i)}" for i in range(20)]
    fill = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    rows = [(i, f"{fill(30)} Zanthippe, {fill(40)} mail zan@x.org {fill(20)} quietly {fill(3)}") for i in range(6)]
    rows += [(10 + i, f"{fill(5)} +1 555 123 4567 {fill(30)} Holdernesse {fill(2)}.") for i in range(4)]
    rows += [(20 + i, f"same mail bob@y.net text Copyword {fill(0)}") for i in range(5)]
    rows += [(30, f"{fill(9)} zanthippe! {fill(3)} ZANTHIPPE {fill(2)}"), (31, None), (32, "")] + [(40 + i, fill(25) + (" quietly" if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term:")] for r in pii_report(docs).collect()}
    assert got == plain_terms(rows)
    assert len(got[30]) == 2 and all(got[i] for i in (*range(6), *range(10, 14))) and not any(got[20 + i] for i in range(5))


def test_copies_do_not_make_terms_revealing(spark):
    rows = [(i, "Holder Zanthippe writes zan@x.org today.") for i in range(20)] + [(50 + i, "other text") for i in range(50)]
    assert all(r.n_term == 0 for r in pii_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_sanitised_text(linked):
    got = {r.doc_id: r.text for r in sanitise(linked).collect()}
    assert "zan@x.org" not in got[0] and "Zanthippe" not in got[0] and "[EMAIL]" in got[0] and "thing." in got[0]
    assert got[101] == "Another writes about things, number 1."


def test_small_tables_are_one_file(spark, monkeypatch):
    files, stage = {}, pii.stage

    def noted(df, name):
        table = stage(df, name)
        files[name] = len(table.inputFiles())
        return table

    monkeypatch.setattr(pii, "stage", noted)
    docs = spark.createDataFrame([(i, f"write to a@b.org about project zebra{i}") for i in range(20)], "doc_id bigint, text string").repartition(5)
    assert pii.pii_report(docs).count() == 20
    assert files["pii-hits"] == 1 and max(files.values()) == 1
