"""Exact round trip of the token files, against the tokenizer itself."""

import zlib

import numpy as np
import pandas as pd
import pytest

from tarmac.llm import token_output as t
from tarmac.llm.queries import tokenizer_file

TEXTS = ["", None, "plain words here, and here.", "  two  spaces\n\n lines ", " lead", "trail ", "x<|endoftext|> y", "\n", "a\tb  c　d \x1cx", "a\nb ", "don't we'll 12,5 %",
         "é\U0001f600 ñ. ß,\nZ", "word " * 4000, "tab \n end ", "a.b. c.,d ..", " \n"]


def plain(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    return [[*tok.encode(x or "", add_special_tokens=False).ids, t.END_ID] for x in texts]


def test_encoder_equals_the_library():
    enc = t.Encoder(tokenizer_file())
    for _ in range(2):  # the second time from the cache
        got = enc.encode([x or "" for x in TEXTS])
        assert [[*g.tolist(), t.END_ID] for g in got] == plain(TEXTS)
    assert enc.encode([]) == []


def test_words_as_lines_of_one_text(monkeypatch):
    monkeypatch.setattr(t, "LINE_WORDS", 2)
    ends = ["a", "'s", "don't", "9", "<|endoftext|>", "x<|endoftext|>", "e\u0301", "\u0301", "\u200b", "\ufeff", "\xa0", "\u3000x", "\x85", "\x1c", "\r", "x\r", "\tx",
            "a\tb", "\U0001f600", "...", "§", "\u2028", "\x00", "", "\ud7ff\u0e33", "²"]
    texts = [sep.join(ends[i:] + ends[:i]) for sep in (" ", "\n") for i in range(len(ends))] + ends
    enc = t.Encoder(tokenizer_file())
    assert [[*g.tolist(), t.END_ID] for g in enc.encode(texts)] == plain(texts)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(t, "CACHE_PIECES", 6)
    enc = t.Encoder(tokenizer_file())
    for x in TEXTS:
        assert [*enc.encode([x or ""])[0].tolist(), t.END_ID] == plain([x])[0]


def test_a_word_is_looked_up_once_for_many_batches(monkeypatch):
    asked = []
    words = t.Encoder._words
    monkeypatch.setattr(t.Encoder, "_words", lambda self, own, before: asked.extend(own.to_pylist()) or words(self, own, before))
    monkeypatch.setattr(t, "encoder", t.Encoder)
    monkeypatch.setattr(t.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 0})()))
    batches = [pd.DataFrame({"doc_id": [i, None], "text": ["one word and one", ""]}) for i in range(9)]
    blocks = list(t._blocks(iter(batches), tokenizer_file(), 1000, False))
    assert [len(b["doc_ids"][0]) for b in blocks] == [18] and asked.count("word") == 1
    monkeypatch.setattr(t, "BATCH_CHARS", 20)  # two texts reach it
    assert [ids for ids, _ in t._together(iter([b.iloc[:1] for b in batches[:5]]))] == [[0, 1], [2, 3], [4]]
    assert list(t._together(iter([]))) == []


@pytest.mark.parametrize("bits", [False, True])
def test_planes_and_crc(bits):
    rnd = np.random.default_rng(1)
    for n in (1, 7, 8, 1001):
        ids = rnd.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (t.from_planes(t.to_planes(ids, bits), n) == ids).all()
    a, b = b"abc" * 99, b"xyz1" * 77
    assert t.shift_crc(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("size,bits", [(64, False), (1000, True)])
def test_round_trip(spark, size, bits):
    docs = [(10 * i if i != 3 else None, x, i) for i, x in enumerate(TEXTS)] + [(20, TEXTS[2], 9), (20, "again", 9)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, start int").repartition(3)
    rows = sorted(t.token_output(df, tokenizer_file(), size, bits).collect(), key=lambda r: r.start)
    ids = dict(zip(map(id, docs), plain([d[1] for d in docs])))
    assert [r.doc_id for r in rows] == sorted((d[0] for d in docs), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in rows] == [sum(q.n_tokens for q in rows[:k]) for k in range(len(rows))]
    want = sorted((str(d[0]), len(ids[id(d)]), zlib.crc32(np.array(ids[id(d)], "<u4").tobytes())) for d in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want


def test_read_tokens_gives_the_ids(spark, tmp_path):
    df = spark.createDataFrame([(2, "second text here"), (1, "first " * 50)], "doc_id bigint, text string")
    t.write_tokens(df, f"file://{tmp_path}/t", tokenizer_file(), 16)
    pieces = t.read_tokens(spark.read.parquet(f"file://{tmp_path}/t")).orderBy("shard", "doc_seq", "piece_no").collect()
    for doc, want in ((1, plain(["first " * 50])[0]), (2, plain(["second text here"])[0])):
        assert [i for r in pieces if r.doc_id == doc for i in r.ids] == want


def test_empty_table(spark):
    assert t.token_output(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_file()).count() == 0
