"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on toxic, one on ordinary text. A text is cut into
windows of one word (longer words in pieces); a window is compressed with
either dictionary, and the difference of the two lengths says which kind of
text it is closer to. The dictionaries are trained on what sets the two kinds
apart: words that one side says in several different contexts and the other
hardly ever. Both end in the same anchor, which follows every window: zstandard
neither stores a block raw then nor skips the match search at its end, so
lengths of short windows are comparable byte by byte.

A document's features are its largest differences and how many windows pass
calibrated thresholds; a logistic fit on labelled rows that the dictionaries
have not seen turns them into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stage, text_of, worker_cache

THRESHOLD = 0.3
#: The labelled rows that training reads at most, of each label: so many for the dictionaries, so many for the
#: calibration, none longer than TRAIN_CHARS. Scoring has no bound.
TRAIN_ROWS, TRAIN_CHARS = 4_000, 20_000
DICT_BYTES, SEGMENT, LEVEL = 8_192, 32, 3
#: A training word has so many bytes and contexts at least, and is said at this many times the other side's rate.
WORD_BYTES, CONTEXTS, RATIO = 4, 4, 100
WINDOW_BYTES = 64
#: Differences in bytes, and in shares of the ordinary length, at which windows are counted.
STEPS, SHARES = (3, 5), (0.3, 0.45, 0.55)
RIDGE = 0.3
ANCHOR = b"<<0123456789abcdefghijklmnopqrstuvwxyz>>"
CACHE = 150_000

_FOLD = bytes(range(256)).translate(bytes(32 if c in b".,;:!?" else c + 32 if 65 <= c <= 90 else c for c in range(256)))


def windows(text: str | None) -> list[bytes]:
    """The words of a text, in pieces of at most WINDOW_BYTES bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if max(map(len, words), default=0) <= WINDOW_BYTES:
        return words
    return [w[k:k + WINDOW_BYTES] for w in words for k in range(0, len(w), WINDOW_BYTES)]


def contexts(texts: list[str]) -> Counter:
    """For each word of a set of texts the number of different pairs of neighbours it has."""
    ids: dict[bytes, int] = {b"": 0}
    rows = [np.fromiter((ids.setdefault(w, len(ids)) for w in [b"", *windows(t), b""]), np.uint64) for t in texts]
    # The word in the high half, a hash of its neighbours in the low one: each different value is one context.
    with np.errstate(over="ignore"):
        found = [r[1:-1] << np.uint64(32) | (r[:-2] * np.uint64(0x9E3779B97F4A7C15) + r[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32) for r in rows]
    each = np.unique(np.concatenate([np.empty(0, np.uint64), *found])) >> np.uint64(32)
    counts = np.bincount(each.astype(np.int64), minlength=len(ids))
    return Counter({w: int(counts[i]) for w, i in ids.items() if len(w) >= WORD_BYTES})


def train_dictionary(own: Counter, other: Counter, size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary of the words that ``own`` says in several contexts and far more often than ``other``."""
    import zstandard

    rate = (other.total() + 1) / (own.total() + 1)
    apart = [w for w, c in own.items() if c >= CONTEXTS and c * rate >= RATIO * (other[w] + 0.5)]
    words = sorted(w for w in apart for _ in range(min(own[w], 1_000)))
    order = np.random.default_rng(1).permutation(len(words))
    samples = [b" " + b" ".join(words[i] for i in order[k:k + 8]) + b" " for k in range(0, len(words), 8)]
    whole = b"".join(b" " + w + b" " for w in sorted(set(words), key=lambda w: (own[w], w)))
    try:
        trained = zstandard.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text for the trainer
        trained = b""
    return trained + whole[-size:]  # the trainer may cut words; the most frequent stand last, whole


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibrated weights; small enough to go with every task."""

    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


class Differences(dict):
    """By window: how many bytes fewer the toxic dictionary takes than the
    ordinary one, and which share of the ordinary length that is."""

    def __init__(self, model: Model):
        self.toxic, self.ordinary = self._compressor(model.toxic), self._compressor(model.ordinary)
        self.empty = len(self.ordinary.compress(ANCHOR))

    @staticmethod
    def _compressor(content: bytes):
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        words = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=words)

    def __missing__(self, window: bytes) -> complex:
        """The difference as real, the share as imaginary part."""
        if len(self) > CACHE:
            self.clear()
        block = b" " + window + b" " + ANCHOR
        ordinary = len(self.ordinary.compress(block))
        less = ordinary - len(self.toxic.compress(block))
        d = self[window] = complex(less, less / max(1, ordinary - self.empty) if less >= 2 else 0)
        return d


def _top(x: np.ndarray) -> tuple[float, float]:
    three = np.partition(x, -3)[-3:] if len(x) > 3 else x
    return float(three.max()), float(three.clip(0).sum())


def features(text: str | None, differences: Differences) -> list[float]:
    w = windows(text)
    if not w:
        return [0.0] * (5 + len(STEPS) + len(SHARES))
    both = np.fromiter(map(differences.__getitem__, w), np.complex128, len(w))
    less, share = both.real, both.imag
    return [*_top(less), *_top(share), *(float(np.log1p((less >= s).sum())) for s in STEPS),
            *(float(np.log1p((share >= s).sum())) for s in SHARES), float(np.log1p(len(w)))]


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple:
    """(mean, scale, weights) of a ridge logistic fit."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a, w = np.c_[np.ones(len(x)), (x - mean) / scale], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(hessian, a.T @ (y - p) - RIDGE * w)
    return tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist())


def score(x: np.ndarray, model: Model) -> np.ndarray:
    a = np.c_[np.ones(len(x)), (x - np.array(model.mean)) / np.array(model.scale)]
    return 1 / (1 + np.exp(-np.clip(a @ np.array(model.weights), -30, 30)))


def held_out():
    """Whether a row is kept from training: crc32 of the doc_id as text leaves 2 on division by 4. Null ids are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Rows with a null id or label do not train; a doc_id with several labels
    counts as toxic if one says so, and trains with one of its texts. Ids are
    drawn by hash, so the sample does not depend on the order of rows: up to ``rows`` for the dictionaries
    (from three quarters of the rows) and as many for the calibration (from the
    rest), of each label.
    """
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = marked.withColumn("part", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 3).cast("int"))
    some = [drawn.where((F.col("part") == part) & (F.col("toxic") == toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for toxic in (0, 1) for part in (0, 1)]
    ids = stage(reduce(DataFrame.union, some), "training-ids")  # at most 4 * rows
    texts = docs.select("doc_id", text_of().alias("text")).where(F.length("text").between(1, chars))
    pdf = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "part", "toxic").agg(F.min("text").alias("text")).toPandas()

    def said(toxic: int, part: int) -> list[str]:
        return sorted(set(pdf[(pdf["toxic"] == toxic) & (pdf["part"] == part)]["text"]))

    bad, good = contexts(said(1, 0)), contexts(said(0, 0))
    model = Model(train_dictionary(bad, good), train_dictionary(good, bad))
    differences = Differences(model)
    seen = [(t, toxic) for toxic in (0, 1) for t in said(toxic, 1)]
    if len({toxic for _, toxic in seen}) < 2:  # one label only: nothing to tell apart
        share = float(np.clip(np.mean([toxic for _, toxic in seen]) if seen else 0.0, 0.01, 0.99))
        n = len(features("", differences))
        return Model(model.toxic, model.ordinary, (0.0,) * n, (1.0,) * n, (float(np.log(share / (1 - share))), *(0.0,) * n))
    fit = calibrate(np.array([features(t, differences) for t, _ in seen]), np.array([float(toxic) for _, toxic in seen]))
    return Model(model.toxic, model.ordinary, *fit)


def _scores(texts: list, model: Model) -> np.ndarray:
    known = worker_cache("toxicity", dict)
    if model not in known:
        known.clear()
        known[model] = Differences(model)
    return score(np.array([features(t, known[model]) for t in texts]).reshape(len(texts), -1), model)


def toxicity_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` has doc_id and toxic. Null text counts as empty; a text without
    words gets the score of no evidence. Equal texts get equal scores; repeated
    rows are each scored. With one label only, or none, every text gets the
    share of toxic rows. An empty table gives an empty result.
    """
    model = train(docs, labels, **how)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at:at + 500]
                yield some[["doc_id", "held_out"]].assign(score=_scores(list(some["text"]), model))

    slim = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = slim.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, held_out boolean, score double")
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def harmless_documents(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, **how) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in their columns. The model is fitted on ``train_on`` (``docs`` if none)."""
    model = train(docs if train_on is None else train_on, labels, **how)

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(list(texts), model) < THRESHOLD)

    return docs.where(F.pandas_udf(clean, "boolean")(F.col("text").cast("string")))
