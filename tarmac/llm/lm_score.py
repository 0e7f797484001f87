"""Cross-entropy difference of two matched n-gram models.

A target and a background bigram model share one vocabulary, one smoothing
and one set of bigrams; only their counts differ. A document's score is the
mean over its tokens of target loss minus background loss (nats per token):
the lower, the more it reads like the target.

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w | u) = (c(u, w) + MU P(w)) / (c(u) + MU)

All counts are over all texts, and every word and bigram counts. The texts are
taken in batches. A batch names each of its words and bigrams once, by a 64-bit
hash, with how often it has it; what batches have of one range of hashes meets
in one place, is summed there, and each batch gets the sums of what it named.
So a word that every text has makes one entry a batch, and the losses come
from the batch's places of its words and bigrams, without the texts.

With shares, words of at least ``word_share`` of all tokens and bigrams of at
least ``pair_share`` of them (at most 1 / share each) go to every task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import arrow_rows, discard, join_small, shuffle_partitions, stage, worker_cache
from tarmac.llm.ngram_join import pack, unpack
from tarmac.llm.token_output import from_planes, to_planes

WORD_SHARE, PAIR_SHARE, MU = 1e-5, 1e-6, 20.0
#: Texts at once in a task, and counts that a task holds before it passes them on.
TEXTS, HELD = 2_000, 400_000
#: Tokens from which on a batch is closed, and texts; at least so many ranges of hashes; rows of batches at once in a task.
BATCH_TOKENS, BATCH_TEXTS, BUCKETS, BLOCK_ROWS = 1 << 20, 50_000, 511, 256
#: Target ids that may go to every task; more are joined by a shuffle.
TARGET_ROWS = 1_000_000

_LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = (Counter(), Counter())

    def flush() -> pd.DataFrame:
        every = list(held[0].keys() | held[1].keys())
        out = pd.DataFrame({"word": every, "background": [held[0][w] for w in every], "target": [held[1][w] for w in every]})
        held[0].clear()
        held[1].clear()
        return out

    for pdf in batches:
        for text, target in zip(pdf["text"], pdf["target"]):
            held[bool(target)].update(words(text))
        if len(held[0]) + len(held[1]) > HELD:
            yield flush()
    yield flush()


class _Ids(dict):
    """Word ids; unknown words have the last."""

    def __init__(self, known: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(known))
        self.unknown = len(known)

    def __missing__(self, word: bytes) -> int:
        return self.unknown

    def of(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.__getitem__, w), np.int64, len(w))


def pairs(ids: np.ndarray, unknown: int) -> np.ndarray:
    """A key for each pair of neighbours; -1 where one is unknown."""
    a, b = ids[:-1], ids[1:]
    return np.where((a == unknown) | (b == unknown), -1, a * np.int64(1 << 32) + b)


@dataclass
class Model:
    """Counts of the shared vocabulary and bigrams; index 0 background, 1 target."""

    known: list[bytes]
    unigrams: np.ndarray  # (2, V)
    totals: np.ndarray  # (2,)
    keys: np.ndarray  # ascending pair keys
    bigrams: np.ndarray  # (2, number of keys)


def losses(model: Model, ids: np.ndarray) -> np.ndarray:
    """The mean loss of the tokens under background and target; 0 for no tokens."""
    if not len(ids):
        return np.zeros(2)
    v = len(model.known)
    counts = np.c_[model.unigrams, (model.totals - model.unigrams.sum(1))[:, None]]  # the unknown word takes the rest
    p = (counts[:, ids] + 1) / (model.totals + v + 1)[:, None]
    key = pairs(ids, v)
    at = np.minimum(np.searchsorted(model.keys, key), max(0, len(model.keys) - 1))
    both = np.where(model.keys[at] == key, model.bigrams[:, at], 0) if len(model.keys) else np.zeros((2, len(key)))
    p[:, 1:] = (both + MU * p[:, 1:]) / (counts[:, ids[:-1]] + MU)
    return -np.log(p).mean(1)


def train(texts: DataFrame, word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE) -> Model:
    """Fit on ``texts`` (text, target): every text is in one of the two models."""
    spark = texts.sparkSession
    counts = texts.mapInPandas(_word_counts, "word binary, background bigint, target bigint").groupBy("word").agg(
        F.sum("background").alias("background"), F.sum("target").alias("target"))
    counts = stage(counts, "word-counts")
    b, t = counts.agg(F.sum("background"), F.sum("target")).first()
    totals = np.array([b or 0, t or 0], float)
    n = totals.sum()
    # At most 1 / word_share rows.
    vocabulary = counts.where(F.col("background") + F.col("target") >= max(1.0, word_share * n)).orderBy("word").toPandas()
    known = [bytes(w) for w in vocabulary["word"]]
    shared = spark.sparkContext.broadcast(known)

    def count_pairs(batches):
        ids_of = _Ids(shared.value)
        for pdf in batches:
            keys = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
            for text, target in zip(pdf["text"], pdf["target"]):
                keys[bool(target)].append(pairs(ids_of.of(text), ids_of.unknown))
            found = [np.unique(np.concatenate(k), return_counts=True) for k in keys]
            every = np.union1d(found[0][0], found[1][0])
            row = {"pair": every}
            for name, (k, c) in zip(("background", "target"), found):
                row[name] = np.zeros(len(every), np.int64)
                row[name][np.searchsorted(every, k)] = c
            yield pd.DataFrame(row)[every >= 0]

    seen = texts.mapInPandas(count_pairs, "pair bigint, background bigint, target bigint").groupBy("pair").agg(
        F.sum("background").alias("background"), F.sum("target").alias("target"))
    # At most 1 / pair_share rows.
    often = stage(seen.where(F.col("background") + F.col("target") >= max(1.0, pair_share * n)), "frequent-pairs").toPandas().sort_values("pair")
    columns = ["background", "target"]
    return Model(known, vocabulary[columns].to_numpy(float).T.copy(), totals, often["pair"].to_numpy(np.int64).copy(), often[columns].to_numpy(float).T.copy())


#: A batch: its rows are its texts, the places of their words among its different words, and those words' hashes (``HEAD``), and blocks of what it named of one range of hashes.
HEAD, WORDS, PAIRS, SEEN = range(4)
BLOCKS = "batch bigint, kind int, bucket int, keys binary, counts binary, doc_ids array<string>, sizes array<int>, targets bigint, places array<binary>"
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _keys(x: np.ndarray) -> bytes:
    """Ascending hashes, compressed."""
    import zstandard

    return zstandard.compress(pack(x), 1)


def _from_keys(data: bytes) -> np.ndarray:
    import zstandard

    return unpack(zstandard.decompress(data))


def _counts(x: np.ndarray) -> bytes:
    """Rows of 64-bit counts as compressed byte planes: most counts are small."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<i8").reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _from_counts(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8").reshape(2, -1)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"batch": "Int64", "targets": "Int64"})


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        both = (h[1:] ^ (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x85EBCA77))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return both ^ (both >> np.uint64(31))


def _named(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """The rows of each batch; the upper ``bits`` of a hash are its bucket."""
    hashes = worker_cache("lm-words", _Hashes)
    texts, held = [], 0  # of the open batch: (uid, doc_id, target, words' hashes), tokens

    def closed() -> pd.DataFrame:
        nonlocal texts, held
        batch, sizes = texts[0][0], np.array([len(t[3]) for t in texts], np.int32)
        h, aim = np.concatenate([t[3] for t in texts]), np.repeat([t[2] for t in texts], sizes)
        later = np.ones(len(h), bool)
        later[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        rows = []
        for kind, seen, target in ((WORDS, h, aim), (PAIRS, _pair_hashes(h)[later[1:]], aim[later])):
            keys, place, counts = np.unique(seen, return_inverse=True, return_counts=True)
            if kind == WORDS:  # the bigrams' places follow from the words'
                places = [*to_planes(place), _keys(keys)]
            of_target = np.bincount(place[target], minlength=len(keys))
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                rows.append((batch, kind, int(bucket[i]), _keys(keys[i:j]), _counts(np.stack([counts[i:j] - of_target[i:j], of_target[i:j]])), None, None, None, None))
        rows.append((batch, HEAD, zlib.crc32(b"%d" % batch) >> (32 - bits), None, None, [t[1] for t in texts], sizes, int(aim.sum()), places))
        texts, held = [], 0
        return _rows(rows)

    for pdf in batches:
        for uid, doc_id, text, target in zip(pdf["uid"], pdf["doc_id"], pdf["text"], pdf["target"]):
            said = words(text)
            texts.append((uid, doc_id, bool(target), np.fromiter(map(hashes.__getitem__, said), np.uint64, len(said))))
            held += len(said)
            if held >= BATCH_TOKENS or len(texts) >= BATCH_TEXTS:
                yield closed()
    if texts:
        yield closed()


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows in the order of buckets and kinds: blocks with the sums over all blocks of the bucket, what is in a batch's head, and
    one row with the number of different words of a bucket (``SEEN``)."""
    blocks, at = [], None

    def closed() -> pd.DataFrame:
        keys = [_from_keys(k) for _, k, _ in blocks]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_from_counts(c) for _, _, c in blocks], axis=1)
        sums = np.stack([np.bincount(place, weights=c, minlength=len(every)).astype(np.int64) for c in counts])
        ends = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(batch, at[1], at[0], None, _counts(sums[:, p]), None, None, None, None) for (batch, _, _), p in zip(blocks, np.split(place, ends))]
        if at[1] == WORDS:
            rows.append((None, SEEN, at[0], None, None, None, None, len(every), None))
        blocks.clear()
        return _rows(rows)

    for pdf in batches:
        heads = pdf[pdf["kind"] == HEAD]
        if len(heads):
            yield heads
        for row in pdf[pdf["kind"] != HEAD].itertuples(index=False):
            if at != (row.bucket, row.kind) and blocks:
                yield closed()
            at = row.bucket, row.kind
            blocks.append((row.batch, row.keys, row.counts))
    if blocks:
        yield closed()


def _batch_losses(batches: Iterator[pd.DataFrame], totals: np.ndarray, seen: int) -> Iterator[pd.DataFrame]:
    """(doc_id, n_tokens, background, aim) of each text, from a batch's head and its blocks in the order of kinds and buckets."""
    head, counts = None, {}

    def closed() -> pd.DataFrame:
        sizes = np.asarray(head.sizes, np.int64)
        n, planes = sizes.sum(), list(head.places)
        of = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(n, bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        said = from_planes(planes[:4], n)
        both = np.unique(_pair_hashes(_from_keys(planes[4])[said])[~first[1:]], return_inverse=True)[1]
        out = {"doc_id": list(head.doc_ids), "n_tokens": sizes}
        none = np.zeros((2, 0), np.int64)
        for k, name in enumerate(("background", "aim")):
            c = (np.concatenate([x[k] for x in counts.get(WORDS, [none])])[said]).astype(float)
            p = (c + 1) / (totals[k] + seen + 1)
            pair = np.concatenate([x[k] for x in counts.get(PAIRS, [none])])[both]
            p[~first] = (pair + MU * p[~first]) / (c[:-1][~first[1:]] + MU)
            out[name] = np.bincount(of, weights=-np.log(p), minlength=len(sizes))
        return pd.DataFrame(out)

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.kind == HEAD:
                if head is not None:
                    yield closed()
                head, counts = row, {}
            else:
                counts.setdefault(row.kind, []).append(_from_counts(row.counts))
    if head is not None:
        yield closed()


def named(rows: DataFrame) -> DataFrame:
    """``BLOCKS`` of ``rows`` (uid, doc_id, text, target)."""
    bits = max(BUCKETS, shuffle_partitions(rows.sparkSession) - 1).bit_length()
    return rows.mapInPandas(lambda b: _named(b, bits), BLOCKS)


def whole_scores(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, background, aim) of ``rows`` (uid, doc_id, text, target), by the counts of all words and bigrams in them."""
    spark = rows.sparkSession
    with arrow_rows(spark, BLOCK_ROWS):
        summed = stage(named(rows).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInPandas(_summed, BLOCKS), "sums")
        n = F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
        r = summed.agg(n.alias("n"), *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("targets"))), F.lit(0)).alias(name) for k, name in ((HEAD, "aim"), (SEEN, "seen")))).first()
        totals, seen = np.array([r["n"] - r["aim"], r["aim"]], float), r["seen"]
        each = summed.where(F.col("kind") != SEEN).repartition("batch").sortWithinPartitions("batch", "kind", "bucket")
        out = stage(each.mapInPandas(lambda b: _batch_losses(b, totals, seen), "doc_id string, n_tokens bigint, background double, aim double"), "losses")
    discard(summed)
    return out


def cross_entropy_difference(docs: DataFrame, target: DataFrame, word_share: float | None = None, pair_share: float | None = None) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, n_tokens, loss_target, loss_background, score.

    ``target`` has the doc_id of the documents that make the target model, all
    others make the background; null ids are background. Null and empty texts
    have no tokens, losses and score 0. Repeated rows count and are scored
    each. Without target documents the target model is uniform. An empty table
    gives an empty result.

    With shares, words of less than ``word_share`` of all tokens are one
    unknown word, and bigrams of less than ``pair_share`` have count 0.
    """
    spark = docs.sparkSession
    chosen = target.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("target_id")).distinct()
    chosen = stage(chosen.withColumn("target", F.lit(True)), "target-ids")
    every = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("string").alias("text"))
    texts = join_small(every, chosen, F.col("doc_id") == F.col("target_id"), "left", TARGET_ROWS)
    texts = texts.select("uid", "doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    whole = word_share is None and pair_share is None
    kind = docs.schema["doc_id"].dataType.simpleString()
    if whole:
        n = F.greatest("n_tokens", F.lit(1))
        sums = whole_scores(texts.withColumn("doc_id", F.col("doc_id").cast("string")))
        return sums.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", (F.col("aim") / n).alias("loss_target"),
                           (F.col("background") / n).alias("loss_background"), ((F.col("aim") - F.col("background")) / n).alias("score"))
    with arrow_rows(spark, TEXTS):
        model = train(texts.select("text", "target"), WORD_SHARE if word_share is None else word_share, PAIR_SHARE if pair_share is None else pair_share)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        ids_of = _Ids(m.known)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids = ids_of.of(text)
                background, aim = losses(m, ids).tolist()
                rows.append((len(ids), aim, background, aim - background))
            out = pd.DataFrame(rows, columns=["n_tokens", "loss_target", "loss_background", "score"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInPandas(run, "doc_id string, n_tokens bigint, loss_target double, loss_background double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
