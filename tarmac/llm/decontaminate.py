"""Benchmark decontamination by spaced seeds.

A mask such as 1101100110101 selects token positions; the hash of the
selected tokens of a window ignores the others, so a substitution at an
ignored place does not hide an overlap. Every window of every benchmark text
and of every document is hashed under a few fixed masks. A shared hash is a
hit: it aligns document and item, and the overlap is verified around it on
the tokens themselves, counting substitutions.

The benchmark is the stated query set: its windows go to the tasks in blocks
of at most ``BLOCK_TOKENS`` tokens (16 bytes for each window and mask); a
larger benchmark takes more passes over the documents, each on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import arrow_rows, join_small, packed, stage, text_of, unpacked, worker_cache

#: Masks for items of at least 11 words, and for items of 5 to 10. Together they hit every aligned stretch of 11 places or more (of 5 or more, for short
#: items) of which 80 % are equal, wherever the others are (a test proves it for every length: the fewest substitutions that keep all masks from hitting
#: are more than 80 % allows). Items of fewer words must be there as they are, and are hashed whole.
MASKS = ("1101001011", "111111", "11010111", "1101000111")
SHORT_MASKS = ("10111", "11101", "11011", "1111")
LONG_ITEM, SHORT_ITEM = 11, 5
#: An overlap has at least this many aligned places (or the whole item, if it is shorter), this share of them equal.
MIN_OVERLAP, MIN_EQUAL = 13, 0.8
BLOCK_TOKENS = 2_000_000
ARROW_ROWS = 1_000

_LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
RESULT = "uid bigint, item_id bigint, start int, end int, equal int"


class _Ids(dict):
    """64-bit hashes of tokens."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h



def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words (A-Z only)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.fromiter(map(worker_cache("tokens", _Ids).__getitem__, words), np.uint64, len(words))


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(t: np.ndarray, mask: str) -> np.ndarray:
    """The hash under ``mask`` of the window at each place."""
    n = len(t) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for i in _offsets(mask):
            h = (h ^ t[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, least: int, equal: float) -> tuple[int, int, int] | None:
    """(start, end, equal places) in the document of the longest aligned
    stretch at ``shift`` (document place minus item place) that begins and
    ends with equal tokens, has ``least`` places and the share ``equal`` of
    them equal; None if there is none."""
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    if hi - lo < least:
        return None
    same = doc[lo:hi] == item[lo - shift:hi - shift]
    # Sums of (same - equal): a stretch [i, j) is good when its sum is not negative.
    total = np.concatenate([[0.0], np.cumsum(same - equal)])
    first = np.minimum.accumulate(total)  # the lowest prefix up to each place
    best = None
    for j in np.flatnonzero(same) + 1:
        i = int(np.searchsorted(-first[:j], -(total[j] + 1e-9)))
        if i < j and j - i >= least and (best is None or j - i > best[1] - best[0]):
            while i < j and not same[i]:
                i += 1
            if j - i >= least:
                best = (i, int(j), int(same[i:j].sum()))
    return best and (lo + best[0], lo + best[1], best[2])


class Index:
    """The windows of some items under one mask, as sorted arrays."""

    def __init__(self, mask: str, items: list[tuple[int, np.ndarray]]):
        self.mask = mask
        each = [(k, seeds(t, mask)) for k, t in items]
        h = np.concatenate([np.empty(0, np.uint64), *(x for _, x in each)])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.items = np.concatenate([np.empty(0, np.int32), *(np.full(len(x), k, np.int32) for k, x in each)])[order]
        self.places = np.concatenate([np.empty(0, np.int32), *(np.arange(len(x), dtype=np.int32) for _, x in each)])[order]
        # Most windows of documents are ruled out by one bit of their hash.
        self.drop = np.uint64(64 - max(16, int(4 * len(h)).bit_length()))
        self.seen = np.zeros(1 << int(64 - self.drop), bool)
        self.seen[self.hashes >> self.drop] = True

    def hits(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in t, item, place in the item) of all shared windows."""
        h = seeds(t, self.mask)
        at = np.flatnonzero(self.seen[h >> self.drop])
        low = np.searchsorted(self.hashes, h[at], side="left")
        many = np.searchsorted(self.hashes, h[at], side="right") - low
        every = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(at, many), self.items[every], self.places[every]


class Block:
    """Some benchmark items, ready to be searched."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...], least: int, equal: float):
        self.least, self.equal = least, equal
        self.items = [(i, t) for i, t in ((i, tokens(x)) for i, x in items) if len(t)]
        of = lambda few, many: [(k, t) for k, (_, t) in enumerate(self.items) if few <= len(t) < many]
        kinds = [(m, of(LONG_ITEM, 1 << 60)) for m in masks] + [(m, of(SHORT_ITEM, LONG_ITEM)) for m in SHORT_MASKS]
        kinds += [("1" * n, of(n, n + 1)) for n in range(1, SHORT_ITEM)]
        self.indexes = [Index(mask, mine) for mask, mine in kinds if mine]

    def search(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """(item_id, start, end, equal places) of each document's best overlap with each item."""
        found: list[dict[int, tuple]] = [{} for _ in docs]
        sizes = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(sizes)
        whole = np.concatenate([np.empty(0, np.uint64), *docs])
        aligned = [np.empty((0, 3), np.int64)]
        for index in self.indexes:
            at, item, place = index.hits(whole)
            doc = np.searchsorted(ends, at, side="right")
            inside = at + len(index.mask) <= ends[doc] if len(at) else np.zeros(0, bool)
            start = ends[doc] - sizes[doc] if len(at) else at
            aligned.append(np.unique(np.stack((doc, item, at - start - place), 1)[inside], axis=0))
        for doc, k, shift in np.unique(np.concatenate(aligned), axis=0).tolist():
            item_id, item = self.items[k]
            got = best_overlap(docs[doc], item, shift, min(self.least, len(item)), self.equal)
            held = found[doc].get(k)
            if got and (held is None or (got[0] - got[1], got[0]) < (held[1] - held[2], held[1])):
                found[doc][k] = (item_id, *got)
        return [list(f.values()) for f in found]


def blocks_of(benchmark: DataFrame, most: int = BLOCK_TOKENS) -> Iterator[list[tuple[int, str]]]:
    """The distinct non-empty benchmark texts in blocks of bounded size, each read by itself."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    items = items.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) > 0).groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = items.withColumn("size", F.size(F.split("text", r"[\x20\x09-\x0D]+")))
    block, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if block and size + row["size"] > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += row["size"]
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = MIN_OVERLAP,
                  equal: float = MIN_EQUAL, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, contaminated,
    n_items, item_id, start, end, equal, text_key.

    item_id to equal describe the longest overlap (ties: the smallest item_id,
    then the earliest): words start to end, end exclusive, of the document.
    Null and empty texts, on either side, overlap with nothing; an item
    shorter than ``least`` words must be there in full length. Equal benchmark
    texts count once, by their smallest item_id. Repeated documents are each
    reported. Empty documents table: empty result; empty benchmark: nothing is
    contaminated.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        found = stage(_per_row(rows, benchmark, masks, least, equal, block_tokens), "overlaps")
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "start", "end", "equal", "text_key")


def _per_row(rows: DataFrame, benchmark: DataFrame, masks, least, equal, block_tokens) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"uid bigint, doc_id {kind}, text_key string, n_items bigint, item_id bigint, start int, end int, equal int"
    names = [x.split()[0] for x in out.split(", ")]
    types = {"item_id": "Int64", "start": "Int32", "end": "Int32", "equal": "Int32"} | ({"doc_id": "Int64"} if kind in ("int", "bigint") else {})
    rows = rows.withColumn("text_key", F.md5(text_of()))
    spark, passes = rows.sparkSession, []
    for items in blocks_of(benchmark, block_tokens):
        if len(passes) == 1:  # several passes meet by row, so their rows need lasting ids
            rows = stage(rows, "rows")
            passes = [rows.mapInPandas(run, out)]
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            block = Block(shared.value, masks, least, equal)
            for pdf in batches:
                lines = []
                for uid, doc_id, all_of, key in zip(pdf["uid"], pdf["doc_id"], block.search([tokens(x) for x in pdf["text"]]), pdf["text_key"]):
                    hits = sorted((h[1] - h[2], h[0] is None, h[0] or 0, h[1], h) for h in all_of)
                    lines.append((uid, None if pd.isna(doc_id) else doc_id, key, len(hits), *(hits[0][-1] if hits else (None,) * 4)))
                yield pd.DataFrame(lines, columns=names).astype(types)

        passes.append(rows.mapInPandas(run, out))
    if not passes:
        none = F.lit(None)
        return rows.select("uid", "doc_id", "text_key", F.lit(0).cast("long").alias("n_items"), none.cast("long").alias("item_id"), *(none.cast("int").alias(c) for c in ("start", "end", "equal")))
    if len(passes) == 1:
        return passes[0]
    overlap = F.struct((F.col("start") - F.col("end")).alias("long"), F.col("item_id").isNull().alias("unnamed"), "item_id", "start", "end", "equal")
    found = reduce(DataFrame.union, passes).groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("text_key").alias("text_key"), F.sum("n_items").alias("n_items"),
        F.min(F.when(F.col("n_items") > 0, overlap)).alias("best"))
    return found.select("uid", "doc_id", "text_key", "n_items", "best.item_id", "best.start", "best.end", "best.equal")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item."""
    bad = contamination(docs, benchmark, **how).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    bad = stage(bad.distinct(), "contaminated")
    kept = join_small(packed(docs, "doc_id", "text"), bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5(text_of()) == F.col("_key")), "left_anti")
    return unpacked(kept, docs)
