"""Periodic runs of words, found by minimizers at several scales.

A run of period q is a longest stretch of at least ``REPEATS`` * q words in
which words q apart are equal, q being the smallest such period. All runs of
all texts of a batch are found together, in one array of word numbers in
which a mark that equals nothing separates the texts.

* Periods below ``LAG_SCANS`` are found by comparing the array with itself
  at that lag.
* Periods from w to 2w - 1 (w = LAG_SCANS, 2 LAG_SCANS, 4 LAG_SCANS, ...) are
  found by the minimizers of scale w: of each window of w places, those whose
  block of w words has the least hash. Two windows at period distance inside
  a run hold the same blocks, so both choose the same ones: minimizers with
  equal blocks at a distance of w to 2w - 1 seed an extension, which decides
  on the words themselves.

No run is missed. Blocks that repeat within w / 4 words are no minimizers.
They lie in a run of a period up to w / 4, known from earlier scales, and not
all blocks of a longer period can (neighbouring ones overlap so far that they
would be in one run, whose period would be the longer run's). What is left
recurs only after more than w / 4 words, so each minimizer seeds at most four
extensions, also where a text repeats one word a million times.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many periods, and this many words.
REPEATS, LEAST_WORDS = 4, 6
#: Lags below are compared directly; a power of two, REPEATS at least.
LAG_SCANS = 8
#: Words of the texts that are looked at together (a longer text is looked at alone).
BATCH_WORDS = 400_000

_PRIME, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

REPORT = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _PRIME) ^ b
    h = (h ^ (h >> _SHIFT)) * _PRIME
    return h ^ (h >> _SHIFT)


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of true of at least ``least``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def _blocks_least(h: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of h over [i, i + w) for each i; h is long enough for all."""
    n = len(h) - w + 1
    padded = np.resize(h, -(-len(h) // w) * w).reshape(-1, w)
    padded.reshape(-1)[len(h):] = h[-1]
    ahead = pick.accumulate(padded, axis=1).reshape(-1)
    behind = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(behind[:n], ahead[w - 1:w - 1 + n])


def _minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of a window of w places that holds them (all of equal ones)."""
    if len(h) < w:
        return np.empty(0, np.int64)
    least = _blocks_least(h, w, np.minimum)
    zeros = np.zeros(w - 1, np.uint64)
    best = _blocks_least(np.concatenate((zeros, least, zeros)), w, np.maximum)
    return np.flatnonzero((h == best) & (h != _NEVER))


def _extend(x: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch of places i around ``at`` with x[i] == x[i + lag], i and i + lag within [low, high)."""
    end, step = at, 64
    while end + lag < high:
        n = min(step, high - lag - end)
        same = x[end:end + n] == x[end + lag:end + lag + n]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + n, step * 2
    start, step = at, 64
    while start > low:
        n = min(step, start - low)
        same = (x[start - n:start] == x[start + lag - n:start + lag])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = start - n, step * 2
    return start, end


def find_runs(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs in the
    texts x[bounds[k]:bounds[k + 1] - 1], each followed by a mark that equals no other place."""
    found: dict[tuple[int, int], int] = {}  # (start, end): smallest period; ascending periods, so the first one stays
    for q in range(1, min(LAG_SCANS, len(x) // REPEATS + 1)):
        for s, e in zip(*_stretches(x[:-q] == x[q:], max(LEAST_WORDS, REPEATS * q) - q)):
            found.setdefault((int(s), int(e) + q), q)
    w, sizes = LAG_SCANS, np.diff(bounds) - 1
    kept = np.arange(len(x))  # places of the texts that are long enough for the scale
    with np.errstate(over="ignore"):
        h = _mix(x.astype(np.uint64), np.full(len(x), 1, np.uint64))
        size = 1  # words of the blocks in h
        while (wide := sizes >= REPEATS * w).any():
            if not wide.all():
                stays = np.repeat(wide, sizes + 1)
                kept, h, bounds = kept[stays], h[stays], np.concatenate(([0], np.cumsum(sizes[wide] + 1)))
                sizes = sizes[wide]
            while size < w:  # a block's hash from its halves'; blocks over a text's end hold its mark
                h = _mix(h, np.concatenate((h[size:], np.zeros(min(size, len(h)), np.uint64))))
                size *= 2
            _scale(x, kept, h, bounds, w, found)
            w *= 2
    rows = np.array([(s, e - s, q) for (s, e), q in found.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _scale(x: np.ndarray, kept: np.ndarray, h: np.ndarray, bounds: np.ndarray, w: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs of periods w to 2w - 1. ``kept`` maps places of h to places of x."""
    inside = np.zeros(len(x) + 1, np.int32)
    for (s, e), q in found.items():
        if 4 * q <= w <= e - s:
            inside[s] += 1
            inside[e - w + 1] -= 1
    h = np.where(np.cumsum(inside[:-1])[kept] > 0, _NEVER, h)
    h[bounds[1:, None] - 1 - np.arange(w)] = _NEVER  # blocks that reach over a text's end
    m = _minimizers(h, w)
    order = np.lexsort((m, h[m]))
    m, key = m[order], h[m][order]
    text = np.searchsorted(bounds, m, side="right")
    pairs, step = [np.empty((0, 2), np.int64)], 1
    while True:  # at most eight steps, unless different blocks share a hash
        far = m[step:] - m[:-step]
        near = (key[step:] == key[:-step]) & (text[step:] == text[:-step]) & (far < 2 * w)
        if not near.any():
            break
        fits = near & (far >= w)
        pairs.append(np.stack((far[fits], m[:-step][fits]), 1))
        step += 1
    pairs = np.concatenate(pairs)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    text = np.searchsorted(bounds, pairs[:, 1], side="right")
    seen = (0, -1, 0)  # lag, text, end of the last stretch
    for (lag, at), t in zip(pairs.tolist(), text.tolist()):
        if seen[:2] == (lag, t) and at < seen[2]:
            continue
        first = int(kept[at])
        low = first - (at - int(bounds[t - 1]))
        s, e = _extend(x, first, lag, low, low + int(bounds[t] - bounds[t - 1]) - 1)
        seen = (lag, t, at + e - first)
        if e - s + lag >= max(LEAST_WORDS, REPEATS * lag):
            found.setdefault((s, e + lag), lag)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail in every tenth document (by CRC-32 of its id)."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _report(docs: list[tuple[int | None, list[bytes]]]) -> pd.DataFrame:
    sizes = np.array([len(w) for _, w in docs], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    x = np.empty(bounds[-1], np.int64)
    marks = np.zeros(len(x), bool)
    marks[bounds[1:] - 1] = True
    codes, _ = pd.factorize(np.array([w for _, words in docs for w in words], dtype=object))
    x[~marks] = codes
    x[marks] = -1 - np.arange(len(docs))
    runs = find_runs(x, bounds)
    of = np.searchsorted(runs[:, 0], bounds)  # runs do not cross marks and are ordered by start
    rows = []
    for k, (doc_id, words) in enumerate(docs):
        mine = runs[of[k]:of[k + 1]] - (bounds[k], 0, 0)
        if len(mine):
            best = mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]].tolist()
            best.append(1000 * best[1] // best[2])
            gone = np.zeros(len(words) + 1, np.int32)
            np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
            np.add.at(gone, mine[:, 0] + mine[:, 1], -1)
            words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
        else:
            best = [None] * 4
        told = "".join(f"{s},{n},{q}\n" for s, n, q in mine.tolist())
        rows.append((doc_id, len(mine), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])
    return out.astype({c: "Int64" for c in out.columns[:6]})


def _texts(batches: Iterator[pd.DataFrame], change: Callable | None) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Documents as words, in lists of bounded size."""
    now, size = [], 0
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            # bytes.split parts at exactly the six white-space bytes of the word definition
            words = (text or "").encode("utf-8", "surrogatepass").split()
            words = change(words, doc_id) if change else words
            if now and size + len(words) > BATCH_WORDS:
                yield now
                now, size = [], 0
            now.append((doc_id, words))
            size += len(words) + 1
    if now:
        yield now


def periodic_runs(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_runs; start, length, period and exponent_milli of the longest
    run (ties: smallest start, then period; null without a run); runs_sha256
    over all runs; collapsed_sha256 over the words that are left when each
    run keeps its first period. ``change`` may rewrite a text's words first.

    Null text counts as empty: no words, no runs. Repeated rows and null ids
    are reported as they are. An empty table gives an empty result. A text is
    looked at whole, in one task; texts never meet, so nothing is shuffled.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        lambda batches: map(_report, _texts(batches, change)), REPORT)
