"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked when their edit distance is at most TAU. A line of
length l is split into TAU + 1 segments, one of which survives TAU edits
whole; it is indexed under (l, segment number, segment). A line of length n
probes the indexes of lengths n - TAU to n with only those substrings that an
alignment with at most TAU edits can put there. Lines that meet are verified
by a banded bit-parallel edit distance.

Equal lines are one node, named by a 64-bit hash and the length, so copies
are not compared. Members of an index entry are compared with its smallest
line first; only members that are in different classes after that are
compared with each other, and of those only pairs whose lengths and bigram
parity sketches allow the distance (an edit changes at most four bigrams, so
no link is lost). Links chain: a class is a connected component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import arrow_rows, join_small, packed, stage, text_of, unpacked
from tarmac.llm.components import components

#: Edits that linked lines may differ by; shorter lines are only compared for equality.
TAU, SHORT = 2, 20
SKETCH_BITS = 256
SLIM_ROWS = 1_000_000
ARROW_ROWS, SEEN = 1_000, 300_000

_G = SKETCH_BITS // 64
ROWS = "uid bigint, doc_id bigint, line int, lid bigint, n int, " + ", ".join(f"g{i} bigint" for i in range(_G)) + ", keys array<bigint>, indexed int"
_LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def _lower(text: str) -> str:
    """A-Z in lower case. Bytes are translated at once, where ``str`` looks every character up."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


def lines(text: str | None) -> list[str]:
    """The lines of a text, A-Z in lower case, white space trimmed and single; blank lines are ""."""
    return [" ".join(x.split()) for x in _lower(text or "").split("\n")]


def line_id(codes: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(codes, seed=len(codes)) - (1 << 63)


_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _PRIME
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


class Codes:
    """Many lines as one array of code points, with prefix sums from which the hash of any substring follows."""

    def __init__(self, lines: list[bytes]):
        self.sizes = np.array([len(x) // 4 for x in lines], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.points = np.frombuffer(b"".join(lines), "<u4").astype(np.uint64)
        n = len(self.points)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))))
            self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _INVERSE))))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(self.points + np.uint64(1)) * power[:-1], dtype=np.uint64)))

    def hashes(self, line: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Of each line's substring at ``at`` of ``size`` points: equal substrings and seeds, equal hashes, wherever they are."""
        first = self.starts[line] + at
        with np.errstate(over="ignore"):
            return _mix((self.sums[first + size] - self.sums[first]) * self.back[first] + seed.astype(np.uint64) * _PRIME)


def keys(codes: Codes, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, own): the index entries that each line is in (own) or probes, ordered by line, its own first.

    A line of l points has tau + 1 segments, the longer ones last. A line of n
    probes the segments of lengths n - tau to n at the places where an
    alignment with at most tau edits can put them.
    """
    n, found = codes.sizes, []
    for more in range(tau + 1):
        l = n - more  # noqa: E741
        short, longer = np.divmod(l, tau + 1)
        for i in range(tau + 1):
            late = np.maximum(0, i - (tau + 1 - longer))  # longer segments before this one
            p, size = i * short + late, short + (i >= tau + 1 - longer)
            lo = np.maximum(np.maximum(0, p - i), p + more - (tau - i))
            hi = np.minimum(np.minimum(n - size, p + i), p + more + (tau - i))
            for off in range(2 * tau + 1):
                line = np.flatnonzero((l >= SHORT) & (lo + off <= hi))
                if len(line):
                    at = (lo + off)[line]
                    found.append((line, codes.hashes(line, at, size[line], l[line] * (tau + 1) + i), (at == p[line]) & (more == 0)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    line, key, own = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((~own, line))
    return line[order], key[order], own[order]


def sketches(codes: Codes) -> np.ndarray:
    """A row per line: the parities of the counts of its bigrams, by hash."""
    out = np.zeros((len(codes.sizes), _G), np.uint64)
    c = codes.points
    if len(c) < 2:
        return out.view(np.int64)
    h = ((c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)) & np.uint64(SKETCH_BITS - 1)
    bits = np.uint64(1) << (h & np.uint64(63))
    ends = codes.starts + codes.sizes
    bits[ends[ends < len(c)] - 1] = 0  # a pair of two lines' points is no bigram
    some = np.flatnonzero(codes.sizes > 1)
    if len(some):
        own, word, first = np.zeros(len(bits) + 1, np.uint64), (h >> np.uint64(6)).astype(np.uint8), np.minimum(codes.starts[some], len(bits))
        for g in range(_G):
            np.multiply(bits, word == g, out=own[:-1])
            out[some, g] = np.bitwise_xor.reduceat(own, first)
    return out.view(np.int64)


def edit_distance(x: str, y: str, most: int) -> int | None:
    """The edit distance if it is at most ``most``, else None.

    Bit d of row e says that the first j + d - most characters of x can be
    made the first j of y with e edits: the band of 2 most + 1 diagonals is
    one small number, and a character of y is a few shifts of it.
    """
    if abs(len(x) - len(y)) > most:
        return None
    a, b = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (x, y))
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    start = int(differ[0]) if len(differ) else k
    a, b = a[start:], b[start:]
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - k:][::-1] != b[len(b) - k:][::-1])
    end = int(differ[0]) if len(differ) else k
    a, b = a[:len(a) - end], b[:len(b) - end]
    match = np.zeros(len(b), np.int64)
    for d in range(2 * most + 1):
        i = np.arange(len(b)) + d - most
        ok = (i >= 0) & (i < len(a))
        match[ok] |= (a[i[ok]] == b[ok]).astype(np.int64) << d
    band = (1 << (2 * most + 1)) - 1
    rows = [((1 << (e + 1)) - 1) << most & band for e in range(most + 1)]
    for m in match.tolist():
        below = above = 0  # the row of one edit less, before and after this character
        for e in range(most + 1):
            now = rows[e]
            rows[e] = (now & m | (below | below >> 1 | above << 1 if e else 0)) & band
            below, above = now, rows[e]
    final = 1 << (len(a) - len(b) + most)
    return next((e for e in range(most + 1) if rows[e] & final), None)


def _rows(batches: Iterator[pd.DataFrame], tau: int) -> Iterator[pd.DataFrame]:
    """A row per line; for each different line that a task meets, one of them has its keys and its sketch."""
    seen: set[int] = set()
    for pdf in batches:
        where, own, new, new_at = [], [], [], []
        for uid, doc_id, text in zip(pdf["uid"], pdf["doc_id"], pdf["text"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            for no, line in enumerate(lines(text)):
                codes, n = line.encode("utf-32-le", "surrogatepass"), len(line)
                lid = line_id(codes)
                if n >= SHORT and lid not in seen:
                    seen.add(lid)
                    new.append(codes)
                    new_at.append(len(own))
                where.append((uid, doc_id))
                own.append((no, lid, n))
        if len(seen) > SEEN:
            seen.clear()
        own_of, g = np.array(own, np.int64).reshape(-1, 3), np.zeros((len(own), _G), np.int64)
        own_keys, indexed = [[]] * len(own), np.zeros(len(own), np.int64)
        if new:
            codes = Codes(new)
            g[new_at] = sketches(codes)
            line, key, of_own = keys(codes, tau)
            indexed[new_at] = np.bincount(line[of_own], minlength=len(new))
            for at, part in zip(new_at, np.split(key.view(np.int64), np.cumsum(np.bincount(line, minlength=len(new)))[:-1])):
                own_keys[at] = part
        yield pd.DataFrame({"uid": [x[0] for x in where], "doc_id": pd.array([x[1] for x in where], "Int64"), "line": own_of[:, 0], "lid": own_of[:, 1], "n": own_of[:, 2],
                            **{f"g{i}": g[:, i] for i in range(_G)}, "keys": own_keys, "indexed": indexed})


def _texts(docs: DataFrame, every: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, text) of the lines in ``wanted`` (lid): one document of each is read again."""
    holders = every.join(wanted, "lid", "left_semi").groupBy("lid").agg(F.min("doc_id").alias("holder"))
    holders = stage(holders.select("holder").distinct(), "line-holders")
    some = join_small(docs, holders, F.col("doc_id").cast("bigint").eqNullSafe(F.col("holder")), "left_semi", SLIM_ROWS)

    def each(batches):
        for pdf in batches:
            found = {line_id(x.encode("utf-32-le", "surrogatepass")): x for text in pdf["text"] for x in lines(text) if len(x) >= SHORT}
            yield pd.DataFrame({"lid": pd.array(list(found), "int64"), "text": list(found.values())})

    said = some.select("text").mapInPandas(each, "lid bigint, text string")
    return join_small(said, wanted.withColumnRenamed("lid", "want"), F.col("lid") == F.col("want"), "inner", SLIM_ROWS).groupBy("lid").agg(F.min("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, every: DataFrame, tau: int) -> DataFrame:
    """The pairs (a, b) of lines within ``tau`` edits."""
    pairs = stage(pairs, "line-pairs")
    wanted = stage(pairs.select(F.col("a").alias("lid")).union(pairs.select(F.col("b").alias("lid"))).distinct(), "line-ids")
    texts = stage(_texts(docs, every, wanted), "line-texts")
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        for pdf in batches:
            ok = [edit_distance(x, y, tau) is not None for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    return stage(both.select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint"), "line-links")


def _may_link(tau: int):
    changed = sum((F.bit_count(F.col(f"x.g{i}").bitwiseXOR(F.col(f"y.g{i}"))) for i in range(_G)), F.lit(0))
    return (F.abs(F.col("x.n") - F.col("y.n")) <= tau) & (changed <= 4 * tau)


def line_classes(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(uid, doc_id, line, n, lid, root) of every line; staged. Lines of one class share ``root``."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _line_classes(docs, tau)


def _line_classes(docs: DataFrame, tau: int) -> DataFrame:
    texts = docs.select("doc_id", text_of().alias("text"))
    slim = texts.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stage(slim.mapInPandas(lambda b: _rows(b, tau), ROWS), "lines")
    every = rows.drop("keys", "indexed")
    entries = rows.where("indexed > 0").select("lid", F.col("indexed").alias("own"), F.posexplode("keys").alias("at", "key")).select("key", "lid", (F.col("at") < F.col("own")).alias("indexed"))
    # Index entries with an indexed line and another one; the smallest indexed line stands for the entry.
    met = entries.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.min(F.when(F.col("indexed"), F.col("lid"))).alias("first"))
    met = stage(met.where("lo != hi AND first IS NOT NULL").select(F.col("key").alias("met"), "first"), "shared-segments")
    shared = stage(join_small(entries, met, F.col("key") == F.col("met"), "inner", SLIM_ROWS).select("key", "lid", "indexed", "first").distinct(), "segment-members")
    of_line = [F.min("n").alias("n"), *(F.min(f"g{i}").alias(f"g{i}") for i in range(_G))]
    nodes = stage(rows.where("indexed > 0").join(shared.select("lid").distinct(), "lid", "left_semi").groupBy("lid").agg(*of_line), "line-nodes")

    x, y = nodes.alias("x"), nodes.alias("y")
    stars = shared.where("lid != first").select(F.col("lid").alias("a"), F.col("first").alias("b")).distinct()
    near = stars.join(x, F.col("a") == F.col("x.lid")).join(y, F.col("b") == F.col("y.lid")).where(_may_link(tau)).select("a", "b")
    links = _verified(near, texts, every, tau)
    roots = components(links)

    placed = shared.join(roots, F.col("lid") == F.col("node"), "left").select("key", "lid", "indexed", F.coalesce("root", "lid").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    left = stage(placed.join(split, "key").join(nodes, "lid"), "unlinked-lines")
    across = left.where("indexed").alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _may_link(tau))
    cross = across.select(F.greatest("x.lid", "y.lid").alias("a"), F.least("x.lid", "y.lid").alias("b")).distinct()
    roots = stage(components(links.union(_verified(cross, texts, every, tau))).withColumnRenamed("root", "of_root"), "line-roots")
    placed = join_small(every.select("uid", "doc_id", "line", "n", "lid"), roots, F.col("lid") == F.col("node"), "left", SLIM_ROWS)
    return stage(placed.select("uid", "doc_id", "line", "n", "lid", F.coalesce("of_root", "lid").alias("root")), "line-classes")


def line_report(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, n_lines, n_blank, n_dropped, dropped.

    Of each class of lines the first stays, by doc_id (null first), then by
    line; of rows repeated with that doc_id one counts as first. ``dropped``
    lists the line numbers from 0, comma-joined. Blank lines stay and are in
    no class. Null text counts as empty, which is one blank line. Lines
    shorter than ``SHORT`` are duplicates only when equal; case (A-Z) and white
    space do not matter. An empty table gives an empty result.
    """
    each = line_classes(docs, tau)
    said = each.where("n > 0")
    first = said.groupBy("root").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "uid", "line")).alias("first")).where("times > 1")
    again = said.join(first, "root").where((F.col("uid") != F.col("first.uid")) | (F.col("line") != F.col("first.line")))
    none = F.lit(None)
    rows = each.select("uid", "doc_id", F.lit(1).alias("one"), (F.col("n") == 0).cast("int").alias("blank"), none.cast("int").alias("gone"))
    rows = rows.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("one").alias("n_lines"), F.sum("blank").alias("n_blank"))
    gone = again.groupBy("uid").agg(F.count("*").alias("n_dropped"), F.array_sort(F.collect_list("line")).alias("lines"))
    kind = docs.schema["doc_id"].dataType
    return rows.join(gone, "uid", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_lines", "n_blank", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("lines", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"))


def dedup_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` without the repeated lines in ``text``. Rows repeated with doc_id and text keep their lines once."""
    keyed = packed(docs, "doc_id", "text").withColumn("_key", F.md5(text_of()))
    plan = line_report(keyed.groupBy("doc_id", "_key").agg(F.first("text").alias("text")).select("doc_id", "text"), tau)
    plan = stage(plan.where("n_dropped > 0").select(F.col("doc_id").alias("_id"), F.split("dropped", ",").alias("_gone"), "n_lines"), "dropped-lines")
    lines_of = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines_of, lambda x, i: ~F.array_contains("_gone", i.cast("string"))), "\n")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.size(lines_of) == F.col("n_lines"))
    return unpacked(keyed.join(plan, same, "left"), docs, text=F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
