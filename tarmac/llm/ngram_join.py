"""Jaccard join of shingle sets, size-aware: subsets for light sets, inverted lists for heavy ones.

Sets are collapsed into classes of equal sets first. Two sets A, B link when
their Jaccard similarity reaches NUM / DEN, which bounds their sizes against
each other and their symmetric difference: |A ^ B| * (DEN + NUM) <=
(DEN - NUM) * (|A| + |B|).

* Light sets (below a boundary size) enumerate their subsets of each size
  that a partner can require; linked light sets share one of them.
* Heavy sets are found by the inverted lists of their elements. Of a set of n
  elements only the first n - ceil(NUM n / DEN) + 1 need to be listed, in any
  order that is the same for all sets: two linked sets share one of those.
  The order puts frequent elements last, so the lists of passages that many
  documents share stay out unless a set has little else.
* The boundary is the size with the least cost: keys that the light sets
  write, against list entries that the heavy sets would meet.

Pairs within a list are not enumerated: every set is first compared with one
that is the smallest member of most of its lists. Lists whose members are in
different components after that get pivots, a few drawn members each, in
rounds (where they hold many pairs): whoever links with a pivot joins its component, and components that
have joined are not compared again. The rounds end when they join little any
more. Only what is then still in different components is compared pair by
pair, and of those only the pairs whose sizes and parity sketches allow a link
(the popcount of the sketches' xor never exceeds |A ^ B|, so no link is lost).
Every link used is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import arrow_rows, discard, join_small, scratch, stage, text_of, worker_cache
from tarmac.llm.components import components

SHINGLE, NUM, DEN = 3, 90, 100
#: Lists longer than this count as frequent in the order of elements.
LONG_LIST = 64
#: Sizes that may be light at most; beyond, subsets explode.
MAX_LIGHT = 29
#: Bits of the fixed-size sketch of frequent elements (it only steers the order), and of a set's parity sketch.
FREQUENT_BITS, PARITY_BITS = 26, 512
ELEMENT_BYTES = 8
#: Pivots of a long list in a round, members from which on a list is long, pairs in long lists for each row of all lists from which on rounds cost less,
#: and the share of the lists' components that a round must join for another one.
PIVOTS, LONG_SPLIT, PAIRS_EACH, WORTH = 16, 16, 16, 0.5
SLIM_ROWS = 1_000_000
#: Documents for which a staged table has one file: of small inputs in many partitions, few files.
FILE_DOCS = 10_000
ARROW_ROWS = 500

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_LOW = (1 << 64) - 1
_LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(33))) * _C[3]
    h = (h ^ (h >> np.uint64(33))) * _C[4]
    return h ^ (h >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h



def many_shingles(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the distinct 64-bit hashes of its k-word shingles, ascending; hashed together."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(worker_cache("shingles", _Words).__getitem__, chain.from_iterable(words)), np.uint64, sizes.sum())
    ends = np.cumsum(sizes)
    whole = _hashed(h, k, k) if len(h) >= k else h[:0]
    out = []
    for end, n in zip(ends.tolist(), sizes.tolist()):
        # A text of fewer words is one shingle; windows that reach into the next text are left out.
        out.append(np.unique(whole[end - n:end - k + 1] if n >= k else _hashed(h[end - n:end], max(n, 1), n)[:n and 1]))
    return out


def _hashed(h: np.ndarray, k: int, length: int) -> np.ndarray:
    """The hash of the k words at each place."""
    n = max(0, len(h) - k + 1)
    with np.errstate(over="ignore"):
        all_of = np.full(n, length, np.uint64)
        for i in range(k):
            all_of = mix(all_of * _C[0] + h[i:i + n] * _C[1] + _C[2])
    return all_of


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    return many_shingles([text], k)[0]


def pack(elements: np.ndarray) -> bytes:
    """Ascending elements as byte planes of their differences, whose high planes compress."""
    gaps = np.diff(elements, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, ELEMENT_BYTES).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(ELEMENT_BYTES, -1).T).reshape(-1).view("<u8")
    return np.cumsum(gaps, dtype=np.uint64)


def parity(elements: np.ndarray) -> np.ndarray:
    odd = np.bincount((elements % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


_WORDS64 = PARITY_BITS // 64
SETS = "uid bigint, doc_id bigint, text_key string, n int, sid bigint, proof bigint, " + ", ".join(f"s{i} bigint" for i in range(_WORDS64)) + ", wide binary, elements binary"


def wide_parity(elements: np.ndarray) -> bytes:
    """A parity sketch of at least twice as many bits as elements."""
    bits = max(PARITY_BITS, 1 << int(2 * len(elements) - 1).bit_length())
    return np.packbits((np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """At most the symmetric difference of the sets of two wide sketches; the longer one is folded to the other's size."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _sets(batches: Iterator[pd.DataFrame], k: int, seed: int) -> Iterator[pd.DataFrame]:
    import xxhash

    names = [x.split()[0] for x in SETS.split(", ")]
    for pdf in batches:
        rows = []
        for uid, doc_id, key, e in zip(pdf["uid"], pdf["doc_id"], pdf["text_key"], many_shingles(pdf["text"].tolist(), k)):
            data = pack(e)
            name = xxhash.xxh3_128_intdigest(data, seed=seed)
            sid, proof = (name & _LOW) - (1 << 63), (name >> 64) - (1 << 63)
            rows.append((uid, None if pd.isna(doc_id) else int(doc_id), key, len(e), sid, proof, *parity(e).tolist(), wide_parity(e), data))
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def need(n: int, num: int, den: int) -> int:
    """Elements that a set of n must share with any partner: ceil(num n / den)."""
    return -(-num * n // den)


def light_keys(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """A hash of each subset of each size from need(n) to n."""
    n, h = len(elements), mix(elements)
    keys = []
    with np.errstate(over="ignore"):
        total = h.sum(dtype=np.uint64)
        for size in range(need(n, num, den), n + 1):
            gone = [h[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), n - size)] if size < n else [np.uint64(0)]
            keys.append(mix((total - np.array(gone, np.uint64)) * _C[1] + np.uint64(size)))
    return np.concatenate(keys)


def _bit(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)


def _in_sketch(sketch: np.ndarray, elements: np.ndarray) -> np.ndarray:
    at = _bit(elements)
    return ((sketch[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def listed(elements: np.ndarray, frequent: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """The elements whose lists a heavy set is in: the first in the common order."""
    count = len(elements) - need(len(elements), num, den) + 1
    if frequent is not None:
        elements = elements[np.argsort(_in_sketch(frequent, elements), kind="stable")]
    return elements[:count]


def postings(sets: DataFrame, frequent: np.ndarray | None, light: int, num: int, den: int, whole: bool = False, only: np.ndarray | None = None) -> DataFrame:
    """(key, sid): list entries of sets from need(light) elements on, subset keys of sets below ``light``; ``whole``: all elements.
    ``only``: those whose key is in this sketch."""
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast((frequent, only))
    heavy_from = need(light, num, den)

    def run(batches):
        often, wanted = shared.value
        for pdf in batches:
            keys, sids = [], []
            for sid, n, data in zip(pdf["sid"], pdf["n"], pdf["elements"]):
                e = unpack(data)
                own = [e] if whole else []
                if not whole and n >= heavy_from:
                    own.append(listed(e, often, num, den))
                if not whole and n < light:
                    own.append(light_keys(e, num, den))
                for k in own:
                    keys.append(k)
                    sids.append(np.full(len(k), sid, np.int64))
            if keys:
                every = pd.DataFrame({"key": np.concatenate(keys).astype("<u8").view("<i8"), "sid": np.concatenate(sids)})
                yield every if wanted is None else every.loc[_in_sketch(wanted, every["key"].to_numpy().view("<u8"))]

    return sets.select("sid", "n", "elements").mapInPandas(run, "key bigint, sid bigint")


def frequent_sketch(keys: DataFrame) -> np.ndarray:
    """A bit for every element in ``keys``, in a bitmap of fixed size (2^FREQUENT_BITS bits, at most 2^20 words collected)."""
    def run(batches):
        for pdf in batches:
            at = _bit(pdf["key"].to_numpy().astype("<i8").view("<u8"))
            yield pd.DataFrame({"word": at >> 6, "bits": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)})

    words = keys.select("key").mapInPandas(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    sketch = np.zeros(1 << (FREQUENT_BITS - 6), np.uint64)
    sketch[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return sketch


def boundary(sizes: dict[int, int], list_length: float, num: int, den: int) -> int:
    """The light boundary of least cost, from the number of sets by size and the mean length of a list that an entry is in."""
    from math import comb

    def light_cost(n: int) -> float:
        return sum(comb(n, c) for c in range(need(n, num, den), n + 1))

    def heavy_cost(n: int) -> float:
        return (n - need(n, num, den) + 1) * max(1.0, list_length)

    def cost(x: int) -> float:
        # Sets just below the boundary are listed too, for their heavy partners.
        return sum(c * ((light_cost(n) if n < x else 0) + (heavy_cost(n) if n >= need(x, num, den) else 0)) for n, c in sizes.items())

    return min(range(1, MAX_LIGHT + 2), key=lambda x: (cost(x), x))


def may_link(x: str, y: str, num: int, den: int) -> Column:
    """Whether the sizes and parity sketches of two rows allow a link."""
    sizes = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(_WORDS64)), F.lit(0))
    fits = (F.least(f"{x}.n", f"{y}.n") * den >= F.greatest(f"{x}.n", f"{y}.n") * num)
    return fits & (apart * (den + num) <= sizes * (den - num))


def verified(pairs: DataFrame, sets: DataFrame, classes: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose full sets link, in at most ``files`` files.

    The wide sketches rule out most of the others first. Then the sets of a
    travel to b's partition, once a pair; b's sets once."""
    of = lambda x: classes.select(F.col("sid").alias(x), F.col("uid").alias(f"{x}_uid"), F.col("n").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide"))
    names = "a bigint, b bigint, a_uid bigint, b_uid bigint"

    def near(batches):
        for pdf in batches:
            ok = [apart(x, y) * (den + num) <= (n + m) * (den - num) for x, y, n, m in zip(pdf["a_wide"], pdf["b_wide"], pdf["a_n"], pdf["b_n"])]
            yield pdf.loc[np.array(ok, bool), ["a", "b", "a_uid", "b_uid"]]

    pairs = stage(pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(near, names).coalesce(files), "pairs")
    seconds = stage(pairs.select("b", F.col("b_uid").alias("uid2")).distinct().coalesce(files), "pair-seconds")
    own = sets.select("uid", F.col("elements"))
    left = join_small(own, pairs, F.col("uid") == F.col("a_uid"), "inner", SLIM_ROWS).select("a", "b", F.col("elements").alias("x"))
    right = join_small(own, seconds, F.col("uid") == F.col("uid2"), "inner", SLIM_ROWS).select("b", F.col("elements").alias("y"))

    def run(batches):
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"]):
                x, y = unpack(x), unpack(y)
                common = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(den * common >= num * (len(x) + len(y) - common))
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    found = stage(left.join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint").coalesce(files), "verified")
    discard(pairs, seconds)
    return found


def similar_sets(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, n_shingles, component_id, class_size.

    Null text counts as empty; documents without words link with nothing and
    are their own component. Texts of fewer than ``k`` words have one shingle,
    the whole sequence. Repeated rows are members of one class. A null doc_id
    is reported as it is and never is a component's id unless all ids are
    null. An empty table gives an empty result. ``class_size`` is the number
    of rows with the same set.

    Shingles are compared by 64-bit hashes. Sets are named by 64 bits, and
    other 64 bits prove that no two different sets have one name (else all are
    named anew).
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _similar_sets(docs, k, num, den).drop("text_key", "root")


def first_of_each(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, text_key) of the text that stays of each component: the smallest
    doc_id (null last), then the smallest ``text_key`` (MD5 of the text).

    Equal texts are in one component, so a pair belongs to one component only.
    Texts without words are each their own component and all listed.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS), scratch() as stay:
        rows = stage(_similar_sets(docs, k, num, den).select("doc_id", "text_key", "n_shingles", "root").coalesce(1 + docs.count() // FILE_DOCS), "components")
        stay.append(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    of_component = rows.where("n_shingles > 0").groupBy("root").agg(first).select("first.doc_id", "first.text_key")
    return of_component.union(rows.where("n_shingles = 0").select("doc_id", "text_key").distinct())


def _similar_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_of()).alias("text_key"), "text")
    sketch = [f"s{i}" for i in range(_WORDS64)]
    files, seed = 1 + docs.count() // FILE_DOCS, 0
    few = lambda df, name, *how: stage(df.coalesce(files), name, *how)
    while True:
        sets = few(rows.mapInPandas(lambda b: _sets(b, k, seed), SETS), "sets", "zstd")
        full = sets.where("n > 0")
        classes = few(full.groupBy("sid").agg(F.min("n").alias("n"), F.min("uid").alias("uid"), F.min("doc_id").alias("least"), F.count("*").alias("class_size"),
                                                (F.min("proof") == F.max("proof")).alias("proven"), *(F.min(s).alias(s) for s in sketch), F.min("wide").alias("wide")), "set-classes")
        if classes.where("NOT proven").isEmpty():
            break
        seed += 1  # two different sets under one name: once in a long time

    # The order of elements: frequent ones last. Copies count here, which moves elements back but loses nothing.
    counts = few(postings(full, None, 1, num, den).groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "list-lengths")
    frequent = frequent_sketch(counts.where(F.col("c") > LONG_LIST))
    # Rows are counted by key alone; only the entries of keys with many rows meet with their sets.
    many = few(postings(full, frequent, 1, num, den).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > LONG_LIST), "many-rows")
    again = postings(full, frequent, 1, num, den, only=frequent_sketch(many)).groupBy("key").agg(F.countDistinct("sid").alias("sids"))
    still = few(again.where(F.col("sids") > LONG_LIST).select("key"), "still-long")
    if not still.isEmpty():  # groups of near copies: their members' other elements are frequent as well
        member = frequent_sketch(still)
        inside = _with_listed(full, frequent, member, num, den)
        more = postings(inside, None, 1, num, den, whole=True).groupBy("key").agg(F.countDistinct("sid").alias("c")).where(F.col("c") > LONG_LIST)
        frequent = frequent | frequent_sketch(few(more.select("key"), "group-elements"))

    discard(still, many)
    length = counts.agg((F.sum(F.col("c") * F.least("c", F.lit(LONG_LIST))) / F.sum("c")).alias("l")).first()["l"] or 1.0
    sizes = {r["n"]: r["c"] for r in classes.where(F.col("n") <= MAX_LIGHT + 1).groupBy("n").agg(F.count("*").alias("c")).collect()}
    light = boundary(sizes, float(length), num, den)

    # Most keys are in one row only. A sketch of the others keeps those out of the lists; what it lets through is counted again.
    met = few(postings(full, frequent, light, num, den).groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "met")
    entries = few(postings(full, frequent, light, num, den, only=frequent_sketch(met)).distinct(), "entries")
    lists = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("sid").alias("first")).where("c > 1").select("key", "first")
    shared = few(entries.join(lists, "key"), "shared")

    sided = lambda side, name: side.join(classes.select(F.col("sid").alias(name), "n", *sketch), name)
    # Each set with the smallest member that it shares most lists with.
    stars = shared.where("sid != first").groupBy(F.col("sid").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("c"))
    stars = stars.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", "best.b")
    x, y = classes.alias("x"), classes.alias("y")
    near = stars.join(x, F.col("a") == F.col("x.sid")).join(y, F.col("b") == F.col("y.sid")).where(may_link("x", "y", num, den)).select("a", "b")
    links = verified(near, sets, classes, num, den, files)
    roots = components(links)
    discard(counts, met, entries)

    # Lists whose members are in different components after that.
    left = few(_still_split(sided(shared.select("key", "sid"), "sid"), roots), "unlinked")
    discard(shared)
    long = left.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= LONG_SPLIT)
    pairs = long.agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0))).first()[0]
    if pairs > PAIRS_EACH * left.count():  # else comparing pairs costs less than rounds
        hard = few(left.join(long.select("key"), "key"), "long-lists")
        turn, before = 0, _list_components(hard)
        while before:
            links = links.union(verified(_pivot_pairs(hard, sketch, turn, num, den), sets, classes, num, den, files))
            roots = components(links)
            last, hard = hard, few(_still_split(hard.drop("root"), roots), "long-lists")
            discard(last)
            turn, now = turn + 1, _list_components(hard)
            if now > (1 - WORTH) * before:
                break
            before = now
        last, left = left, few(_still_split(left.drop("root"), roots), "unlinked")
        discard(last, hard)

    across = left.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root")) & may_link("x", "y", num, den))
    cross = across.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    found = verified(cross, sets, classes, num, den, files)
    roots = components(links.union(found))
    discard(left)

    known = classes.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "n", "least", "class_size", F.coalesce("root", "sid").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = few(known.join(least, "root").select("sid", F.col("n").alias("class_n"), "component_id", "class_size", "root"), "set-components")
    out = sets.select("doc_id", "text_key", "n", "sid").join(of_class.withColumnRenamed("sid", "class"), (F.col("sid") == F.col("class")) & (F.col("n") == F.col("class_n")), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "text_key", "root")


def _still_split(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``lists`` (key, sid, ...) with each set's root, of lists with several roots."""
    placed = lists.join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")).drop("node")
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return placed.join(split, "key")


def _list_components(lists: DataFrame) -> int:
    """How many components meet in lists, over all of the lists."""
    each = lists.groupBy("key").agg(F.approx_count_distinct("root").alias("roots"))
    return each.agg(F.coalesce(F.sum("roots"), F.lit(0))).first()[0]


def _pivot_pairs(left: DataFrame, sketch: list[str], turn: int, num: int, den: int) -> DataFrame:
    """(a, b): each member of a list with the list's pivots of this round, where a link is possible."""
    member = F.struct("sid", "root", "n", *sketch)
    drawn = [F.min(F.struct(F.xxhash64("sid", F.lit(turn * PIVOTS + i)).alias("draw"), member.alias("m"))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = left.groupBy("key").agg(*drawn)
    each = pivots.select("key", F.explode(F.array_distinct(F.array(*[f"p{i}.m" for i in range(PIVOTS)]))).alias("m")).select("key", "m.*")
    x, y = left.alias("x"), each.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & may_link("x", "y", num, den))
    return met.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def _with_listed(sets: DataFrame, frequent: np.ndarray, member: np.ndarray, num: int, den: int) -> DataFrame:
    """The sets with a listed element in the sketch ``member``."""
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast((frequent, member))

    def run(batches):
        often, wanted = shared.value
        for pdf in batches:
            def has(data):
                return bool(_in_sketch(wanted, listed(unpack(data), often, num, den)).any())

            keep = [has(d) for d in pdf["elements"]]
            yield pdf.loc[np.array(keep, bool)]

    return sets.select("sid", "n", "elements").mapInPandas(run, "sid bigint, n int, elements binary")
