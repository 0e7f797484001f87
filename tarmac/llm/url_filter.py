"""URL filter: path rules first, then a Bloom filter cascade over the corpus' own hosts.

The cascade answers membership exactly for every key of a known universe, here
all distinct hosts of the pages. Level 1 encodes the listed keys; level 2 the
unlisted keys that level 1 lets through by mistake; level 3 the listed keys
that level 2 lets through; and so on until a level has no false positives. A
key is listed when the first level that refuses it is an even one. Pages are
judged by hashing their own host against the levels' bits: no join, and no
list of hosts, takes part.

The bits are Spark arrays of 64-bit words, filled by ``bit_or`` and read by a
scalar subquery. Their total is split by key hash into slices of at most
``SLICE_WORDS`` words, and one pass over the pages holds one slice, so what a
task holds does not grow with the list.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import join_small, lower_ascii, stage

#: Words of 64 bits that the levels of one slice may have together (8 MB).
SLICE_WORDS = 1 << 20
#: False positives of level 1 at most, and of each later level.
FIRST_RATE, NEXT_RATE = 0.05, 0.1

#: The rules (verdict, host, path), and the terms that put a domain on the list when a part of a label equals one.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LISTED_TERMS = ("ads", "adult", "bets", "casino", "pills", "spam")


class Level(NamedTuple):
    """Size of one cascade level: ``words`` 64-bit words in each slice, probed at ``probes`` places."""
    no: int
    words: int
    probes: int


class Cascade(NamedTuple):
    """The levels, each with its bits (slice, words array), one row per slice."""
    levels: list[tuple[Level, DataFrame]]
    slices: int


# -- parts of a url -----------------------------------------------------------

def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) struct of the longest rule that fits, or null. A rule
    fits its host and all subdomains when the path starts with the rule's; of
    equal lengths the one with the longer host wins."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


# -- the cascade ---------------------------------------------------------------

def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(slices)).cast("int")


def _places(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level.no * 64 + i), key), F.lit(level.words * 64)) for i in range(level.probes)]


def plan_level(no: int, n: int, rate: float, slices: int) -> Level:
    """The size of a level that encodes ``n`` keys in ``slices`` slices."""
    bits = max(64.0, -n / slices * math.log(rate) / math.log(2) ** 2)
    words = math.ceil(bits / 64)
    return Level(no, words, max(1, min(16, round(words * 64 * slices / max(n, 1) * math.log(2)))))


def _fill(keys: DataFrame, level: Level, slices: int) -> DataFrame:
    """(slice, words): the level's bits for ``keys``."""
    placed = keys.select(_slice(F.col("key"), slices).alias("slice"), F.explode(F.array(*_places(F.col("key"), level))).alias("place"))
    bits = placed.groupBy("slice", F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    per = level.words
    empty = keys.sparkSession.range(slices * per).select((F.col("id") / per).cast("int").alias("slice"), (F.col("id") % per).alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = bits.union(empty).groupBy("slice", "word").agg(F.bit_or("bits").alias("bits"))
    return dense.groupBy("slice").agg(F.expr("transform(array_sort(collect_list(struct(word, bits))), x -> x.bits)").alias("words"))


def _passes(key: Column, level: Level, words: Column) -> Column:
    """Whether every probed bit of ``key`` is set in ``words``."""
    def bit(place: Column) -> Column:
        return F.get(words, F.shiftright(place, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))) != 0

    return reduce(lambda x, y: x & y, (bit(p) for p in _places(key, level)))


def _words(bits: DataFrame, slice_no: int) -> Column:
    return bits.where(F.col("slice") == slice_no).select("words").scalar()


def _through(keys: DataFrame, bits: DataFrame, level: Level, slices: int) -> DataFrame:
    """The keys that ``level`` lets through; one bounded slice at a time."""
    parts = [keys.where((_slice(F.col("key"), slices) == s) & _passes(F.col("key"), level, _words(bits, s))) for s in range(slices)]
    return reduce(DataFrame.union, parts)


def build(universe: DataFrame, first_rate: float = FIRST_RATE, next_rate: float = NEXT_RATE, slice_words: int = SLICE_WORDS) -> Cascade:
    """The cascade of ``universe`` (key, listed), whose keys are distinct and not null.

    Only counts come to the driver. Each level's survivors and bits are
    written once. Without listed keys there are no levels and nothing is a
    member.
    """
    known = stage(universe.select("key", "listed"), "cascade-universe")
    inside, outside = known.where("listed").select("key"), known.where("NOT listed").select("key")
    n = inside.count()
    # All levels of a slice together stay within the bound: later levels encode shrinking sets.
    slices = max(1, math.ceil(2 * sum(plan_level(1, n, r, 1).words for r in (first_rate, next_rate)) / slice_words)) if n else 1
    levels = []
    while n:
        level = plan_level(len(levels) + 1, n, next_rate if levels else first_rate, slices)
        bits = stage(_fill(inside, level, slices), "cascade-bits")
        levels.append((level, bits))
        wrong = stage(_through(outside, bits, level, slices), "cascade-wrong")
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels, slices)


def member(key: Column, cascade: Cascade, slice_no: int) -> Column:
    """Exact membership of a key of the universe that belongs to slice ``slice_no``."""
    found = F.lit(False)
    for level, bits in reversed(cascade.levels):
        found = _passes(key, level, _words(bits, slice_no)) & ~found
    return found


# -- urls -----------------------------------------------------------------------

def listed_domains(hosts: DataFrame, terms=LISTED_TERMS) -> DataFrame:
    """(domain): of each host, what follows from its first label on that has a
    hyphen-separated part among ``terms`` (never the last label alone)."""
    label = rf"(?s)(?:^|\.)((?:[^.]*-)?(?:{'|'.join(terms)})(?:-[^.]*)?\..*)$"
    return hosts.select(F.regexp_extract("host", label, 1).alias("domain")).where("domain != ''").distinct()


def host_universe(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """(key, listed) of every distinct host: listed when the host or a parent
    domain of it is in ``domains``. Joined once per distinct host, by equality."""
    entries = stage(domains.where("domain IS NOT NULL").select("domain", F.size(F.split("domain", r"\.", -1)).alias("depth")).distinct(), "listed-domains")
    depths = sorted(r["depth"] for r in entries.select("depth").distinct().collect())  # numbers of labels, not entries
    if not depths:
        return hosts.select(F.col("host").alias("key"), F.lit(False).alias("listed"))
    parents = hosts.select("host", F.explode(F.array_distinct(F.array(*(F.substring_index("host", ".", -d) for d in depths)))).alias("parent"))
    under = join_small(parents, entries.select(F.col("domain").alias("parent_domain")), F.col("parent") == F.col("parent_domain"), "left_semi").select("host")
    both = hosts.select("host", F.lit(False).alias("listed")).union(under.select("host", F.lit(True)))
    return both.groupBy(F.col("host").alias("key")).agg(F.max("listed").alias("listed"))


def judge_urls(pages: DataFrame, domains: DataFrame | None = None, rules=RULES, terms=LISTED_TERMS, slice_words: int = SLICE_WORDS,
               first_rate: float = FIRST_RATE, next_rate: float = NEXT_RATE) -> DataFrame:
    """One row per row of ``pages`` (page_id, url; other columns are ignored):
    page_id, host, path, rule, verdict (allow or block), listed.

    ``domains`` (domain) is the block list; None: the domains of the pages'
    own hosts whose labels contain one of ``terms``. A rule's verdict goes
    before the list's. Null urls, and urls without ``://``, have empty host
    and path, fit no rule and are never listed. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = stage(parts.where("host != ''").select("host").distinct(), "url-hosts")
    listed = listed_domains(hosts, terms) if domains is None else domains.select(lower_ascii(F.col("domain")).alias("domain"))
    cascade = build(host_universe(hosts, listed), first_rate, next_rate, slice_words)
    judged = parts.withColumn("listed", F.lit(False))
    for s in range(cascade.slices):
        mine = (F.col("host") != "") & (_slice(F.col("host"), cascade.slices) == s)
        judged = judged.withColumn("listed", F.when(mine, member(F.col("host"), cascade, s)).otherwise(F.col("listed")))
        if s + 1 < cascade.slices:  # the next slice's bits replace this one's
            judged = stage(judged, "judged-urls")
    rule = judged.withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return rule.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "listed")
