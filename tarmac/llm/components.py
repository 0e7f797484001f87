"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import discard, shuffle_partitions, stage

#: Edges that one task writes at most while all partitions are not in use.
TASK_EDGES = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b) that is not its component's smallest node.

    Each round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. Nodes without edges, and roots,
    do not appear. Only a count and a checksum come to the driver.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        stars, parts = _small_star(_large_star(now)), 1 + state[0] // TASK_EDGES
        if parts < shuffle_partitions(edges.sparkSession):  # few edges: no file for every partition in every round
            stars = stars.coalesce(parts)
        before, now = now, stage(stars, "stars")
        discard(before)
        last, state = state, _state(now)
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
