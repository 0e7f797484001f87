"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import discard, materialize, scratch, shared_dir  # noqa: F401

#: White space that separates words, as a character class body.
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that may be broadcast at most; wider joins are shuffled.
BROADCAST_ROWS = 100_000

stage = materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on: Column, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with the staged table ``small``: broadcast when its counted rows
    are within the bound, else a shuffled join whose hot keys AQE splits."""
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share."""
    return f"{shared_dir(spark)}/tarmac/stages/{name}-{uuid.uuid4().hex}"


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` as the columns ``needed`` and ``_row``, a struct of all of its columns: whatever those are called, no name clashes."""
    return docs.select(*[F.col(f"`{c}`") for c in needed], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unpacked(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    return df.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


_held: dict[str, object] = {}


def worker_cache(owner: str, make):
    """What a Python worker keeps between the batches and tasks of one operator. Another operator's is dropped:
    a worker serves many stages, and their caches together would not fit."""
    if owner not in _held:
        _held.clear()
        _give_back()
        _held[owner] = make()
    return _held[owner]


def _give_back() -> None:
    """Return freed memory to the system; else a worker keeps what its last operator needed at most."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most ``rows`` rows at once in the jobs run inside: bounds their memory where rows are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
