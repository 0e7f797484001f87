"""Writers: CSV files, tables, JDBC, and one export per analysis.

All writes are parallel (one file per task) and idempotent (``overwrite``);
nothing is funnelled through the driver. ``single_file=True`` coalesces to
one task and is meant for report-sized results only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """Header CSV, no index column; NULL written as an empty field."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_table(df: DataFrame, name: str, path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Replace-load a catalog table (external when ``path`` is given) and return it."""
    w = df.write.mode(mode).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None,
               batch_size: int = 5000, mode: str = "overwrite") -> None:
    """Replace-load a database table over JDBC in multi-row batches (the
    reference loads 5,000 rows per INSERT). Each task opens its own
    connection; cap ``numPartitions`` to what the database accepts."""
    props = {"batchsize": str(batch_size), **(properties or {})}
    df.write.mode(mode).jdbc(url, table, properties=props)


#: Exports written at the same time.
WRITERS = 6


def export_all(results: Mapping[str, Callable[[], DataFrame]], root: str, fmt: str = "parquet") -> dict[str, tuple[str, int]]:
    """Write each named result under ``root/<name>``; returns name -> (path, rows).

    Each is written by its own job, a file per task, several jobs at a time;
    rows are counted while they are written. Results that share kept
    aggregates compute them once, whichever comes first.
    """
    def write(name: str) -> tuple[str, int]:
        path, seen = f"{root.rstrip('/')}/{name}", Observation()
        df = results[name]().observe(seen, F.count(F.lit(1)).alias("rows"))
        (write_csv if fmt == "csv" else write_parquet)(df, path)
        return path, seen.get["rows"]

    names = list(results)
    if not names:
        return {}
    first = {names[0]: write(names[0])}  # what the results share is ready after it
    with ThreadPoolExecutor(WRITERS) as pool:
        return first | dict(zip(names[1:], pool.map(write, names[1:])))


def export_manifest(spark: SparkSession, written: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Row count of every export."""
    return spark.createDataFrame([(name, rows) for name, (_, rows) in written.items()], "export_name string, rows bigint")


class VersionedTable:
    """A replace-loaded table behind one name.

    Each load writes a new version in a folder of its own and then switches
    the pointer, a small table of (version, written); the view of the table's
    name follows. Who reads an older version goes on doing so until ``drop_old``
    removes it, and a load that fails leaves the current version as it is.
    """

    def __init__(self, spark: SparkSession, name: str, root: str):
        self.spark, self.name, self.root = spark, name, root.rstrip("/")

    def versions(self) -> list[str]:
        """All versions, the current one last."""
        try:
            rows = self.spark.read.schema("version string, written timestamp").parquet(f"{self.root}/pointer").orderBy("written", "version").collect()
        except AnalysisException:  # nothing loaded yet
            return []
        gone = set(self._gone())
        return [r["version"] for r in rows if r["version"] not in gone]

    def load(self, df: DataFrame) -> DataFrame:
        """Replace the table's rows; returns the new version."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{version}")
        switch = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written"))
        switch.coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")
        return self.current()

    def current(self) -> DataFrame:
        """The current version, also as the view of the table's name."""
        df = self.read(self.versions()[-1])
        df.createOrReplaceTempView(self.name)
        return df

    def read(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version}")

    def drop_old(self, keep: int = 1) -> list[str]:
        """Remove the files of all but the newest ``keep`` versions; their readers must be done."""
        old = self.versions()[:-keep]
        for version in old:
            # An empty overwrite: Spark removes the files in any store that it can write.
            path = f"{self.root}/{version}"
            self.spark.createDataFrame([], self.spark.read.parquet(path).schema).coalesce(1).write.mode("overwrite").parquet(path)
        if old:
            self.spark.createDataFrame([(v,) for v in old], "version string").coalesce(1).write.mode("append").parquet(f"{self.root}/gone")
        return old

    def _gone(self) -> list[str]:
        try:
            return [r["version"] for r in self.spark.read.schema("version string").parquet(f"{self.root}/gone").collect()]
        except AnalysisException:
            return []
