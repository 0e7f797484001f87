"""Session construction and the shared folder for materialised tables."""

from __future__ import annotations

import os
import tempfile
import threading
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "tarmac", shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local session tuned for the small test scales.

    On a cluster pass your own session instead: nothing in the library
    depends on these settings except that AQE should stay on.
    """
    n = (os.cpu_count() or 8) if cores == "*" else int(cores)
    parts = shuffle_partitions or max(4, 2 * int(n))
    builder = SparkSession.builder
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage-cutting tables: the cluster's ``spark.checkpoint.dir``.

    Only when that is unset and the master is local do we create our own
    (tests); on a cluster a machine-local folder would be invisible to the
    other executors, so we refuse instead.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # Spark Connect has no SparkContext
            d = None
    if d:
        return d.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    d = tempfile.mkdtemp(prefix="tarmac-ckpt-")
    try:
        spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir() or d
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): plain folder only
        return d


#: Beyond this many bytes of code a fused stage is run operator by operator.
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: The JVM interprets a larger method for every row instead of compiling it.
_COMPILED_BYTES = "8000"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside keep to generated methods that the JVM compiles: for
    writes of wide rows, whose columns fused with joins exceed that."""
    before = spark.conf.get(_METHOD_LIMIT, None)
    spark.conf.set(_METHOD_LIMIT, _COMPILED_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_METHOD_LIMIT)
        else:
            spark.conf.set(_METHOD_LIMIT, before)


#: Spark removes the shuffle files of a finished execution when this is set.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group of staged tables: a task holds one while it writes, which with wide rows should not be the default's 128 MB.
ROW_GROUP = 16 << 20
_SCOPES: list[list[DataFrame]] = []


def materialize(df, name: str = "stage", compression: str = "snappy"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a reader: cuts the lineage (lost executors re-read the files) and,
    unlike ``DataFrame.checkpoint`` on an unpersisted plan, computes the input
    only once. The write's shuffle files go when it is done; the table stays
    until it is discarded (see ``discard`` and ``scratch``)."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarmac/stages/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    table = spark.read.parquet(path)
    table._staged = path
    if _SCOPES:
        _SCOPES[-1].append(table)
    return table


def discard(*tables) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_staged", None)
        if path:
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            table._staged = None


@contextmanager
def scratch() -> Iterator[list]:
    """Tables staged inside are discarded at the end, but for those appended to the list that this gives."""
    stay: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield stay
    finally:
        made = _SCOPES.pop()
        discard(*[t for t in made if not any(t is s for s in stay)])
        if _SCOPES:
            _SCOPES[-1].extend(stay)


#: Kept frames at most; beyond, the one that was used least recently goes.
KEPT_FRAMES = 64
_KEPT: OrderedDict[tuple[str, int], DataFrame] = OrderedDict()
_KEPT_LOCK = threading.RLock()


def keep(df: DataFrame) -> DataFrame:
    """Have ``df`` computed once, by whichever query needs it first, for all
    that read it: a small aggregate that several plans share.

    Nothing runs here. The rows lie in the executors' storage (memory, then
    their disks); those of a lost executor are computed again from the data.
    An equal plan over the same files gets the frame that is kept already.
    ``release`` gives the storage back; beyond ``KEPT_FRAMES`` the least
    recently used frame is given back by itself.
    """
    key = (_application(df.sparkSession), df.semanticHash())
    with _KEPT_LOCK:
        held = _KEPT.get(key)
        if held is not None and held.sameSemantics(df):
            _KEPT.move_to_end(key)
            return held
        _KEPT[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
        while len(_KEPT) > KEPT_FRAMES:
            _KEPT.popitem(last=False)[1].unpersist()
        return df


def _application(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def release(frames: list[DataFrame] | None = None) -> None:
    """Give back the storage of kept frames (all of them by default)."""
    with _KEPT_LOCK:
        for key, df in list(_KEPT.items()):
            if frames is None or any(df is f for f in frames):
                del _KEPT[key]
                df.unpersist()


@contextmanager
def keeping() -> Iterator[None]:
    """Frames first kept inside are released at the end."""
    with _KEPT_LOCK:
        before = {id(f) for f in _KEPT.values()}
    try:
        yield
    finally:
        with _KEPT_LOCK:
            release([f for f in _KEPT.values() if id(f) not in before])
