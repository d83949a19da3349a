"""Materialised intermediate tables in the shared folder of the cluster.

Operators that read one input several times (bucket counts, then ranks) need every read to see the same
values, also after an executor is lost. A written table gives that, and unlike a cached plan it keeps
column pruning and filter pushdown for the readers.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a task that sorts or groups wide rows; more rows make more tasks, so none of them spills.
TASK_ROWS = 400_000
_local_default: dict[str, str] = {}
_memo: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names for intermediate tables; a fresh local one in local mode only."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_default:
        _local_default[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_default[app]


def stage(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def deal(df: DataFrame, rows: int, *by: str, ordered: bool = False) -> DataFrame:
    """Rows dealt by a hash or, if ``ordered``, by ranges of ``by``: over tasks of about ``TASK_ROWS`` of the ``rows`` there are, however many partitions are set.

    Groups of ``by`` are then whole in a task, so an aggregate or window after it moves nothing and keeps no map of an input split's keys. Few rows are left to AQE.
    """
    parts = -(-rows // TASK_ROWS)
    at = [] if parts <= df.sparkSession.sparkContext.defaultParallelism else [parts]
    return (df.repartitionByRange if ordered else df.repartition)(*at, *by)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, the shuffle files of every action are removed when it ends; for chains of staged tables, which read nothing twice."""
    before = spark.conf.get(CLEANUP_SETTING)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


def open_store(folder: str):
    """The file system of a folder and the path there, for tasks that read or write plain files."""
    from pyarrow import fs
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return fs.LocalFileSystem(), folder


def input_state(spark: SparkSession, folder: str) -> str:
    """Names, lengths and times of what lies in a folder, without reading any of it; empty where it cannot be listed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return ""
    found = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in store.listStatus(path)]
    return hashlib.md5(repr(sorted(found)).encode()).hexdigest()


def forget(kept: tuple[str, ...] = ()) -> None:
    """Tables staged once are built anew when next asked for, but for those whose key holds one of ``kept``; for timing."""
    for key in [k for k in _memo if not any(name in k[1] for name in kept)]:
        del _memo[key]


def stage_once(spark: SparkSession, key: str, build, folder: str | None = None, partition_by: tuple[str, ...] = (),
               order: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Stage under a key once per application; later calls read the same table, unless the input ``folder`` has changed.

    With ``partition_by`` the table has a folder per value, dealt and sorted by ``order`` inside, so that filters on either skip files or
    row groups; ``dealt`` says that ``build`` has done that.
    """
    memo_key = (spark.sparkContext.applicationId, key if folder is None else f"{key}:{input_state(spark, folder)}")
    if memo_key not in _memo:
        df = build()
        path = f"{shared_folder(spark)}/shared-{uuid.uuid4().hex}"
        if partition_by and not dealt:
            df = df.repartitionByRange(*partition_by, *order).sortWithinPartitions(*partition_by, *order)
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
        _memo[memo_key] = path
    return spark.read.parquet(_memo[memo_key])
