"""Shared helpers: lineage cuts in shared storage, and whole-table readers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one set here where none is (single machine)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="locusforge-")
    context.setCheckpointDir(local)
    return shared_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable shared storage and read it from there."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session is gone; the folder goes with the cluster's own clean-up
            return
    _written.clear()


atexit.register(_remove_written)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system and path object of ``path``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in shared storage that is removed when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stash(df: DataFrame, kind: str = "stash") -> DataFrame:
    """Write ``df`` as Parquet in shared storage and read it again; for wide rows, which compress well."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name as it is, whatever dots or quotes it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a scan, dealt out by ``key`` if the files give fewer partitions than there are cores: files of one row group
    would keep one core busy with work in Python. Larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, F.col(quoted(key))) if rows.rdd.getNumPartitions() < cores else rows


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


@lru_cache(maxsize=1)
def hold_freed() -> None:
    """Let this process keep up to 32 MB that it freed until ``give_back``: arrays of some 100 KB that come and go are else
    mapped anew each time, and every page of them faults."""
    try:
        set_option = ctypes.CDLL("libc.so.6").mallopt
    except (OSError, AttributeError):  # another C library
        return
    set_option(-1, 32 << 20)  # M_TRIM_THRESHOLD
    set_option(-3, 16 << 20)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Hand memory that was freed back to the system: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator, max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator:
    """Arrow batches cut into pieces of bounded size, so that a worker's memory does not follow the batch size."""
    try:
        yield from _pieces(batches, max_bytes, max_rows)
    finally:
        give_back()


def _pieces(batches: Iterator, max_bytes: int, max_rows: int) -> Iterator:
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(max_rows, int(rows * max_bytes / max(1, batch.nbytes))))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
