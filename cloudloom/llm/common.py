"""What the training-data operators share: the shared work folder, staged tables and hashing.

Intermediate results are cut from their lineage by writing them as Parquet into the folder that
all executors share (``spark.checkpoint.dir``), so a lost executor never takes the only copy.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the session is local and names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="cloudloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/cloudloom-{uuid.uuid4().hex}/{name}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            remove_path(spark, path.rpartition("/")[0])

    atexit.register(remove)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path by Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that worker processes fill during a task, by the operator that fills them.
_TABLES: dict[str, list[dict]] = {}


def kept(owner: str, table: dict) -> dict:
    """Register a table of ``owner``."""
    _TABLES.setdefault(owner, []).append(table)
    return table


def release(owner: str) -> None:
    """Empty the tables of ``owner`` in this process and hand the memory back."""
    for table in _TABLES.get(owner, ()):
        if hasattr(table, "old"):
            table.old = {}
        table.clear()
    give_back()


def give_back() -> None:
    """Hand memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def tables(owner: str) -> Iterator[None]:
    """A task's use of the tables of ``owner``: workers outlive their tasks, and idle ones would keep what they have filled."""
    try:
        yield
    finally:
        release(owner)


#: Rows and bytes of a column that become Python objects at once.
PIECE_ROWS, PIECE_BYTES = 2000, 4 << 20


def pieces(column: pa.Array, most_rows: int = PIECE_ROWS, most_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, list]]:
    """(first row, values) of runs of a text column, each of a few MB unless a single value is larger."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        base = ends[at - 1] if at else 0
        to = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right"))), n)
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def utf8_crc32(column: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes."""
    return F.crc32(column.cast("string").cast("binary"))


def id_crc32(column: Column) -> Column:
    """Unsigned CRC-32 of an integer id written as decimal text."""
    return F.crc32(column.cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on arrays of ``uint64`` (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on ``seed`` alone."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
