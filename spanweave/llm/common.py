"""Helpers shared by the corpus operators: scratch tables, batch slicing, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles at once.
SLICE_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that runs in one process may go without: it gets a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "spanweave-scratch")
    return root.rstrip("/")


#: Scratch tables that results still read; they go with the session.
_leftovers: list[tuple[SparkSession, str]] = []


def _drop_leftovers() -> None:
    while _leftovers:
        with contextlib.suppress(Exception):  # the session may have ended before
            drop_path(*_leftovers.pop())


atexit.register(_drop_leftovers)


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/spanweave/{label}-{uuid.uuid4().hex}"
    _leftovers.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back; what follows no longer depends on df's lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Scratch tables that go when the work is done: what is returned must not read them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, label), 0

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        return self.kept(df, label)[0]

    def kept(self, df: DataFrame, label: str) -> tuple[DataFrame, str]:
        """A staged table and its path, for dropping it early."""
        self.count += 1
        path = f"{self.root}/{self.count}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        drop_path(self.spark, self.root)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of stages whose result has been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim_memory() -> None:
    """Gives freed memory of large arrays back to the system, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """A function of record batches whose worker gives memory back before and after: workers outlive their tasks, and what they keep is missing to the executor."""

    def whole(batches):
        trim_memory()
        yield from run(batches)
        trim_memory()

    return whole


def plain_strings(col) -> pa.Array:
    """A string column with nulls as empty strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    return pc.fill_null(col, "")


def slices(batches: Iterator[pa.RecordBatch], text: str | int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts record batches so that the text column of each piece has about `most` bytes (one row at least). text: name or place of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = plain_strings(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // most
        cut = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


def fresh(names, wanted: str) -> str:
    """A column name that none of `names` has (Spark compares them without case)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit integers (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
