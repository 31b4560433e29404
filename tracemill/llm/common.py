"""Shared helpers: reading tables, scratch tables in the shared folder, Arrow row batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.skew import salted_join  # noqa: F401
from tracemill.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Where a session on one machine has none (small tests) a temporary folder becomes the checkpoint folder; on a cluster that
    would be a folder of each machine's own, so a session without the setting is an error there.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        spark.conf.set("spark.checkpoint.dir", told)
        spark.sparkContext.setCheckpointDir(told)
    at = spark._jvm.org.apache.hadoop.fs.Path(told)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()  # Spark and pyarrow then mean the same place
    return ("file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/tracemill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` made and nothing reads any more."""
    for table in tables:
        spark, at = table.sparkSession, table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; to be called when its results are stored elsewhere."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tracemill/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_text(name: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of `batch` with about `limit` bytes of `column` each (one row at least)."""
    sizes = pa.compute.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if batch.num_rows > begin:
        yield batch.slice(begin)


def file_system(path: str):
    """pyarrow's file system of a path, and the path within it."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def trimmed() -> None:
    """Hand freed memory back to the system at the end of a task; a Python worker lives on for other tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
