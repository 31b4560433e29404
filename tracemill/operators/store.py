"""Written intermediate tables in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        # one machine, as in tests
        told = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        spark.conf.set("spark.checkpoint.dir", told)
    at = spark._jvm.org.apache.hadoop.fs.Path(told)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()  # Spark and pyarrow then mean the same place
    return ("file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/tracemill-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """`df` written and read again: later uses see one result, and lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discarded(*tables: DataFrame) -> None:
    """Delete tables that `materialised` made and nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table.scratch_path)


def swept(spark: SparkSession) -> None:
    """Delete all tables of this application; to be called when its results are stored elsewhere."""
    delete(spark, f"{shared_dir(spark)}/tracemill-tables/{spark.sparkContext.applicationId}")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
