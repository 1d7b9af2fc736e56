"""Shared storage for tables that cut lineage, and broadcasts whose size is checked first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows, of a few short columns each, may be broadcast (some MB).
BROADCAST_ROWS = 50_000
#: A table of one column of longs may have so many (about 20 MB as a hash table).
BROADCAST_IDS = 500_000
#: For tables of long arrays: a reader holds a group of rows whole, so groups are of few MB, and no larger when decoded.
LONG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset in local mode (tests), a temporary one; on a
    cluster that would be a folder of one machine, so there it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one."""
    return f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and the
    loss of an executor costs none of it. Results read such tables until they are written themselves;
    then dropped() or cleared() deletes them. options: those of the writer."""
    path = f"{session_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark knows."""
    its = spark._jvm.org.apache.hadoop.fs.Path(path)
    its.getFileSystem(spark._jsc.hadoopConfiguration()).delete(its, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from saved() that nothing reads any more."""
    removed(df.sparkSession, df.saved_at)


def cleared(spark: SparkSession) -> None:
    """Deletes all tables that saved() wrote in this application; for when all results are written."""
    removed(spark, session_dir(spark))


def fits(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows (or its weights sum up to no more), else
    as it is: then Spark shuffles, and splits skewed partitions at run time."""
    if weight is None:
        few = fits(df, limit)
    else:
        few = (df.agg(F.sum(weight)).first()[0] or 0) <= limit
    return F.broadcast(df) if few else df
