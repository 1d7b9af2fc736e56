"""What the operators need besides the library's storage: renamed columns and bounded samples."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.storage import BROADCAST_IDS, BROADCAST_ROWS, cleared, dropped, fits, removed, saved, session_dir, shared_dir, small

__all__ = ["BROADCAST_IDS", "BROADCAST_ROWS", "arrow_batches", "cleared", "dropped", "fits", "numbered", "removed", "sampled", "saved", "session_dir", "shared_dir", "small"]


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, what Spark runs hands at most so many rows at once to Python: for rows of many KB each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs with its columns renamed, so that no name clashes with another table's; the new name of each (of
    several equal names the first), and the columns that give the old names back."""
    new = [f"own_{i}" for i in range(len(docs.columns))]
    names = dict(reversed(list(zip(docs.columns, new, strict=True))))
    return docs.toDF(*new), names, [F.col(n).alias(c) for n, c in zip(new, docs.columns, strict=True)]


def sampled(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """About limit distinct rows of df at most (all, if there are no more): those that hash lowest in the
    columns by, all of which must be given to tell rows apart.

    A cut-off on the hash instead of a sort, so that no task gathers candidates, and reruns agree. Equal
    rows are combined before they are shuffled, and count once.
    """
    n = df.count()
    if n > limit:
        df = df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 32)) < int((1 << 32) * limit / n))
    return df.dropDuplicates(by)
