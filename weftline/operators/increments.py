"""Incremental work: what is not done yet, keyed upserts, aligned lookups, versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(candidates: DataFrame, done: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Candidates whose keys are not done: a left anti join; Spark broadcasts done if it is small."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return candidates.join(done.select(*keys), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: str | Sequence[str], version: str | None = None) -> DataFrame:
    """old with the rows of new added or put in place by key; of several new rows of a key the one
    with the largest version counts (without a version keys of new must be distinct)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if version:
        last = Window.partitionBy(*keys).orderBy(F.desc(version))
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return pending(old, new, keys).unionByName(new)


def aligned(rows: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """rows with lookup's value; a row without one fails the job."""
    joined = rows.join(lookup.select(key, value), key, "left")
    found = F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit(f"no {value} for "), F.col(key).cast("string")))).otherwise(F.col(value))
    return joined.withColumn(value, found)


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Writes a new version beside the ones that may be read just now, and returns its folder."""
    folder = f"{path}/version={version:06d}"
    df.write.mode("errorifexists").parquet(folder)
    return folder
