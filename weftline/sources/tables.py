"""Keyed tables in folders of Parquet, with committed versions.

A write makes a new folder of rows (a segment) and then a manifest, which lists the segments that make up the
version. Readers take the manifest with the highest number, so that a write is seen whole or not at all, and
what a failed write leaves is seen by nobody. A manifest's number can be taken once: of two writers one
has to look at the other's version first. Manifests also hold each writer's last batch, so that a batch that
is tried again, as streams do after a failure, writes nothing twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.storage import removed

#: Columns that segments have besides their rows' own.
SEGMENT, GONE = "_segment", "_gone"


class Conflict(Exception):
    """Another writer's version came first, and this write can't be put on top of it."""


@dataclass
class Manifest:
    """version 0 is the table before its first write. writers: each writer's last batch."""

    version: int = 0
    segments: list[str] = field(default_factory=list)
    writers: dict[str, int] = field(default_factory=dict)


class Table:
    """A table with the columns of schema (DDL), of which keys name a row.

    Rows with a null in a key are like others, and equal keys are one row, the last written. Of several rows with one key
    in a write the one with the largest order counts (default: any, and then they should be equal).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        context = spark._jvm.org.apache.hadoop.fs
        self._at = context.Path(f"{self.path}/_manifests")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._at, name)

    def manifest(self, version: int | None = None) -> Manifest:
        """The current version's manifest, or that of another version that is still there."""
        numbers = self._numbers()
        if version is None and not numbers:
            return Manifest()
        number = numbers[-1] if version is None else version
        if number not in numbers:
            raise ValueError(f"{self.path} has no version {number}")
        stream = self._fs.open(self._file(f"{number:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _committed(self, new: Manifest) -> bool:
        """Puts a manifest in place if its number is free: it is written under another name and then renamed, so that
        nobody sees half of it."""
        temporary, final = self._file(f".{uuid.uuid4().hex}"), self._file(f"{new.version:09d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(temporary, final, none)
        except Exception as error:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def _commit(self, segments: list[str], batch: tuple[str, int] | None, on: Manifest | None = None) -> Manifest:
        """Adds segments to the current version, or puts them in place of those of a version, which must still be the
        current one."""
        while True:
            now = self.manifest()
            if batch and now.writers.get(batch[0], -1) >= batch[1]:
                return now
            if on and on.version != now.version:
                raise Conflict(f"{self.path} is at version {now.version}, not {on.version}")
            kept = [] if on else now.segments
            new = Manifest(now.version + 1, kept + segments, now.writers | (dict([batch]) if batch else {}))
            if self._committed(new):
                return new

    def _segment(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _last(self, rows: DataFrame, order: Column) -> DataFrame:
        """Of each key the row with the largest order. An aggregate, so that rows of a hot key are combined before they
        are shuffled."""
        names = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names), order).alias("_best"))
        return best.select(*self.keys, "_best.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current version, or of an older one that is still there; empty before the first write."""
        own = self.spark.createDataFrame([], self.schema)
        segments = self.manifest(version).segments
        if not segments:
            return own
        kind = f"{self.schema}, {GONE} boolean"
        parts = [self.spark.read.schema(kind).parquet(f"{self.path}/{s}").withColumn(SEGMENT, F.lit(i)) for i, s in enumerate(segments)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if len(parts) > 1:
            rows = self._last(rows, F.col(SEGMENT))
        return rows.where(f"{GONE} IS NULL").select(*own.columns)

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None, order: Column | None = None) -> Manifest:
        """Adds rows or puts them in place of those with their keys, and takes out the keys of gone (a key in both is
        taken out). batch: the writer's name and a number that grows; a batch that was committed is not written again."""
        now = self.manifest()
        if batch and now.writers.get(batch[0], -1) >= batch[1]:
            return now
        own = [c for c in self.spark.createDataFrame([], self.schema).columns]
        if order is None:
            rows = rows.select(*own).dropDuplicates(self.keys)
        else:
            rows = self._last(rows.select(*own, order.alias("_order")), F.col("_order")).select(*own)
        rows = rows.withColumn(GONE, F.lit(None).cast("boolean"))
        if gone is not None:
            out = gone.select(*self.keys).distinct()
            rows = rows.join(out, [F.equal_null(rows[k], out[k]) for k in self.keys], "left_anti")
            rows = rows.unionByName(out.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        return self._commit([self._segment(rows)], batch)

    def replace(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> Manifest:
        """Puts rows in place of all rows; raises Conflict if another writer was faster."""
        now = self.manifest()
        if batch and now.writers.get(batch[0], -1) >= batch[1]:
            return now
        own = self.spark.createDataFrame([], self.schema).columns
        rows = rows.select(*own).dropDuplicates(self.keys).withColumn(GONE, F.lit(None).cast("boolean"))
        return self._commit([self._segment(rows)], batch, on=now)

    def compact(self) -> Manifest:
        """Makes one segment of all, so that reading needs no shuffle."""
        now = self.manifest()
        if len(now.segments) < 2:
            return now
        rows = self.read(now.version).withColumn(GONE, F.lit(None).cast("boolean"))
        return self._commit([self._segment(rows)], None, on=now)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the newest versions, and the folders that no kept version has: old ones and those of failed
        writes. For when no writer or reader of an older version is at work. Returns the number of folders."""
        numbers = self._numbers()
        kept = {s for n in numbers[-keep:] for s in self.manifest(n).segments}
        for n in numbers[:-keep]:
            self._fs.delete(self._file(f"{n:09d}.json"), False)
        root = self._at.getParent()
        found = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        old = [n for n in found if n != self._at.getName() and n not in kept]
        for n in old:
            removed(self.spark, f"{self.path}/{n}")
        return len(old)
