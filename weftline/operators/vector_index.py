"""A stored index of vectors for approximate search by dot product.

Vectors are dealt out to cells around centres (k-means on a bounded sample), and each row of the index is a
block of one cell's vectors: as bytes of what they differ from the centre by, and whole. Tables are partitioned
by cell, so that a search reads the cells that its queries look into and no others. The bytes rank a block's
vectors; as their largest error is known, no vector is lost by them, and those that may be among the
best are scored again from the whole vectors. What a search may miss is in cells that it doesn't look into: how
many it must look into is measured when the index is built. An exact search looks into as many as may hold anything better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import search as exact
from weftline.storage import dropped, saved

#: Most cells, vectors of the sample for each, and numbers of a block's whole vectors.
MOST_CELLS, SAMPLE_OF_CELL, BLOCK_NUMBERS = 4096, 256, 1 << 16
#: Rows of a cell that one task packs.
CELL_TASK_ROWS = 200_000
#: Vectors that are looked for when an index is built, and the recall of their ASKED_K nearest that the number of cells must reach.
ASKED, ASKED_K, RECALL = 256, 18, 0.95
#: Queries of a cell that are scored at once.
QUERIES_AT_ONCE = 256
SEED = 11
#: Stated, as a folder without partitions has none.
BLOCKS = "block long, codes binary, scales binary, error double, vectors binary, keys array<{}>, cell int"


@dataclass(frozen=True)
class VectorIndex:
    """blocks (cell, block, keys, codes, scales, error, vectors), and cells (cell, centre, radius, n) with the number
    to look into."""

    blocks: DataFrame
    cells: DataFrame
    probes: int

    def centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centres and radii of the cells; MOST_CELLS rows at most."""
        rows = self.cells.orderBy("cell").toPandas()
        dim = len(rows["centre"].iloc[0]) if len(rows) else 0
        return rows["cell"].to_numpy(), np.array(rows["centre"].tolist(), np.float64).reshape(len(rows), dim), rows["radius"].to_numpy()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _centres(rows: DataFrame, n: int, cells: int) -> np.ndarray:
    """Centres of a sample of SAMPLE_OF_CELL rows for each cell, those that hash lowest."""
    if n < 2:
        return np.array([rows.first()["v"]], np.float64)
    most = cells * SAMPLE_OF_CELL
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < int((1 << 32) * most / n))
    model = KMeans(k=cells, maxIter=12, seed=SEED, featuresCol="features").fit(rows.select(array_to_vector(F.col("v").cast("array<double>")).alias("features")))
    return np.stack(model.clusterCenters())


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (key, v) with the cell of the nearest centre and the distance from it."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "v")}
    half = (centres * centres).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cell = (x @ centres.T - half).argmax(1)
                away = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], ["key", "v", "cell", "away"])

    return rows.mapInArrow(run, f"key {kinds['key']}, v {kinds['v']}, cell int, away double")


def _blocks(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, block, keys, codes, scales, error, vectors) of sorted runs of a cell's rows."""
    key = assigned.schema["key"].dataType.simpleString()
    step = max(1, BLOCK_NUMBERS // centres.shape[1])

    def block(cell: int, number: int, keys: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        rest = x - centres[cell]
        scale = np.abs(rest).max(1) / 127
        scale[scale == 0] = 1
        codes = np.rint(rest / scale[:, None]).astype(np.int8)
        error = np.sqrt(((rest - codes * scale[:, None]) ** 2).sum(1)).max()
        values = [[cell], [number], [codes.tobytes()], [scale.tobytes()], [float(error)], [x.astype(np.float32).tobytes()]]
        arrays = [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([keys.to_pylist()], pa.list_(keys.type))], ["cell", "block", "codes", "scales", "error", "vectors", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            cells, x = batch.column(2).to_numpy(), _matrix(batch.column(1)) if batch.num_rows else None
            borders = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True]))) if batch.num_rows else [0]
            for a, b in zip(borders[:-1], borders[1:]):
                for at in range(a, b, step):
                    end = min(b, at + step)
                    yield block(int(cells[at]), (batch.column(3)[0].as_py() << 32) + n, batch.column(0).slice(at, end - at), x[at:end])
                    n += 1

    picked = assigned.select("key", "v", "cell", F.spark_partition_id().alias("task"))
    return picked.mapInArrow(run, f"cell int, block long, codes binary, scales binary, error double, vectors binary, keys array<{key}>")


def build(vectors: DataFrame, path: str, key: str = "key", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Writes the index of vectors to a folder. Null vectors are left out; all others have one length, and keys are
    distinct. Every row is indexed; centres come from a sample of SAMPLE_OF_CELL rows a cell. cells: about half the square root of
    the number of rows by default, MOST_CELLS at most."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("v IS NOT NULL")
    n, kind = rows.count(), rows.schema["key"].dataType.simpleString()
    if not n:
        spark.createDataFrame([], BLOCKS.format(kind)).write.partitionBy("cell").parquet(f"{path}/blocks")
        spark.createDataFrame([], "cell int, centre array<double>, radius double, n long").write.parquet(f"{path}/cells")
        spark.createDataFrame([(1, kind)], "probes int, key string").write.parquet(f"{path}/settings")
        return opened(spark, path)
    cells = min(MOST_CELLS, max(2, cells or round(n**0.5 / 2)))
    centres = _centres(rows, n, cells)
    assigned = saved(_assigned(rows, centres))
    by_cell = assigned.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    known.join(F.broadcast(by_cell), "cell").select("cell", "centre", "radius", "n").coalesce(1).write.parquet(f"{path}/cells")  # MOST_CELLS rows at most
    # A cell that holds a large share of all rows is dealt over several tasks.
    parts = by_cell.select("cell", F.ceil(F.col("n") / CELL_TASK_ROWS).alias("parts"))
    salted = assigned.join(F.broadcast(parts), "cell").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("parts")))
    dealt = salted.repartition("cell", "salt").sortWithinPartitions("cell").select("key", "v", "cell")
    _blocks(dealt, centres).write.partitionBy("cell").parquet(f"{path}/blocks")
    spark.createDataFrame([(_measured(assigned, n, centres), kind)], "probes int, key string").write.parquet(f"{path}/settings")
    dropped(assigned)
    return opened(spark, path)


def _measured(assigned: DataFrame, n: int, centres: np.ndarray) -> int:
    """How many cells to look into for the recall wanted: of ASKED rows or so, those that hash lowest, the exact neighbours are
    looked for, and at which place among the row's cells theirs comes."""
    asked = assigned.where(F.pmod(F.xxhash64(F.lit("asked"), "key"), F.lit(1 << 32)) < int((1 << 32) * min(1, ASKED / n)))
    asked = saved(asked.select(F.col("key").alias("query_id"), "v"))
    hits = exact.dense_search(asked, assigned, ASKED_K, vector="v")
    found = hits.join(assigned.select("key", "cell"), "key").join(asked, "query_id").select("cell", "v").toPandas()  # some ASKED * ASKED_K rows
    dropped(asked)
    if not len(found):
        return len(centres)
    score = np.array(found["v"].tolist(), np.float64) @ centres.T
    place = (score > score[np.arange(len(found)), found["cell"].to_numpy()][:, None]).sum(1)
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(RECALL * len(place))) - 1)]) + 1


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """The index in a folder."""
    settings = spark.read.parquet(f"{path}/settings").first()
    return VectorIndex(spark.read.schema(BLOCKS.format(settings["key"])).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/cells"), settings["probes"])


def _looked_into(index: VectorIndex, asked: DataFrame, probes: int | None, seen: int = 0) -> DataFrame:
    """(query_id, v, norm, cell) for queries (query_id, v): the cells with the best centres, or (probes None) those after the
    first seen ones that may hold a score of least or more, a column of asked."""
    cells, centres, radii = index.centres()
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("query_id", "v")}
    columns = ["query_id", "v"] + ["least"] * (probes is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(at, QUERIES_AT_ONCE)
                x = _matrix(part.column(1))
                score, norm = x @ centres.T, np.sqrt((x * x).sum(1))
                order = np.argsort(-score, axis=1, kind="stable")
                if probes is None:
                    later = np.zeros(score.shape, bool)
                    np.put_along_axis(later, order[:, seen:], True, axis=1)
                    least = np.nan_to_num(part.column(2).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                    q, c = np.nonzero(later & (score + norm[:, None] * radii >= least[:, None] - 1e-6))
                else:
                    c = order[:, :probes].ravel()
                    q = np.repeat(np.arange(len(x)), min(probes, len(cells)))
                taken = pa.array(q)
                yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), pa.array(norm[q]), pa.array(cells[c], pa.int32())], ["query_id", "v", "norm", "cell"])

    return asked.select(*columns).mapInArrow(run, f"query_id {kinds['query_id']}, v {kinds['v']}, norm double, cell int")


def _candidates(index: VectorIndex, looked: DataFrame, k: int) -> DataFrame:
    """(query_id, cell, block, place, low, high): of each block that a query looks into the vectors that may be among its k best, with bounds
    of their scores. Queries meet blocks as packs of up to QUERIES_AT_ONCE, so that no pair of a query and a vector is a row."""
    cells, centres, _ = index.centres()
    row_of = {int(c): i for i, c in enumerate(cells)}
    kind = looked.schema["query_id"].dataType.simpleString()
    order = Window.partitionBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id")
    packs = looked.withColumn("pack", F.floor((F.row_number().over(order) - 1) / QUERIES_AT_ONCE)).groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("deal"), "pack")
    packs = packs.agg(F.collect_list(F.struct("query_id", "v", "norm")).alias("asked")).select("cell", "asked.query_id", "asked.v", "asked.norm")
    wanted = [r[0] for r in looked.select("cell").distinct().collect()]  # MOST_CELLS at most
    blocks = index.blocks.where(F.col("cell").isin(wanted)).select("cell", "block", "codes", "scales", "error")
    # Packs are far larger than what Spark reckons from the table of queries: they are not to go through the driver.
    met = blocks.join(packs.hint("merge"), "cell").select("cell", "block", "codes", "scales", "error", "query_id", "v", "norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell, block, codes, scales, error = (batch.column(j)[i].as_py() for j in range(5))
                ids, v = batch.column(5)[i].values, batch.column(6)[i].values
                x, norm = _matrix(v), np.array(batch.column(7)[i].as_py())
                centre = centres[row_of[cell]]
                score = x @ centre
                score = score[:, None] + (x @ np.frombuffer(codes, np.int8).reshape(-1, len(centre)).T.astype(np.float64)) * np.frombuffer(scales)
                off = norm * error + 1e-9
                at = min(k, score.shape[1])
                least = np.partition(score, -at, axis=1)[:, -at]
                q, place = np.nonzero(score >= (least - 2 * off)[:, None])
                s = score[q, place]
                columns = [ids.take(pa.array(q)), pa.array(np.full(len(q), cell), pa.int32()), pa.array(np.full(len(q), block), pa.int64()), pa.array(place, pa.int32()), pa.array(s - off[q]), pa.array(s + off[q])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "cell", "block", "place", "low", "high"])

    return met.mapInArrow(run, f"query_id {kind}, cell int, block long, place int, low double, high double")


def _whole(index: VectorIndex, found: DataFrame) -> DataFrame:
    """(cell, block, place, key, v) of the candidates' vectors: each block is read once, whatever the number of its candidates."""
    key = index.blocks.schema["keys"].dataType.elementType.simpleString()
    wanted = found.select("cell", "block", "place").distinct().groupBy("cell", "block").agg(F.collect_list("place").alias("places"))
    cells = [r[0] for r in found.select("cell").distinct().collect()]  # MOST_CELLS at most
    met = index.blocks.where(F.col("cell").isin(cells)).select("cell", "block", "keys", "vectors").join(wanted.hint("merge"), ["cell", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell, block, vectors, places = (batch.column(c)[i].as_py() for c in ("cell", "block", "vectors", "places"))
                keys = batch.column("keys")[i].values
                x = np.frombuffer(vectors, np.float32).reshape(len(keys), -1)[places]
                n, dim = x.shape
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.ravel()))
                columns = [pa.array([cell] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(places, pa.int32()), keys.take(pa.array(places)), rows]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "block", "place", "key", "v"])

    return met.mapInArrow(run, f"cell int, block long, place int, key {key}, v array<float>")


def _best(index: VectorIndex, asked: DataFrame, looked: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score) of the k best in the cells looked into, and of what equals the last of them up to rounding."""
    found = saved(_candidates(index, looked, k))
    query = Window.partitionBy("query_id")
    numbered = found.withColumn("n", F.row_number().over(query.orderBy(F.desc("low"))))
    bound = numbered.withColumn("least", F.max(F.when(F.col("n") == k, F.col("low"))).over(query))
    kept = saved(bound.where(F.col("least").isNull() | (F.col("high") >= F.col("least") - 1e-6)).select("query_id", "cell", "block", "place"))
    # Vectors are joined by shuffles, however few: no vector goes through the driver.
    scored = kept.join(_whole(index, kept).hint("merge"), ["cell", "block", "place"]).join(asked.select("query_id", F.col("v").alias("q")).hint("merge"), "query_id")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    out = saved(scored.select("query_id", "key", F.round(score, 6).alias("score")))
    dropped(found)
    dropped(kept)
    return out


def search(index: VectorIndex, queries: DataFrame, k: int, vector: str = "embedding", probes: int | None = None, exactly: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k best by dot product for queries (query_id, vector), ties by key.

    probes: cells to look into, by default the number that was measured. exactly: cells that may hold something better
    than what these have are looked into as well, so that the result is that of a scan of all vectors. Null vectors are left out.
    Scores are exact, of the whole vectors.
    """
    asked = saved(queries.select("query_id", F.col(vector).alias("v")).where("v IS NOT NULL"))
    if not len(index.centres()[0]):
        return exact.dense_search(asked.limit(0), index.blocks.selectExpr("keys[0] AS key", "array(0D) AS v").limit(0), k, vector="v")
    probes = probes or index.probes
    found = _best(index, asked, _looked_into(index, asked, probes), k)
    if exactly:
        place = Window.partitionBy("query_id").orderBy(F.desc("score"))
        least = found.withColumn("n", F.row_number().over(place)).where(F.col("n") == k).select("query_id", F.col("score").alias("least"))
        more = saved(_looked_into(index, asked.join(least, "query_id", "left"), None, probes))
        found = found.unionByName(_best(index, asked, more, k))
    return exact.top_ranked(found, k)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of wanted hits (query_id, key) that were found."""
    both = wanted.select("query_id", "key").join(found.select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
