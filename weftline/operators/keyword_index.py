"""A stored inverted index: texts are tokenised once, and searched as often as wanted.

Documents are put in shards by their number of tokens, as scores grow with it. A shard's postings are a row of arrays for each
part of the buckets, so that rows are few and what is done with postings is done in arrays. A search first meets
queries, packed likewise, with the largest frequency of each bucket in a shard: what a
shard's documents can reach at most is the sum of a query's weights times them. Shards that can't reach the
score that k documents of the most promising shard have are left out, so that only the postings of the rest are read
and scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import sparse
from weftline.functions.text import BUCKETS
from weftline.storage import LONG_ROWS, dropped, fits, saved, small

#: Documents of a shard, and postings: so many, but no more postings than that (one document at least).
SHARD_DOCS, SHARD_POSTINGS = 512, 1 << 19
#: Folders that a table of postings is dealt over by bucket, so that a search reads those of its buckets only.
PARTS = 32
#: Stated, as a folder without partitions has none.
POSTINGS = "shard long, buckets array<int>, counts array<int>, places array<int>, tfs array<double>, part int"
#: Queries of a pack, and their terms: so many, but no more terms than that (one query at least).
PACK_QUERIES, PACK_TERMS = 1024, 1 << 15
#: So many packs may be broadcast (some MB).
BROADCAST_PACKS = 16
#: Meetings of a posting with a query that are worked out at once.
MEETINGS_AT_ONCE = 1_000_000
#: Slack for sums in another order.
SLACK = 1e-9


@dataclass(frozen=True)
class KeywordIndex:
    """The tables of an index: postings (part, shard, buckets, counts, places, tfs), of each bucket so many places and tfs one
    after another; maxima (shard, buckets, most), shards (shard, keys) and weights (bucket, df, idf)."""

    postings: DataFrame
    maxima: DataFrame
    shards: DataFrame
    weights: DataFrame


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of values: from each of the ends to the next."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers (0 at least) begin."""
    return np.flatnonzero(np.diff(x, prepend=-1))


def _sharded(docs: DataFrame) -> DataFrame:
    """(shard, part, keys, buckets, most, counts, places, tfs) of rows (key, buckets, tfs, n): of a shard a row for each part of its
    buckets, and one with a null part that has its keys and the maxima of all its buckets."""
    key = docs.schema["key"].dataType
    ordered = docs.repartitionByRange(F.desc("n"), "key").sortWithinPartitions(F.desc("n"), "key")
    picked = ordered.select("key", "buckets", "tfs", F.spark_partition_id().alias("task"))

    def shard_rows(held: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
        keys, buckets, tfs = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        flat, tf = buckets.flatten().to_numpy(), tfs.flatten().to_numpy()
        place = np.repeat(np.arange(len(keys)), np.diff(buckets.offsets.to_numpy()))
        order = np.argsort(flat % PARTS * np.int64(BUCKETS) + flat, kind="stable")
        flat, tf, place = flat[order], tf[order], place[order]
        first = _starts(flat)
        there, ends = flat[first], np.append(first, len(flat))
        begin = _starts(there % PARTS)
        runs = np.append(begin, len(there))
        null = lambda kind, rows: pa.nulls(rows, pa.list_(kind))
        columns = [
            pa.array(np.full(len(runs), (held[0].column(3)[0].as_py() << 32) + n), pa.int64()),
            pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(there[begin] % PARTS, pa.int32())]),
            pa.array([keys.to_pylist()] + [None] * len(begin), pa.list_(keys.type)),
            pa.concat_arrays([_lists(there, [0, len(there)], pa.int32()), _lists(there, runs, pa.int32())]),
            pa.concat_arrays([_lists(np.maximum.reduceat(tf, first), [0, len(there)], pa.float64()), null(pa.float64(), len(begin))]),
            pa.concat_arrays([null(pa.int32(), 1), _lists(np.diff(ends), runs, pa.int32())]),
            pa.concat_arrays([null(pa.int32(), 1), _lists(place, ends[runs], pa.int32())]),
            pa.concat_arrays([null(pa.float64(), 1), _lists(tf, ends[runs], pa.float64())]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "part", "keys", "buckets", "most", "counts", "places", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, rows, size = 0, [], 0, 0
        for batch in batches:
            upto = np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy(), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(upto, upto[at] + SHARD_POSTINGS - size, side="right")) - 1
                end = min(at + SHARD_DOCS - rows, batch.num_rows, max(fit, at if held else at + 1))
                if end > at:
                    held.append(batch.slice(at, end - at))
                rows, size, at = rows + end - at, size + int(upto[end] - upto[at]), end
                if at < batch.num_rows or rows == SHARD_DOCS:
                    yield shard_rows(held, n)
                    n, held, rows, size = n + 1, [], 0, 0
        if held:
            yield shard_rows(held, n)

    lists = "buckets array<int>, most array<double>, counts array<int>, places array<int>, tfs array<double>"
    return picked.mapInArrow(run, f"shard long, part int, keys array<{key.simpleString()}>, {lists}")


def inverse_frequency(n_docs, df):
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def changed_frequencies(df: DataFrame, before: DataFrame, after: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(bucket, df) after a change, from (bucket, df) and the changed documents as they were and as they are: a document that is
    new isn't in before, one that is deleted isn't in after. Only changed texts are tokenised; equal to counting all anew."""
    parts = [sparse.postings(rows.select(F.col(key).alias("key"), F.col(text).alias("t")), "key", "t").select("bucket", F.lit(sign).cast("long").alias("df")) for rows, sign in ((after, 1), (before, -1))]
    summed = parts[0].unionByName(parts[1]).groupBy("bucket").agg(F.sum("df").alias("df"))
    merged = df.select("bucket", "df").unionByName(summed).groupBy("bucket").agg(F.sum("df").alias("df"))
    return merged.where(F.col("df") > 0)


def _counted(postings: DataFrame) -> DataFrame:
    """(bucket, df) of the postings of an index; a task sums up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), minlength=BUCKETS).astype(np.int64)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(df[there])], ["bucket", "df"])

    return postings.select("buckets", "counts").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def build(docs: DataFrame, path: str, key: str = "key", text: str = "text", wanted: np.ndarray | None = None) -> KeywordIndex:
    """Writes the index of docs to a folder. wanted: a flag for each bucket, where only some will be asked for.

    A document without tokens is in no shard, but counts for the weights; a null text is empty. Keys should be distinct.
    """
    spark = docs.sparkSession
    rows = saved(sparse.documents(docs.select(F.col(key).alias("key"), F.col(text).alias("t")), "key", "t", np.ones(BUCKETS, bool) if wanted is None else wanted))
    sharded = saved(_sharded(rows), **LONG_ROWS)
    dropped(rows)
    postings = sharded.where("part IS NOT NULL").select("shard", "buckets", "counts", "places", "tfs", "part")
    # Many shards have each part, so its rows are dealt by shard, too.
    spread = postings.repartition("part", (F.col("shard") % 8)).sortWithinPartitions("part", "shard")
    spread.write.options(**LONG_ROWS).partitionBy("part").parquet(f"{path}/postings")
    whole = sharded.where("part IS NULL")
    whole.select("shard", "buckets", "most").write.options(**LONG_ROWS).parquet(f"{path}/maxima")
    whole.select("shard", "keys").write.parquet(f"{path}/shards")
    n = docs.select(F.count_distinct(key)).first()[0]
    _counted(postings).select("bucket", "df", inverse_frequency(F.lit(n), F.col("df")).alias("idf")).write.parquet(f"{path}/weights")
    dropped(sharded)
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> KeywordIndex:
    """The index in a folder."""
    return KeywordIndex(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), *[spark.read.parquet(f"{path}/{name}") for name in ("maxima", "shards", "weights")])


def _terms(index: KeywordIndex, queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query_id, bucket, weight): what queries ask for of an index."""
    asked = sparse.postings(queries.select(F.col(query).alias("query_id"), F.col(text).alias("t")), "query_id", "t")
    # A query that stands in the table twice is one.
    asked = asked.groupBy("query_id", "bucket").agg(F.max("tf").alias("tf"))
    return asked.join(small(index.weights), "bucket").select("query_id", "bucket", (F.col("tf") * F.col("idf")).alias("weight"))


def _packed(terms: DataFrame) -> DataFrame:
    """(pack, ids, q, buckets, weights) of terms (query_id, bucket, weight), to be saved: a row has several queries, and their terms
    ordered by bucket, each with the place of its query in ids."""
    kind = terms.schema["query_id"].dataType.simpleString()
    size = terms.agg(F.count_distinct("query_id"), F.count("*")).first()
    rows = terms.groupBy("query_id").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("weight").alias("weights"))
    rows = rows.coalesce(max(1, -(-size[0] // PACK_QUERIES), -(-size[1] // PACK_TERMS))).select("query_id", "buckets", "weights", F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            upto = np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy(), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(upto, upto[at] + PACK_TERMS, side="right")) - 1
                end = min(at + PACK_QUERIES, batch.num_rows, max(fit, at + 1))
                part = batch.slice(at, end - at)
                buckets = part.column(1).flatten().to_numpy()
                order = np.argsort(buckets, kind="stable")
                q = np.repeat(np.arange(part.num_rows), np.diff(upto[at : end + 1]))[order]
                lists = [pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *[_lists(x, [0, len(x)], t) for x, t in ((q, pa.int32()), (buckets[order], pa.int32()), (part.column(2).flatten().to_numpy()[order], pa.float64()))]]
                yield pa.RecordBatch.from_arrays([pa.array([(part.column(3)[0].as_py() << 32) + n], pa.int64()), *lists], ["pack", "ids", "q", "buckets", "weights"])
                n, at = n + 1, end

    return rows.mapInArrow(run, f"pack long, ids array<{kind}>, q array<int>, buckets array<int>, weights array<double>")


def _row(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    """Lists of numbers in a row of a batch."""
    return [batch.column(name)[i].values.to_numpy() for name in names]


def _few(packs: DataFrame) -> DataFrame:
    return F.broadcast(packs) if fits(packs, BROADCAST_PACKS) else packs


def reachable(index: KeywordIndex, packs: DataFrame) -> DataFrame:
    """(query_id, pack, q, shard, most): what a shard's documents can reach at most, for packs of queries."""
    met = index.maxima.withColumnRenamed("buckets", "there").crossJoin(_few(packs))
    kind = packs.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full(BUCKETS, -1.0)
        for batch in batches:
            for i in range(batch.num_rows):
                there, most, q, buckets, weights = _row(batch, i, "there", "most", "q", "buckets", "weights")
                top[there] = most
                tf = top[buckets]
                top[there] = -1
                met = tf >= 0
                ids = batch.column("ids")[i].values
                # A weight may be below 0 where keys aren't distinct.
                sums = np.bincount(q[met], np.maximum(weights[met], 0) * tf[met], minlength=len(ids))
                found = np.flatnonzero(np.bincount(q[met], minlength=len(ids)))
                same = [pa.array(np.full(len(found), batch.column(c)[i].as_py()), pa.int64()) for c in ("pack", "shard")]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found)), same[0], pa.array(found, pa.int32()), same[1], pa.array(sums[found], pa.float64())], ["query_id", "pack", "q", "shard", "most"])

    return met.select("shard", "there", "most", "pack", "ids", "q", "buckets", "weights").mapInArrow(run, f"query_id {kind}, pack long, q int, shard long, most double")


def _only(postings: DataFrame, used: np.ndarray) -> DataFrame:
    """(shard, buckets, counts, places, tfs) of the used buckets. used: a flag for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            buckets, counts, places, tfs = (batch.column(i).flatten().to_numpy() for i in range(1, 5))
            keep = used[buckets]
            each = np.repeat(keep, counts)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[keep]
            buckets, counts = buckets[keep], counts[keep]
            ends, upto = (np.append(0, np.cumsum(np.bincount(row, w, minlength=batch.num_rows))) for w in (None, counts))
            columns = [_lists(buckets, ends, pa.int32()), _lists(counts, ends, pa.int32()), _lists(places[each], upto, pa.int32()), _lists(tfs[each], upto, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["shard", "buckets", "counts", "places", "tfs"])

    picked = postings.select("shard", "buckets", "counts", "places", "tfs")
    return picked.mapInArrow(run, "shard long, buckets array<int>, counts array<int>, places array<int>, tfs array<double>")


def _scores(index: KeywordIndex, packs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, shard, place, score) of the wanted (pack, q, shard, least): of a shard's documents the k best for a query
    and those equal to the last, if they have the least score."""
    there = [r[0] for r in packs.select(F.explode("buckets").alias("bucket")).distinct().collect()]  # BUCKETS numbers at most
    used = np.zeros(BUCKETS, bool)
    used[there] = True
    postings = index.postings.where(F.col("part").isin(sorted({b % PARTS for b in there})))
    postings = postings.join(small(wanted.select("shard").distinct()), "shard", "left_semi")
    held = _only(postings, used).groupBy("shard").agg(F.collect_list(F.struct("buckets", "counts", "places", "tfs")).alias("held"))
    asked = wanted.groupBy("shard", "pack").agg(F.collect_list("q").alias("asked"), F.collect_list("least").alias("least"))
    met = held.join(asked.join(_few(packs), "pack"), "shard").select("shard", "held", "asked", "least", "ids", "q", "buckets", "weights")
    kind = packs.schema["ids"].dataType.elementType.simpleString()

    def scored(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        asked, least, q, terms, weights = _row(batch, i, "asked", "least", "q", "buckets", "weights")
        parts = batch.column("held")[i].values
        buckets, counts, places, tfs = (parts.field(name).flatten().to_numpy() for name in ("buckets", "counts", "places", "tfs"))
        ids = batch.column("ids")[i].values
        own = np.full(len(ids), -1)
        own[asked] = np.arange(len(asked))
        q, terms, weights = (x[own[q] >= 0] for x in (q, terms, weights))
        q = own[q]
        first = np.searchsorted(terms, buckets, side="left")
        n = np.searchsorted(terms, buckets, side="right") - first
        n, first, docs = np.repeat(n, counts), np.repeat(first, counts), int(places.max(initial=-1)) + 1
        n, first, places, tfs = (x[n > 0] for x in (n, first, places, tfs))
        score, seen = np.zeros(len(asked) * docs), np.zeros(len(asked) * docs, bool)
        upto, at = np.append(0, np.cumsum(n)), 0
        while at < len(n):
            # Each posting with each query that has its bucket.
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + MEETINGS_AT_ONCE, side="right")) - 1)
            posting = np.repeat(np.arange(at, end), n[at:end])
            term = np.arange(upto[at], upto[end]) - upto[posting] + first[posting]
            cell = q[term] * docs + places[posting]
            score += np.bincount(cell, weights[term] * tfs[posting], minlength=len(score))
            seen[cell] = True
            at = end
        score = np.where(seen, score, -np.inf).reshape(len(asked), docs)
        last = min(k, docs)
        border = np.maximum(np.partition(score, -last, axis=1)[:, -last], least) if last else least
        row, place = np.nonzero((score >= border[:, None] - 1e-5) & np.isfinite(score))
        shard = np.full(len(row), batch.column("shard")[i].as_py())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(asked[row])), pa.array(shard, pa.int64()), pa.array(place, pa.int32()), pa.array(score[row, place])], ["query_id", "shard", "place", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield scored(batch, i)

    return met.mapInArrow(run, f"query_id {kind}, shard long, place int, score double")


def _top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query and all that equal the last of them up to rounding: ranks are given by rounded score."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)))
    return scores.withColumn("at", F.rank().over(order)).where(F.col("at") <= k).drop("at")


def _first(bounds: DataFrame) -> DataFrame:
    """The most promising shard of each query; of equal ones the last, as this is worked out more than once."""
    best = bounds.groupBy("query_id").agg(F.max(F.struct("most", "shard", "pack", "q")).alias("b"))
    return best.select("query_id", "b.pack", "b.q", "b.shard", F.lit(float("-inf")).alias("least"))


def _least(seen: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the score that k documents have; minus infinity where there aren't so many."""
    return seen.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least"))


def _reached() -> Column:
    return F.col("most") * (1 + SLACK) + 1e-6 >= F.col("least")


def search(index: KeywordIndex, queries: DataFrame, k: int, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, key, score): for each query the k best documents and those equal to the last, by shared buckets.
    Queries are a table; a query without tokens, or with none that a document has, has no hits."""
    terms = saved(_terms(index, queries, query, text))
    packs = saved(_packed(terms), **LONG_ROWS)
    bounds = saved(reachable(index, packs))
    first = _first(bounds)
    seen = saved(_top(_scores(index, packs, first, k), k))
    rest = bounds.join(small(first.select("query_id", F.col("shard").alias("done"))), "query_id").where("shard <> done")
    rest = saved(rest.join(small(_least(seen, k)), "query_id").where(_reached()).select("pack", "q", "shard", "least"))
    best = saved(_top(seen.unionByName(_top(_scores(index, packs, rest, k), k)), k))
    for table in (terms, packs, bounds, seen, rest):
        dropped(table)
    hits = index.shards.join(small(best), "shard")
    return hits.select("query_id", F.element_at("keys", F.col("place") + 1).alias("key"), F.round("score", 6).alias("score"))


def pruned_share(index: KeywordIndex, queries: DataFrame, k: int, query: str = "query_id", text: str = "text") -> float:
    """The share of (query, shard) pairs with a shared bucket that search() doesn't score: for a look at an index."""
    packs = saved(_packed(saved(_terms(index, queries, query, text))))
    bounds = saved(reachable(index, packs))
    least = _least(_top(_scores(index, packs, _first(bounds), k), k), k)
    return bounds.join(least, "query_id").agg(F.avg((~_reached()).cast("double"))).first()[0] or 0.0
