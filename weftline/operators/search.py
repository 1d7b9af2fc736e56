"""Retrieval over many queries at once: a keyword leg, a dense leg, fusion, dedup, reranking.

Queries that make up one block of bounded size are carried along by the tasks that scan the rows: a task keeps the k
best of its rows for each query, so that (tasks x queries x k) rows are shuffled whatever the number of rows. More
queries than that stay a table: the keyword leg joins them with an inverted index by bucket (keyword_index),
the dense leg joins blocks of them with the blocks of rows of a scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import sparse
from weftline.functions.text import BUCKETS
from weftline.functions.vectors import min_max
from weftline.operators import keyword_index
from weftline.operators.keyword_index import inverse_frequency
from weftline.plans.models import hypothetical_text
from weftline.storage import dropped, saved, session_dir, small

#: Queries of a block: so many, but no more numbers than that.
QUERY_BLOCK, BLOCK_NUMBERS = 8192, 4_000_000
#: Scores that a task works out at once, and meetings of a posting with a query.
SCORES_AT_ONCE, MEETINGS_AT_ONCE = 2_000_000, 1_000_000
#: Numbers of a packed block of rows, and of queries where they are joined.
ROW_NUMBERS, QUERY_NUMBERS = 1 << 16, 1 << 16


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, tf): the inverted index of a table."""
    return sparse.postings(docs, key, text)


def bucket_weights(index: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(bucket, df, idf) of an inverted index; at most BUCKETS rows."""
    df = index.groupBy("bucket").agg(F.count("*").alias("df"))
    n = docs.select(F.count_distinct(key)).first()[0]
    return df.select("bucket", "df", inverse_frequency(F.lit(n), F.col("df")).alias("idf"))


def top_ranked(hits: DataFrame, k: int, query: str = "query_id", key: str = "key", score: str = "score") -> DataFrame:
    """The k best hits of each query with rank 1..k; ties by key."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.col(key))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _fits(queries: DataFrame, numbers: Column) -> bool:
    """Whether queries make up one block. numbers: how many a query has."""
    size = queries.agg(F.count("*"), F.sum(numbers)).first()
    return size[0] <= QUERY_BLOCK and (size[1] or 0) <= BLOCK_NUMBERS


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_ranked(hits.withColumn("score", F.round("score", 6)), k)


def keyword_search(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", key: str = "key", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank): BM25-like search by shared buckets, for all queries at once.

    Texts are tokenised once: what they have of the queries' buckets is written, one row a text, counts by
    bucket give the weights, and a block of queries is scored against the written rows. With more queries than a block
    holds, an inverted index of the same rows is written and searched (and may be kept: keyword_index.build()).
    """
    wanted = saved(sparse.postings(queries.select(F.col(query).alias("query_id"), F.col(text).alias("t")), "query_id", "t"))
    used = np.zeros(BUCKETS, bool)
    used[[r["bucket"] for r in wanted.select("bucket").distinct().collect()]] = True  # BUCKETS numbers at most
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    per_query = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    if not _fits(per_query, F.col("n")):
        dropped(wanted)
        index = keyword_index.build(docs, f"{session_dir(docs.sparkSession)}/{uuid.uuid4().hex}", text="t", wanted=used)
        return _ranked(keyword_index.search(index, queries, k, query, text), k)
    index = saved(sparse.documents(docs, "key", "t", used))
    weights = bucket_weights(index.select(F.explode("buckets").alias("bucket")), docs, "key")
    terms = wanted.join(F.broadcast(weights), "bucket").groupBy("query_id")  # BUCKETS rows at most
    terms = terms.agg(F.collect_list("bucket").alias("buckets"), F.collect_list(F.col("tf") * F.col("idf")).alias("weights")).toPandas()
    dropped(wanted)
    if not len(terms):
        return index.select(F.lit(None).cast(queries.schema[query].dataType).alias("query_id"), "key", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return _ranked(_scored(index, terms, k), k)


def _kept(query_ids: np.ndarray, k: int) -> Callable:
    """The k best of each query, among what was kept before and a matrix of new scores (queries by rows).
    Ties at the border are kept: ranks are by rounded score and key. Scores of minus infinity are none."""

    def keep(best: pd.DataFrame | None, score: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        at = min(k, score.shape[1])
        least = np.partition(score, -at, axis=1)[:, -at] - 1e-5
        q, d = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        found = pd.DataFrame({"q": q, "key": keys[d], "score": score[q, d]})
        best = found if best is None else pd.concat([best, found], ignore_index=True)
        return _best(best, k) if len(best) > 4 * k * len(query_ids) else best

    return keep


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["q", "score"], ascending=[True, False], ignore_index=True)
    place = found.groupby("q").cumcount()
    border = found["q"].map(found[place == k - 1].set_index("q")["score"]).fillna(-np.inf)
    return found[found["score"] >= border - 1e-5]


def _hits(best: pd.DataFrame | None, query_ids: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    if best is not None and len(best):
        best = _best(best, k)
        yield pd.DataFrame({"query_id": query_ids[best["q"].to_numpy()], "key": best["key"].to_numpy(), "score": best["score"].to_numpy()})


def _schema(query_id: type, keys: DataFrame) -> str:
    return f"query_id {'string' if query_id is str else 'long'}, key {keys.schema['key'].dataType.simpleString()}, score double"


def _scored(index: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Hits of a block of queries (query_id, buckets, weights) in rows (key, buckets, tfs)."""
    ids = queries["query_id"].to_numpy()
    bucket = np.concatenate(queries["buckets"].to_numpy())
    order = np.argsort(bucket, kind="stable")
    of_query = np.repeat(np.arange(len(ids)), queries["buckets"].map(len))[order]
    weight = np.concatenate(queries["weights"].to_numpy())[order]
    first = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    keep = _kept(ids, k)
    step = max(1, SCORES_AT_ONCE // len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for part in _by_meetings(batch, first, step):
                keys, lists, tfs = part.column(0).to_pandas().to_numpy(), part.column(1), part.column(2)
                buckets, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy()
                row = pc_parents(lists)
                n = first[buckets + 1] - first[buckets]
                # Each posting with each query that has its bucket.
                posting = np.repeat(np.arange(len(buckets)), n)
                term = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[buckets][posting]
                cell = of_query[term] * part.num_rows + row[posting]
                met = np.bincount(cell, minlength=len(ids) * part.num_rows) > 0
                score = np.bincount(cell, weight[term] * tf[posting], minlength=len(ids) * part.num_rows)
                best = keep(best, np.where(met, score, -np.inf).reshape(len(ids), part.num_rows), keys)
        for hits in _hits(best, ids, k):
            yield pa.RecordBatch.from_pandas(hits, preserve_index=False)

    return index.select("key", "buckets", "tfs").mapInArrow(run, _schema(type(ids[0]), index))


def _by_meetings(batch: pa.RecordBatch, first: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (key, buckets, ...): up to step rows, and as many as have MEETINGS_AT_ONCE meetings, one at least."""
    lists = batch.column(1)
    buckets, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    upto = np.concatenate(([0], np.cumsum(first[buckets + 1] - first[buckets])))[offsets - offsets[0]]
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] + MEETINGS_AT_ONCE, side="right")) - 1
        end = min(at + step, batch.num_rows, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def pc_parents(lists: pa.ListArray) -> np.ndarray:
    """The row of each element of a list array."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, key: str = "key", vector: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query_id, key, score, rank): exact search by dot product. queries: (query_id, vector). Null vectors
    are left out."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("v IS NOT NULL")
    asked = queries.select("query_id", F.col(vector).alias("v")).where("v IS NOT NULL")
    if not _fits(asked, F.size("v")):
        return _ranked(_joined(rows, asked, k, skip_self), k)
    block = asked.toPandas()
    if not len(block):
        return rows.select(F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "key", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return _ranked(_scan(rows, block, k, skip_self), k)


def packed(rows: DataFrame, name: str, numbers: int) -> DataFrame:
    """(names, matrix) of rows (name, v): as many rows as come one after another in a task, up to so many numbers, as one,
    with the vectors as bytes of doubles."""
    kind = rows.schema[name].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.unique(batch.column(1).value_lengths().to_numpy()) if batch.num_rows else []
            if len(lengths) > 1:
                raise ValueError("vectors of different lengths")
            step = max(1, numbers // max(1, int(lengths[0]))) if len(lengths) else 1
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([matrix.tobytes()], pa.binary())], [name, "matrix"])

    return rows.select(name, "v").mapInArrow(run, f"{name} array<{kind.simpleString()}>, matrix binary")


def _joined(rows: DataFrame, asked: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Hits of any number of queries. They are packed in blocks, dealt into groups that are small enough to be broadcast,
    and each group meets the packed rows in a scan of its own; a task keeps its k best rows of each query."""
    size = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    groups = max(1, -(-size[0] * (size[1] or 1) // BLOCK_NUMBERS))
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    blocks = rows.transform(lambda df: packed(df, "key", ROW_NUMBERS))
    queries = saved(asked.withColumn("group", group).repartition("group"))
    kinds = {c: t.dataType.simpleString() for c, t in (("query_id", asked.schema["query_id"]), ("key", rows.schema["key"]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, pd.DataFrame] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys = (np.array(batch.column(c)[i].as_py(), dtype=object) for c in (0, 2))
                a, b = (np.frombuffer(batch.column(c)[i].as_py()).reshape(len(names), -1) for c, names in ((1, ids), (3, keys)))
                score = a @ b.T
                if skip_self:
                    score[ids[:, None] == keys[None, :]] = -np.inf
                name = (ids[0], len(ids))
                held = best.get(name)
                best[name] = (ids, _kept(ids, k)(held[1] if held else None, score, keys))
        for ids, found in best.values():
            for hits in _hits(found, ids, k):
                yield pa.RecordBatch.from_pandas(hits, preserve_index=False)

    parts = []
    for g in range(groups):
        own = packed(queries.where(F.col("group") == g), "query_id", QUERY_NUMBERS).select("query_id", F.col("matrix").alias("asked"))
        # One group's queries against all rows, in blocks: BLOCK_NUMBERS numbers or so are broadcast.
        met = blocks.join(F.broadcast(own)).select("query_id", "asked", "key", "matrix")
        parts.append(met.mapInArrow(run, f"query_id {kinds['query_id']}, key {kinds['key']}, score double"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits


def _scan(vectors: DataFrame, queries: pd.DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Hits of a block of queries: one matrix product for each batch of vectors."""
    ids = queries["query_id"].to_numpy()
    matrix = np.stack(queries["v"].to_numpy()).astype(np.float64)
    keep = _kept(ids, k)
    step = max(1, SCORES_AT_ONCE // len(ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                keys = part["key"].to_numpy()
                score = matrix @ np.stack(part["v"].to_numpy()).astype(np.float64).T
                if skip_self:
                    score[ids[:, None] == keys[None, :]] = -np.inf
                best = keep(best, score, keys)
        yield from _hits(best, ids, k)

    return vectors.mapInPandas(run, _schema(type(ids[0]), vectors))


def fused(legs: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of legs (query_id, key, rank): a union and a sum instead of outer joins."""
    rows = legs[0].select("query_id", "key", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", "key", "rank"))
    # The sum is over exact decimals, so that its order doesn't matter.
    part = F.round(1 / (constant + F.col("rank")), 12).cast("decimal(20,12)")
    scores = rows.groupBy("query_id", "key").agg(F.sum(part).cast("double").alias("score"))
    return top_ranked(scores.withColumn("score", F.round("score", 6)), k)


def deduplicated(hits: DataFrame, dedup_key: Column, rank: str = "rank") -> DataFrame:
    """The best-ranked hit of each query and key; places that fall free are not filled."""
    order = Window.partitionBy("query_id", "__key").orderBy(rank)
    numbered = hits.withColumn("__key", dedup_key).withColumn("__n", F.row_number().over(order))
    return numbered.where("__n = 1").drop("__key", "__n")


def reranked(hits: DataFrame, raw_score: Column, alpha: float, fusion_score: str = "score", rank: str = "rank") -> DataFrame:
    """Hits with rrf_score, ce_score_raw, both normalised within their query, and score and rank of the
    blend alpha * ce + (1 - alpha) * rrf. With alpha 0 order and score stay and no score is computed."""
    if alpha == 0:
        return hits.withColumn("rrf_score", F.col(fusion_score))
    query = Window.partitionBy("query_id")
    rows = hits.withColumns({"rrf_score": F.col(fusion_score), "ce_score_raw": raw_score})
    rows = rows.withColumns(
        {
            "rrf_score_norm": min_max(F.col("rrf_score"), F.min("rrf_score").over(query), F.max("rrf_score").over(query)),
            "ce_score": min_max(F.col("ce_score_raw"), F.min("ce_score_raw").over(query), F.max("ce_score_raw").over(query)),
        }
    )
    rows = rows.withColumn("score", F.round(alpha * F.col("ce_score") + (1 - alpha) * F.col("rrf_score_norm"), 6))
    order = query.orderBy(F.desc("score"), F.col(rank))
    return rows.withColumn("prior_rank", F.col(rank)).withColumn(rank, F.row_number().over(order))


def cut(hits: DataFrame, threshold: float | None, k: int, rank: str = "rank") -> DataFrame:
    """Hits from the threshold upwards, and of them the k best of each query."""
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(rank)
    return hits.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def word_overlap(question: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's distinct words that the text has."""
    return sparse.token_overlap(question, text)


@dataclass(frozen=True)
class Options:
    """top_k hits after fusion of prefetch times as many of each leg; then dedup, rerank, threshold, slice."""

    top_k: int = 6
    prefetch: int = 3
    alpha: float = 0.7
    threshold: float | None = None
    final_top_k: int | None = None
    rrf_constant: int = 60


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    options: Options,
    dense_leg: Callable[[DataFrame, int, DataFrame | None], DataFrame],
    dedup_key: Column,
    where: Column | None = None,
    query_text: str = "text",
    text: str = "text",
    rewrite: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(query_id, key, rank, score, rrf_score, ...) for queries (query_id, text).

    where filters docs before either leg. rewrite makes the text that the dense leg looks for (an answer as it might
    be written, say) from a question; a null or blank one falls back on the question, and so do all without rewrite. The
    keyword leg and the reranker always take the question. dense_leg(queries, k, keys) gives the dense ranking of queries (query_id, text,
    dense_text) among the rows with a key in keys (key), which is None without a filter. Texts join late, for the hits only.
    """
    keys = None
    if where is not None:
        docs = docs.where(where)
        keys = docs.select("key")
    question = F.col(query_text)
    queries = saved(queries.withColumn("dense_text", hypothetical_text(rewrite(question), question) if rewrite else question))
    n = options.top_k * options.prefetch
    legs = [keyword_search(queries, docs, n, text=text), dense_leg(queries, n, keys)]
    hits = saved(fused(legs, options.top_k, options.rrf_constant))
    hits = docs.join(small(hits), "key").join(small(queries.select("query_id", F.col(query_text).alias("__query"))), "query_id")
    hits = deduplicated(hits, dedup_key)
    hits = reranked(hits, word_overlap(F.col("__query"), F.col(text)), options.alpha)
    return cut(hits, options.threshold, options.final_top_k or options.top_k).drop("__query")
