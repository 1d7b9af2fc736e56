"""Summaries of corpora, chunks and evaluation scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus_summary(pages: DataFrame, chars: str, symbols: Column) -> DataFrame:
    """One row: pages, characters, their floored mean, symbols, pages with symbols."""
    n = F.count("*")
    return pages.agg(
        n.alias("pages"),
        F.coalesce(F.sum(chars), F.lit(0)).alias("total_chars"),
        F.floor(F.coalesce(F.sum(chars), F.lit(0)) / F.greatest(n, F.lit(1))).alias("avg_chars"),
        F.coalesce(F.sum(symbols), F.lit(0)).alias("symbols"),
        F.count_if(symbols > 0).alias("pages_with_symbols"),
    )


def top_groups(rows: DataFrame, group: str, place: str, k: int = 10) -> DataFrame:
    """The k largest groups, ties by first appearance."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(place).alias("first_place"))
    return counts.orderBy(F.desc("n"), "first_place").limit(k)


def size_stats(rows: DataFrame, size: str, groups: Sequence[str] = ()) -> DataFrame:
    """min, median, mean, p95 and max of sizes; p95 is the value at place int(n * 0.95) from 0.

    The place comes from counts of distinct sizes, which are combined before the shuffle, so that no
    task sorts a group's rows.
    """
    counts = rows.groupBy(*groups, size).agg(F.count("*").alias("__c"))
    order = Window.partitionBy(*groups).orderBy(size) if groups else Window.partitionBy(F.lit(0)).orderBy(size)
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    placed = counts.withColumn("__upto", F.sum("__c").over(order)).withColumn("__n", F.sum("__c").over(whole))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("__upto") > place, F.col(size)))

    low, high, p95 = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2), F.floor(F.col("__n") * 0.95)
    return placed.groupBy(*groups).agg(
        F.sum("__c").alias("n"),
        F.min(size).alias("min_size"),
        ((at(low) + at(high)) / 2).alias("median_size"),
        F.round(F.sum(F.col(size) * F.col("__c")) / F.sum("__c"), 6).alias("mean_size"),
        at(p95).alias("p95_size"),
        F.max(size).alias("max_size"),
    )


def chunks_by_page(chunks: DataFrame) -> DataFrame:
    """(page_url, n_chunks, mean_chars) of each page."""
    return chunks.groupBy("page_url").agg(F.count("*").alias("n_chunks"), F.round(F.avg("char_count"), 6).alias("mean_chars"))


def chunk_problems(chunks: DataFrame, most_chars: int = 2000, least_chars: int = 20) -> DataFrame:
    """Chunks to look at, with a problem each: empty, short, long, without an address, or with an id that others have."""
    copies = chunks.groupBy("chunk_id").agg(F.count("*").alias("__copies")).where("__copies > 1")
    size = F.length(F.coalesce("text", F.lit("")))
    found = chunks.join(copies, "chunk_id", "left").withColumn(
        "problem",
        F.when(size == 0, "empty").when(size < least_chars, "short").when(size > most_chars, "long")
        .when(F.coalesce("citation_url", F.lit("")) == "", "no address").when(F.col("__copies").isNotNull(), "repeated id"),
    )
    return found.where("problem IS NOT NULL").drop("__copies")


def score_summary(scores: DataFrame) -> DataFrame:
    """Per metric of (qid, metric, score): mean, median, sample deviation, min, max; NaN counts as missing."""
    value = F.when(~F.isnan("score"), F.col("score"))
    return scores.groupBy("metric").agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.median(value), 6).alias("median"),
        F.round(F.stddev_samp(value), 6).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def worst(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k questions with the lowest mean score, ties by id."""
    mean = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("qid").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    return mean.orderBy("mean_score", "qid").limit(k)


def missing_scores(questions: DataFrame, metrics: Sequence[str], scores: DataFrame) -> DataFrame:
    """(qid, metric) still to be scored: pairs without a score, or with a null or NaN one."""
    pairs = questions.select("qid", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    good = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).select("qid", "metric")
    return pairs.join(good, ["qid", "metric"], "left_anti")
