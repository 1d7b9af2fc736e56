"""Sinks: page index, chunks, score tables, and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import schemas
from weftline.sources.tables import Table


def save_index(pages: DataFrame, path: str, append: bool = True) -> None:
    pages.drop("markdown").write.mode("append" if append else "overwrite").json(path)


def save_pages(pages: DataFrame, path: str, most_segments: int = 16) -> None:
    """Stores the Markdown of pages by url, so that a page that is stored again, after a failure, is there once."""
    table = Table(pages.sparkSession, path, schemas.MARKDOWN, ["url"])
    if len(table.upsert(pages.select("url", "saved_path", "markdown")).segments) > most_segments:
        table.compact()


def save_chunks(chunks: DataFrame, path: str, append: bool = True) -> None:
    chunks.write.mode("append" if append else "overwrite").json(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("append").parquet(path)


def _as_null(scores: DataFrame) -> DataFrame:
    """Scores with NaN as null."""
    return scores.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def save_scores(scores: DataFrame, path: str) -> None:
    """Puts scores (qid, metric, score) in place of those of the table of a folder, at once or not at all; NaN as null."""
    Table(scores.sparkSession, path, schemas.SCORES, ["qid", "metric"]).replace(_as_null(scores))


def append_scores(scores: DataFrame, path: str) -> None:
    """Adds scores to a checkpoint, NaN as null."""
    _as_null(scores).write.mode("append").json(path)


def save_scores_csv(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)


def save_answers(answers: DataFrame, path: str) -> None:
    """Answers in the order of their questions."""
    answers.orderBy("ordinal").write.mode("overwrite").json(path)


def log_queries(queries: DataFrame, path: str) -> None:
    """Appends (user_id, name, username, query, at) to the audit log."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("username"), F.lit("unknown"))
    queries.select("user_id", name.alias("name"), F.substring("query", 1, 300).alias("query"), "at").write.mode("append").json(path)
