"""Sources: sitemaps, raw pages, and the JSON lines that ingestion leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from weftline import schemas
from weftline.functions import urls
from weftline.operators import markup
from weftline.operators.increments import aligned
from weftline.sources.tables import Table

SHORTEST_PAGE = 50


def sitemap_urls(spark: SparkSession, path: str, skip: tuple[str, ...] = urls.SKIPPED) -> DataFrame:
    """(pos, url) of a sitemap file's loc elements, in order, without skipped ones."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.expr("xpath(value, '//*[local-name()=\"loc\"]/text()')")).alias("url"), F.monotonically_increasing_id().alias("pos"))
    return text.select("pos", F.trim("url").alias("url")).where(~urls.skipped(F.col("url"), skip))


def head(pages: DataFrame, n: int | None, by: str = "pos") -> DataFrame:
    return pages if n is None else pages.orderBy(by).limit(n)


def fetched(addresses: DataFrame, fetch: Callable[[str], str], partitions: int = 1) -> DataFrame:
    """(url, html, error): addresses through a fetch callable, one after another in each partition; a
    failure is kept as a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, fetch(url), None))
                except Exception as error:  # any failure of the source is data here
                    rows.append((url, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return addresses.select("url").repartition(partitions).mapInPandas(run, "url string, html string, error string")


def parsed(raw: DataFrame, closed: bool = False) -> DataFrame:
    """Pages (schemas.PAGES) from (url, html); pages of under SHORTEST_PAGE characters go. Equal rows count once. closed: of
    texts' character references, only those with a semicolon are decoded."""
    pages = markup.parsed(raw, closed).where(F.length("markdown") >= SHORTEST_PAGE)
    path = urls.relative_path(F.col("url"))
    return pages.select("url", "title", urls.section(F.col("url")).alias("section"), "markdown", F.length("markdown").alias("char_count"), path.alias("saved_path"), "markers")


def _or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines; malformed lines go, or fail the job if strict. A missing path is empty."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return _or_empty(spark, lambda: spark.read.schema(schema).option("mode", mode).json(path), schema)


def done_urls(spark: SparkSession, index_path: str) -> DataFrame:
    return json_lines(spark, index_path, schemas.INDEX).where(F.col("url").isNotNull()).select("url").distinct()


def saved_pages(spark: SparkSession, index_path: str, markdown_path: str) -> DataFrame:
    """Index records with the Markdown that sinks.save_pages stored, one for each url; records without it go, malformed ones
    too. A path is but a label: urls with different query strings have the same."""
    stored = Table(spark, markdown_path, schemas.MARKDOWN, ["url"]).read().select("url", "markdown")
    return json_lines(spark, index_path, schemas.INDEX).dropDuplicates(["url"]).join(stored, "url")


def saved_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; char_count is counted anew."""
    return json_lines(spark, path, schemas.CHUNKS).where(F.col("chunk_id").isNotNull()).withColumn("char_count", F.length("text"))


def saved_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors; a missing path is empty, and files that can't be read count as missing, too."""
    return _or_empty(spark, lambda: spark.read.schema(schemas.VECTORS).option("ignoreCorruptFiles", True).parquet(path), schemas.VECTORS)


def score_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(qid, metric, score) from JSON of {qid: {metric: score}}; a missing file is empty."""
    kind = "map<string,map<string,double>>"
    rows = _or_empty(spark, lambda: spark.read.text(path, wholetext=True), "value string")
    by_question = rows.select(F.explode(F.from_json("value", kind)).alias("qid", "scores"))
    return by_question.select("qid", F.explode("scores").alias("metric", "score"))


def reference_answers(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """questions (qid, question) with the answer of each, from JSON of {qid: answer}; a question without one
    fails the job."""
    kind = "map<string,string>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("qid", "answer"))
    return aligned(questions, rows, "qid", "answer")


def table_stats(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("points_count"))


def usable_score(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)
