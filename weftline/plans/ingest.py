"""Ingestion and answering as plans over tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions import citations
from weftline.operators import stats
from weftline.operators.chunking import chunks
from weftline.operators.increments import aligned, pending
from weftline.sources import pages as sources
from weftline.sources import sinks
from weftline.sources.tables import Table
from weftline.storage import saved


def ingest_pages(raw: DataFrame, index_path: str, markdown_path: str, closed: bool = False) -> DataFrame:
    """Parses the pages of (url, html) that the index doesn't have, one for each url, stores their Markdown and then
    appends them to the index: a job that fails between leaves pages to be parsed and stored again, by url, not records
    without text or pages twice. closed: see sources.pages.parsed()."""
    todo = pending(raw.dropDuplicates(["url"]), sources.done_urls(raw.sparkSession, index_path), "url")
    new = saved(sources.parsed(todo, closed))
    sinks.save_pages(new, markdown_path)
    sinks.save_index(new, index_path)
    return new


def split_incremental(pages: DataFrame, chunks_path: str, **limits: int) -> DataFrame:
    """Chunks the pages that have none yet, appends them, and returns all chunks."""
    spark = pages.sparkSession
    done = sources.saved_chunks(spark, chunks_path).select(F.col("page_url").alias("url")).distinct()
    sinks.save_chunks(chunks(pending(pages, done, "url"), **limits), chunks_path)
    return sources.saved_chunks(spark, chunks_path)


def embed_missing(all_chunks: DataFrame, embed: Callable[[Column], Column], vectors_path: str) -> DataFrame:
    """Chunks with their vectors; those missing are embedded and appended first. A vector belongs to a
    chunk's id: change the id with the text."""
    spark = all_chunks.sparkSession
    missing = pending(all_chunks, sources.saved_vectors(spark, vectors_path), "chunk_id")
    sinks.save_vectors(missing.select("chunk_id", embed(F.col("text")).alias("embedding")), vectors_path)
    return aligned(all_chunks, sources.saved_vectors(spark, vectors_path), "chunk_id", "embedding")


def contexts(hits: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, context): the hits of each query as numbered blocks in order of rank."""
    block = citations.context_block(F.col("rank"), F.col("symbol"), F.col("title"), F.col("url"), F.col(text))
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(ordered.alias("blocks")).select("query_id", F.array_join(F.col("blocks.block"), citations.BETWEEN).alias("context"))


def answers(hits: DataFrame, answer: Callable[[Column, Column], Column], question: str = "question") -> DataFrame:
    """Answers by a callable of (question, context), with their sources resolved and renumbered."""
    docs = F.sort_array(F.collect_list(F.struct("rank", "symbol", "title", "url", "kind")))
    packed = hits.groupBy("query_id", question).agg(docs.alias("docs")).join(contexts(hits), "query_id")
    made = packed.withColumn("answer", answer(F.col(question), F.col("context")))
    return made.withColumns(
        {
            "sources": citations.cited_sources(F.col("answer"), F.col("docs")),
            "answer": citations.renumbered(F.col("answer"), F.transform(citations.cited_sources(F.col("answer"), F.col("docs")), lambda s: s["index"])),
        }
    )


def running_text(tokens: DataFrame) -> DataFrame:
    """(answer_id, seq, text): the answer as it grows, from (answer_id, seq, token)."""
    order = Window.partitionBy("answer_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.select("answer_id", "seq", F.array_join(F.collect_list("token").over(order), "").alias("text"))


def answer_stream(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], answer: Callable[[Column, Column], Column], path: str, checkpoint: str):
    """A query that answers the questions (query_id, question) of a stream, batch by batch, and appends the
    answers to a folder. retrieve gives the hits of a batch of questions, with the columns that answers() needs."""

    def run(batch: DataFrame, number: int) -> None:
        asked = saved(batch.where(F.coalesce(F.trim("question"), F.lit("")) != ""))
        answers(retrieve(asked), answer).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def ingest_stream(spark: SparkSession, raw_dir: str, index_path: str, markdown_path: str, checkpoint: str, files_at_once: int = 64):
    """A query that parses new raw pages in a folder, once each, and appends them to the index."""
    stream = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", files_at_once).parquet(raw_dir)
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: ingest_pages(batch.dropDuplicates(["url"]), index_path, markdown_path)).start()
    )


def scored_incremental(questions: DataFrame, metrics: list[str], score: Callable[[Column, Column], Column], checkpoint_path: str) -> DataFrame:
    """(qid, metric, score): pairs without a usable score are scored and appended to the checkpoint (NaN as
    null, so that the next run tries them again); the latest state of all scores is returned."""
    spark = questions.sparkSession
    old = sources.json_lines(spark, checkpoint_path, schemas.SCORES).where(sources.usable_score(F.col("score")))
    todo = stats.missing_scores(questions, metrics, old).join(questions, "qid")
    made = saved(todo.select("qid", "metric", score(F.col("metric"), F.col("question")).alias("score")))
    sinks.append_scores(made, checkpoint_path)
    return sources.json_lines(spark, checkpoint_path, schemas.SCORES).where(sources.usable_score(F.col("score"))).unionByName(made.where(~sources.usable_score(F.col("score"))))


TRIES = "qid string, metric string, score double, tries int, not_before double"


def tried_scores(questions: DataFrame, metrics: list[str], score: Callable[[Column, Column], Column], path: str, now: float, most_tries: int = 5, wait_s: float = 10) -> DataFrame:
    """(qid, metric, score, tries, not_before) after one more pass over what is due at now (seconds).

    A null or NaN score is a failed try: after the n-th one the pair waits wait_s * 2^(n-1) seconds, and after most_tries its
    score stays null. The state is a committed table by qid and metric, so that a pass that stops counts no
    try; what is scored is scored once.
    """
    spark = questions.sparkSession
    table = Table(spark, path, TRIES, ["qid", "metric"])
    state = table.read()
    over = state.where(sources.usable_score(F.col("score")) | (F.col("tries") >= most_tries) | (F.col("not_before") > now))
    pairs = questions.select("qid", "question", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    due = pairs.join(over.select("qid", "metric"), ["qid", "metric"], "left_anti").join(state.select("qid", "metric", "tries"), ["qid", "metric"], "left")
    made = due.select("qid", "metric", score(F.col("metric"), F.col("question")).alias("made"), (F.coalesce("tries", F.lit(0)) + 1).alias("tries"))
    value = F.when(sources.usable_score(F.col("made")), F.col("made"))
    wait = now + wait_s * F.pow(F.lit(2.0), F.col("tries") - 1)
    # Saved, as a scorer may give something else when it is asked again.
    rows = saved(made.select("qid", "metric", value.alias("score"), F.col("tries").cast("int").alias("tries"), F.when(value.isNull(), wait).alias("not_before")))
    if not rows.isEmpty():
        table.upsert(rows)
    return table.read()


def score_to_the_end(questions: DataFrame, metrics: list[str], score: Callable[[Column, Column], Column], path: str, most_tries: int = 5, wait_s: float = 10, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """tried_scores() again and again, with the waits between, until no pair is left to be tried."""
    while True:
        state = tried_scores(questions, metrics, score, path, clock(), most_tries, wait_s)
        left = state.where(F.col("score").isNull() & (F.col("tries") < most_tries)).agg(F.min("not_before")).first()[0]
        if left is None:
            return state
        sleep(max(0.0, left - clock()))


def assembled(tokens: DataFrame) -> DataFrame:
    """(answer_id, text, n_tokens): whole answers from (answer_id, seq, token) in order of seq; a token that comes twice counts once.
    Work is in proportion to the tokens, unlike that of running_text(), whose result grows with their square."""
    parts = tokens.dropDuplicates(["answer_id", "seq"]).groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("seq", "token"))).alias("parts"))
    return parts.select("answer_id", F.array_join("parts.token", "").alias("text"), F.size("parts").alias("n_tokens"))
