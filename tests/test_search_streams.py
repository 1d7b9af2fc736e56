"""Search operators, statistics, and state in batch and stream."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import vectors
from weftline.operators import increments, metrics, search, stats
from weftline.plans import ingest, models
from weftline.streaming import assembly, limits


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, key long, score double, rank int")


def test_fusion_is_symmetric_and_ranks(spark):
    a, b = hits(spark, [(1, 10, 0.9, 1), (1, 11, 0.5, 2)]), hits(spark, [(1, 11, 7.0, 1), (1, 12, 3.0, 2)])
    one, two = (search.fused(x, 3).collect() for x in ([a, b], [b, a]))
    assert one == two and [r["key"] for r in sorted(one, key=lambda r: r["rank"])] == [11, 10, 12]


@pytest.mark.parametrize(("alpha", "order"), [(0.0, [1, 2, 3]), (1.0, [3, 1, 2]), (0.5, [1, 3, 2])])
def test_rerank(spark, alpha, order):
    rows = hits(spark, [(1, 1, 1.0, 1), (1, 2, 0.5, 2), (1, 3, 0.1, 3)])
    raw = F.when(F.col("key") == 3, 9.0).when(F.col("key") == 1, 5.0).otherwise(1.0)
    found = sorted(search.reranked(rows, raw, alpha).collect(), key=lambda r: r["rank"])
    assert [r["key"] for r in found] == order
    if alpha == 0:
        assert [r["score"] for r in found] == [1.0, 0.5, 0.1]


def test_rerank_of_equal_scores_dedup_and_cut(spark):
    rows = hits(spark, [(1, 1, 0.5, 1), (1, 2, 0.5, 2), (2, 7, 0.4, 1)])
    assert {r["score"] for r in search.reranked(rows, F.lit(1.0), 0.7).collect()} == {0.5}
    assert sorted(r["key"] for r in search.deduplicated(rows, F.lit("same")).collect()) == [1, 7]
    assert sorted(r["key"] for r in search.cut(rows, 0.5, 1).collect()) == [1]
    assert search.cut(hits(spark, []), 0.5, 1).count() == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "key long, embedding array<float>")
    queries = vectors.where("key % 20 = 0").withColumnRenamed("key", "query_id")
    want = {}
    rows = vectors.collect()
    for q in queries.collect():
        score = lambda r: sum(a * b for a, b in zip(q["embedding"], r["embedding"]))
        want[q["query_id"]] = [r["key"] for r in sorted(rows, key=lambda r: (-score(r), r["key"]))[:5]]
    for block in (4096, 3):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        found = {}
        for r in sorted(search.dense_search(queries, vectors.repartition(6), 5).collect(), key=lambda r: r["rank"]):
            found.setdefault(r["query_id"], []).append(r["key"])
        assert found == want
    assert search.dense_search(queries.limit(0), vectors, 5).count() == 0


def test_increments(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "id long, v string, at int")
    assert sorted((r["id"], r["v"]) for r in increments.upserted(old, new, "id", "at").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    with pytest.raises(Exception, match="no v for"):
        increments.aligned(spark.createDataFrame([(9,)], "id long"), old, "id", "v").collect()
    folder = increments.write_version(old, f"{tmp_path}/t", 3)
    assert spark.read.parquet(folder).count() == 2


def test_statistics(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 21)], "size long")
    found = stats.size_stats(rows, "size").first()
    assert (found["n"], found["p95_size"], found["median_size"], found["mean_size"]) == (20, 20, 10.5, 10.5)
    assert stats.size_stats(rows.limit(1), "size").first()["p95_size"] == 1
    scores = spark.createDataFrame([("Q01", "m", 1.0), ("Q02", "m", float("nan")), ("Q03", "m", None), ("Q04", "m", 0.5)], "qid string, metric string, score double")
    assert stats.score_summary(scores).first()["mean"] == 0.75
    assert [r["qid"] for r in stats.worst(scores, 1).collect()] == ["Q04"]
    questions = spark.createDataFrame([(f"Q0{i}", "q") for i in range(1, 6)], "qid string, question string")
    assert sorted(r["qid"] for r in stats.missing_scores(questions, ["m"], scores).collect()) == ["Q02", "Q03", "Q05"]


def test_scored_incremental(spark, tmp_path):
    questions = spark.createDataFrame([("Q01", "a"), ("Q02", "bb")], "qid string, question string")
    found = ingest.scored_incremental(questions, ["m"], lambda metric, question: F.length(question) * 1.0, f"{tmp_path}/none")
    assert sorted((r["qid"], r["score"]) for r in found.collect()) == [("Q01", 1.0), ("Q02", 2.0)]
    more = questions.unionByName(spark.createDataFrame([("Q03", "ccc")], questions.schema))
    nan = F.when(F.col("question") == "ccc", float("nan")).otherwise(9.0)
    found = ingest.scored_incremental(more, ["m"], lambda metric, question: nan, f"{tmp_path}/none")
    assert sorted((r["qid"], str(r["score"])) for r in found.collect()) == [("Q01", "1.0"), ("Q02", "2.0"), ("Q03", "nan")]
    found = ingest.scored_incremental(more, ["m"], lambda metric, question: F.length(question) * 1.0, f"{tmp_path}/none")
    assert sorted((r["qid"], r["score"]) for r in found.collect()) == [("Q01", 1.0), ("Q02", 2.0), ("Q03", 3.0)]


def test_answer_stream(spark, tmp_path):
    questions = spark.createDataFrame([(1, "q?"), (2, " ")], "query_id long, question string")
    questions.write.parquet(f"{tmp_path}/in")
    hits = spark.createDataFrame([(1, 1, "s", "T", "u1", "k", "text one")], "query_id long, rank int, symbol string, title string, url string, kind string, text string")
    stream = spark.readStream.schema(questions.schema).parquet(f"{tmp_path}/in")
    ingest.answer_stream(stream, lambda asked: asked.join(hits, "query_id"), models.extractive_answer, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [(r["query_id"], r["answer"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "text one [1]")]


def test_chunk_statistics(spark):
    rows = [("a", "x" * 30, "u", "c", 30), ("a", "y" * 40, "u", "c", 40), ("b", "", "v", "c", 0), ("d", "z" * 3000, "v", "c", 3000), ("e", "w" * 50, "v", "", 50), ("f", "fine and long enough", "v", "c", 20)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, page_url string, citation_url string, char_count int")
    found = {(r["chunk_id"], r["problem"]) for r in stats.chunk_problems(chunks).collect()}
    assert found == {("a", "repeated id"), ("b", "empty"), ("d", "long"), ("e", "no address")}
    assert {(r["page_url"], r["n_chunks"], r["mean_chars"]) for r in stats.chunks_by_page(chunks).collect()} == {("u", 2, 35.0), ("v", 4, 767.5)}


def test_answers(spark):
    rows = [(1, "q?", 1, "s", "T", "u1", "k", " text one "), (1, "q?", 2, "", "T2", "u2", "k", "text two")]
    found = ingest.answers(spark.createDataFrame(rows, "query_id long, question string, rank int, symbol string, title string, url string, kind string, text string"), models.extractive_answer).first()
    assert found["context"] == "[1] **s** (u1)\ntext one\n\n---\n\n[2] **T2** (u2)\ntext two"
    assert found["answer"] == "text one [1]" and found["sources"][0]["url"] == "u1"
    tokens = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "answer_id long, seq long, token string")
    assert [r["text"] for r in ingest.running_text(tokens).orderBy("seq").collect()] == ["a", "ab"]


EVENTS = [(i, i % 3, f"2024-01-01 00:{i // 2:02d}:{i % 2 * 30:02d}") for i in range(60)]


def test_limiter_in_batch_and_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    plain, live = {}, {}
    for event, user, ts in EVENTS:
        at = int(ts[14:16]) * 60 + int(ts[17:])
        kept = [t for t in live.get(user, []) if t > at - 300]
        plain[event] = len(kept) < 2
        live[user] = [*kept, at] if plain[event] else kept
    batch = {r["event_id"]: r["accepted"] for r in limits.throttled(events, 2, 300).collect()}
    assert batch == plain and not all(plain.values())
    for i in range(3):
        events.where(f"event_id div 20 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = limits.throttled_stream(stream, 2, 300).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == plain
    run = limits.debounced_stream(stream, 200).writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", f"{tmp_path}/state2").start()
    run.processAllAvailable()
    run.stop()
    assert {r["event_id"] for r in spark.table("debounced").collect() if r["emitted"]} == {r["event_id"] for r in limits.debounced(events, 200).collect() if r["emitted"]}
    null_user = spark.createDataFrame([(1, None, "2024-01-01"), (2, None, "2024-01-01"), (3, 5, "2024-01-01")], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {(r["event_id"], r["accepted"]) for r in limits.throttled(null_user, 1, 10).collect()} == {(1, True), (2, False), (3, True)}
    emitted = {r["event_id"] for r in limits.debounced(events, 200).collect() if r["emitted"]}
    assert emitted == {e for e, u, _ in EVENTS if e % 3 == u and (e // 3) % 3 == 0}


def test_stream_forgets_a_key_after_its_window(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:00:10"), (3, 2, "2024-01-01 00:30:00"), (4, 1, "2024-01-01 02:00:00"), (5, 3, "2024-01-01 06:00:00"), (6, 4, "2024-01-01 12:00:00")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    for i in range(6):
        events.where(f"event_id = {i + 1}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = limits.throttled_stream(stream, 1, 300, "1 minute").writeStream.format("memory").queryName("forgets").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    assert {r["event_id"]: r["accepted"] for r in spark.table("forgets").collect()} == {r["event_id"]: r["accepted"] for r in limits.throttled(events, 1, 300).collect()}
    # Only the last event's key is still held.
    held = spark.read.format("statestore").option("stateVarName", "times").load(f"{tmp_path}/state")
    assert [r["key"]["user_id"] for r in held.select("key").distinct().collect()] == [4]


def test_batch_models_load_once_and_are_checked(spark, tmp_path):
    loads, sizes = tmp_path / "loads", tmp_path / "sizes"

    def make():
        with loads.open("a") as out:
            out.write(f"{os.getpid()}\n")

        def model(texts):
            with sizes.open("a") as out:
                out.write(f"{len(texts)}\n")
            made = np.array([[len(t), 1.0] for t in texts])
            return made / np.sqrt((made**2).sum(1))[:, None]

        return model

    def broken():
        raise OSError("no model here")

    rows = spark.createDataFrame([(i, "x" * (i % 7) if i % 10 else None) for i in range(200)], "i long, t string").repartition(4)
    found = rows.select("i", "t", models.batch_embedder(make, 2)(F.col("t")).alias("v")).collect()
    assert all(abs(r["v"][0] - len(r["t"] or "") * r["v"][1]) < 1e-5 for r in found)
    workers = loads.read_text().split()
    assert len(workers) == len(set(workers)) and max(map(int, sizes.read_text().split())) <= 16
    assert rows.select(models.batch_embedder(broken, 2, fallback=make)(F.col("t")).alias("v")).where("size(v) = 2").count() == 200
    for wrong in (models.batch_embedder(broken, 2), models.batch_embedder(make, 3), models.batch_embedder(lambda: lambda ts: [[2.0, 0.0]] * len(ts), 2)):
        with pytest.raises(Exception, match="no model here|shape|length one"):
            rows.select(wrong(F.col("t"))).collect()
    # Pooled and made unit by expressions, the same comes out.
    pooled = rows.where("t IS NOT NULL").select("t", vectors.l2_normalized(vectors.mean_pooled(F.array(F.array(F.length("t").cast("double"), F.lit(1.0))), 2)).alias("v"), models.batch_embedder(make, 2)(F.col("t")).alias("w"))
    assert pooled.where(F.abs(vectors.dot(F.col("v"), F.col("w")) - 1) > 1e-5).count() == 0
    score = models.batch_scorer(lambda: lambda a, b: [float(len(x) - len(y)) for x, y in zip(a, b)])
    assert {(r["i"], r["s"]) for r in rows.select("i", score(F.col("t"), F.lit("ab")).alias("s")).collect()} == {(i, (i % 7 if i % 10 else 0) - 2.0) for i in range(200)}


def test_tries_and_waiting_times(spark, tmp_path):
    questions = spark.createDataFrame([(f"Q{i}", f"q{i}") for i in range(6)], "qid string, question string")
    asked, now, slept = [], [0.0], []

    def score(metric, question):
        """Q0 works at once, Qn fails n times."""
        asked.append(now[0])
        return F.when(F.substring(question, 2, 1).cast("int") < len(asked), 1.0).otherwise(F.lit(float("nan")))

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    state = ingest.score_to_the_end(questions, ["m"], score, f"{tmp_path}/t", clock=lambda: now[0], sleep=sleep)
    assert {(r["qid"], r["score"], r["tries"]) for r in state.collect()} == {("Q0", 1.0, 1), ("Q1", 1.0, 2), ("Q2", 1.0, 3), ("Q3", 1.0, 4), ("Q4", 1.0, 5), ("Q5", None, 5)}
    assert slept == [10, 20, 40, 80]
    # Another pass finds nothing to do, a new question is scored alone.
    again = ingest.tried_scores(questions.unionByName(spark.createDataFrame([("Q9", "q0")], questions.schema)), ["m"], score, f"{tmp_path}/t", now[0])
    assert again.where("qid = 'Q9'").first()["tries"] == 1 and again.where("qid = 'Q5'").first()["score"] is None


def test_assembled_answers(spark):
    tokens = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (1, 10, "c")], "answer_id long, seq long, token string")
    assert sorted(map(tuple, ingest.assembled(tokens).collect())) == [(1, "abc", 3), (2, "x", 1)]


def test_answers_assembled_on_a_stream(spark, tmp_path):
    rows = [
        (0, "a", 1, "b", False, 1), (0, "a", 0, "a", False, 0), (0, "b", 0, "x", False, 2),  # a's tokens out of order, b never ends
        (1, "a", 1, "other", False, 3), (1, "a", 3, "d", True, 4),  # one again, the last before the one in front
        (2, "a", 2, "c", False, 5), (2, "c", 0, None, True, 6),
        (3, "d", 0, "y", False, 500), (4, "e", 0, "z", True, 1000),
    ]
    tokens = spark.createDataFrame(rows, "file int, answer_id string, seq int, token string, last boolean, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    for i in range(5):
        tokens.where(F.col("file") == i).drop("file", "s").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(tokens.drop("file", "s").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = assembly.assembled_stream(stream, 60, "10 seconds").writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    found = sorted(map(tuple, spark.table("assembled").collect()))
    assert found == [("a", "abcd", 4, True), ("b", "x", 1, False), ("c", "", 1, True), ("d", "y", 1, False), ("e", "z", 1, True)]


def test_measures_of_answers(spark):
    contexts = ["The cat sat on the mat. Dogs bark.", "Nothing here.", "Birds fly south in winter."]
    samples = spark.createDataFrame([("a", "Where sat the cat?", "The cat sat on a mat. Fish swim deep.", "Birds fly in winter. The moon is far.", contexts), ("b", None, "", None, [])], "qid string, question string, answer string, reference string, contexts array<string>")
    found = {(r["qid"], r["metric"]): r["score"] for r in metrics.measured(samples).collect()}
    assert found[("a", "faithfulness")] == 0.5 and found[("a", "context_recall")] == 0.5
    assert found[("a", "context_precision")] == round(1 / 3, 6) and found[("a", "answer_relevancy")] == 0.75
    assert found[("b", "faithfulness")] is None and found[("b", "answer_correctness")] is None and len(found) == 10
    relevant = spark.createDataFrame([("q", i, i in (1, 3)) for i in range(1, 5)], "qid string, rank int, relevant boolean")
    assert abs(metrics.average_precision(relevant).first()["value"] - (1 + 2 / 3) / 2) < 1e-9


def test_ingest_stream_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(f"http://h/{i}", f"<h1>T</h1><p>{'word ' * 30}") for i in range(4)], "url string, html string")
    raw, index, stored, state = (f"{tmp_path}/{x}" for x in ("raw", "index", "markdown", "state"))
    for part in ("url < 'http://h/2'", "url >= 'http://h/1'"):
        rows.where(part).write.mode("append").parquet(raw)
        run = ingest.ingest_stream(spark, raw, index, stored, state)
        run.awaitTermination()
    found = spark.read.json(index)
    assert sorted(r["url"] for r in found.collect()) == [f"http://h/{i}" for i in range(4)]
