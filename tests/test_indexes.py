"""Stored indexes against scans, and committed tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import sparse
from weftline.functions.text import query_tokens
from weftline.operators import keyword_index, search, vector_index
from weftline.sources import tables


def same(a, b):
    return sorted(map(tuple, a.select("query_id", "key", "score", "rank").collect())) == sorted(map(tuple, b.select("query_id", "key", "score", "rank").collect()))


def made_docs(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(rng.choice([0, 3, 10, 80])))) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, "... !"), (n + 2, rows[0][1])], "key long, text string"), words


def test_keyword_index_equals_a_scan_and_leaves_shards_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "SHARD_DOCS", 16)
    docs, words = made_docs(spark, 400)
    queries = spark.createDataFrame([(1, "w1 w2 w59"), (2, "W3, w3. w4"), (3, "nothing here"), (4, ""), (5, None), (6, "w58"), (7, " ".join(words))], "query_id long, text string")
    index = keyword_index.build(docs, f"{tmp_path}/index")
    again = keyword_index.opened(spark, f"{tmp_path}/index")
    for k in (1, 7, 500):
        found = search.top_ranked(keyword_index.search(again, queries, k), k)
        assert same(found, search.keyword_search(queries, docs, k))
    assert keyword_index.pruned_share(index, queries, 3) > 0.3
    assert keyword_index.search(index, queries.limit(0), 3).count() == 0
    nothing = keyword_index.build(docs.limit(0), f"{tmp_path}/empty")
    assert keyword_index.search(nothing, queries, 3).count() == 0


def test_keyword_index_has_few_rows_and_any_bounds_give_the_same_hits(spark, tmp_path, monkeypatch):
    docs, words = made_docs(spark, 300)
    docs = docs.unionByName(spark.range(1000, 1060).selectExpr("id AS key", "'w7 w8 W7' AS text"))
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["w1 w2 w59", "W3, w3. w4", "nothing here", None, "w7 w8", "w7", "w58", " ".join(words)])], "query_id string, text string")
    wanted = {k: search.keyword_search(queries, docs, k).cache() for k in (3, 70)}
    for name, few in (("SHARD_POSTINGS", 40), ("PACK_QUERIES", 2), ("PACK_TERMS", 5), ("MEETINGS_AT_ONCE", 7), ("BROADCAST_PACKS", 0)):
        monkeypatch.setattr(keyword_index, name, few)
    index = keyword_index.build(docs, f"{tmp_path}/index")
    # A row for each part of a shard, not for each of its buckets.
    shards = index.shards.count()
    assert shards > 20 and index.postings.count() <= shards * keyword_index.PARTS
    assert index.postings.where(F.size("places") > 40).count() == 0
    sizes = index.postings.select("shard", F.size("places").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    alone = index.shards.where("size(keys) = 1").select("shard")
    assert sizes.join(alone, "shard", "left_anti").where("n > 40").count() == 0
    for k, hits in wanted.items():
        assert same(search.top_ranked(keyword_index.search(index, queries, k), k), hits)


def test_groups_of_rows_of_an_index_are_no_larger_when_decoded(spark, tmp_path):
    from pathlib import Path

    import pyarrow.parquet as pq

    docs, _ = made_docs(spark, 50)
    keyword_index.build(docs, f"{tmp_path}/index")
    for name in ("postings", "maxima"):
        groups = [f.metadata.row_group(i) for f in map(pq.ParquetFile, Path(f"{tmp_path}/index/{name}").rglob("*.parquet")) for i in range(f.metadata.num_row_groups)]
        assert groups and not any("DICTIONARY" in e for g in groups for j in range(g.num_columns) for e in g.column(j).encodings)


def test_words_are_hashed_together(monkeypatch):
    words = ["...", "a!.", "!.A.!", "_x_", "'\u0130'", "\u03a3\u0391\u03a3", "«é»", "x\x00y", "\x7fz\x01", "日本。", "a" * 5000, "", "!", "Ⅷ", "ß.", "\u212a"] + [f"(W{i})," for i in range(90_000)]
    asked, token = [], sparse._token
    monkeypatch.setattr(sparse, "_token", lambda w: asked.append(w) or token(w))
    found = sparse._buckets(pa.array(words, pa.large_string()))
    assert set(asked) == {w for w in words if not w.isascii()}
    for word, bucket in list(zip(words, found, strict=True))[:200]:
        h = 2166136261
        for b in token(word).encode():
            h = (h ^ b) * 16777619 % 2**32
        assert bucket == (h % 2**17 if token(word) else -1)
    assert len(sparse._buckets(pa.array([], pa.large_string()))) == 0


def test_searching_an_index_reads_no_text(spark, tmp_path):
    docs, _ = made_docs(spark, 50)
    docs.write.parquet(f"{tmp_path}/docs")
    keyword_index.build(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/index")
    index = keyword_index.opened(spark, f"{tmp_path}/index")
    import shutil

    shutil.rmtree(tmp_path / "docs")
    queries = spark.createDataFrame([(1, "w1 w2")], "query_id long, text string")
    assert same(search.top_ranked(keyword_index.search(index, queries, 5), 5), search.keyword_search(queries, docs, 5))


def test_more_queries_than_a_block(spark, monkeypatch):
    docs, words = made_docs(spark, 200)
    queries = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w{i // 2}") for i in range(50)], "query_id string, text string")
    vectors = spark.createDataFrame([(f"k{i}", [float(i % 7), float(i % 5), 1.0 + i % 3]) for i in range(300)], "key string, embedding array<float>")
    asked = vectors.where(F.col("key").endswith("0")).withColumnRenamed("key", "query_id")
    by_word, by_vector = search.keyword_search(queries, docs, 4).cache(), search.dense_search(asked, vectors, 4, skip_self=True).cache()
    assert by_word.count() and by_vector.count() == 120
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 20)
    monkeypatch.setattr(search, "QUERY_NUMBERS", 9)
    monkeypatch.setattr(search, "ROW_NUMBERS", 50)
    assert same(search.keyword_search(queries, docs, 4), by_word)
    assert same(search.dense_search(asked, vectors.repartition(5), 4, skip_self=True), by_vector)


def clustered(spark, n=4000, dim=16, groups=40):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(groups, dim))
    x = middle[rng.integers(0, groups, n)] + rng.normal(scale=0.25, size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, embedding array<float>")


def test_vector_index_recall_and_exact_search(spark, tmp_path):
    vectors = clustered(spark)
    queries = vectors.where("key % 40 = 0").withColumnRenamed("key", "query_id")
    wanted = search.dense_search(queries, vectors, 18).cache()
    vector_index.build(vectors, f"{tmp_path}/index")
    index = vector_index.opened(spark, f"{tmp_path}/index")
    assert index.blocks.select(F.sum(F.size("keys"))).first()[0] == 4000
    cells, centres, _ = index.centres()
    assert index.probes <= len(cells) // 4
    found = vector_index.search(index, queries, 18)
    assert vector_index.recall(found, wanted) >= 0.9
    # Scores are those of the whole vectors, and the cells looked into hold a small part of all vectors.
    exact = {(r["query_id"], r["key"]): r["score"] for r in wanted.collect()}
    assert all(exact[q, k] == s for q, k, s in found.select("query_id", "key", "score").collect() if (q, k) in exact)
    sizes = {r["cell"]: r["n"] for r in index.cells.collect()}
    looked = vector_index._looked_into(index, queries.select("query_id", F.col("embedding").alias("v")), index.probes).groupBy("query_id").agg(F.collect_list("cell").alias("c")).collect()
    assert np.mean([sum(sizes[c] for c in r["c"]) for r in looked]) < 0.3 * 4000
    assert same(vector_index.search(index, queries, 18, exactly=True), wanted)
    assert same(vector_index.search(index, queries, 18, probes=1, exactly=True), wanted)


def test_vector_index_of_equal_few_and_no_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_NUMBERS", 30)
    monkeypatch.setattr(vector_index, "CELL_TASK_ROWS", 50)
    vectors = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, [0.0, 0.0, float(i)]) for i in range(5)] + [(999, None)], "key long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, None)], "query_id long, embedding array<float>")
    index = vector_index.build(vectors, f"{tmp_path}/index", cells=4)
    assert same(vector_index.search(index, queries, 7, exactly=True), search.dense_search(queries, vectors, 7))
    index = vector_index.build(vectors.limit(0), f"{tmp_path}/none")
    assert vector_index.search(index, queries, 7).count() == 0
    assert vector_index.search(vector_index.build(vectors.limit(3), f"{tmp_path}/few"), queries.limit(0), 2).count() == 0


def test_token_overlap_is_that_of_the_tokens(spark):
    texts = ["a b c", "A, b! (c)", "", None, "torch.nn.Linear, x", "été x y", "... !"]
    rows = spark.createDataFrame([(q, t) for q in texts for t in texts], "q string, t string")
    found = rows.select(sparse.token_overlap(F.col("q"), F.col("t")).alias("o"), F.array_distinct(query_tokens(F.col("q"))).alias("a"), query_tokens(F.col("t")).alias("b")).collect()
    assert all(r["o"] == (len(set(r["a"] or []) & set(r["b"] or [])) / len(r["a"]) if r["a"] else 0) for r in found)


def test_filter_and_rewrite_reach_the_legs(spark):
    docs = spark.createDataFrame([(1, "red apple", "x"), (2, "red pear", "x"), (3, "red plum", "y")], "key long, text string, kind string")
    queries = spark.createDataFrame([(1, "red"), (2, "plum")], "query_id long, text string")
    asked = {}

    def leg(rows, k, keys):
        asked["texts"] = sorted(r["dense_text"] for r in rows.collect())
        asked["keys"] = None if keys is None else sorted(r["key"] for r in keys.collect())
        return rows.sparkSession.createDataFrame([], "query_id long, key long, score double, rank int")

    rewrite = lambda q: F.when(q == "red", F.concat(F.lit("about "), q)).otherwise("  ")
    found = search.hybrid_search(queries, docs, search.Options(), leg, F.col("key"), where=F.col("kind") == "x", rewrite=rewrite)
    assert sorted((r["query_id"], r["key"]) for r in found.collect()) == [(1, 1), (1, 2)]
    assert asked == {"texts": ["about red", "plum"], "keys": [1, 2]}
    search.hybrid_search(queries, docs, search.Options(), leg, F.col("key"))
    assert asked == {"texts": ["plum", "red"], "keys": None}


def rows_of(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_table_versions_retries_and_conflicts(spark, tmp_path, monkeypatch):
    table = tables.Table(spark, f"{tmp_path}/t", "id long, v string", ["id"])
    df = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    assert rows_of(table) == [] and table.manifest().version == 0
    table.upsert(df((1, "a"), (2, "b"), (None, "n")), batch=("w", 0))
    table.upsert(df((2, "c"), (3, "d")), gone=df((1, "")).select("id"), batch=("w", 1))
    want = [(2, "c"), (3, "d"), (None, "n")]
    assert rows_of(table) == sorted(want, key=str)
    # A batch that comes again writes nothing.
    assert table.upsert(df((2, "wrong")), batch=("w", 1)).version == 2 and rows_of(table) == sorted(want, key=str)
    assert sorted(map(tuple, table.read(1).collect()), key=str) == sorted([(1, "a"), (2, "b"), (None, "n")], key=str)

    # A write that stops between its rows and its manifest is seen by nobody, and can be made again.
    monkeypatch.setattr(tables.Table, "_committed", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        table.upsert(df((4, "e")), batch=("w", 2))
    assert rows_of(table) == sorted(want, key=str)
    monkeypatch.undo()
    table.upsert(df((4, "e")), batch=("w", 2))
    want.append((4, "e"))
    assert rows_of(table) == sorted(want, key=str)

    # Two writers: additions are both there, a replacement of what has changed is refused.
    other, before = tables.Table(spark, f"{tmp_path}/t", "id long, v string", ["id"]), table.manifest()
    other.upsert(df((5, "f")))
    with pytest.raises(tables.Conflict):
        table._commit(["nothing"], None, on=before)
    taken = tables.Manifest(table.manifest().version, ["x"])
    assert not table._committed(taken)
    want.append((5, "f"))
    table.compact()
    assert len(table.manifest().segments) == 1 and rows_of(table) == sorted(want, key=str)
    assert table.vacuum() == 5 and rows_of(table) == sorted(want, key=str)
    with pytest.raises(ValueError):
        table.read(1)
    table.replace(df((9, "z"), (9, "z")))
    assert rows_of(table) == [(9, "z")]
    table.upsert(spark.createDataFrame([(9, "old", 1), (9, "new", 3), (9, "mid", 2)], "id long, v string, at int"), order=F.col("at"))
    assert rows_of(table) == [(9, "new")]


def test_vectors_of_queries_are_not_broadcast(spark, tmp_path):
    rows = spark.range(60).selectExpr("id AS key", "array(float(sin(id)), float(cos(id)), float(sin(id * 7))) AS embedding")
    index = vector_index.build(rows, str(tmp_path / "index"), cells=4)
    asked = rows.selectExpr("key AS query_id", "embedding AS v").where("query_id % 5 = 0")
    found = vector_index._candidates(index, vector_index._looked_into(index, asked, 2), 3)
    whole = vector_index._whole(index, found.select("cell", "block", "place"))
    for df in (found, whole):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_scores_are_worked_out_for_few_meetings_at_once(monkeypatch):
    monkeypatch.setattr(search, "MEETINGS_AT_ONCE", 50)
    first = np.arange(101) * 10  # each of 100 buckets is asked for by ten queries
    lists = [list(range(n)) for n in (3, 0, 9, 1, 2, 2, 4, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([[0] * 7, *lists], pa.list_(pa.int32()))], ["key", "buckets"]).slice(1)
    parts = list(search._by_meetings(batch, first, 3))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(1, 9))
    assert [[len(x) for x in p.column(1).to_pylist()] for p in parts] == [[3, 0], [9], [1, 2, 2], [4, 0]]
