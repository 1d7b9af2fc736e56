"""A sitemap as a data source, and side outputs."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import keyword_index
from weftline.functions import sparse
from weftline.sources import crawl
from weftline.streaming import observed


def site(folder, n):
    for i in range(n):
        (folder / f"{i}.html").write_text(f"<p>page {i}")
    places = [f"{folder}/{i}.html" for i in range(n)] + [f"{folder}/genindex.html", f"{folder}/missing.html"]
    (folder / "map.xml").write_text("<urlset xmlns='x'>" + "".join(f"<url><loc> {p} </loc></url>" for p in places) + "</urlset>")


def test_pages_of_a_sitemap_in_batch(spark, tmp_path):
    site(tmp_path, 7)
    spark.dataSource.register(crawl.SitemapPages)
    rows = spark.read.format("sitemap").option("sitemap", f"{tmp_path}/map.xml").option("partitions", 3).option("wait", 0).load()
    found = {r["pos"]: r for r in rows.collect()}
    assert sorted(found) == list(range(8)) and rows.rdd.getNumPartitions() == 3
    assert [found[i]["html"] for i in range(7)] == [f"<p>page {i}" for i in range(7)] and found[7]["html"] is None and "FileNotFoundError" in found[7]["error"]
    (tmp_path / "map.xml").write_text("<urlset/>")
    assert rows.count() == 0


def test_retries_and_pace(tmp_path, monkeypatch):
    site(tmp_path, 3)
    slept, asked = [], []
    monkeypatch.setattr(crawl.time, "sleep", slept.append)
    pages = crawl._Batch({"sitemap": f"{tmp_path}/map.xml", "attempts": "3", "wait": "2", "rps": "1", "partitions": "2"})
    read = pages.fetch

    def fetch(address):
        asked.append(address)
        if address.endswith("0.html") and asked.count(address) < 3:
            raise OSError("busy")
        return read(address)

    pages.fetch = fetch
    assert [r[0] for r in pages.read(crawl.Span(0, 4, 2))] == [0, 2]
    assert asked.count(f"{tmp_path}/0.html") == 3 and [s for s in slept if s in (2.0, 4.0)] == [2.0, 4.0]
    assert any(1.5 < s <= 2 for s in slept)


def test_a_stream_reads_no_page_twice(spark, tmp_path):
    site(tmp_path, 4)
    spark.dataSource.register(crawl.SitemapPages)
    counts = []
    listener = observed.BatchCounts(lambda name, batch, found: counts.append((batch, found["rows"], found["failed"])))
    spark.streams.addListener(listener)
    try:
        for n in (4, 4, 6):
            if n == 6:
                for i in (4, 5):
                    (tmp_path / f"{i}.html").write_text(f"<p>page {i}")
                text = (tmp_path / "map.xml").read_text().replace("</urlset>", "".join(f"<url><loc>{tmp_path}/{i}.html</loc></url>" for i in (4, 5)) + "</urlset>")
                (tmp_path / "map.xml").write_text(text)
            pages = spark.readStream.format("sitemap").option("sitemap", f"{tmp_path}/map.xml").option("wait", 0).load()
            pages = observed.counted(pages, failed=F.count_if(F.col("error").isNotNull()))
            run = pages.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
            run.awaitTermination()
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        spark.streams.removeListener(listener)
    found = [r["url"].removeprefix(f"{tmp_path}/") for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(found) == ["0.html", "1.html", "2.html", "3.html", "4.html", "5.html", "missing.html"]
    assert sum(n for _, n, _ in counts) == 7 and sum(n for _, _, n in counts) == 1


def test_a_side_output_that_fails_fails_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "q")], "id long, query string").write.parquet(f"{tmp_path}/in")
    done = []

    def log(batch):
        raise OSError("no log today")

    stream = spark.readStream.schema("id long, query string").parquet(f"{tmp_path}/in")
    run = observed.answered_and_logged(lambda batch, number: done.append(batch.count()), log)
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    assert done == [1]
    assert observed.at_best(lambda rows: rows.count())(spark.range(2)) and not observed.at_best(log)(spark.range(2))
    with pytest.raises(OSError):
        log(None)


def test_frequencies_kept_up_to_date(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6)))
    frame = lambda docs: spark.createDataFrame(list(docs.items()), "key long, text string")
    counted = lambda docs: sparse.postings(frame(docs), "key", "text").groupBy("bucket").agg(F.count("*").alias("df"))
    docs = {i: text() for i in range(30)}
    df = counted(docs)
    for _ in range(3):
        before, after = {}, {}
        for i in rng.sample(range(40), 12):
            if i in docs:
                before[i] = docs.pop(i)
            if rng.random() < 0.7:
                after[i] = docs[i] = text()
        df = keyword_index.changed_frequencies(df, frame(before), frame(after))
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, counted(docs).collect()))
