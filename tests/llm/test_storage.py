import os

import pytest
from pyspark.sql import functions as F

from weftline.llm import storage


def test_saved_tables_can_be_deleted(spark):
    table = storage.saved(spark.range(5))
    path = table.saved_at.removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    storage.dropped(table)
    assert not os.path.exists(path)
    other = storage.saved(spark.range(2)).saved_at.removeprefix("file://")
    storage.cleared(spark)
    assert not os.path.exists(other)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Cluster)


def test_samples_are_bounded_whatever_repeats(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), "id")).alias("u"), F.lit("x").alias("h"))
    sample = storage.sampled(rows, ["u", "h"], 300)
    assert 150 < sample.count() < 450
    assert storage.sampled(rows, ["u", "h"], 5000).count() == 2001


def test_numbered_columns_come_back(spark):
    docs = spark.sql("SELECT 1 AS a, 2 AS b, 3 AS a")
    own, names, back = storage.numbered(docs)
    assert own.columns == ["own_0", "own_1", "own_2"] and names == {"a": "own_0", "b": "own_1"}
    assert own.select(*back).columns == ["a", "b", "a"]
