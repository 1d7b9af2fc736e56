import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from("ab #é\n\t|"), max_size=60), max_size=6))
def test_measures_agree_with_plain_code(texts):
    assert [tuple(r) for r in quality.measure(texts).itertuples(index=False)] == [plain_measures(t) for t in texts]


def test_host_verdict_and_defined_cases(spark, documents):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "en", "bad", 5) for i in range(30)] + [(100, good, "en", "bad", 9), (101, good, "en", "fine", 9), (102, None, "en", None, None), (103, good, None, None, 1)]
    rows += [(200 + i, good + f" x{i}", "en", "fine", 9) for i in range(30)]
    found = {r["doc_id"]: r for r in quality.quality(documents(rows), keep=["doc_id"]).collect()}
    assert not found[100]["base_failed"] and not found[100]["kept"]
    assert found[101]["kept"]
    assert found[102]["base_failed"] and found[102]["n_words"] == 0
    docs = documents(rows).withColumnRenamed("lang", "kept")
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}
    assert quality.quality(documents([])).count() == 0
    clash = documents(rows + rows[:2]).selectExpr("*", "1 AS host", "2 AS q", "3 AS failed", "4 AS bad", "5 AS n_words")
    again = quality.quality(clash)
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars", "host", "q", "failed", "bad", *quality.MEASURES, "base_failed", "kept"]
    assert again.count() == len(rows) + 2
    long = quality.quality(documents([(1, " ".join(f"w{i}" for i in range(200_000)))]), keep=["doc_id"]).first()
    assert long["n_words"] == 200_000 and long["kept"] and long["n_repeat_words"] == 0


def test_permutation_is_one_and_can_be_undone():
    for n in (1, 2, 3, 17, 1000):
        keys = mixing._round_keys(1, 5, 0)
        out = mixing.permuted(np.arange(n), n, keys)
        assert sorted(out.tolist()) == list(range(n))
        assert mixing.permuted(out, n, keys, back=True).tolist() == list(range(n))


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_reaches_targets_and_repeats(spark, documents):
    rows = [(i, " ".join(["w"] * (i * 37 % 400)), "en", s, 1) for i, s in enumerate(["a", "b", None, "c", "a", "d"] * 40)]
    rows += [(1, "w w w", "en", "a", 1)] * 2 + [(None, None, "en", "e", None), (7000, "x y", "en", "tiny", 3)]
    docs = documents(rows)
    found = mixing.mix(docs, block_words=64).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    targets = plain_targets(dict(sizes))
    taken = Counter()
    for r in found:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        assert target - 1 - 1e-6 <= taken[source] <= target + 1e-6
    assert sorted(map(str, mixing.mix(docs.repartition(7), block_words=64).collect())) == sorted(map(str, found))
    assert mixing.mix(documents([])).count() == 0


@pytest.mark.parametrize("part", [3, 50_000])
def test_targets_of_many_sources_in_ranges(spark, monkeypatch, part):
    """Each task puts few sources in order; targets are those of plain code, whatever the ranges."""
    monkeypatch.setattr(mixing, "PART_SOURCES", part)
    sizes = {f"s{i * 7919 % 101}": i * i * 37 % 1000 for i in range(60)} | {"é": 5, "\U0001f600": 70, "\uffff": 7, "": 9, None: 50, "hot": 9000}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    wanted = plain_targets(sizes)
    assert found.keys() == wanted.keys()
    assert all(abs(found[s] - wanted[s]) < 1e-6 for s in wanted)


def test_slots_are_dealt_once_and_blocks_drawn_evenly(monkeypatch):
    """Groups and shards part the slots among them; every block is in each whole epoch once, and the words
    taken are the target."""
    import pandas as pd

    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    for size, target, n_shards in ((1000, 1730.0, 7), (64, 128.0, 1), (65, 1.5, 4), (5000, 4999.9, 10)):
        groups, shards, blocks_of, both = mixing._drawn(64, 7)
        source = pd.DataFrame({"code": [9], "source_size": [size], "target": [target], "n_shards": [n_shards]})
        dealt = pd.concat(shards(groups(iter([source]))))
        assert dealt["shard"].max() < n_shards
        slots = sorted(dealt["slot"])
        assert slots == list(range(len(slots)))
        each = pd.DataFrame({"code": 9, "source_size": size, "words": int(target), "slot": slots})
        drawn = pd.concat(blocks_of(iter([each])))
        assert sorted(map(tuple, pd.concat(both(groups(iter([source])))).to_numpy().tolist())) == sorted(map(tuple, drawn.to_numpy().tolist()))
        lengths = {b: min(64, size - 64 * b) for b in range(-(-size // 64))}
        assert drawn["take"].sum() == int(target)
        epochs = int(target) // size
        for block, length in lengths.items():
            takes = drawn[drawn["block"] == block]["take"].tolist()
            assert takes.count(length) >= epochs and len(takes) <= epochs + 1


def test_mix_of_long_texts_and_clashing_columns(spark, documents):
    docs = documents([(1, "w " * 400_000, "en", "a", 1), (2, "w " * 1000, "en", "b", 1)])
    docs = docs.selectExpr("*", "1 AS size", "2 AS target", "'x' AS code", "'y' AS block")
    found = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert found[1]["size"] == 400_000 and found[2]["taken"] == 2000 and abs(found[1]["taken"] - found[1]["target"]) < 1
