import random

import numpy as np
import pytest

from test_kernels import plain_shingles
from weftline.llm import kernels, neardup


def brute_force(rows, percent):
    """Components by comparing all pairs and following links."""
    sets = [plain_shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(i, len(s), c) for (i, _), s, c in zip(rows, sets, label)}


def corpus(seed, n_groups=12, copies=14, words=60):
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, words))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((doc, " ".join(text)))
            doc += 1
    return rows


@pytest.mark.parametrize(("seed", "percent", "most"), [(1, 85, 48), (2, 80, 48), (3, 85, 3)])
def test_components_equal_brute_force(spark, documents, monkeypatch, seed, percent, most):
    """With a small limit, the way for crowded bands decides."""
    monkeypatch.setattr(neardup, "MOST_IN_BAND", most)
    rows = corpus(seed, words=220) + [(9001, None), (9002, ""), (9003, " \n "), (9004, "one"), (9005, "ONE")]
    found = neardup.near_duplicates(documents(rows), percent=percent).collect()
    assert {(r[0], r[1], r[2]) for r in found} == brute_force(rows, percent)
    assert len(found) == len(rows)


def test_repeated_rows_ids_and_nulls(spark, documents):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (None, text), (3, "x y z"), (7, text)]
    found = sorted(neardup.near_duplicates(documents(rows)).collect(), key=str)
    assert sorted((r["id"], r["component_id"]) for r in found if r["id"] is not None) == [(3, 3), (5, 5), (5, 5), (7, 5)]
    assert [(r["id"], r["component_id"]) for r in found if r["id"] is None] == [(None, None)]
    two = [(5, text), (5, "p q r s t u"), (9, "p q r s t u"), (11, text)]
    found = neardup.near_duplicates(documents(two)).collect()
    assert sorted((r["id"], r["component_id"]) for r in found) == [(5, 5), (5, 5), (9, 5), (11, 5)]
    # Text A of id 1 stands for id 0 too, and B of id 1 for a near copy.
    near = " ".join(f"w{i}" for i in range(60))
    mixed = [(0, text), (1, text), (1, near), (2, near + " end")]
    found = neardup.near_duplicates(documents(mixed)).collect()
    assert sorted((r["id"], r["component_id"]) for r in found) == [(0, 0), (1, 0), (1, 1), (2, 1)]
    assert neardup.near_duplicates(documents([])).count() == 0


def test_large_groups_long_texts_and_other_ids(spark, documents, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 3)
    monkeypatch.setattr(neardup, "HOT_SHARE", 10**9)
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(i, "a b c d e f g") for i in range(9)] + [(20, long), (21, long + " end"), (30, "p q r s t u")]
    docs = documents(rows).selectExpr("cast(doc_id AS string) AS id", "text", "1 AS gone", "2 AS again", "3 AS n", "4 AS bands")
    found = {r["id"]: r["component_id"] for r in neardup.near_duplicates(docs, "id").collect()}
    assert found == {str(i): "0" if i < 9 else "20" if i < 30 else "30" for i, _ in rows}
    kept = neardup.one_of_each(docs, "id")
    assert kept.columns == docs.columns and sorted(r["id"] for r in kept.collect()) == ["0", "20", "30"]


def test_pairs_at_the_threshold_are_found():
    """Of 1200 pairs right at the threshold each meets in a band and passes the estimate."""
    rng = np.random.default_rng(3)
    draw = lambda n: kernels.mix(rng.integers(1, 1 << 62, n).astype(np.uint64))
    for percent in (80, 85):
        rows = neardup.band_rows(percent)
        for size in (20, 150, 310, 2000):
            kind = int(size >= neardup.SMALL * percent // 100)
            make = neardup.registers_large if kind else neardup.registers_small
            for _ in range(150):
                union = draw(size)
                only = size * (100 - percent) // 100
                one, two = union[: size - only // 2], np.concatenate((union[: size - only], union[size - only // 2 :]))
                p, q = make(one)[None, :], make(two)[None, :]
                assert neardup.may_be_linked(p, q, percent)[0]
                assert len(np.intersect1d(neardup.band_keys(p, rows, kind)[0], neardup.band_keys(q, rows, kind)[0]))


def test_one_of_each_keeps_columns_and_one_row(spark, documents):
    text = "a b c d e f g"
    docs = documents([(5, text), (5, text), (7, text), (8, None), (9, "q")])
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 8, 9]


def test_bands_meet_the_stated_miss_rate():
    for percent in (80, 85, 95):
        rows = neardup.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (neardup.REGISTERS // rows) < 1e-8
    rng = np.random.default_rng(0)
    for n, make in ((200, neardup.registers_small), (2000, neardup.registers_large)):
        s = kernels.mix(rng.integers(0, 1 << 62, n).astype(np.uint64))
        t = np.concatenate((s[: int(n * 0.95)], kernels.mix(rng.integers(0, 1 << 62, n // 20).astype(np.uint64))))
        share = (make(s) == make(t)).mean()
        assert abs(share - 0.95 / 1.05) < 0.12
