"""Toxicity, spans, licenses, languages, and the pipeline."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from weftline.llm import licenses, spans, toxicity
from weftline.llm.registry import QUERIES

WORDS = [f"{a}{b}{c}" for a in ("ba", "ce", "di", "fo") for b in ("na", "pe", "ri") for c in ("st", "ll", "m")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_features_see_hidden_and_near_insults():
    names = toxicity.FEATURES
    row = lambda t: dict(zip(names, toxicity.features([t])[0]))
    assert row("You are an idiot, you stupid moron!")["near_second_person"] > 0
    assert row("what an 1d10t and s.t.u.p.i.d person")["obfuscated"] > 0
    assert row("a st*pid idea")["obfuscated"] > 0
    assert row("version 1.2.3 of well-known e-mail at 10:30")["obfuscated"] == 0
    assert not toxicity.features([None, ""]).any()
    assert len(toxicity.features([])) == 0


LETTERS = "[a-z\u0080-\U0010ffff']+"


def plain_features(text):
    """The features by their definitions; without hidden spellings and learned stems."""
    text = text or ""
    words = re.findall(LETTERS, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    at = [i for i, w in enumerate(words) if w in toxicity.INSULTS]
    seconds = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= 6 for j in seconds) for i in at)
    marks = [c in "!?" for c in text]
    spaced = re.findall(r"[^\x20\x09-\x0D]+", text)
    shouted = sum(len(re.findall("[A-Z]", w)) >= 3 for w in spaced)
    size, n = max(1, len(text.encode())), max(1, len(words))
    return [
        100 * len(at) / n, np.log1p(len(at)), len({words[i] for i in at}), np.log1p(sum(b - a <= 15 for a, b in zip(at, at[1:]))),
        np.log1p(near), 100 * near / n, 100 * len(seconds) / n, 100 * sum(w in toxicity.THREATS for w in words) / n,
        len(re.findall("[A-Z]", text)) / size, shouted / n, 100 * sum(marks) / size, 100 * sum(a and b for a, b in zip(marks, marks[1:])) / size,
        len(re.findall(r"[#*$%&@|<>~^_=+]", text)) / size, np.log1p(len(words)),
    ]


def test_features_equal_plain_code():
    rng = random.Random(7)
    pool = ["you", "idiot", "STUPID", "kill", "Your", "dumm", "été", "plain", "WORD", "it's", "why?!", "#tag", "no!!!", "x", "\n", "merde,"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, "", " ", "you " * 200_000]
    found = toxicity.features(texts)
    keep = [i for i, f in enumerate(toxicity.FEATURES) if f not in ("obfuscated", "obfuscated_percent", "learned_percent", "learned", "learned_weight")]
    for row, text in zip(found[:, keep], texts):
        assert np.allclose(row, plain_features(text)), text and text[:200]


def test_toxicity_of_empty_tables_and_clashing_columns(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(documents([]), labels).count() == 0
    docs = documents([(1, "a"), (2, "b"), (2, "c")]).selectExpr("*", "1 AS x", "2 AS label", "3 AS score", "4 AS features")
    assert toxicity.toxicity(docs, labels).count() == 3


def test_toxicity_learns_and_keeps_held_out_labels_apart(spark, documents):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        text = prose(rng, rng.randrange(20, 60))
        if bad:
            text += " " + " ".join(rng.choice(["grumhaft", "grumling", "idiot"]) for _ in range(5))
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(None, None), (5000, ""), (3, rows[3][1])]
    known = spark.createDataFrame([*labels, (77, None), (None, 1)], "doc_id long, toxic int")
    docs = documents(rows)
    found = toxicity.toxicity(docs, known).collect()
    assert len(found) == len(rows)
    truth = dict(labels)
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for s, p, _ in held)
    assert np.mean([p == t for _, p, t in held]) > 0.95
    turned = spark.createDataFrame([(i, 1 - t) for i, t in labels], "doc_id long, toxic int")
    import zlib

    mixed = known.where("doc_id IS NOT NULL").join(turned.withColumnRenamed("toxic", "other"), "doc_id").collect()
    swapped = [(r["doc_id"], r["other"] if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 else r["toxic"]) for r in mixed]
    again = toxicity.toxicity(docs, spark.createDataFrame(swapped, "doc_id long, toxic int")).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in again) == sorted((str(r["doc_id"]), round(r["score"], 9)) for r in found)
    none = toxicity.toxicity(docs, known.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def plain_runs(sentences):
    """Runs by their definition; a sentence is a list of words."""
    out = set()
    for i in range(len(sentences)):
        for j in range(i + 1, len(sentences)):
            if len(sentences[i]) < spans.LONG_WORDS and sum(map(len, sentences[i : j + 1])) >= spans.MIN_WORDS:
                out.add((i, j))
                break
        for j in range(i - 1, -1, -1):
            if len(sentences[i]) < spans.LONG_WORDS and sum(map(len, sentences[j : i + 1])) >= spans.MIN_WORDS:
                out.add((j, i))
                break
        if len(sentences[i]) >= spans.LONG_WORDS:
            out.add((i, i))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 1000), (3, 2)])
def test_spans_equal_brute_force(spark, documents, monkeypatch, seed, hot):
    """With a small limit, the way for hot hashes decides."""
    monkeypatch.setattr(spans, "HOT_RUNS", hot)
    monkeypatch.setattr(spans, "HOT_SHARE", 10**9 if hot < 1000 else 50_000)
    rng = random.Random(seed)
    passage = [prose(rng, rng.choice([2, 5, 11, 30])) for _ in range(9)]
    rows = []
    for i in range(40):
        own = [prose(rng, rng.randrange(1, 15)) for _ in range(rng.randrange(0, 8))]
        if i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[rng.randrange(3) :]
        rows.append((i, own))
    rows.append((50, [*passage, *passage]))
    seen, gone = {}, {}
    for doc, sentences in sorted(rows):
        words = [s.split() for s in sentences]
        for a, b in sorted(plain_runs(words)):
            key = tuple(" ".join(sentences[a : b + 1]).lower().split())
            if seen.setdefault(key, (doc, a)) != (doc, a):
                gone.setdefault(doc, set()).update(range(a, b + 1))
    found = spans.without_repeats(documents([(d, " ".join(s)) for d, s in rows])).collect()
    for r in found:
        kept = [s for i, s in enumerate(dict(rows)[r["doc_id"]]) if i not in gone.get(r["doc_id"], ())]
        assert r["text"] == " ".join(kept)
        assert r["n_removed"] == len(gone.get(r["doc_id"], ()))
    assert sum(r["n_removed"] for r in found) > 50


def test_spans_defined_cases(spark, documents):
    text = "one two three four five six seven. eight nine ten eleven twelve thirteen.\nfourteen fifteen sixteen."
    docs = documents([(1, text), (1, text), (2, "x. " + text), (3, None), (4, ""), (None, "short")])
    found = sorted(((r["doc_id"], r["text"]) for r in spans.without_repeats(docs).collect()), key=str)
    assert found == sorted([(1, text), (1, text), (2, "x."), (3, None), (4, ""), (None, "short")], key=str)
    assert spans.without_repeats(documents([])).count() == 0
    clash = docs.selectExpr("*", "1 AS __id", "2 AS spans", "3 AS key", "4 AS n_removed").withColumnRenamed("doc_id", "id")
    clash = clash.withColumn("id", clash["id"].cast("string"))
    found = spans.without_repeats(clash, "id")
    assert found.columns == ["id", "text", "lang", "source", "n_chars", "__id", "spans", "key", "n_sentences", "n_removed"]
    assert {(r["id"], r["text"]) for r in found.collect()} == {("1", text), ("2", "x."), ("3", None), ("4", ""), (None, "short")}


def test_spans_of_long_sentences_wide_stops_and_long_texts(spark, documents):
    rng = random.Random(6)
    long = prose(rng, 60)
    chinese = "这是一段普通的文字。后面还有别的文字！再来一句话？"
    many = " ".join(prose(rng, 8) for _ in range(20_000))
    rows = [(1, f"Own start. {long}"), (2, f"Another start. {long} Its own end."), (3, chinese), (4, "开头。" + chinese), (5, many), (6, "x " * 300_000), (7, "Tail of it. " + many)]
    found = {r["doc_id"]: r for r in spans.without_repeats(documents(rows)).collect()}
    assert found[2]["text"] == "Another start. Its own end."
    assert found[3]["text"] == chinese and found[4]["text"] == "开头。"
    assert found[5]["text"] == many and found[7]["text"] == "Tail of it." and found[7]["n_sentences"] == 20_001


def plain_licenses(text):
    """Notices by their definition: (template, first word, containment) of each run of a template's shingles."""
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = set()
    for i, (name, template) in enumerate((n, t) for n, ts in licenses.TEMPLATES.items() for t in ts):
        own = re.findall("[0-9a-z]+", template.lower())
        want = {tuple(own[j : j + 5]) for j in range(len(own) - 4)}
        part = []
        for at in [*(j for j, r in enumerate(runs) if r in want), 10**9]:
            if part and at - part[-1] > len(want):
                share = len({runs[j] for j in part}) / len(want)
                if share >= licenses.CONTAINMENT:
                    out.add((i, part[0], round(share, 6)))
                part = []
            part.append(at)
    return out


def test_licenses_equal_brute_force(spark, documents):
    rng = random.Random(1)
    rows, texts = [], [t for ts in licenses.TEMPLATES.values() for t in ts]
    for i, notice in enumerate(texts * 3):
        words = notice.split()
        if i >= len(texts):  # some words changed: near the border of containment
            for _ in range(rng.randrange(0, max(1, len(words) // 25) + 1)):
                words[rng.randrange(len(words))] = "changed"
        rows.append((i, f"{prose(rng, rng.randrange(0, 90))}\n{' '.join(words)}.\n{prose(rng, rng.randrange(0, 90))}"))
    rows += [(9000, prose(rng, 500)), (9001, None), (9002, ""), (9003, "under the License"), (9004, texts[0] + ". " + prose(rng, 60) + " " + texts[0]), (None, texts[1])]
    rows += [(9005, prose(rng, 150_000) + texts[3] + prose(rng, 1000)), (5, rows[5][1])]
    docs = documents(rows).selectExpr("*", "1 AS license", "2 AS template")
    found = licenses.licenses(docs).collect()
    expected = sorted(((str(d), *x) for d, t in rows for x in plain_licenses(t)), key=str)
    assert sorted(((str(r["doc_id"]), r["template"], r["first_word"], round(r["containment"], 6)) for r in found), key=str) == expected
    assert len({r["template"] for r in found}) == len(texts)
    assert licenses.licenses(documents([])).count() == 0
    assert licenses.bands(0.5) == 24


def test_pipeline_equals_its_stages(spark, documents, tmp_path):
    rng = random.Random(8)
    good = [prose(rng, 80) for _ in range(30)]
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(50, good[0] + " and", "en", "s1", 1), (51, "short", "en", "s1", 5), (52, good[1].replace("st", "zz") + " " + item, "en", "s2", 9)]
    mail = "mail.me@host.example.com"
    rows += [(53, prose(rng, 70) + " " + mail, "en", "s2", 7)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r for r in docs.collect()})
    first, near, clean, private = kept
    assert set(first) == {*range(30), 50, 52, 53} and set(near) == set(first) - {50} and set(clean) == set(near) - {52} == set(private)
    assert mail not in private[53]["text"] and private[53]["n_chars"] == len(private[53]["text"])
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in result} == set(private)


def test_pipeline_of_empty_and_odd_tables(spark, documents, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(120_000))
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, prose(rng, 80), None, None, None), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (None, prose(rng, 90), "en", "a", 1)]
    for name, rows in (("none", []), ("odd", odd)):
        folder = tmp_path / name
        documents(rows).selectExpr("*", "1 AS host", "2 AS `__new`", "3 AS block").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted((r["doc_id"] for r in found), key=str) == ([] if not rows else [2, 3, None])


def test_registered_once_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
