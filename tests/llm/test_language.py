"""Languages, against a plain computation of the posterior."""

import math
import random
from urllib.parse import urlsplit

import numpy as np

from weftline.llm import extraction, language

PARTS = {"de": ["ung", "schl", "keit", "ver"], "fr": ["eau", "tion", "oux", "ment"], "en": ["ing", "the", "ly", "wh"]}
PAGES = "page_id long, url string, html string"


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(3)) for _ in range(n))


def labelled(spark, rng, n=20):
    return spark.createDataFrame([(text(rng, x, 40), x) for x in PARTS for _ in range(n)] + [(None, "de"), ("x", None)], "text string, lang string")


def plain(pages, languages, table, temperature):
    """Posterior of each page by the definition, one page at a time."""
    n, s = len(languages), language.SMOOTHING
    rows = []
    for _, url, html in pages:
        found = extraction.Page(html).main_text(extraction.PRIOR_WEIGHTS) if html else ""
        score = language.text_evidence([found], table, temperature)[0]
        host = (urlsplit(url).hostname or "") if url else ""
        declared = html.split('lang="')[1][:2] if html and 'lang="' in html else None
        vote = np.exp(score - score.max())
        rows.append((score, vote / vote.sum(), score.max() == score.min(), host, ".".join(host.split(".")[-2:]), host.split(".")[-1], declared))
    out = []
    for i, (score, _, _, host, domain, suffix, declared) in enumerate(rows):
        others = [r for j, r in enumerate(rows) if j != i and not r[2]]
        prior = np.full(n, 1 / n)
        for level, value in ((None, None), (5, suffix), (4, domain), (3, host)):
            votes = [r[1] for r in others if level is None or r[level] == value]
            prior = (sum(votes, np.zeros(n)) + s * prior) / (len(votes) + s)
        weight = score + np.log(prior)
        if declared in languages:
            everywhere = sum((r[1] for r in others), np.zeros(n)) + s
            said = sum((r[1] for r in others if r[6] == declared), np.zeros(n))
            weight += np.log((said + np.where(np.array(languages) == declared, s / 2, s / 20)) / everywhere)
        its = language.SUFFIX_LANGUAGES.get(suffix, [])
        if set(its) & set(languages):
            weight += [math.log(language.SUFFIX_TRUST if x in its else (1 - language.SUFFIX_TRUST) / (n - 1)) for x in languages]
        likely = np.exp(weight - weight.max())
        out.append((languages[int(weight.argmax())], 1 / likely.sum()))
    return out


def test_equals_the_plain_posterior(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        x, said = rng.choice(list(PARTS)), rng.choice([*PARTS, "it"])
        host = rng.choice(["a.one.de", "b.one.de", "two.fr", "three.com"])
        rows.append((i, f"http://{host}/{i}", f'<html lang="{said}"><p>{text(rng, x, rng.randrange(0, 3))}</p>'))
    rows += [(60, None, None), (61, "http://two.fr/x", ""), (0, rows[0][1], rows[0][2])]
    docs = labelled(spark, rng)
    languages, table, temperature = language.learn_models(docs)
    found = language.page_languages(spark.createDataFrame(rows, PAGES), docs).collect()
    expected = plain(rows, languages, table, temperature)
    assert sorted((r["page_id"], r["lang"], round(r["confidence"], 6)) for r in found) == sorted((p[0], lang, round(c, 6)) for p, (lang, c) in zip(rows, expected))


def test_use_all_evidence(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 4}.example.{'de' if x == 'de' else 'com'}/", f'<html lang="{x}"><p>{text(rng, x, 30)}</p>') for i, x in enumerate(list(PARTS) * 12)]
    rows += [(900, None, None), (901, "http://h0.example.de/x", '<html lang="de"><p>12</p>'), (902, "not an address", "<p></p>")]
    rows += [(903, "http://h1.example.com/", f"<p>{text(rng, 'fr', 60_000)}</p>")]
    docs = labelled(spark, rng)
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS lang", "2 AS host", "3 AS score")
    found = {r["page_id"]: r for r in language.page_languages(pages, docs).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["lang"] == list(PARTS)[i % 3] for i in range(36))
    assert found[901]["lang"] == "de" and found[901]["text_lang"] is None
    assert found[900]["lang"] in PARTS and 0 < found[900]["confidence"] <= 1
    assert found[903]["lang"] == "fr"
    empty = language.page_languages(spark.createDataFrame(rows[:2], PAGES), docs.limit(0)).collect()
    assert {r["lang"] for r in empty} == {None}
    assert language.page_languages(spark.createDataFrame([], PAGES), docs).count() == 0


def test_rare_languages_are_known_and_samples_bounded(spark):
    rng = random.Random(3)
    common = [(text(rng, "de", 5), "de") for _ in range(300)] + [("immer das gleiche", "de")] * 2000
    docs = spark.createDataFrame([*common, (text(rng, "fr", 40), "fr"), (text(rng, "fr", 40), "fr")], "text string, lang string")
    sample = language.training_texts(docs, limit=100)
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert sizes["fr"] == 2 and 60 < sizes["de"] < 150
    assert language.learn_models(docs, limit=100)[0] == ["de", "fr"]


def test_declarations():
    import re

    first = lambda html: next((m[1] for p in language.DECLARATIONS if (m := re.search(p, html))), None)
    assert first("<html class=x lang='de'>") == "de"
    assert first('<html><meta http-equiv="content-language" content="fr-FR">') == "fr"
    assert first('<meta property="og:locale" content="es_ES">') == "es"
    assert first("<p lang=de>") is None
