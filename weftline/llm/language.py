"""Language of pages by Bayesian fusion of evidence (operator 6).

Four pieces of evidence are multiplied: the likelihood of the page's text under character trigram models
of each language; that of the language its markup declares; that of its address's suffix; and a prior
of its host. Host priors are smoothed in a hierarchy, host to registered domain to suffix to all pages,
from grouped counts of what the texts alone say, the page's own vote left out. How far declarations
can be trusted is counted in the same way. A text's likelihood is tempered, by a temperature fitted to
labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import extraction, kernels
from weftline.llm.storage import dropped, saved, small

#: Labelled texts used for a language's model and for the temperature, at most (about) for each language: the
#: distinct ones with the smallest hash. One in TEMPERATURE_SHARE of them serves the temperature.
TRAINING_TEXTS, TEMPERATURE_SHARE = 2000, 4
BUCKETS = 1 << 14
#: Temperatures tried: neighbouring trigrams share letters, so that a text's are no independent evidence.
TEMPERATURES = tuple(2.0**-i for i in range(9))
#: Weight of each level of the hierarchy in pages.
SMOOTHING = 5.0
#: Likelihood that a country's suffix stands on pages of one of its languages.
SUFFIX_TRUST = 0.8

#: Where markup declares a language: the root element, a meta element in its stead, or a locale for previews.
DECLARATIONS = (
    r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})",
    r"(?i)<meta\b[^<>]*?\bcontent-language\b[^<>]*?\bcontent\s*=\s*[\"']?([a-z]{2,3})",
    r"(?i)<meta\b[^<>]*?\bog:locale\b[^<>]*?\bcontent\s*=\s*[\"']?([a-z]{2,3})",
)

# Languages of country suffixes.
SUFFIX_LANGUAGES = {
    "de": ["de"], "at": ["de"], "ch": ["de", "fr", "it"], "li": ["de"], "fr": ["fr"], "be": ["nl", "fr"], "es": ["es"],
    "mx": ["es"], "ar": ["es"], "cl": ["es"], "co": ["es", "en"], "pe": ["es"], "uk": ["en"], "us": ["en"], "ie": ["en"],
    "au": ["en"], "nz": ["en"], "ca": ["en", "fr"], "it": ["it"], "pt": ["pt"], "br": ["pt"], "nl": ["nl"], "pl": ["pl"],
    "ru": ["ru"], "se": ["sv"], "dk": ["da"], "no": ["no"], "fi": ["fi"], "jp": ["ja"], "cn": ["zh"], "kr": ["ko"],
}


def _trigrams(texts: list[str | None]) -> list[np.ndarray]:
    """Bucket of each byte trigram of the letters of each text, words bordered by one gap."""
    gap = np.ones(256, bool)
    gap[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
    out = []
    for text in texts:
        raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
        letters = np.where(gap[raw], np.uint8(32), raw)
        letters = np.concatenate(([np.uint8(32)], letters, [np.uint8(32)]))
        letters = letters[np.concatenate(([True], (letters[1:] != 32) | (letters[:-1] != 32)))].astype(np.uint64)
        code = letters[:-2] << np.uint64(16) | letters[1:-1] << np.uint64(8) | letters[2:]
        out.append((kernels.mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return out


def training_texts(texts: DataFrame, text: str = "text", lang: str = "lang", limit: int = TRAINING_TEXTS) -> DataFrame:
    """(lang, text, h): about limit distinct labelled texts of each language at most, with their hash.

    The cut-off on the hash comes from each language's number of distinct texts, so that rare languages
    keep all of theirs and repeated texts crowd out nothing.
    """
    known = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.withColumn("h", F.xxhash64("text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("c"))
    below = known.join(small(counts), "lang").where(F.pmod("h", F.lit(1 << 32)) < F.lit(float(1 << 32)) * limit / F.col("c"))
    return below.dropDuplicates(["lang", "h"]).select("lang", "text", "h")


def learn_models(texts: DataFrame, text: str = "text", lang: str = "lang", limit: int = TRAINING_TEXTS) -> tuple[list[str], np.ndarray, float]:
    """All languages of the labelled texts, the log likelihood of each bucket in each, and the temperature:
    that at which held-back texts are likeliest. Tables of bounded size."""
    sample = saved(training_texts(texts, text, lang, limit))
    held_back = F.pmod(F.shiftright("h", 32), F.lit(TEMPERATURE_SHARE)) == 0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                n = np.bincount(np.concatenate(_trigrams(part["text"].tolist())), minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": name, "bucket": at, "n": n[at]})

    counted = sample.where(~held_back).mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    table = np.full((len(languages), BUCKETS), 0.1)
    for i, name in enumerate(languages):
        part = counted[counted["lang"] == name]
        table[i, part["bucket"].to_numpy()] += part["n"].to_numpy()
    table = np.log(table / table.sum(1, keepdims=True))

    def trials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = text_evidence(batch["text"].tolist(), table, 1.0)
            own = np.searchsorted(languages, batch["lang"])
            for i, t in enumerate(TEMPERATURES):
                likely = t * scores
                likely -= likely.max(1, keepdims=True)
                loss = likely[np.arange(len(own)), own] - np.log(np.exp(likely).sum(1))
                yield pd.DataFrame({"i": [i], "fit": [float(loss.sum())]})

    tried = {}
    if len(languages) > 1:
        summed = sample.where(held_back).select("lang", "text").mapInPandas(trials, "i int, fit double").groupBy("i").agg(F.sum("fit").alias("fit"))
        tried = {r["i"]: round(r["fit"], 6) for r in summed.collect()}
    dropped(sample)
    return languages, table, TEMPERATURES[max(tried, key=lambda i: (tried[i], i), default=0)]


def text_evidence(texts: list[str | None], table: np.ndarray, temperature: float) -> np.ndarray:
    """Log likelihood of each text in each language, tempered; zeros without letters."""
    out = np.zeros((len(texts), len(table)))
    for i, grams in enumerate(_trigrams(texts)):
        if len(grams):
            out[i] = table[:, grams].sum(1) * temperature
    return out


def _smoothed(votes: Column, total: Column, above: Column) -> Column:
    """Counts of each language smoothed towards the level above."""
    return F.zip_with(votes, above, lambda n, p: (n + SMOOTHING * p) / (total + SMOOTHING))


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def page_languages(
    pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """page_id, url, text_lang, declared, host, lang and confidence of each page.

    text_lang is the best language by the text alone (null without letters), lang by all evidence.
    Null pages and addresses count as no evidence; a page without any gets the most common language.
    Repeated rows vote each. Without labelled texts lang is null. Ties go to the first language by name.
    Texts count as a whole, however long.
    """
    languages, table, temperature = learn_models(labelled, text, lang)
    if not languages:
        nothing = F.lit(None).cast("string")
        return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), nothing.alias("text_lang"), nothing.alias("declared"), nothing.alias("host"), nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    n = len(languages)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [extraction.Page(x).main_text(extraction.PRIOR_WEIGHTS) if x else "" for x in batch]
            yield pd.Series(list(text_evidence(texts, table, temperature)), dtype=object)

    names = F.array(*map(F.lit, languages))
    declared = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(F.col(html), pattern, 1)), F.lit("")) for pattern in DECLARATIONS])
    host = F.lower(F.regexp_extract(F.col(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), evidence(F.col(html)).alias("score"),
        declared.alias("declared"), F.coalesce(host, F.lit("")).alias("host"),
    )
    top = F.array_max("score")
    likely = F.transform("score", lambda s: F.exp(s - top))
    total = F.aggregate(likely, F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumns(
        {
            "suffix": F.element_at(F.split("host", r"\."), -1),
            "domain": F.regexp_extract("host", r"([^.]+(?:\.(?:co|com|org|net|ac|gov))?\.[^.]+)$", 1),
            "blank": F.array_max("score") == F.array_min("score"),
            "vote": F.transform(likely, lambda x: x / total),
        }
    )
    rows = saved(rows)
    voters = rows.where("NOT blank")
    hosts = saved(voters.groupBy("host", "domain", "suffix").agg(_sums("vote", n).alias("host_votes"), F.count("*").alias("host_n")))
    domains = saved(hosts.groupBy("domain", "suffix").agg(_sums("host_votes", n).alias("domain_votes"), F.sum("host_n").alias("domain_n")))
    suffixes = saved(domains.groupBy("suffix").agg(_sums("domain_votes", n).alias("suffix_votes"), F.sum("domain_n").alias("suffix_n")))
    everything = suffixes.agg(F.coalesce(_sums("suffix_votes", n), F.array(*[F.lit(0.0)] * n)).alias("all_votes"), F.coalesce(F.sum("suffix_n"), F.lit(0)).alias("all_n"))
    said = voters.where(F.col("declared").isin(languages)).groupBy("declared").agg(_sums("vote", n).alias("said_votes"))

    wide = F.lit(-(-(n + 4) // 4))  # a row holds n numbers besides its key
    joined = rows.join(small(hosts.select("host", "host_votes", "host_n"), weight=wide), "host", "left")
    joined = joined.join(small(domains.select("domain", "domain_votes", "domain_n"), weight=wide), "domain", "left")
    joined = joined.join(small(suffixes, weight=wide), "suffix", "left").join(small(said, weight=wide), "declared", "left")
    joined = joined.join(F.broadcast(everything))  # one row
    own = F.when(F.col("blank"), F.transform("vote", lambda x: F.lit(0.0))).otherwise(F.col("vote"))
    one = F.when(F.col("blank"), 0).otherwise(1)
    zero = F.array(*[F.lit(0.0)] * n)

    def without(votes: str) -> Column:
        return F.zip_with(F.coalesce(F.col(votes), zero), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def count(of: str) -> Column:
        return F.greatest(F.coalesce(F.col(of), F.lit(0)) - one, F.lit(0))

    flat = F.array(*[F.lit(1.0 / n)] * n)
    prior = joined.withColumn("prior", _smoothed(without("all_votes"), count("all_n"), flat))
    for level in ("suffix", "domain", "host"):
        prior = prior.withColumn("prior", _smoothed(without(f"{level}_votes"), count(f"{level}_n"), F.col("prior")))
    # P(declared | language), from how often pages voted for a language declare it.
    everywhere = F.transform(without("all_votes"), lambda v: v + SMOOTHING)
    trust = F.zip_with(F.zip_with(without("said_votes"), names, lambda v, x: v + F.when(x == F.col("declared"), SMOOTHING / 2).otherwise(SMOOTHING / 20)), everywhere, lambda v, w: v / w)
    trust = F.when(F.col("declared").isin(languages), trust).otherwise(F.transform(names, lambda x: F.lit(1.0)))
    of_suffix = F.lit(None).cast("array<string>")
    for suffix, its in SUFFIX_LANGUAGES.items():
        if set(its) & set(languages):
            of_suffix = F.when(F.col("suffix") == suffix, F.array(*map(F.lit, its))).otherwise(of_suffix)
    hint = F.transform(names, lambda x: F.when(of_suffix.isNull(), 1.0).when(F.array_contains(of_suffix, x), SUFFIX_TRUST).otherwise((1 - SUFFIX_TRUST) / max(1, n - 1)))
    fused = prior.withColumns({"trust": trust, "hint": hint})
    weight = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("score")[i - 1] + F.log(F.col("prior")[i - 1]) + F.log(F.col("trust")[i - 1]) + F.log(F.col("hint")[i - 1]))
    fused = fused.withColumn("weight", weight)
    most = F.array_max("weight")
    whole = F.aggregate(F.transform("weight", lambda w: F.exp(w - most)), F.lit(0.0), lambda a, b: a + b)
    return fused.select(
        "page_id", "url", F.when(~F.col("blank"), names[F.array_position("score", F.array_max("score")).cast("int") - 1]).alias("text_lang"),
        "declared", "host", names[F.array_position("weight", most).cast("int") - 1].alias("lang"), (1 / whole).alias("confidence"),
    )
