"""Toxicity of texts by gradient-boosted trees over dense features (operator 2).

Features come from the text alone: densities of lexicons, nearness of insults to words of the second
person, and rates of capitals, punctuation and obfuscated spellings. There are fixed word lists and a
lexicon of words and word stems that is learned from a bounded sample of labelled rows: those whose
rate in toxic texts is far above that in others. Trees are fitted to a second such sample and
calibrated by isotonic regression on a third; no row is in two of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import kernels
from weftline.llm.storage import saved

#: Labelled rows used at most, those with the smallest hash of their id: for the lexicon, the trees and
#: calibration; and the tenths of hashes from which each is drawn.
LEXICON_ROWS, TRAIN_ROWS, CALIBRATE_ROWS = 6_000, 20_000, 10_000
TENTHS = {"lexicon": range(0, 4), "train": range(4, 8), "calibrate": range(8, 10)}
#: Stems of words, in bytes (0: the whole word); their least ratio of rates; and the least number and
#: share of toxic texts that must have one.
STEMS = (0, 3, 4, 5, 6, 7, 8, 10)
LEAST_RATIO = 6.0
LEAST_TEXTS, LEAST_SHARE = 3, 0.004
TREES, DEPTH, STEP = 20, 3, 0.25
THRESHOLD = 0.7
#: Share of the score that comes straight from the trees, to order texts that isotonic steps tie.
UNTIED = 0.001

# Word lists.
INSULTS = (
    "arsehole arse asshole bastard bitch bollocks braindead buffoon clown creep cretin cunt degenerate despicable "
    "dickhead dimwit dipshit disgusting dolt douche douchebag dumb dumbass dumbo dunce faggot filth filthy fool freak "
    "fuck fucker fucking garbage goon halfwit hideous idiot idiotic idiots imbecile imbeciles jackass jerk lame liar "
    "loathsome loser losers lowlife lunatic maggot moron moronic morons motherfucker nitwit numbskull nutjob pathetic "
    "pig pigs prick psycho puke rat repulsive retard retarded revolting rubbish scum scumbag shit shithead shitty sick "
    "simpleton slut snowflake spineless stupid stupidity subhuman swine thug trash twat twit ugly useless vermin vile "
    "wanker weirdo whore wimp worthless wretch wretched "
    "abschaum arschloch bloedmann blöd blödmann depp dreckig dummkopf dumm dumme dummer ekelhaft erbärmlich hurensohn "
    "idioten kotz mistkerl scheiße scheisse schwachkopf schwein trottel versager wertlos widerlich wichser "
    "abruti abrutie bâtard connard connasse conne crétin crétine débile dégoûtant dégueulasse idiote imbécile minable "
    "merde nul nulle ordure pathétique pourriture putain raclure salaud salope stupide "
    "asqueroso asquerosa basura cabrón capullo estúpido estúpida gilipollas idiotas imbécil inútil mierda patético "
    "patética payaso perdedor puta puto tonto tonta"
).split()
THREATS = "kill die hang burn destroy hate hates hated beat punch smash shoot töten sterben hasse tuer crever haine matar odio".split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur youre you're du dich dir dein deine deinen euch ihr euer tu te toi ton ta "
    "tes vous votre vos tú ti usted ustedes vosotros tuyo"
).split()
# Letters behind the signs that stand in for them.
LOOKALIKES = str.maketrans("01345789@$!|+€", "oieastbgasiite")

FEATURES = (
    "insult_percent", "insults", "insult_kinds", "insult_pairs", "near_second_person", "near_percent", "second_person",
    "threats", "capitals", "shouted", "marks", "repeated_marks", "obfuscated", "obfuscated_percent", "signs", "words",
    "learned_percent", "learned", "learned_weight",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[list(b"!?")] = 1
_SIGN = np.zeros(256, np.int64)
_SIGN[list(b"#*$%&@|<>~^_=+")] = 1
_INSULTS = frozenset(INSULTS)
#: Runs of letters, digits and the signs that may stand among them; what a hidden word may begin after; a letter before a
#: sign; signs before a letter; single letters with gaps.
_RUN = re.compile(r"[\w@$!|+€*.-]+")
_OPENS = frozenset("\"'(")
_LETTER_SIGN = re.compile(r"[^\W\d_][0-9@$!|+€*._-]")
_SIGN_LETTER = re.compile(r"[0-9@$|+€]+[^\W\d_]")
_SPACED_OUT = re.compile(r"(?<!\w)[^\W\d_](?:[ .*_-][^\W\d_]){3,}(?!\w)")
_LONGEST = max(map(len, INSULTS))
_WILD = re.compile(r"[*]+")


def _hash(words: list[str]) -> np.ndarray:
    w = kernels.Words([" ".join(words)], gap=~_LETTER)
    return np.unique(w.hashes())


_HASHES = tuple(map(_hash, (INSULTS, THREATS, SECOND_PERSON)))


def _odd_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs with a sign after a letter, up to their last letter or digit, and runs with a letter after signs at the start."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        if a and not (text[a - 1].isspace() or text[a - 1] in _OPENS):
            continue
        end = b
        while end > a and not text[end - 1].isalnum():
            end -= 1
        first = _LETTER_SIGN.search(text, a, end)
        if first and first.start() + 2 < end:
            yield a, end
        elif (start := _SIGN_LETTER.match(text, a, b)) and start.end() < b:
            yield a, b


def odd_words(text: str) -> Iterator[str]:
    """Words that may be spelt with digits, signs or gaps, each sign looked at a few times whatever the words' length."""
    at = 0
    spaced = _SPACED_OUT.search(text)
    for a, b in _odd_runs(text):
        while spaced and spaced.start() < a:
            if spaced.start() >= at:
                yield spaced[0]
                at = spaced.end()
            spaced = _SPACED_OUT.search(text, max(at, spaced.start() + 1))
        if a >= at:
            yield text[a:b]
            at = b
    while spaced:
        if spaced.start() >= at:
            yield spaced[0]
            at = spaced.end()
        spaced = _SPACED_OUT.search(text, max(at, spaced.start() + 1))


def hidden_insults(text: str) -> int:
    """Insults spelt with digits, signs or gaps between letters."""
    found = 0
    for word in odd_words(text):
        plain = word.translate(LOOKALIKES)
        joined = re.sub(r"[ .*_-]", "", plain)
        if joined in _INSULTS or re.sub(r"(.)\1+", r"\1", joined) in _INSULTS:
            found += 1
        elif "*" in plain and (m := _WILD.sub("*", re.sub(r"[ ._-]", "", plain))) and 4 <= len(re.sub(r"[ ._-]", "", plain)) and len(m) <= _LONGEST and m[0] != "*":
            pattern = re.compile(re.escape(m).replace(r"\*", r"\w{1,4}"))
            found += any(pattern.fullmatch(x) for x in INSULTS)
    return found


def _has_odd(text: str) -> bool:
    return any(c in text for c in "0134578@$|+€*_") or "." in text or "-" in text


def stem_hashes(w: kernels.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than a stem's length (0: all), and the hashes of their stems."""
    at = np.flatnonzero(w.end - w.start > length)
    end = np.minimum(w.end[at], w.start[at] + length) if length else w.end[at]
    return at, kernels.mix(kernels.span_hashes(w.buf, w.start[at], end) + np.uint64(length))


Lexicon = tuple[np.ndarray, np.ndarray]
NO_LEXICON: Lexicon = (np.empty(0, np.uint64), np.empty(0))


def learned_weights(w: kernels.Words, lexicon: Lexicon) -> np.ndarray:
    """For each word the greatest weight of its entries; 0 without one."""
    hashes, weights = lexicon
    out = np.zeros(len(w.start))
    if len(hashes):
        for length in STEMS:
            at, own = stem_hashes(w, length)
            place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            out[at] = np.maximum(out[at], np.where(hashes[place] == own, weights[place], 0.0))
    return out


def features(texts: list[str | None], lexicon: Lexicon = NO_LEXICON) -> np.ndarray:
    """A row of FEATURES for each text; a null text counts as empty, whose features are all 0."""
    n = len(texts)
    w = kernels.Words(texts, lower=True, gap=~_LETTER)
    hashes = w.hashes()
    count = np.diff(w.first)
    text_of = np.repeat(np.arange(n), count)
    insult, threat, second = (np.isin(hashes, h) for h in _HASHES)
    at = np.flatnonzero(insult)
    of = text_of[at]
    insults = np.bincount(of, minlength=n)
    _, one = np.unique(np.stack((of.astype(np.uint64), hashes[at])), axis=1, return_index=True) if len(at) else (0, at)
    kinds = np.bincount(of[one], minlength=n)
    close = (np.diff(at) <= 15) & (np.diff(of) == 0)
    pairs = np.bincount(of[1:][close], minlength=n)
    near = np.zeros(n, np.int64)
    seconds = np.flatnonzero(second)
    if len(at) and len(seconds):
        right = np.searchsorted(seconds, at)
        by = np.zeros(len(at), bool)
        for side in (right - 1, right):
            ok = (side >= 0) & (side < len(seconds))
            other = seconds[np.clip(side, 0, len(seconds) - 1)]
            by |= ok & (np.abs(other - at) <= 6) & (text_of[other] == of)
        near = np.bincount(of[by], minlength=n)

    raw = kernels.Words(texts)
    bounds = raw.text_at
    size = np.maximum(np.diff(bounds) - 1, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    upper, mark = _UPPER[raw.buf], _MARK[raw.buf]
    twice = np.zeros(len(mark), np.int64)
    twice[1:] = mark[1:] & mark[:-1]
    long_word = (raw.end - raw.start) >= 3
    sums = np.concatenate(([0], np.cumsum(upper)))
    shout = long_word & (sums[raw.end] - sums[raw.start] >= 3)
    shouted = np.concatenate(([0], np.cumsum(shout)))
    learned = learned_weights(w, lexicon)
    weight = np.bincount(text_of, learned, minlength=n)
    known = np.bincount(text_of, learned > 0, minlength=n)
    hidden = np.array([hidden_insults(t.lower()) if t and _has_odd(t) else 0 for t in texts])
    words = np.maximum(count, 1)
    return np.column_stack(
        [
            100 * insults / words,
            np.log1p(insults),
            kinds,
            np.log1p(pairs),
            np.log1p(near),
            100 * near / words,
            100 * per_second(second, w.first) / words,
            100 * per_second(threat, w.first) / words,
            per_text(upper) / size,
            (shouted[raw.first[1:]] - shouted[raw.first[:-1]]) / words,
            100 * per_text(mark) / size,
            100 * per_text(twice) / size,
            np.log1p(hidden),
            100 * hidden / words,
            per_text(_SIGN[raw.buf]) / size,
            np.log1p(count),
            100 * known / words,
            np.log1p(known),
            100 * weight / words,
        ]
    ).astype(float)


def per_second(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags counted in each text's words."""
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[first[1:]] - sums[first[:-1]]


def _features(lexicon: Lexicon):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([row for a, b in kernels.blocks(texts) for row in features(texts[a:b], lexicon)], dtype=object)

    return run


def _rates(texts: list[str], known: np.ndarray | None) -> pd.DataFrame:
    """Stems of texts: in how many texts, and the sum of their shares of a text's words."""
    w = kernels.Words(texts, lower=True, gap=~_LETTER)
    counts = np.diff(w.first)
    of = np.repeat(np.arange(len(texts)), counts)
    parts = []
    for length in STEMS:
        at, own = stem_hashes(w, length)
        if known is not None and len(known):
            there = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            at, own = at[there], own[there]
        parts.append(pd.DataFrame({"h": own.view(np.int64), "t": of[at], "rate": 1 / counts[of[at]]}))
    each = pd.concat(parts).groupby(["h", "t"], as_index=False)["rate"].sum()
    return each.groupby("h", as_index=False).agg(rate=("rate", "sum"), n=("t", "count"))


def _summed(texts: DataFrame, known: np.ndarray | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["text"].tolist()
            for a, b in kernels.blocks(rows):
                yield _rates(rows[a:b], known)

    summed = texts.select("text").mapInPandas(run, "h long, rate double, n long")
    return summed.groupBy("h").agg(F.sum("rate").alias("rate"), F.sum("n").alias("n"))


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Stems (as hashes, sorted) and weights from (text, label), a bounded sample: of what it holds only.

    Repeated texts count once, as toxic if one of them is. A text counts by the shares of its words, so
    that long ones weigh no more.
    """
    texts = saved(texts.where(F.col("text").isNotNull()).groupBy("text").agg(F.max("label").alias("label")))
    size = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if len(size) < 2:
        return NO_LEXICON
    least = max(LEAST_TEXTS, LEAST_SHARE * size[1.0])
    toxic = _summed(texts.where("label = 1"), None).where(F.col("n") >= least).toPandas()
    toxic["h"] = toxic["h"].to_numpy().view(np.uint64)
    toxic = toxic.sort_values("h")
    known = toxic["h"].to_numpy()
    other = _summed(texts.where("label = 0"), known).toPandas()
    rest = pd.Series(other["rate"].to_numpy(), index=other["h"].to_numpy().view(np.uint64)).reindex(known).fillna(0.0).to_numpy()
    # A stem that other texts never show counts as if one in a hundred thousand words were.
    ratio = (toxic["rate"].to_numpy() / size[1.0] + 1e-5) / (rest / size[0.0] + 1e-5)
    good = ratio >= LEAST_RATIO
    return known[good], np.log(ratio[good])


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row are not for learning; a null id never is for learning either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Labels other than 0 and 1, and those of held-out or null ids, are not used; where an id has both,
    1 counts. Null and empty texts get a score like others, as do texts of any length, and equal texts the
    same. Of an id with several texts the first by code points (for the trees: by features) is learned
    from. If the labels show one class or none, the score is the share of 1 among them (0 without
    labels). Other columns are not read.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("double").alias("label")).withColumn("h", F.xxhash64("doc_id"))

    def sample(name: str, limit: int) -> DataFrame:
        tenth = F.pmod("h", F.lit(10))
        return known.where((tenth >= TENTHS[name][0]) & (tenth <= TENTHS[name][-1])).orderBy("h", "doc_id").limit(limit).select("doc_id", "label")

    # The samples are bounded by their parameters, and so may be broadcast.
    first = F.broadcast(sample("lexicon", LEXICON_ROWS))
    learned_from = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(first, "doc_id").groupBy("doc_id")
    lexicon = learn_lexicon(learned_from.agg(F.min("text").alias("text"), F.max("label").alias("label")))
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), _features(lexicon)(F.col(text)).alias("x")))
    part = {}
    for name, limit in (("train", TRAIN_ROWS), ("calibrate", CALIBRATE_ROWS)):
        chosen = rows.join(F.broadcast(sample(name, limit)), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label"))
        part[name] = saved(chosen.select("label", array_to_vector("x").alias("features")))
    counts = {r["label"]: r["count"] for r in part["train"].groupBy("label").count().collect()}
    scored = rows.select("doc_id", array_to_vector("x").alias("features"))
    if len(counts) == 2:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=10, maxBins=64, seed=1)
        model = trees.fit(part["train"].coalesce(2))
        chance = vector_to_array("probability")[1]
        seen = model.transform(part["calibrate"]).select("label", chance.alias("chance"))
        scored = model.transform(scored).select("doc_id", chance.alias("chance"))
        if seen.isEmpty():
            scored = scored.withColumn("score", F.col("chance"))
        else:
            steps = IsotonicRegression(featuresCol="chance", predictionCol="step").fit(seen)
            scored = steps.transform(scored).withColumn("score", (1 - UNTIED) * F.col("step") + UNTIED * F.col("chance"))
    else:
        scored = scored.withColumn("score", F.lit(next(iter(counts), 0.0)))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")
    )
