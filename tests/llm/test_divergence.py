"""The divergence audit, held against plain code."""

import random
import re
from collections import Counter, defaultdict

from weftline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, most=200):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    df, by, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        by[lang, source].update(terms)
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        sources = [s for la, s in by if la == lang]
        v = len(kept)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + v) for t in kept}

        p = {s: shares(by[lang, s]) for s in sources}
        q = shares(sum((by[lang, s] for s in sources), Counter()))
        value = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(value(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-value(p[s][t], q[t]), t.encode(), t) for t in kept if by[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -x, i) for i, (x, _, item) in enumerate(sorted(found), 1) if part == "pair" or i <= most]
    return sorted(out)


def check(spark, documents, rows, **more):
    docs = documents(rows)
    for name, value in more.items():
        docs = docs.selectExpr("*", f"{value} AS {name}")
    assert sorted(tuple(r) for r in divergence.divergence(docs).collect()) == plain(rows, divergence.MOST_RANKS)


def made(seed, n, words):
    rng = random.Random(seed)
    pool = [rng.choice(["A", "b", "Éa", "zz", "ß"]) * rng.randrange(1, 3) + rng.choice(["x", "y", "日", ""]) for _ in range(words)]
    text = lambda: "".join(rng.choice(pool) + rng.choice([" ", ".", "1", "\n", "_"]) for _ in range(rng.randrange(0, 30)))
    return [(i, rng.choice([text(), text(), text(), "", None]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ü", None, "s3"]), 0) for i in range(n)]


def test_equals_plain_code(spark, documents):
    rows = made(1, 120, 60)
    rows += rows[:5] + [(900, None, "xx", "lonely", None), (901, "rare words", "yy", "a", 1), (902, None, "yy", "b", 1), (None, "a b a", "en", "s1", 3)]
    check(spark, documents, rows, term="'clash'", n="1", v="2", value="3", total="4")


def test_ties_beyond_the_last_rank(spark, documents, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_RANKS", 7)
    check(spark, documents, made(2, 90, 200))
    same = [(i, " ".join(f"t{chr(97 + j)}" for j in range(20)), "en", "a" if i < 5 else "b", 1) for i in range(6)]
    check(spark, documents, same)


def test_empty_table_and_long_text(spark, documents):
    check(spark, documents, [])
    check(spark, documents, [(i, ("word" + "x" * 200_000 + " ") * 3 + "Other " * 100_000, "en", f"s{i}", 1) for i in range(4)])
