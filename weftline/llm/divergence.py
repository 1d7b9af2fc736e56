"""Source divergence audit (operator 13).

How the words of each source differ from those of its language. Terms of a source are grouped into cells by
their count in the source and their count in the language: terms of a cell have the same divergence, so
that it is worked out once for each cell. Cells are ranked by it, those that the first ranks can't reach
go by the cumulative number of their terms, and only the rest is expanded to terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import kernels
from weftline.llm.storage import arrow_batches, saved, small

#: A term counts if so many documents of its language have it.
MIN_DOCS = 3
#: Ranks of terms that are reported, and the unit of shares.
MOST_RANKS, UNIT = 200, 1_000_000_000

#: Bytes between terms: all of ASCII but for letters.
_BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_COUNTS = [("lang", pa.large_string()), ("source", pa.large_string()), ("term", pa.large_string()), ("n", pa.int64()), ("n_docs", pa.int64())]


def _counted(langs: list[str], sources: list[str], texts: list[str | None]) -> pa.RecordBatch:
    """(lang, source, term, n, n_docs) of some documents, and a row with the empty term for each language and source."""
    words = kernels.Words(texts, lower=True, gap=_BETWEEN)
    ends = np.concatenate(([0], np.cumsum(words.end - words.start)))
    bytes_ = words.buf[~_BETWEEN[words.buf]]
    coded = pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(bytes_))).dictionary_encode()
    groups = list(dict.fromkeys(zip(langs, sources)))
    place = {g: i for i, g in enumerate(groups)}
    of_text = np.array([place[g] for g in zip(langs, sources)], np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    n_terms = max(1, len(coded.dictionary))
    # Each text's distinct terms, then each group's.
    in_text, n = np.unique(text * n_terms + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    pair, at = np.unique(of_text[in_text // n_terms] * n_terms + in_text % n_terms, return_inverse=True)
    n, docs = np.bincount(at, n, len(pair)).astype(np.int64), np.bincount(at, minlength=len(pair))
    group = np.concatenate((pair // n_terms, np.arange(len(groups))))
    none = pa.array([""] * len(groups), pa.large_string())
    terms = pa.concat_arrays([coded.dictionary.take(pa.array(pair % n_terms)), none])
    zeros = np.zeros(len(groups), np.int64)
    columns = [pa.array([groups[g][i] for g in group.tolist()], pa.large_string()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, terms, pa.array(np.concatenate((n, zeros))), pa.array(np.concatenate((docs, zeros)))], [c for c, _ in _COUNTS])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs): how often a source has a term in a language, and in how many documents.

    Terms are runs of letters A-Z, lower-cased, a-z and all that isn't ASCII. Nulls count as empty. Every language
    and source has a row with the empty term. Counts are summed in tasks before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in kernels.parts(batch, 2):
                yield _counted(langs[a:b], sources[a:b], texts)

    picked = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    found = picked.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), by decimals, as the product may not fit a long."""
    wide = [x.cast("decimal(20,0)") for x in (count + 1, total + terms)]
    return (1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide[0], wide[1])).cast("long")


def _value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), which fits a long, as shares are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others (part `pair`, all
    of them), and its up to MOST_RANKS most telling terms (part `term`).

    A language keeps the terms that at least MIN_DOCS of its documents have; V is their number. A share is 1 +
    floor(UNIT * (count + 1) / (N + V)) with N all counts; the value of shares p and q is floor((p - q)^2 / q). A pair's value is summed
    over all kept terms with the item's share as q (0 without kept terms), a term's is that against the language's share, where
    the source's is larger. Ranks go by value, then by UTF-8. A null text, language or source is an empty one; a source
    without terms is a source, too; repeated rows are documents each. An empty table gives no rows. Further columns
    play no part. Within a language the work on pairs is the number of sources that share each term, squared,
    and of pairs each is a row of the result by its definition.
    """
    with arrow_batches(docs.sparkSession, 1000):
        counts = saved(term_counts(docs, text, lang, source))
    terms = counts.where("n > 0").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    terms = saved(terms.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "lang_n", "of"))
    each = terms.select("lang", "term", "lang_n", F.inline("of"))
    langs = counts.select("lang").distinct().join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    own = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    groups = counts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang")
    zero = F.lit(0).cast("long")
    groups = saved(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "n_terms", "v", "lang_total")]))
    return _pairs(terms, each, groups).unionByName(_terms(each, groups))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


def _pairs(terms: DataFrame, each: DataFrame, groups: DataFrame) -> DataFrame:
    """Part `pair`, by cells of the counts in both sources. Terms that both have are counted by cell; those of one source alone are
    all of its cells less these, and the rest of the V terms has neither."""
    both = terms.select("lang", F.explode("of").alias("a"), "of").select("lang", F.col("a.source").alias("source"), F.col("a.n").alias("n"), F.explode("of").alias("b"))
    both = both.select("lang", "source", F.col("b.source").alias("item"), "n", F.col("b.n").alias("m")).where("source <> item")
    both = both.groupBy("lang", "source", "item", "n", "m").agg(F.count("*").alias("terms"))
    cells = saved(each.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))

    of_item = [F.col(c).alias(f"item_{c}") for c in ("total", "n_terms")]
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), *of_item), "lang").where("source <> item")
    pairs = saved(pairs)  # the rows of the result
    p = lambda count: _share(count, F.col("total"), F.col("v"))
    q = lambda count: _share(count, F.col("item_total"), F.col("v"))
    zero = F.lit(0).cast("long")
    wide = lambda value, times: value.cast("decimal(20,0)") * times.cast("decimal(18,0)")
    n, m = F.col("n"), F.col("m")
    shared = _value(p(n), q(m)).cast("decimal(20,0)") - _value(p(n), q(zero)) - _value(p(zero), q(m)) + _value(p(zero), q(zero))
    parts = [
        both.join(small(pairs), ["lang", "source", "item"]).select("lang", "source", "item", (shared * F.col("terms").cast("decimal(17,0)")).alias("value")),
        cells.join(small(pairs), ["lang", "source"]).select("lang", "source", "item", wide(_value(p(n), q(zero)), F.col("terms")).alias("value")),
        cells.withColumnRenamed("source", "item").join(small(pairs), ["lang", "item"]).select("lang", "source", "item", wide(_value(p(zero), q(n)), F.col("terms")).alias("value")),
        pairs.select("lang", "source", "item", F.when(F.col("v") > 0, wide(_value(p(zero), q(zero)), F.col("v") - F.col("n_terms") - F.col("item_n_terms"))).otherwise(0).alias("value")),
    ]
    rows = parts[0].select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    for part in parts[1:]:
        rows = rows.unionByName(part.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value")))
    summed = rows.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    return _ranked(summed.withColumn("part", F.lit("pair")))


def _terms(each: DataFrame, groups: DataFrame) -> DataFrame:
    """Part `term`. Cells of equal value are one tier; a source's tiers are cut to MOST_RANKS in parts before they are sorted
    together, and of these the ones stay whose first rank is in reach."""
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    cells = each.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms")).join(small(groups), ["lang", "source"])
    cells = saved(cells.select("lang", "source", "n", "lang_n", "terms", p.alias("p"), q.alias("q")).where("p > q").withColumn("value", _value(F.col("p"), F.col("q"))))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    tiers = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= MOST_RANKS)
    before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tiers = tiers.withColumn("before", before).where(F.col("before") < MOST_RANKS).select("lang", "source", "value")
    wanted = saved(cells.join(tiers, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value"))
    rows = each.join(small(wanted), ["lang", "source", "n", "lang_n"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return _ranked(rows).where(F.col("rank") <= MOST_RANKS)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v))::BIGINT AS p,
             (1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v))::BIGINT AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN total USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
