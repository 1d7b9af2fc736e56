"""Quality rules with verdicts on hosts (operator 10).

Each text is held against rules on its own words and lines. The share of failures of each host is
shrunk towards an empirical beta prior, fitted to all hosts by the method of moments, so that a host
with few documents needs more evidence; documents of a host whose shrunk rate is too high go too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import kernels
from weftline.llm.storage import numbered, saved, small

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 1e6)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _own(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return kernels.mix(hashes ^ (text.astype(np.uint64) * _ODD))


def measure(texts: list[str | None]) -> pd.DataFrame:
    """The measures of each text; a null or empty text has zeros."""
    w = kernels.Words(texts)
    n = len(texts)
    counts = np.diff(w.first)
    text_of = np.repeat(np.arange(n), counts)

    covered = np.zeros(len(w.start), bool)
    runs = kernels.windows(w.hashes(), 3)
    if len(runs):
        inside = text_of[: len(runs)] == text_of[2:]
        at = np.flatnonzero(inside)
        _, kind, times = np.unique(_own(runs[at], text_of[at]), return_inverse=True, return_counts=True)
        again = at[times[kind] >= 2]
        for j in range(3):
            covered[again + j] = True

    line_end = np.flatnonzero(w.buf == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    filled = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end = line_start[filled], line_end[filled]
    text_of_line = np.searchsorted(w.text_at, line_start, "right") - 1
    own = _own(kernels.span_hashes(w.buf, line_start, line_end), text_of_line)
    _, first = np.unique(own, return_index=True)
    lines = np.bincount(text_of_line, minlength=n) - np.bincount(text_of_line[first], minlength=n)

    return pd.DataFrame(
        {
            "n_words": counts,
            "word_chars": _per_text(w.chars(), w.first),
            "n_symbols": _per_text(_SYMBOL[w.buf], w.text_at),
            "n_dup_lines": lines,
            "n_repeat_words": _per_text(covered, w.first),
        }
    )


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch.tolist()
        parts = [measure(texts[a:b]) for a, b in kernels.blocks(texts)]
        yield pd.concat(parts, ignore_index=True) if parts else measure([])


def base_failed(q: str) -> Column:
    """Whether the text's own rules reject it; q is the struct of measures."""
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{q}.n_words")
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): each host's failure rate, shrunk. measured: (host, failed).

    The null host is a host like others. Without rows the result is empty.
    """
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
    )
    share = F.col("n_failed") / F.col("n_docs")
    mean = F.sum("n_failed") / F.sum("n_docs")
    square = F.sum(F.col("n_docs") * share * share) / F.sum("n_docs")
    prior = hosts.agg(mean.alias("mean"), square.alias("square"))
    spread = F.col("square") - F.col("mean") * F.col("mean")
    low, high = PRIOR_WEIGHT
    weight = F.when(spread <= 1e-12, F.lit(high)).otherwise(
        F.least(F.lit(high), F.greatest(F.lit(low), F.col("mean") * (1 - F.col("mean")) / spread - 1))
    )
    prior = prior.select("mean", weight.alias("weight"))  # one row
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate"))


def quality(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: all) with the measures, base_failed and kept.

    A null text counts as empty and fails. Repeated rows are judged one by one; the null host is one like
    others; a host at the border MAX_HOST_RATE is kept. Texts of any length are measured whole. Columns of
    docs that have the name of a measure give way to it. With all columns kept, texts are measured twice
    (for the hosts' rates, then for the rows) rather than written or shuffled.
    """
    made = [*MEASURES, "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    own, names, _ = numbered(docs)
    rows = _judged(own, names[text], names[host], sorted({names[c] for c in keep}))
    return rows.select(*[F.col(names[c]).alias(c) for c in keep], "q.*", F.col("failed").alias("base_failed"), "kept")


def _judged(own: DataFrame, text: str, host: str, keep: list[str]) -> DataFrame:
    """The columns in keep, q (the struct of measures), failed and kept; own has numbered columns."""
    rows = own.select(*keep, F.col(host).alias("its_host"), _measures(F.col(text)).alias("q"))
    rows = rows.withColumn("failed", base_failed("q"))
    if text not in keep:
        rows = saved(rows)
    rates = host_rates(rows.select(F.col("its_host").alias("host"), "failed"))
    bad = saved(rates.where(F.col("rate") > MAX_HOST_RATE).select("host", F.lit(True).alias("bad")))
    out = rows.join(small(bad), F.col("its_host").eqNullSafe(F.col("host")), "left")
    return out.withColumn("kept", ~F.col("failed") & F.col("bad").isNull())


def good_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules and their host's verdict keep, with their own columns."""
    own, names, back = numbered(docs)
    return _judged(own, names[text], names[host], own.columns).where("kept").select(*back)


OP10_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
win AS (
  SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c >= 2),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) AS t(j) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
q AS (
  SELECT w.r, doc_id, source, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN lines ON w.r = lines.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY source),
p0 AS (SELECT sum(bad) / sum(n) AS m, sum(bad * bad / n) / sum(n) AS sq FROM h),
p AS (SELECT m, CASE WHEN sq - m * m <= 1e-12 THEN 1e6
                     ELSE least(1e6, greatest(1.0, m * (1 - m) / (sq - m * m) - 1)) END AS s FROM p0),
v AS (SELECT source, (bad + m * s) / (n + s) <= 0.5 AS fine FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND v.fine AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
