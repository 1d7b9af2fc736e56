"""Repeated passages removed by hashed runs of consecutive sentences (operator 3).

From each sentence a run extends forwards, and from each one backwards, until it has at least two
sentences and MIN_WORDS words; a sentence of LONG_WORDS words is a run by itself. So every sentence of a
longer passage is in a run that lies within the passage, whatever stands around it. Runs are joined by
their hashes over all documents. Sentences covered by a run that occurred before, in a document with a
smaller id or earlier in the same one, are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import kernels
from weftline.llm.storage import BROADCAST_IDS, dropped, fits, numbered, saved

MIN_WORDS = 12
MIN_SENTENCES = 2
LONG_WORDS = 25
#: A hash is hot if it has over one in so many of all runs (and over HOT_RUNS); so there are fewer hot ones than that.
HOT_SHARE, HOT_RUNS = 50_000, 1000

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_AFTER = np.zeros(256, bool)
_AFTER[list(b"\"')]}*_")] = True
#: Full-width stops, as 24-bit numbers of their UTF-8 bytes.
_WIDE_ENDS = [int.from_bytes(c.encode(), "big") for c in "。！？"]


class Sentences:
    """Sentences of texts, and their runs.

    Words are runs of other bytes than white space; each kana, Chinese or full-width character is one. A
    sentence ends with a word that ends in . ! or ? (before closing signs), with a full-width stop, at a
    line's end or at the text's. ``first``/``last`` are the borders of each sentence in words, ``of`` its
    text, ``bounds[i]:bounds[i + 1]`` the sentences of text i.
    """

    def __init__(self, texts: list[str | None], min_words: int, min_sentences: int, long_words: int):
        w = self.words = kernels.Words(texts, lower=True)
        buf = w.buf
        code = self._split_wide(w)
        n = len(w.start)
        last = buf[w.end - 1] if n else np.empty(0, np.uint8)
        before = buf[np.maximum(w.end - 2, 0)] if n else last
        ends = _ENDS[last] | (_AFTER[last] & _ENDS[before] & (w.end - w.start > 1))
        if code is not None:
            ends |= np.isin(code[w.start], _WIDE_ENDS)
        lines = np.concatenate(([0], np.cumsum(buf == 10)))
        following = np.concatenate((w.start[1:], [len(buf)])) if n else w.start
        ends |= lines[following] > lines[w.end]
        self.last = np.flatnonzero(ends) + 1
        self.first = np.concatenate(([0], self.last[:-1])) if len(self.last) else self.last
        self.of = np.searchsorted(w.first, self.first, "right") - 1
        self.bounds = np.searchsorted(self.first, w.first)
        self.runs = self._runs(min_words, min_sentences, long_words)

    @staticmethod
    def _split_wide(w: kernels.Words) -> np.ndarray | None:
        """Makes each character of U+3000 to U+9FFF and of the full-width forms a word of its own; the
        24 bits from each place on, or None if there is no such character."""
        buf = w.buf
        after = np.concatenate((buf[1:], [0]))
        wide = (buf >= 0xE3) & (buf <= 0xE9) | (buf == 0xEF) & ((after == 0xBC) | (after == 0xBD))
        if not wide.any():
            return None
        inside = wide.copy()
        inside[1:] |= wide[:-1]
        inside[2:] |= wide[:-2]
        filled = np.zeros(len(buf), bool)
        at = np.zeros(len(buf) + 1, np.int64)
        np.add.at(at, w.start, 1)
        np.add.at(at, w.end, -1)
        filled = np.cumsum(at[:-1]) > 0
        left = np.concatenate(([False], filled[:-1]))
        left_inside = np.concatenate(([False], inside[:-1]))
        starts = filled & (~left | wide | (left_inside & ~inside))
        w.start = np.flatnonzero(starts)
        w.end = np.flatnonzero(left & (~filled | starts))
        w.first = np.searchsorted(w.start, w.text_at)
        third = np.concatenate((buf[2:], [0, 0]))
        return buf.astype(np.int64) << 16 | after.astype(np.int64) << 8 | third

    def _runs(self, min_words: int, min_sentences: int, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From and to which sentence (inclusive) each run goes, and its hash."""
        m = len(self.first)
        index = np.arange(m)
        alone = self.last - self.first >= long_words
        there = np.maximum(index + min_sentences - 1, np.searchsorted(self.last, self.first + min_words))
        there = np.where(alone, index, there)
        ok = there < self.bounds[self.of + 1] if m else np.empty(0, bool)
        forward = np.stack((index[ok], there[ok]))
        here = np.minimum(index - min_sentences + 1, np.searchsorted(self.first, self.last - min_words, "right") - 1)
        here = np.where(alone, index, here)
        ok = here >= self.bounds[self.of] if m else np.empty(0, bool)
        backward = np.stack((here[ok], index[ok]))
        both = np.unique(np.concatenate((forward, backward), axis=1), axis=1) if m else np.empty((2, 0), int)
        a, b = both.astype(np.int64)
        hashes = self.words.hashes()
        power = kernels.powers(len(hashes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[0][:-1], dtype=np.uint64)))
        low, high = self.first[a], self.last[b]
        return a, b, kernels.mix((sums[high] - sums[low]) * power[1][low] + (high - low).astype(np.uint64))


def _spans(limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            for start, _, texts in kernels.parts(batch, 2):
                s = Sentences(texts, *limits)
                a, b, hashes = s.runs
                of = s.of[a]
                base = s.bounds[of]
                rows = pa.array(of + start)
                parts = [keys.take(rows), ids.take(rows), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32)), pa.array(hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays(parts, ["key", "id", "a", "b", "h"])

    return run


def _cut(limits: tuple[int, int, int]):
    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            texts, spans = texts.tolist(), spans.tolist()
            out = []
            for start, stop in kernels.blocks(texts):
                s = Sentences(texts[start:stop], *limits)
                of_run = np.searchsorted(s.of[s.runs[0]], np.arange(stop - start + 1))
                for i in range(stop - start):
                    first, last = int(s.bounds[i]), int(s.bounds[i + 1])
                    text, found = texts[start + i], spans[start + i]
                    if found is None or not len(found):
                        out.append((text, last - first, 0))
                        continue
                    mine = slice(int(of_run[i]), int(of_run[i + 1]))
                    real = set(zip((s.runs[0][mine] - first).tolist(), (s.runs[1][mine] - first).tolist(), s.runs[2][mine].view(np.int64).tolist(), strict=True))
                    gone = np.zeros(last - first, bool)
                    for x in found:
                        if (x["a"], x["b"], x["h"]) in real:
                            gone[x["a"] : x["b"] + 1] = True
                    if gone.any():
                        data = text.encode("utf-8", "surrogatepass")
                        at = np.append(s.words.start[s.first[first:last]] - s.words.text_at[i], len(data))
                        parts = [data[: at[0]]] + [data[at[j] : at[j + 1]] for j in np.flatnonzero(~gone)]
                        text = b"".join(parts).decode("utf-8", "surrogatepass").rstrip() if not gone.all() else ""
                    out.append((text, len(gone), int(gone.sum())))
            yield pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    return cut


def repeats(spans: DataFrame) -> DataFrame:
    """(key, a, b, h): the runs of spans (key, id, a, b, h) that are not the first with their hash; a table
    with all of them goes in.

    The first one of each hash is found by partial aggregation. Hot hashes, of which there can be few only,
    are broadcast to their runs, so that no task gets all runs of one; the others are joined by shuffle.
    """
    most = max(HOT_RUNS, spans.count() // HOT_SHARE)
    at = F.struct("id", "key", "a", "b")
    first = spans.groupBy("h").agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1")
    first = saved(first.select("h", F.col("first.key").alias("first_key"), F.col("first.a").alias("first_a"), "c"))
    hot = F.broadcast(first.where(F.col("c") > most))  # under HOT_SHARE rows, as each has more than that share of all
    others = spans.join(hot.select("h"), "h", "left_anti").join(first.where(F.col("c") <= most), "h")
    met = spans.join(hot, "h").unionByName(others)
    # Rows that repeat id and text are one occurrence; a document's own repeats differ in place.
    return met.where(~((F.col("key") == F.col("first_key")) & (F.col("a") == F.col("first_a")))).select("key", "a", "b", "h")


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES, long_words: int = LONG_WORDS
) -> DataFrame:
    """docs with repeated passages cut out of the text, n_sentences (before) and n_removed.

    The first occurrence of a run, by id, text and place, stays, but for sentences that other runs remove.
    Ids of any type that can be ordered; rows with a null id come first. Null texts stay null and texts
    without a run as they are; a text of any length is one document. Rows that repeat id and text are
    one document: their own copies of a passage do not count as repeats. Other texts of one id are other
    documents. Columns n_sentences and n_removed of docs give way, others stay as they are.
    """
    limits = (min_words, min_sentences, long_words)
    own, names, back = numbered(docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("n_sentences", "n_removed")]))
    id_col, text_col = names[doc_id], names[text]
    own = own.withColumn("key", F.xxhash64(id_col, text_col))
    kind = own.schema[id_col].dataType.simpleString()
    spans = saved(own.select("key", id_col, text_col).mapInArrow(_spans(limits), f"key long, id {kind}, a int, b int, h long"))
    by_doc = saved(repeats(spans).groupBy("key").agg(F.collect_set(F.struct("a", "b", "h")).alias("spans")))
    dropped(spans)
    keys = by_doc.select("key")
    if fits(keys, BROADCAST_IDS):  # only texts with something to cut are shuffled
        hit = own.join(F.broadcast(keys), "key", "left_semi").join(by_doc, "key", "left")
        rest = own.join(F.broadcast(keys), "key", "left_anti").withColumn("spans", F.lit(None).cast(by_doc.schema["spans"].dataType))
        joined = hit.unionByName(rest)
    else:
        joined = own.join(by_doc, "key", "left")
    made = joined.withColumn("made", _cut(limits)(F.col(text_col), F.col("spans"))).withColumn(text_col, F.col("made.text"))
    return made.select(*back, "made.n_sentences", "made.n_removed")
