"""Bulk feature hashing: the tokens of a column of texts as term frequencies by bucket, in Arrow arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import BUCKETS, FNV_BASIS, FNV_PRIME

#: Text taken in at once.
PART_BYTES = 1 << 23

_OUTER = re.compile(r"^[^\w]+|[^\w.]+$")
#: The ASCII signs that are not of a word.
_SIGNS = "".join(c for c in map(chr, range(128)) if not re.match(r"\w", c))
#: Words that are fewer than this are hashed one by one.
FEW_WORDS = 16


def _token(word: str) -> str:
    """The query token of a white-space separated word; empty if only punctuation."""
    return _OUTER.sub("", word.lower())


def _tokens(words: pa.Array) -> pa.Array:
    """_token() of an array of words; those that are ASCII are not made Python strings."""
    tokens = pc.ascii_rtrim(pc.ascii_ltrim(pc.ascii_lower(words), _SIGNS), _SIGNS.replace(".", ""))
    other = pc.invert(pc.string_is_ascii(words))
    return pc.replace_with_mask(tokens, other, pa.array(map(_token, words.filter(other).to_pylist()), words.type))


def _buckets(words: pa.Array) -> np.ndarray:
    """The buckets of white-space separated words; -1 if only punctuation. All words are hashed together, byte by byte,
    the longest to the end each by itself."""
    tokens = _tokens(words)
    size = pc.binary_length(tokens).to_numpy().astype(np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    octets = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(tokens.buffers()[1] or b"", np.int64)[tokens.offset :][: len(size)][order]
    h = np.full(len(size), FNV_BASIS, np.uint32)
    done, n = 0, int((size > 0).sum())
    while n >= FEW_WORDS:
        h[:n] = (h[:n] ^ octets[start[:n] + done]) * np.uint32(FNV_PRIME)
        done += 1
        n = int(np.searchsorted(-size, -done, side="left"))
    for i in range(n):
        x = int(h[i])
        for b in octets[start[i] + done : start[i] + size[i]].tolist():
            x = (x ^ b) * FNV_PRIME & 0xFFFFFFFF
        h[i] = x
    out = np.empty(len(size), np.int64)
    out[order] = np.where(size > 0, (h % BUCKETS).astype(np.int64), -1)
    return out


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, tf) of a batch of texts, ordered by row and bucket; each distinct word is hashed once."""
    words = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    rows = pc.list_parent_indices(words).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    buckets = _buckets(coded.dictionary)[coded.indices.to_numpy()] if len(rows) else rows
    used = buckets >= 0
    pairs, tf = np.unique(rows[used] * BUCKETS + buckets[used], return_counts=True)
    return pairs // BUCKETS, pairs % BUCKETS, tf


def _distinct_words(texts: pa.Array) -> Iterator[list[str]]:
    """The distinct white-space separated words of each text, which are made Python strings once for a batch."""
    words = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    rows = pc.list_parent_indices(words).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    n = max(1, len(coded.dictionary))
    pairs = np.unique(rows * n + coded.indices.to_numpy())
    names = coded.dictionary.to_pylist()
    borders = np.searchsorted(pairs, np.arange(len(texts) + 1) * n)
    for a, b in zip(borders[:-1], borders[1:]):
        yield [names[i] for i in (pairs[a:b] % n).tolist()]


def token_overlap(asked: Column, text: Column) -> Column:
    """The share of the distinct query tokens of a column of questions that the text beside each has; 0 without tokens.
    Each text is taken apart once."""

    @F.pandas_udf("double")
    def overlap(asked: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for part in _parts([pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(text, pa.large_string())], ["asked", "text"])]):
            for question, words in zip(part.column(0).to_pylist(), _distinct_words(part.column(1))):
                wanted = {_token(w) for w in (question or "").split()} - {""}
                out.append(len(wanted & set(map(_token, words))) / len(wanted) if wanted else 0.0)
        return pd.Series(out, dtype="float64")

    return overlap(asked, text)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) in parts of about PART_BYTES of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        place = np.cumsum(sizes) // PART_BYTES
        borders = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [batch.num_rows]))
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, tf): term frequencies of each row's query tokens; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows, buckets, tf = term_counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(buckets, pa.int32()), pa.array(tf, pa.float64())], [key, "bucket", "tf"])

    picked = texts.select(F.col(key), F.col(text))
    return picked.mapInArrow(run, f"{key} {picked.schema[key].dataType.simpleString()}, bucket int, tf double")


def documents(texts: DataFrame, key: str, text: str, wanted: np.ndarray) -> DataFrame:
    """(key, buckets, tfs, n): of each row the wanted buckets that it has, and the sum of their frequencies; rows without any
    are left out. wanted: a flag for each of the BUCKETS buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows, buckets, tf = term_counts(batch.column(1))
            keep = wanted[buckets]
            rows, buckets, tf = rows[keep], buckets[keep], tf[keep]
            there, first = np.unique(rows, return_index=True)
            ends = pa.array(np.append(first, len(rows)), pa.int32())
            parts = [batch.column(0).take(pa.array(there)), pa.ListArray.from_arrays(ends, pa.array(buckets, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.float64()))]
            parts.append(pa.array(np.add.reduceat(tf, first) if len(first) else tf, pa.float64()))
            yield pa.RecordBatch.from_arrays(parts, [key, "buckets", "tfs", "n"])

    picked = texts.select(F.col(key), F.col(text))
    return picked.mapInArrow(run, f"{key} {picked.schema[key].dataType.simpleString()}, buckets array<int>, tfs array<double>, n double")
