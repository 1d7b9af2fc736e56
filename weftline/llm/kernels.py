"""Vectorised text kernels that run inside tasks, on one Arrow batch at a time.

A batch of texts is joined into one byte buffer; word borders, word hashes and
shingle hashes are then computed for all its texts at once. Words are maximal
runs of bytes other than space and 0x09-0x0D; all other white space of Unicode
is part of a word. Buffers are cut so that a batch never needs more than a few
tens of MB of temporary arrays, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text is handled alone.
BLOCK_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept between calls up to a block's length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of a fixed odd base and of its inverse, for hashes of variable runs by prefix sums."""
    return _power(_BASE, n), _power(_BASE_INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most BLOCK_BYTES characters, one row at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and size + n > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """From and to which row, and the texts of the column: only one block's are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and size + n > BLOCK_BYTES:
            yield first, i, batch.column(column).slice(first, i - first).to_pylist()
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes), batch.column(column).slice(first).to_pylist()


class Words:
    """Word borders of a list of texts.

    ``buf`` holds the bytes of all texts, a line feed after each; ``start`` and
    ``end`` border the words in it; ``first[i]:first[i + 1]`` are the words of
    text i. A null text has no words.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, gap: np.ndarray = _SPACE):
        """gap: for each byte whether it stands between words; the line feed must."""
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        self.text_at = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)))
        space = gap[self.buf]
        before = np.concatenate(([True], space[:-1]))
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        self.first = np.searchsorted(self.start, self.text_at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.buf, self.start, self.end)

    def chars(self) -> np.ndarray:
        """Code points in each word: its bytes but for UTF-8 continuations."""
        heads = np.concatenate(([0], np.cumsum((self.buf & 0xC0) != 0x80, dtype=np.int64)))
        return heads[self.end] - heads[self.start]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end] for ascending, disjoint spans: differences of prefix sums of a
    polynomial in a fixed odd base, so that a span's hash depends on its bytes alone."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        at = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, at + BLOCK_BYTES, "right")))
        part = buf[at : int(end[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * _power(_BASE, len(part)), out=sums[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * _power(_BASE_INVERSE, len(part) + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, borders of texts ignored."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, factor = hashes[:n].copy(), 1
    for j in range(1, k):
        factor = factor * _STEP % (1 << 64)
        out += hashes[j : j + n] * np.uint64(factor)
    return mix(out)


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Per text the hashes of its k-word runs in order, repeats kept; a text with fewer words has
    its whole sequence as one, a text without words none."""
    hashes = words.hashes()
    runs = windows(hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(runs[a : b - k + 1])
        elif b > a:
            out.append(windows(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text its distinct shingles, sorted; A-Z are lower-cased first."""
    return [np.unique(s) for s in shingles(Words(texts, lower=True), k)]
