"""Whole Arrow batches of texts as arrays of code points, so that per-character work runs in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from leafmill.llm.glyphs import word_codes

#: Characters worked on at a time, which bounds memory; a longer text is worked on alone and whole.
BLOCK = 1_000_000


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows that hold about `limit` characters together."""
    texts = batch.column(column).to_pylist()
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, texts[start:k]
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, texts[start:]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), wrapping."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(4096, np.uint64)
with np.errstate(over="ignore"):
    _POWERS[1:] = _BASE
    _POWERS = np.cumprod(_POWERS)


def within(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of `n` places how far it lies behind the last of `starts`; 0 before the first."""
    out = np.zeros(n, np.int64)
    first = starts[0]
    out[first:] = np.arange(first, n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return out


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text).

    Words are what white space parts; case, punctuation, characters without width and look-alike letters are left
    aside, and a word of nothing else is none.
    """
    plain = [t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in texts]
    lengths = np.array([len(t) + 1 if t is not None else 1 for t in plain], np.int64)
    joined = codes("\n".join("" if t is None else t for t in plain) + "\n")
    got = word_codes()[joined]
    ends = np.cumsum(lengths)
    kept = got != 0
    number = np.cumsum(kept)
    bounds = number[ends - 1]  # characters kept up to the end of each text, its closing line feed included
    got = got[kept].astype(np.uint64)
    letter = got != 32
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    before = np.concatenate(([False], letter[:-1]))
    starts = np.flatnonzero(letter & ~before)
    stops = np.flatnonzero(~letter & before)
    where = within(starts, len(got))
    with np.errstate(over="ignore"):
        value = np.where(letter, mix(got) * _POWERS[where & 4095], np.uint64(0))
        hashes = mix(np.add.reduceat(value, starts) + (stops - starts).astype(np.uint64))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    return hashes, counts


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words (runs may cross texts; the caller masks those)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * _BASE + hashes[k : k + n]
        return mix(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A Karp-Rabin hash of each run of `size` words, from running sums, so that long runs cost no more than short ones.
    Runs may cross texts; the caller masks those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, back = np.full(len(hashes), _BASE), np.full(n, _INVERSE)
        power[0] = back[0] = 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power))))
        return mix((sums[size:] - sums[:n]) * np.cumprod(back))
