"""Words as the text operators define them, on flat byte arrays and as Spark columns.

White space is space and ``\\t \\n \\x0b \\f \\r``; everything else belongs to a word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACES = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_KEPT: dict[int, np.ndarray] = {}


def _kept_powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; kept for later batches, whose sizes are alike."""
    if len(_KEPT.get(base, ())) < n:
        _KEPT[base] = _powers(np.uint64(base), 1 << max(12, (n - 1).bit_length()))
    return _KEPT[base][:n]


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: np.uint64 = _STEP) -> np.ndarray:
    """64-bit hash of each slice ``values[start:end]`` (uint64), all slices at once.

    A prefix sum of values times powers of an odd base, modulo 2**64; the slice's sum is shifted
    back by the inverse power, so equal slices hash alike wherever they stand.
    """
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _kept_powers(int(step), n), out=prefix[1:])
    back = _kept_powers(pow(int(step), -1, 1 << 64), n)
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's word count."""
    flat = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if fold:
        flat = _FOLD[flat]
    inside = ~_IS_SPACE[flat]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, bounds))
    return segment_hashes(_BYTE_VALUE[flat], starts, ends) if len(starts) else np.zeros(0, np.uint64), counts


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: flat sorted hashes, and how many per text.

    A text with fewer words than ``width`` has its whole word sequence as its one shingle;
    a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(counts) - counts
    combined = np.zeros(len(hashes), np.uint64)
    lengths = np.minimum(counts, width)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    # Short texts: their sequence; others: every full window. The length tells them apart.
    window = np.repeat(lengths, counts)
    for k in range(width):
        part = mix(combined * _STEP + padded[k : k + len(hashes)] + np.uint64(k + 1))
        combined = np.where(k < window, part, combined)
    combined = mix(combined + window.astype(np.uint64))
    shingles = np.where(counts > 0, counts - lengths + 1, 0)
    owner = np.repeat(np.arange(len(texts)), shingles)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    values = combined[first[owner] + inner]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.bincount(owner[fresh], minlength=len(texts))


def slices(sizes, limit: int):
    """Slices of rows whose sizes add up to about ``limit``, so that memory stays bounded."""
    begin = held = 0
    for i, size in enumerate(sizes):
        held += size + 1
        if held >= limit:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def in_chunks(texts: list, limit: int = 1 << 20):
    """Slices of the list holding about ``limit`` bytes each."""
    return slices([len(t) for t in texts], limit)


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def trim_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def split_words(text: Column) -> Column:
    """Array of words; empty for null and for text without words."""
    trimmed = trim_spaces(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def count_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def bind(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df, *names: str) -> dict[str, str]:
    """Names for working columns that clash with none of the table's, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        fresh = name
        while fresh.lower() in taken:
            fresh += "_"
        out[name] = fresh
        taken.add(fresh.lower())
    return out
