"""Words in packed blocks: many n-grams travel as one row of a few bytes each.

A row ``shard, kind, source, part, data, tally`` holds columns of words and of whole numbers. A word in the
codebook, a table of fixed size with the most frequent words, is its rank there; any other is spelled out by its
64-bit hash, so nothing depends on the size of the vocabulary. Numbers are laid out byte by byte and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = "shard int, kind int, source long, part int, data binary, tally array<long>"
#: The hash that stands for "no word".
NOTHING = np.uint64(0)
#: Rows of a block that a table of n-grams is cut into.
PIECE = 1 << 22


def pack(ints: list[np.ndarray], names: list[np.ndarray] = ()) -> bytes:
    """Whole numbers from 0 to 2**32 - 1, and 64-bit hashes."""
    head = np.array([len(ints), len(names), *map(len, ints), *map(len, names)], np.int64)
    if any(len(x) and int(np.max(x)) >> 32 for x in ints):
        raise OverflowError("a count needs more than 32 bits")
    planes = [np.ascontiguousarray(np.asarray(x, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in ints]
    flat = b"".join([head.tobytes(), *planes, *(np.asarray(x, "<u8").tobytes() for x in names)])
    return np.int64(len(flat)).tobytes() + pa.compress(flat, codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    flat = pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n_ints, n_names = np.frombuffer(flat, np.int64, 2).tolist()
    lengths = np.frombuffer(flat, np.int64, n_ints + n_names, 16).tolist()
    at, ints, names = 16 + 8 * len(lengths), [], []
    for n in lengths[:n_ints]:
        planes = np.frombuffer(flat, np.uint8, 4 * n, at).reshape(4, n)
        ints.append(np.ascontiguousarray(planes.T).view("<u4").reshape(n))
        at += 4 * n
    for n in lengths[n_ints:]:
        names.append(np.frombuffer(flat, "<u8", n, at))
        at += 8 * n
    return ints, names


class Names:
    """Sorted distinct 64-bit hashes, found by their upper bits: about one name for each."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.shift = np.uint64(64 - max(1, len(names).bit_length()))
        uppers = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.begin = np.r_[np.searchsorted(names, uppers), len(names)].astype(np.int32)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where those are that are held, and their places here."""
        upper = (names >> self.shift).astype(np.int32)
        at, end = self.begin[upper], self.begin[upper + 1]
        left = np.flatnonzero(at < end)
        at, end, names = at[left], end[left], names[left]
        found, places = [left[:0]], [at[:0]]
        while len(left):
            hit = self.names[at] == names
            found.append(left[hit])
            places.append(at[hit])
            more = ~hit & (at + 1 < end)
            left, at, end, names = left[more], at[more] + 1, end[more], names[more]
        return np.concatenate(found), np.concatenate(places)


class Codebook:
    """Codes of words: 0 is a word spelled out, 1 is ``NOTHING``, then the given words in order."""

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([np.zeros(2, np.uint64), words.astype(np.uint64)])
        order = np.argsort(self.words[1:], kind="stable")
        self.sorted, self.ranks = Names(self.words[1:][order]), (order + 1).astype(np.uint32)

    def codes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.uint32)
        found, places = self.sorted.find(words)
        out[found] = self.ranks[places]
        return out

    def pack(self, columns: list[np.ndarray], ints: list[np.ndarray], codes: list[np.ndarray] | None = None) -> bytes:
        """Columns of words with columns of whole numbers; ``codes``: those of the words, where they are known."""
        codes = [self.codes(c) for c in columns] if codes is None else codes
        return pack([*codes, *ints], [c[k == 0] for c, k in zip(columns, codes, strict=True)])

    def unpack(self, data: bytes) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Columns of words, columns of whole numbers, and the words' codes."""
        ints, names = unpack(data)
        columns = []
        for code, spelled in zip(ints, names, strict=False):
            words = self.words[code]
            if len(spelled):
                words[code == 0] = spelled
            columns.append(words)
        return columns, ints[len(columns) :], ints[: len(columns)]


def place(names: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit hash, by its upper half."""
    return ((names >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int16 if shards < 1 << 15 else np.int32)


def by_place(names: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has some of the hashes, and where they are, in order."""
    if len(names):
        at = place(names, shards)
        order = np.argsort(at, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            yield int(at[own[0]]), own


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows ``shard, kind, source, part, data, tally``."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "kind", "source", "part", "data", "tally"]
    )


def rows(batches) -> Iterator[dict]:
    for found in batches:
        for i in range(found.num_rows):
            yield {name: found.column(name)[i].as_py() for name in found.schema.names}


def to_shards(df: DataFrame, shards: int) -> DataFrame:
    """Each shard in a task of its own."""
    return df.repartitionById(shards, "shard")
