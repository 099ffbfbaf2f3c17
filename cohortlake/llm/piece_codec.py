"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch's distinct words become one flat array of symbol ids. Each round finds the minimum
pair rank of every word (a segmented minimum), merges its leftmost non-overlapping
occurrences in all words at once, and compacts, until no pair can merge. The model's tables
have the size of the vocabulary and travel with the task; executors need no model file.

Rows: a null text is encoded like an empty one; any other text whole, of any length.
Repeated rows get equal results; an empty table gives an empty one; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.words import in_chunks, segment_hashes, slices

MARK = "▁"
_NONE = np.int32(np.iinfo(np.int32).max)
_CODE_POINTS = 0x110000
CACHED_WORDS = 300_000
CHUNK = 1 << 19
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class WordCache:
    """Ids of words met before, found by a 128-bit hash, so that later batches merge new words only.

    It is emptied when it would pass ``CACHED_WORDS``; that changes time, never the ids.
    """

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.flat = np.zeros(0, "<u4")
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words, and which are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """Put in words whose keys are ascending and new."""
        at = np.searchsorted(self.keys, keys)
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.begin, self.length = np.insert(self.begin, at, begin), np.insert(self.length, at, counts)
        self.flat = np.r_[self.flat, flat.astype("<u4")]


class PieceTables:
    """Lookup arrays of a BPE model with an identity normaliser and byte fallback."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, model.SentencePiece
        plain = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback
        rules = spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces
        odd = {kinds.USER_DEFINED, kinds.UNUSED} & {p.type for p in model.pieces}
        if not plain or rules or odd or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback, no normalisation rules and plain pieces is needed")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.size = len(model.pieces)
        names = [p.piece for p in model.pieces]
        self.begin, self.end = names.index(model.trainer_spec.bos_piece), names.index(model.trainer_spec.eos_piece)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        # Symbols are pieces, then code points that are no piece of their own.
        self.char_symbol = np.arange(self.size, self.size + _CODE_POINTS, dtype=np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i

        def symbol(part: str) -> int | None:
            return normal.get(part, self.size + ord(part) if len(part) == 1 else None)

        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        rank_of = {score: rank for rank, score in enumerate(scores)}
        pairs = []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left * (self.size + _CODE_POINTS) + right, rank_of[model.pieces[i].score], i))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_key, self.pair_rank, self.pair_piece = (
            table[:, 0].copy(),
            table[:, 1].astype(np.int32),
            table[:, 2].astype(np.int32),
        )
        # Where words may be cut apart: no piece joins what stands on both sides.
        joined = [p for p in normal if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("pieces that run over the end of a word are not supported")
        # Characters that no longer piece holds stand alone.
        self.lone = [ord(c) for c in "\n\t\r" if not any(c in p for p in joined)]
        self.byte_id = np.zeros(256, np.int32)
        plain_bytes, is_byte, skip = [], np.zeros(self.size, bool), np.zeros(self.size, bool)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], is_byte[i] = i, True
                plain_bytes.append(bytes([value]))
            elif p.type == kinds.CONTROL:
                skip[i] = True
                plain_bytes.append(b"")
            elif p.type == kinds.UNKNOWN:
                plain_bytes.append(model.trainer_spec.unk_surface.encode())
            else:
                plain_bytes.append(p.piece.replace(MARK, " ").encode())
        self.is_byte, self.is_control = is_byte, skip
        self.piece_len = np.array([len(b) for b in plain_bytes], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(plain_bytes), np.uint8)
        self.starts_blank = np.array([p.type == kinds.NORMAL and p.piece.startswith(MARK) for p in model.pieces])

    def state(self) -> dict:
        """The tables as plain values, to be broadcast: executors need not have this module."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, state: dict) -> PieceTables:
        """Tables over a broadcast state. The worker's copy also keeps the words met so far."""
        tables = cls.__new__(cls)
        tables.__dict__ = state
        if "cache" not in state:
            state["cache"] = WordCache()
        return tables

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * (self.size + _CODE_POINTS) + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return at, self.pair_key[at] == key

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, found = self._find(left, right)
        return np.where(found, self.pair_rank[at], _NONE), self.pair_piece[at]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray, one_at_a_time: bool = False):
        """Final symbols of words given by the symbols of their characters, flat, and how many each has.

        A merge may offer a better pair than the rank just merged; the exact order then
        matters, so words where that happens after several merges are done again with one
        merge a round.
        """
        given, symbols = symbols, symbols.copy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        last = np.ones(len(owner), bool)
        last[:-1] = owner[1:] != owner[:-1]
        rank, piece = np.full(len(owner), _NONE, np.int32), np.zeros(len(owner), np.int32)
        inner = np.flatnonzero(~last)
        rank[inner], piece[inner] = self._rank(symbols[inner], symbols[inner + 1])
        done_symbols, done_owner, again = [], [], []
        before = np.full(len(lengths), -1, np.int32)
        several = np.zeros(len(lengths), bool)
        while len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            names = owner[starts]
            wrong = several[names] & (least < before[names])
            ended = (least == _NONE) | wrong
            sizes = np.diff(np.r_[starts, len(owner)])
            if ended.any():
                again.extend(names[wrong].tolist())
                leaving, good = np.repeat(ended, sizes), np.repeat(ended & ~wrong, sizes)
                done_symbols.append(symbols[good])
                done_owner.append(owner[good])
                stay = ~leaving
                symbols, owner, rank, piece = symbols[stay], owner[stay], rank[stay], piece[stay]
                least, sizes, names = least[~ended], sizes[~ended], names[~ended]
                if not len(owner):
                    break
            best = rank == np.repeat(least, sizes)
            at = np.flatnonzero(best)
            if one_at_a_time:
                at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            else:
                # In a run of overlapping pairs the 1st, 3rd, 5th ... merge.
                fresh = np.r_[True, at[1:] != at[:-1] + 1]
                nth = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                at = at[nth % 2 == 0]
                several[names] = False
                twice = owner[at[1:]][owner[at[1:]] == owner[at[:-1]]]
                several[twice] = True
            before[names] = least
            symbols[at] = piece[at]
            rank[at + 1] = -1
            keep = rank != -1
            moved = np.cumsum(keep) - 1
            # The pair that begins at a merged symbol ends where the swallowed one ended.
            symbols, owner, rank, piece = symbols[keep], owner[keep], rank[keep], piece[keep]
            at = moved[at]
            near = np.zeros(len(owner), bool)
            near[at] = True
            near[np.maximum(at - 1, 0)] = True
            touched = np.flatnonzero(near)
            follow = np.minimum(touched + 1, len(owner) - 1)
            linked = (follow > touched) & (owner[follow] == owner[touched])
            rank[touched[~linked]] = _NONE
            touched, follow = touched[linked], follow[linked]
            rank[touched], piece[touched] = self._rank(symbols[touched], symbols[follow])
        if again:
            redo = np.sort(np.array(again))
            exact, counts = self.merge(given[np.isin(np.repeat(np.arange(len(lengths)), lengths), redo)], lengths[redo], True)
            done_symbols.append(exact)
            done_owner.append(np.repeat(redo, counts))
        flat, owner = np.concatenate([*done_symbols, np.zeros(0, np.int32)]), np.concatenate([*done_owner, []])
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner.astype(np.int64), minlength=len(lengths))

    def ids(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of the words, flat, and how many each has; unknown characters become bytes."""
        flat, counts = self.merge(symbols, lengths)
        unknown = np.flatnonzero(flat >= self.size)
        if not len(unknown):
            return flat, counts
        raw = [chr(c - self.size).encode("utf-8", "replace") for c in flat[unknown]]
        wide = np.ones(len(flat), np.int64)
        wide[unknown] = [len(b) for b in raw]
        out = np.repeat(flat, wide)
        out[np.repeat(flat >= self.size, wide)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(lengths)), counts)
        return out, np.bincount(np.repeat(owner, wide), minlength=len(lengths))

    def encode(self, texts: list[str], cache: WordCache, ends: bool = True) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. ``cache`` keeps words between batches."""
        marked = [self.prefix + t if t else "" for t in texts]
        points = np.frombuffer("".join(marked).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
        text_at = np.cumsum([0, *map(len, marked)])
        starts = self._word_starts(points, text_at[:-1])
        codes = self._codes(points, starts, cache)
        sizes = np.diff(np.searchsorted(starts, text_at))
        used = cache.length[codes]
        at = np.repeat(cache.begin[codes] - (np.cumsum(used) - used), used)
        at += np.arange(len(at))
        tokens = cache.flat[at]
        bounds = np.r_[0, np.cumsum(used)][np.cumsum([0, *sizes])]
        head, tail = (np.uint32(i).astype("<u4").tobytes() if ends else b"" for i in (self.begin, self.end))
        return [head + tokens[a:b].tobytes() + tail for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _word_starts(self, points: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Where a word begins: at a text, at a run of marks, at and after a character that stands alone."""
        if not len(points):
            return np.zeros(0, np.int64)
        first = points == ord(MARK)
        first[1:] &= ~first[:-1]
        for c in self.lone:
            alone = points == c
            first |= alone
            first[1:] |= alone[:-1]
        first[text_at[text_at < len(points)]] = True
        return np.flatnonzero(first)

    def _codes(self, points: np.ndarray, starts: np.ndarray, cache: WordCache) -> np.ndarray:
        """Place of each word in the cache, which gets the new ones."""
        if not len(starts):
            return np.zeros(0, np.int64)
        lengths = np.diff(np.r_[starts, len(points)])
        value = points.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(1)
        value ^= value >> np.uint64(29)
        keys, checks = (segment_hashes(value, starts, starts + lengths, step) for step in _STEPS)
        order = np.argsort(keys)
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[order[1:]] != keys[order[:-1]]
        some = order[fresh]
        _, known = cache.find(keys[some], checks[some])
        new = some[~known]
        if len(new) and len(cache.keys) + len(new) > CACHED_WORDS:
            cache.__init__()
            new = some
        if len(new):
            sizes = lengths[new]
            at = np.repeat(starts[new] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            flat, counts = self.ids(self.char_symbol[points[at]], sizes)
            cache.add(keys[new], checks[new], flat, counts)
        place, known = cache.find(keys[some], checks[some])
        codes = np.empty(len(keys), np.int64)
        codes[order] = place[np.cumsum(fresh) - 1]
        if not (known.all() and (cache.checks[codes] == checks).all()):
            raise ValueError("two words share a hash")
        return codes

    def decode(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids: control ids vanish, byte ids join into characters, the added blank goes."""
        ids = [np.frombuffer(p, "<u4").astype(np.int64) for p in packed]
        ids = [i[~self.is_control[i]] for i in ids]
        flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        sizes = self.piece_len[flat]
        at = np.repeat(self.piece_at[flat] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        data = self.piece_bytes[at].tobytes()
        bounds = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, ids)])]
        out = []
        for i, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True):
            if self.prefix and len(i) and self.starts_blank[i[0]]:
                a += 1
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(self._decode_bytes(i, data[a:b]))
        return out

    def _decode_bytes(self, ids: np.ndarray, data: bytes) -> str:
        """Byte ids that form no character: one replacement mark for each such byte."""
        text, at = [], 0
        while at < len(data):
            for width in (1, 2, 3, 4):
                try:
                    text.append(data[at : at + width].decode())
                    at += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                text.append("�")
                at += 1
        return "".join(text)


def code_columns(
    df: DataFrame,
    tables: PieceTables,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = "decoded",
    id_bytes: int = 4,
) -> DataFrame:
    """Add each text's ids, begin and end ids included, as packed ``<u4`` bytes, and the text they decode to.

    Both happen in one pass, in slices of ``CHUNK`` bytes, so a worker holds one batch of rows and
    one slice of results. ``id_bytes`` 2 packs the ids as ``<u2``, for vocabularies that fit.
    """
    if id_bytes not in (2, 4) or tables.size > 1 << 8 * id_bytes:
        raise ValueError("ids take 4 bytes, or 2 where the vocabulary fits")
    shared = df.sparkSession.sparkContext.broadcast(tables.state())
    at = df.columns.index(text)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceTables.of(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for part in slices(sizes, CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                packed = coder.encode([t or "" for t in rows.column(at).to_pylist()], coder.cache)
                texts = [pa.array(coder.decode(packed), pa.string())] if decoded else []
                if id_bytes == 2:
                    packed = [np.frombuffer(p, "<u4").astype("<u2").tobytes() for p in packed]
                added = [pa.array(packed, pa.binary()), *texts]
                names = [*rows.schema.names, ids, *([decoded] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], names)

    fields = [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return df.mapInArrow(code, T.StructType([*df.schema.fields, *fields]))


def encode_column(
    df: DataFrame, tables: PieceTables, text: str = "text", out: str = "ids", id_bytes: int = 4
) -> DataFrame:
    """Add the ids of each text, begin and end ids included, as packed ``<u4`` (or ``<u2``) bytes."""
    return code_columns(df, tables, text, out, None, id_bytes)


def decode_column(df: DataFrame, tables: PieceTables, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that packed ids stand for; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(tables.state())

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = PieceTables.of(shared.value)
        for batch in batches:
            packed = [p or b"" for p in batch]
            texts: list[str] = []
            for part in in_chunks(packed):
                texts += tables.decode(packed[part])
            yield pd.Series(texts, dtype=object)

    return df.withColumn(out, decode(F.col(ids)))
