"""Quality classifier: an interpolated modified Kneser-Ney model of words.

Trained on trusted text. Words are as in ``words.word_hashes`` (split at white space, A-Z folded), 64-bit hashes;
a text is two start marks, its words, one end mark. Counts of 3-grams, continuation counts of 2- and 1-grams,
counts of counts and context totals are sharded by n-gram. A document's perplexity is compared with a quantile,
for its language, of the perplexities of trusted documents that the model has not seen.

Back-off sums are kept as one additive weight per n-gram. With ``p`` the interpolated probability of a seen
n-gram, ``p'`` that of the n-gram without its first word, and ``b`` the back-off factor of its context, the weight
is ``ln p - ln b - ln p'``, plus ``ln b`` of the n-gram as a context itself. An n-gram's parts are seen when it is, so the sum of the weights
of all n-grams of a text is its log probability. A 3-gram, its first pair and that pair's weight are in the shard of
the pair, a word's weight in that of the word; the documents' places travel there in blocks (``word_blocks``) and
sums for each text come back. What a shard must know of n-grams kept elsewhere (continuation counts of pairs, counts of words)
it asks of their shards, which add up what all have sent. Weights are not stored: each task computes those of its shard from the counts.

Disk: the model is stored as counts of coded words; documents are taken in ``PARTS`` parts (by a hash of the text) and shards in
``SHARD_PARTS``, one part of the documents with one of the shards after the other. A place of
a text whose words the training text lacks is unseen and stays where it is (a bitmap of fixed size; it lets others through as well).

Rows: null and empty texts and texts without words have a null perplexity and are rejected. A language without
held-out trusted documents (null is a language) takes the threshold of all languages; without any, all texts with
words are kept. Equal texts get equal results, whatever their ids; a repeated row is repeated. Of ties at the
quantile all are kept. Other columns of the table are not read, so their names cannot clash. An empty table gives an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.bitmaps import bitmap
from cohortlake.llm.word_blocks import NOTHING, PIECE, ROWS, Codebook, Names, batch, by_place, place, pack, rows, to_shards, unpack
from cohortlake.llm.words import mix, slices, word_hashes
from cohortlake.operators.ranks import exact_quantiles
from cohortlake.operators.skew import BROADCAST_BYTES, join_null_safe, skew_join
from cohortlake.session import materialize, release, small_steps, shuffle_width, sized, written

ORDER = 3
FREQUENT = 1 << 18
CHUNK = 1 << 21
PARTS, SHARD_PARTS = 3, 2
VOCABULARY_BITS = 26
START, END = mix(np.array([1, 2], np.uint64))
STEP = np.uint64(0x9E3779B97F4A7C15)
# Kinds of rows, in the order in which a shard reads them.
TRIPLES, PAIRS, PAIR_ANSWERS, WORD_ANSWERS, WORDS, HEAD, PLACES, SINGLES = range(8)


class Model(NamedTuple):
    """``blocks``: the shards' counts; ``shape``: discounts and totals; ``codebook``: the most frequent words, broadcast."""

    blocks: DataFrame
    shards: int
    shape: Shape
    codebook: object


class Shape(NamedTuple):
    """Discounts of 3-, 2- and 1-grams; sum of the words' continuation counts; probability spared for each word, seen or not."""

    cuts: list[list[float]]
    total: int
    spare: float

    def cut(self, order: int, n: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.cuts[ORDER - order]])[np.minimum(n, 3)]

    @property
    def unknown(self) -> float:
        """Log probability of a word that was never seen."""
        return float(np.log(self.spare))


def _sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Marked word sequences of all texts with words, flat, and the text each position belongs to."""
    hashes, counts = word_hashes(texts)
    lengths = np.where(counts > 0, counts + ORDER, 0)
    ends = np.cumsum(lengths)
    sequence = np.full(int(lengths.sum()), START, np.uint64)
    inner = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    sequence[np.repeat(ends - lengths, counts) + ORDER - 1 + inner] = hashes
    sequence[ends[counts > 0] - 1] = END
    return sequence, np.repeat(np.arange(len(texts)), lengths)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * STEP + second)


def _triples(context: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Name of a 3-gram: that of its first pair, and that of its second turned by one bit."""
    return context ^ ((own << np.uint64(1)) | (own >> np.uint64(63)))


def _chunks(batches, shards: int = 1, column: int = 0):
    """``batch, slice, sequence, owner`` of texts with words, ``CHUNK`` bytes or 16 kB for each shard (4 times ``CHUNK`` at most) at a time."""
    limit = min(max(CHUNK, shards << 14), 4 * CHUNK)
    for found in batches:
        texts = found.column(column).cast(pa.binary())
        for part in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), limit):
            sequence, owner = _sequences([t or b"" for t in texts[part].to_pylist()])
            if len(sequence):
                yield found, part, sequence, owner


def _tally(n: np.ndarray) -> list[int]:
    """Counts of counts 1 to 4, of 3 or more, of all above 0, and their sum."""
    return [*(int((n == k).sum()) for k in range(1, 5)), int((n > 2).sum()), int((n > 0).sum()), int(n.sum())]


def _tallied(blocks: DataFrame, kind: int) -> list[int]:
    found = blocks.where(F.col("kind") == kind).agg(*[F.sum(F.col("tally")[i]).alias(f"t{i}") for i in range(7)]).first()
    return [x or 0 for x in found]


def _discounts(c: list[int]) -> list[float]:
    """Discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    if min(c[:2]) == 0:
        return [0.5, 0.5, 0.5]
    y = c[0] / (c[0] + 2 * c[1])
    raw = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def _pieces(columns: list[np.ndarray]):
    for k, at in enumerate(range(0, len(columns[0]), PIECE)):
        yield k, [c[at : at + PIECE] for c in columns]


def count_words_of(texts: DataFrame) -> DataFrame:
    """``word, n``: the words and marks of the ``text`` column."""

    def count(batches):
        for _, _, sequence, _ in _chunks(batches):
            word, n = np.unique(sequence, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    counted = texts.select("text").mapInArrow(count, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def count_triples(texts: DataFrame, codebook, shards: int) -> DataFrame:
    """Blocks of 3-grams of the ``text`` column with their counts, in the shards of their first pairs."""

    def spread(batches):
        book = codebook.value
        for _, _, sequence, owner in _chunks(batches, shards):
            codes = book.codes(sequence)
            at = np.flatnonzero(owner[:-2] == owner[2:])
            out = []
            for shard, own in by_place(_pair(sequence[at], sequence[at + 1]), shards):
                places = [at[own] + k for k in range(ORDER)]
                out.append((shard, 0, 0, 0, book.pack([sequence[i] for i in places], [], [codes[i] for i in places]), None))
            yield batch(out)

    def count(batches):
        book, found, shard = codebook.value, [], None
        for row in rows(batches):
            words, _, codes = book.unpack(row["data"])
            found.append([*words, *codes])
            shard = row["shard"]
        if not found:
            return
        *words, x, y, z = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort(words[::-1])
        words = [c[order] for c in words]
        fresh = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in words], axis=0)])
        n, at = np.diff(np.r_[fresh, len(order)]), order[fresh]
        for k, (a, b, c, x, y, z, n_own) in _pieces([*(c[fresh] for c in words), x[at], y[at], z[at], n]):
            yield batch([(shard, TRIPLES, shard << 20 | k, 0, book.pack([a, b, c], [n_own], [x, y, z]), _tally(n_own))])

    return to_shards(texts.select("text").mapInArrow(spread, ROWS), shards).mapInArrow(count, ROWS)


def _own_pairs(words: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Names of the second pairs of a block's 3-grams, a place of each, each place's pair, and the number of different first words."""
    return np.unique(_pair(words[1], words[2]), return_index=True, return_inverse=True, return_counts=True)


def continue_pairs(triples: DataFrame, codebook, shards: int) -> DataFrame:
    """Continuation counts of pairs: how many different words precede them. Blocks of pairs in their shards, and answers to each block of 3-grams."""

    def ask(batches):
        book = codebook.value
        for row in rows(batches):
            words, _, codes = book.unpack(row["data"])
            names, first, _, n = _own_pairs(words)
            out = []
            for shard, own in by_place(names, shards):
                pairs, coded = ([c[first[own]] for c in columns[1:]] for columns in (words, codes))
                out.append((shard, 0, row["source"], 0, book.pack(pairs, [n[own]], coded), None))
            yield batch(out)

    def add(batches):
        book, sources, found, shard = codebook.value, [], [], None
        for row in rows(batches):
            words, counts, codes = book.unpack(row["data"])
            found.append([*words, *counts, *codes])
            sources.append(row["source"])
            shard = row["shard"]
        if not found:
            return
        b, c, n, y, z = (np.concatenate(x) for x in zip(*found, strict=True))
        _, first, inverse = np.unique(_pair(b, c), return_index=True, return_inverse=True)
        total = np.bincount(inverse, n).astype(np.int64)
        order = np.lexsort((c[first], b[first]))
        at = first[order]
        for k, (b, c, y, z, n_own) in _pieces([b[at], c[at], y[at], z[at], total[order]]):
            yield batch([(shard, PAIRS, shard << 20 | k, 0, book.pack([b, c], [n_own], [y, z]), _tally(n_own))])
        for source, own in zip(sources, np.split(inverse, np.cumsum([len(x[0]) for x in found])[:-1]), strict=True):
            yield batch([(source >> 20, PAIR_ANSWERS, source, shard, pack([total[own]]), None)])

    return to_shards(triples.mapInArrow(ask, ROWS), shards).mapInArrow(add, ROWS)


def _own_words(words: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Different words of a block's (second) pairs, a place of each, and each place's words: those of first words, then those of second."""
    return np.unique(np.concatenate(words[-2:]), return_index=True, return_inverse=True)


def continue_words(blocks: DataFrame, codebook, shards: int) -> DataFrame:
    """Five counts of each word: different words before it; and of the pairs that it begins the sum and how many are 1, 2, or more.

    Blocks of words in their shards, and answers to each block of 3-grams or pairs.
    """

    def ask(batches):
        book = codebook.value
        for row in rows(batches):
            words, counts, codes = book.unpack(row["data"])
            names, first, inverse = _own_words(words)
            coded = np.concatenate(codes[-2:])[first]
            sums = [np.zeros(len(names))] * 5
            if row["kind"] == PAIRS:
                n, (begins, ends) = counts[0], np.split(inverse, 2)
                parts = [n, n == 1, n == 2, n > 2]
                sums = [np.bincount(ends, minlength=len(names)), *(np.bincount(begins, x, len(names)) for x in parts)]
            out = []
            for shard, own in by_place(names, shards):
                out.append((shard, 0, row["source"], row["kind"], book.pack([names[own]], [x[own] for x in sums], [coded[own]]), None))
            yield batch(out)

    def add(batches):
        book, sources, found, shard = codebook.value, [], [], None
        for row in rows(batches):
            words, counts, _ = book.unpack(row["data"])
            found.append([*words, *counts])
            sources.append((row["source"], row["part"]))
            shard = row["shard"]
        if not found:
            return
        word, *parts = (np.concatenate(x) for x in zip(*found, strict=True))
        names, inverse = np.unique(word, return_inverse=True)
        sums = [np.bincount(inverse, x).astype(np.int64) for x in parts]
        for k, (own, *counts) in _pieces([names, *sums]):
            yield batch([(shard, WORDS, shard << 20 | k, 0, pack(counts, [own]), _tally(counts[0]))])
        for (source, kind), own in zip(sources, np.split(inverse, np.cumsum([len(x[0]) for x in found])[:-1]), strict=True):
            # Of one shard's answers ``part`` tells the kind that has asked, and who answers.
            yield batch([(source >> 20, WORD_ANSWERS, source, kind * shards + shard, pack([x[own] for x in sums]), None)])

    return to_shards(blocks.mapInArrow(ask, ROWS), shards).mapInArrow(add, ROWS)


def train(texts: DataFrame, frequent: int = FREQUENT) -> Model:
    """The model of the ``text`` column; ``frequent``: words in the codebook."""
    spark = texts.sparkSession
    shards = max(12, shuffle_width(spark) // 2)
    with small_steps(spark):
        counted = materialize(count_words_of(texts), "words")
        top = counted.orderBy(F.desc("n"), "word").limit(frequent).select("word").toArrow()
        release(spark, [counted.__dict__["_stored_at"]])
        codebook = spark.sparkContext.broadcast(Codebook(top.column("word").to_numpy().view(np.uint64)))
        triples = materialize(count_triples(texts, codebook, shards), "triples")
        pairs = materialize(continue_pairs(triples, codebook, shards), "pairs")
        asking = triples.unionByName(pairs.where(F.col("kind") == PAIRS))
        words = materialize(continue_words(asking, codebook, shards), "vocabulary")
    three, two, one = _tallied(triples, TRIPLES), _tallied(pairs, PAIRS), _tallied(words, WORDS)
    cuts = [_discounts(x[:4]) for x in (three, two, one)]
    held = sum(d * n for d, n in zip(cuts[2], (one[0], one[1], one[4]), strict=True))
    total, size = one[6] or 1, one[5]
    spare = (held or 1.0) / total / (size + 1)
    return Model(triples.unionByName(pairs).unionByName(words), shards, Shape(cuts, total, spare), codebook)


class _Words:
    """Probabilities and back-off factors of words by their five counts."""

    def __init__(self, counts: list[np.ndarray], shape: Shape):
        n, total, *by_count = counts
        held = sum(d * k for d, k in zip(shape.cuts[1], by_count, strict=True))
        self.n, self.total = n.astype(np.int64), total.astype(np.int64)
        self.share = held / np.maximum(self.total, 1)
        self.p = (self.n - shape.cut(1, self.n)) / shape.total + shape.spare

    def pairs(self, shape: Shape, begins: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities of pairs of these words with their continuation counts."""
        return (n - shape.cut(2, n)) / self.total[begins] + self.share[begins] * self.p[ends]

    def weights(self, shape: Shape) -> np.ndarray:
        seen, begins = self.n > 0, self.total > 0
        return np.where(seen, np.log(self.p) - shape.unknown, 0.0) + np.log(np.where(begins, self.share, 1.0))


def _answered(names: np.ndarray, answers: dict[int, list[np.ndarray]], columns: int, shards: int) -> list[np.ndarray]:
    """The answers of all shards to what was asked of them, in the order of the names."""
    out = [np.zeros(len(names), np.int64) for _ in range(columns)]
    for shard, own in by_place(names, shards):
        for column, values in zip(out, answers[shard], strict=True):
            column[own] = values
    return out


class _Weights:
    """Weights of a shard's n-grams by name."""

    def __init__(self, blocks: list[dict], book: Codebook, shape: Shape, shards: int):
        answers = {(r["kind"], r["source"], r["part"]): unpack(r["data"])[0] for r in blocks if r["kind"] in (PAIR_ANSWERS, WORD_ANSWERS)}
        of = lambda kind, source, first: {d: answers[kind, source, first + d] for d in range(shards) if (kind, source, first + d) in answers}
        grams, weights, triples = [], [], []
        for r in blocks:
            kind, source = r["kind"], r["source"]
            if kind == WORDS:
                counts, (names,) = unpack(r["data"])
                grams.append(names)
                weights.append(_Words(counts, shape).weights(shape))
            if kind not in (TRIPLES, PAIRS):
                continue
            words, (n,), _ = book.unpack(r["data"])
            n = n.astype(np.int64)
            names, _, inverse = _own_words(words)
            known = _Words(_answered(names, of(WORD_ANSWERS, source, kind * shards), 5, shards), shape)
            begins, ends = np.split(inverse, 2)
            if kind == PAIRS:
                p = known.pairs(shape, begins, ends, n)
                grams.append(_pair(*words))
                weights.append(np.log(p) - np.log(known.share[begins]) - np.log(known.p[ends]))
            else:
                own, first, place, _ = _own_pairs(words)
                (continued,) = _answered(own, of(PAIR_ANSWERS, source, 0), 1, shards)
                below = known.pairs(shape, begins[first], ends[first], continued)
                triples.append([_pair(*words[:2]), own[place], n, below[place]])
        if triples:
            context, own, n, below = (np.concatenate(x) for x in zip(*triples, strict=True))
            cut = shape.cut(3, n)
            start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            total, held = np.add.reduceat(n, start), np.add.reduceat(cut, start)
            spread = np.diff(np.r_[start, len(n)])
            share = np.repeat(held / total, spread)
            p = (n - cut) / np.repeat(total, spread) + share * below
            grams += [_triples(context, own), context[start]]
            weights += [np.log(p) - np.log(share) - np.log(below), np.log(held / total)]
        names = self._turned(np.concatenate([np.zeros(0, np.uint64), *grams]))
        order = np.argsort(names)
        names = names[order]
        fresh = np.flatnonzero(np.r_[True, names[1:] != names[:-1]][: len(names)])
        self.names = Names(names[fresh])
        self.weights = np.add.reduceat(np.concatenate(weights)[order], fresh) if len(fresh) else np.zeros(0)

    @staticmethod
    def _turned(names: np.ndarray) -> np.ndarray:
        """Halves swapped: the upper one is alike in a shard."""
        return names << np.uint64(32) | names >> np.uint64(32)

    def of(self, names: np.ndarray) -> np.ndarray:
        """Weights of n-grams; 0 for those never seen."""
        out = np.zeros(len(names))
        found, places = self.names.find(self._turned(names))
        out[found] = self.weights[places]
        return out


def _known_words(model: Model, frequent: int):
    """Broadcast: weights by code of the ``frequent`` first words of the codebook (nan: to be asked), and the bitmap of all trained words."""
    book, shape = model.codebook.value, model.shape

    def listed(only: Codebook | None):
        def run(batches):
            for row in rows(batches):
                counts, (names,) = unpack(row["data"])
                some = np.arange(len(names)) if only is None else np.flatnonzero(only.codes(names))
                weights = _Words(counts, shape).weights(shape)[some]
                yield pa.RecordBatch.from_arrays([pa.array(names[some].view(np.int64)), pa.array(weights)], ["word", "weight"])

        return run

    stored = model.blocks.where(F.col("kind") == WORDS).select("data")
    words = stored.mapInArrow(listed(None), "word long, weight double")
    top = stored.mapInArrow(listed(Codebook(book.words[2 : 2 + frequent])), "word long, weight double").toArrow()
    weights = np.full(len(book.words), np.nan)
    weights[book.codes(top.column("word").to_numpy().view(np.uint64))] = top.column("weight").to_numpy()
    held = words.sparkSession.range(1).select(bitmap(words.select("word"), VOCABULARY_BITS).alias("held")).toArrow()
    return words.sparkSession.sparkContext.broadcast((weights, held.column("held").combine_chunks().flatten().to_numpy().view(np.uint64)))


def _trained(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bitmap lets each word through (``bitmaps.may_hold``)."""
    out = np.ones(len(words), bool)
    for slot in (words, words >> np.uint64(32)):
        slot = slot & np.uint64((1 << VOCABULARY_BITS) - 1)
        out &= (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _document_places(model: Model, known, low: int, high: int):
    """For each chunk of texts its names, numbers of places and what is known here, and for each shard the places to look up there.

    Only shards ``low`` to ``high``; numbers of places and what is known here come with the first.
    """
    codebook, shards, unknown = model.codebook, model.shards, model.shape.unknown

    def run(batches):
        book, (weights, bits) = codebook.value, known.value
        block = TaskContext.get().partitionId() << 24
        for found, part, sequence, owner in _chunks(batches, shards, 2):
            size = part.stop - part.start
            codes = book.codes(sequence)
            trained = codes > 0
            others = np.flatnonzero(~trained)
            trained[others] = _trained(sequence[others], bits)
            # All but the first start mark: words. Here, or in their shards.
            one = 1 + np.flatnonzero(owner[1:] == owner[:-1])
            here = weights[codes[one]]
            ask = one[np.isnan(here) & trained[one]]
            events = np.bincount(owner[:-2][owner[:-2] == owner[2:]], minlength=size)
            some = np.flatnonzero(events)
            if low:
                events, score = np.zeros(size), np.zeros(size)
            else:
                score = events * unknown + np.bincount(owner[one], np.nan_to_num(here), size)
            out = []
            h1, h2 = (found.column(i).to_numpy()[part][some].view(np.uint64) for i in (0, 1))
            head = pack([some, [size]], [h1, h2, events[some].astype(np.uint64), score[some].view(np.uint64)])
            out.append((low + block % (high - low), HEAD, block, 0, head, None))
            # A pair with an untrained word is unseen, and so are the 3-grams that begin with it.
            at = np.flatnonzero((owner[1:] == owner[:-1]) & trained[1:] & trained[:-1])
            context = _pair(sequence[at], sequence[at + 1])
            here = _within(context, shards, low, high)
            at, context = at[here], context[here]
            ask = ask[_within(sequence[ask], shards, low, high)]
            words, code = np.r_[sequence, NOTHING], np.r_[codes, np.uint32(1)]
            third = np.r_[(owner[:-2] == owner[2:]) & trained[2:], False][at]
            third = np.where(third, at + 2, len(sequence))
            for shard, own in by_place(context, shards):
                places = [at[own], at[own] + 1, third[own]]
                ordinals = np.diff(owner[at[own]], prepend=0)
                data = book.pack([words[i] for i in places], [ordinals, np.array([size])], [code[i] for i in places])
                out.append((shard, PLACES, block, 0, data, None))
            for shard, own in by_place(sequence[ask], shards):
                data = pack([np.diff(owner[ask[own]], prepend=0), np.array([size])], [sequence[ask[own]]])
                out.append((shard, SINGLES, block, 0, data, None))
            yield batch(out)
            block += 1

    return run


def _within(names: np.ndarray, shards: int, low: int, high: int) -> np.ndarray:
    at = place(names, shards)
    return np.flatnonzero((at >= low) & (at < high))


def _sums(model: Model):
    """For each chunk of texts the sums of the weights that a shard knows, by text; heads go on as they are."""
    codebook, shards, shape = model.codebook, model.shards, model.shape

    def run(batches):
        book, blocks, weights = codebook.value, [], None
        for row in rows(batches):
            if row["kind"] < HEAD:
                blocks.append(row)
                continue
            if row["kind"] == HEAD:
                yield _sum_batch(row["source"], True, row["data"])
                continue
            if weights is None:
                weights, blocks = _Weights(blocks, book, shape, shards), []
            if row["kind"] == PLACES:
                (a, b, c), (ordinals, size), _ = book.unpack(row["data"])
                context = _pair(a, b)
                value = weights.of(context)
                full = np.flatnonzero(c != NOTHING)
                value[full] += weights.of(_triples(context[full], _pair(b[full], c[full])))
            else:
                (ordinals, size), (names,) = unpack(row["data"])
                value = weights.of(names)
            sums = np.bincount(np.cumsum(ordinals), value, int(size[0]))
            if sums.any():
                yield _sum_batch(row["source"], False, pack([], [sums.view(np.uint64)]))

    return run


def _sum_batch(block: int, head: bool, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([head]), pa.array([data], pa.binary())], ["block", "head", "data"])


def _scores(found: pa.Table) -> pa.Table:
    """``h1, h2, score, events`` of the texts of a chunk."""
    heads, data = found.column("head").to_pylist(), found.column("data").to_pylist()
    (some, size), (h1, h2, events, score) = unpack(data[heads.index(True)])
    sums = np.zeros(int(size[0]))
    for is_head, part in zip(heads, data, strict=True):
        if not is_head:
            sums += unpack(part)[1][0].view(np.float64)
    columns = [h1.view(np.int64), h2.view(np.int64), score.view(np.float64) + sums[some], events.view(np.int64)]
    return pa.table([pa.array(c) for c in columns], ["h1", "h2", "score", "events"])


def perplexities(df: DataFrame, model: Model, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``h1, h2, n_words, perplexity`` of each distinct text with words; ``h1``, ``h2``: ``text_name`` of the text.

    ``frequent``: words of the codebook whose weights are added up where the text is; the rest are asked for.
    Copies of a text add up their log probabilities and their places alike, so the quotient is that of one.
    """
    spark, found = df.sparkSession, []
    with small_steps(spark):
        known = _known_words(model, frequent)
    named = df.select(*text_name(text), F.col(text).alias("text"))
    bounds = [model.shards * k // SHARD_PARTS for k in range(SHARD_PARTS + 1)]
    for part, low, high in ((k, *b) for k in range(PARTS) for b in zip(bounds[:-1], bounds[1:], strict=True)):
        places = named.where(F.pmod("h1", F.lit(PARTS)) == part).mapInArrow(_document_places(model, known, low, high), ROWS)
        blocks = model.blocks.where(F.col("shard").between(low, high - 1))
        met = to_shards(blocks.drop("tally").unionByName(places.drop("tally")), high - low)
        summed = met.sortWithinPartitions("kind", "source").mapInArrow(_sums(model), "block long, head boolean, data binary")
        with small_steps(spark):
            found.append(materialize(summed.groupBy("block").applyInArrow(_scores, "h1 long, h2 long, score double, events long"), "scores"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # Places are counted with the first part of the shards, in each copy of a text; the end mark is one of them.
    sums = every.groupBy("h1", "h2").agg(
        F.sum("score").alias("score"), F.sum("events").alias("events"), (F.max("events") - 1).alias("n_words")
    )
    return sums.select("h1", "h2", "n_words", F.exp(-F.col("score") / F.col("events")).alias("perplexity"))


def text_name(text: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def classify(
    df: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = 0.99,
    slack: float = 1.15,
) -> DataFrame:
    """``id, lang, n_words, perplexity, threshold, trusted, kept`` for each row.

    ``trusted``: one column of ids. A fifth of them, by hash, is held out of training and sets the
    thresholds: the ``quantile`` of their perplexities in each language, times ``slack``.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    ids, _, size = sized(ids, "trusted")
    if size <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    held = F.pmod(F.xxhash64("trusted_id"), F.lit(5)) == 0
    training = df.join(ids.where(~held), F.col(id_col) == F.col("trusted_id")).select(F.col(text).alias("text"))
    before = len(written())
    model = train(training)
    model_tables = written(before)
    scores = materialize(perplexities(df, model, text), "scores")
    release(df.sparkSession, model_tables)
    rows = df.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), *text_name(text))
    scored = skew_join(materialize(rows, "named"), scores, ["h1", "h2"], "left").drop("h1", "h2")
    scored = scored.withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    flagged = scored.join(ids.withColumn("held", held), F.col("id") == F.col("trusted_id"), "left")
    flagged = flagged.withColumn("trusted", F.col("trusted_id").isNotNull()).withColumn("held", F.coalesce("held", F.lit(False)))
    flagged = materialize(flagged, "scored")
    heldout = flagged.where("held AND perplexity IS NOT NULL").select("lang", "perplexity")
    limits = exact_quantiles(heldout, ["lang"], "perplexity", {"own": quantile})
    everyone = exact_quantiles(heldout.select(F.lit(0).alias("g"), "perplexity"), ["g"], "perplexity", {"all": quantile})
    limits = materialize(limits, "limits")
    overall = materialize(everyone.select("all"), "limits")
    joined = join_null_safe(flagged, limits, ["lang"], "left").withColumn("all", overall.scalar())
    threshold = F.coalesce("own", "all", F.lit(float("inf"))) * slack
    return joined.select(
        "id", "lang", "n_words", "perplexity", threshold.alias("threshold"), "trusted",
        F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"),
    )
