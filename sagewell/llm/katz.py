"""Katz backoff models of any order: counted, stored and evaluated through packed blocks.

Texts are read in chunks of bounded size. A chunk numbers its words locally and sends each word once
(with its training count) to the part that the word's hash names; parts add the counts up, keep the
vocabulary and answer with word numbers and counts. Then, level by level, a chunk sends each of its
distinct n-grams once, as the number of its context (the n-gram of the level below) and of its word,
to the block that the context names (for frequent contexts, the pair). Blocks add up, keep the level's
table, number its n-grams and answer with counts and with what a context's backoff weight is made of.
What crosses
the network is the distinct words and n-grams of chunks, as sorted and compressed arrays, not tokens.
Texts are scored recursively, from words up to the highest level.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, materialise, pack, pack_ints, pack_words, raw, unpack, unpack_ints, unpack_words

#: Counts up to this are discounted.
LARGEST = 5
#: Tokens of a chunk; a longer text makes a longer chunk of its own.
CHUNK_TOKENS = 2_000_000
#: A context with more occurrences than this has its n-grams dealt out by context and word.
FREQUENT = 250_000
#: Bytes of text to a part of the vocabulary, and training tokens to a block of n-grams.
PART_BYTES, BLOCK_TOKENS = 64_000_000, 2_000_000
#: Questions are counted and answered, and texts scored, in so many passes one after the other, so that less
#: of what is shuffled is on disk at a time.
SLICES = 3
#: Stands for no word in an n-gram that only asks for its context.
NO_WORD = (1 << 32) - 1
#: The token that ends a text, and stands before its first word.
END = b""

_PARTS = "kind string, part int, chunk bigint, ids array<{0}>, held binary, sizes binary, a binary, b binary"


def discounts(spectrum: list[int]) -> np.ndarray:
    """Good-Turing discount ratio of each count 0..LARGEST (0 unused), by Katz's formula.

    spectrum[r] is how many n-grams have count r, up to LARGEST + 1. Where the formula gives no ratio
    in (0, 1] or they don't grow with the count, absolute discounting with the usual estimate from
    n1 and n2 stands in for all of them.
    """
    n, k = [float(x) for x in spectrum], LARGEST
    out = np.ones(k + 1)
    fine = n[1] > 0 and (k + 1) * n[k + 1] < n[1] and all(n[r] > 0 for r in range(1, k + 1))
    if fine:
        cut = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            out[r] = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
        fine = bool((out[1:] > 0).all() and (out[1:] < 1).all())
    if not fine:
        d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        out[1:] = [(r - d) / r for r in range(1, k + 1)]
    return out


@dataclass
class Unigrams:
    """What every task needs to know of the unigrams: totals and discounts, of fixed size."""

    tokens: int
    distinct: int
    ratio: np.ndarray
    unseen: float  # the probability of all unknown words together
    above: float = 1.0  # ratio of counts over LARGEST

    def prob(self, counts: np.ndarray) -> np.ndarray:
        """Of words with these training counts; 0 is the class of unknown words."""
        if not self.tokens:
            return np.ones(len(counts))
        known = counts * np.where(counts <= LARGEST, self.ratio[np.minimum(counts, LARGEST)], self.above) / self.tokens
        return np.where(counts > 0, known, self.unseen)


def unigrams(spectrum: list[int], tokens: int, distinct: int) -> Unigrams:
    ratio = discounts(spectrum)
    lost = sum(spectrum[r] * r * (1 - ratio[r]) for r in range(1, LARGEST + 1)) / max(tokens, 1)
    if tokens and lost <= 0:  # no word is rare: make room for one more occurrence
        return Unigrams(tokens, distinct, ratio * 0 + tokens / (tokens + 1), 1 / (tokens + 1), tokens / (tokens + 1))
    return Unigrams(tokens, distinct, ratio, lost)


def _spectrum(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[counts <= LARGEST + 1], minlength=LARGEST + 2).tolist()


def _block(context: np.ndarray, word: np.ndarray, context_count: np.ndarray, blocks: int, frequent: int) -> np.ndarray:
    mixed = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.where(context_count > frequent, mixed + word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), mixed)
    return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % blocks


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal values."""
    starts = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def _sort(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys from 0 to top in order, and the places they come from, equal ones in order of place. Key and place
    are sorted as one number where they fit in 63 bits, which takes a third of the time."""
    bits = len(keys).bit_length()
    if int(top).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = keys.astype(np.int64)
    both <<= bits
    both |= np.arange(len(keys))
    both.sort()
    order = both & ((1 << bits) - 1)
    both >>= bits
    return both, order


def _number(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, which of them each key is, and where each is first."""
    keys, order = _sort(keys, top)
    starts, sizes = _runs(keys)
    which = np.empty(len(keys), np.int32)
    which[order] = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    return keys[starts], which, order[starts]


def _statistics(context: np.ndarray, counts: np.ndarray, lower: np.ndarray, n: int) -> np.ndarray:
    """What the weights of contexts 0..n-1 are made of, from their seen n-grams, a column for each: how many have
    each count up to LARGEST, how many have each such count in the level below, and the sum of larger ones there."""
    out = np.zeros((2 * LARGEST + 1, n), np.int64)
    for at, values in ((0, counts), (LARGEST, lower)):
        some = np.flatnonzero((values > 0) & (values <= LARGEST))
        out[at : at + LARGEST] = np.bincount((values[some] - 1) * n + context[some], minlength=LARGEST * n).reshape(LARGEST, n)
    large = np.flatnonzero(lower > LARGEST)
    out[-1] = np.bincount(context[large], lower[large], n)
    return out


def backoff(context_count: np.ndarray, by_count: np.ndarray, mass: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts: what seen n-grams' counts are divided by, and the backoff weight.

    by_count[r-1] says how many n-grams have count r; mass is the probability in the level below of
    all seen words. A context without discounted n-grams is divided by one more than its count, which
    frees mass for unseen words; either way the context's probabilities add up to one.
    """
    lost = sum(by_count[r - 1] * (r * (1 - ratio[r])) for r in range(1, LARGEST + 1))
    below = np.where(lost > 0, context_count, context_count + 1)
    left = np.where(lost > 0, lost / np.maximum(context_count, 1), 1 / (context_count + 1))
    return below, left / np.maximum(1 - mass, 1e-300)


def _encode(parts: int, kind: str, chunk_tokens: int):
    """Texts to chunk rows ('tok') and, for each part, word rows ('voc')."""

    def emit(numbers, ids, helds, arrays, chunk):
        words = list(numbers)
        order = np.array([len(a) for a in arrays], np.int64)
        tokens = np.concatenate(arrays)
        held = np.array(helds, bool)
        counts = np.bincount(tokens[np.repeat(~held, order)], minlength=len(words))
        part = np.fromiter((xxhash.xxh64_intdigest(w) % parts for w in words), np.int64, len(words))
        by_part = np.argsort(part, kind="stable")
        starts, sizes = _runs(part[by_part])
        rows = [("tok", 0, chunk, ids, pack(held, "u1"), pack_ints(order), pack_ints(tokens), b"")]
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            at = by_part[s : s + n]
            rows.append(("voc", int(part[at[0]]), chunk, None, pack_ints(np.diff(at, prepend=0)), b"", pack_words([words[i] for i in at.tolist()]), pack_ints(counts[at])))
        types = [pa.string(), pa.int32(), pa.int64(), None, pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = ["kind", "part", "chunk", "ids", "held", "sizes", "a", "b"]
        for k in range(0, len(rows), 256):
            columns = list(zip(*rows[k : k + 256], strict=True))
            arrays_ = [pa.array(c, pa.list_(kind) if t is None else t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays_, names=names)

    def over(batches):
        chunk = TaskContext.get().partitionId() << 24
        fresh = lambda: defaultdict(count().__next__)  # noqa: E731 - a word not met before gets the next number
        numbers, ids, helds, arrays, total = fresh(), [], [], [], 0
        for batch in batches:
            for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                words = text.lower().split()
                words.append(END)
                arrays.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(doc)
                helds.append(held)
                total += len(words)
                if total >= chunk_tokens:
                    yield from emit(numbers, ids, helds, arrays, chunk)
                    numbers, ids, helds, arrays, total = fresh(), [], [], [], 0
                    chunk += 1
        if ids:
            yield from emit(numbers, ids, helds, arrays, chunk)

    return over


_REPLY = "kind string, level int, part int, chunk bigint, held binary, a binary, b binary, total bigint, spectrum array<bigint>, distinct bigint"


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    names = [x.split()[0] for x in _REPLY.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _join(blobs: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in blobs)


def _cut(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _count_words(parts: int):
    """A part's words over all chunks: the vocabulary row ('uni') with words and counts."""

    def work(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        part, seen = table.column("part")[0].as_py(), []
        for words, counts in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
            words, counts = unpack_words(words), unpack_ints(counts)
            some = np.flatnonzero(counts)  # words of held-out texts only are no vocabulary
            seen.append((np.fromiter((numbers.setdefault(words[i], len(numbers)) for i in some.tolist()), np.int64, len(some)), counts[some]))
        total = np.zeros(len(numbers), np.int64)
        for at, counts in seen:
            total[at] += counts
        if len(total) * parts + part >= NO_WORD:
            raise OverflowError("word numbers need over 32 bits")
        return _table([("uni", 1, part, -1, b"", pack_words(list(numbers)), pack_ints(total), int(total.sum()), _spectrum(total), len(total))])

    return work


def _answer_words(parts: int):
    """Numbers and counts of each chunk's words, from a part's vocabulary row."""

    def work(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _table([])
        words, counts, part = [], np.zeros(0, np.int64), asked.column("part")[0].as_py()
        if known.num_rows and known.column("distinct")[0].as_py():
            words, counts = unpack_words(known.column("a")[0].as_py()), unpack_ints(known.column("b")[0].as_py())
        numbers, rows = {w: i for i, w in enumerate(words)}, []
        counts = np.append(counts, 0)
        for chunk, local, own in zip(*(asked.column(x).to_pylist() for x in ("chunk", "held", "a")), strict=True):
            at = np.fromiter((numbers.get(w, -1) for w in unpack_words(own)), np.int64)
            rows.append(("ans", 1, part, chunk, local, pack_ints(np.where(at >= 0, at * parts + part + 1, 0)), pack_ints(counts[at]), 0, [], 0))
        return _table(rows)

    return work


@dataclass(frozen=True)
class Totals:
    """What every task needs to know of a model, of fixed size: the words' totals, and discounts by level."""

    order: int
    blocks: int
    frequent: int
    words: Unigrams
    ratios: tuple = ()  # of levels 2, 3, ...

    def ratio(self, level: int) -> np.ndarray:
        return self.words.ratio if level == 1 else self.ratios[level - 2]

    def above(self, level: int) -> float:
        return self.words.above if level == 1 else 1.0


@dataclass
class _Level:
    """A chunk's distinct n-grams of one level: context (a number in the level below) and local word,
    training counts in the chunk, for each token the n-gram that it ends (-1: its context isn't known), and
    the n-gram of the level below that each ends on. Then, from answers: counts in all training texts and
    numbers; and of the contexts what counts are divided by, and backoff weights."""

    context: np.ndarray
    word: np.ndarray
    train: np.ndarray
    where: np.ndarray
    suffix: np.ndarray
    count: np.ndarray | None = None
    gid: np.ndarray | None = None
    below: np.ndarray | None = None
    alpha: np.ndarray | None = None


class _Chunk:
    """A chunk's tokens, with its levels as far as they are answered."""

    def __init__(self, texts: pa.Table, answers: pa.Table, totals: Totals):
        row = {x: texts.column(x)[0].as_py() for x in ("ids", "held", "sizes", "a")}
        self.ids, self.held, self.totals = row["ids"], unpack(row["held"], "u1").astype(bool), totals
        self.tokens, self.sizes = unpack_ints(row["a"]).astype(np.int32), unpack_ints(row["sizes"])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.in_train = np.repeat(~self.held, self.sizes)
        n, none = int(self.tokens.max()) + 1, np.zeros(0, np.int64)
        gid, count = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.given: dict[tuple[int, str], list] = {}
        for kind, level, *rest in zip(*(answers.column(x).to_pylist() for x in ("kind", "level", "part", "held", "a", "b", "total", "spectrum")), strict=True):
            self.given.setdefault((level, kind), []).append(rest)
        for _, local, numbers, counts, *_ in self.given.pop((1, "ans"), []):
            at = np.cumsum(unpack_ints(local))
            gid[at], count[at] = unpack_ints(numbers) - 1, unpack_ints(counts)
        # words in order of their numbers, so that n-grams are sorted by them once and for all
        order, rank = np.argsort(gid, kind="stable"), np.empty(n, np.int32)
        rank[order] = np.arange(n)
        self.tokens, gid, count = rank[self.tokens], gid[order], count[order]
        self.levels = {1: _Level(none, np.arange(n), none, self.tokens, none, count, gid)}

    def build(self, level: int) -> _Level:
        """The distinct n-grams of a level that have a known context."""
        low, width = self.levels[level - 1], len(self.levels[1].count)
        context = np.empty(len(self.tokens), np.int32)
        context[1:] = low.where[:-1]
        context[self.first] = int(self.tokens[-1]) if level == 2 else -1  # a text's first word follows END
        if len(low.count):
            context[(low.count == 0)[context]] = -1
        known = np.flatnonzero(context >= 0)
        keys = context[known].astype(np.int64)
        keys *= width
        keys += self.tokens[known]
        keys, where, first = _number(keys, len(low.count) * width)
        suffix = low.where[known[first]]
        train = np.bincount(where[self.in_train[known]], minlength=len(keys)).astype(np.int32)
        context[known] = where
        above = (keys // width).astype(np.int32)
        keys -= above.astype(np.int64) * width
        self.levels[level] = out = _Level(above, keys.astype(np.int32), train, context, suffix)
        return out

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which n-grams are asked for, sorted by block, context and word; whether each asks for its word too; the blocks.

        Those whose end isn't known in the level below can't be; of a context that only such words
        follow one asks for its weight, with no word."""
        x, low, t = self.levels[level], self.levels[level - 1], self.totals
        full = (low.count > 0)[x.suffix] & (x.suffix >= 0)
        has = np.zeros(len(low.count), bool)
        has[x.context[full]] = True
        alone = np.flatnonzero(~has[x.context])
        pick = full.copy()
        pick[alone[_runs(x.context[alone])[0]]] = True
        at = np.flatnonzero(pick)
        # n-grams are sorted by context and word: contexts move as a whole, frequent ones n-gram by n-gram
        context = x.context[at]
        heads = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(at)] | (low.count > t.frequent)[context])
        sizes, context, lead = np.diff(np.append(heads, len(at))), context[heads], at[heads]
        gid, word = low.gid[context], np.where(full[lead], self.levels[1].gid[x.word[lead]], NO_WORD)
        block = _block(gid, word, low.count[context], t.blocks, t.frequent)
        by = _sort(gid, int(gid.max(initial=0)))[1] if level > 2 else np.arange(len(gid))
        by = by[np.argsort(block[by].astype(np.uint16 if t.blocks < 1 << 16 else np.int64), kind="stable")]
        sizes = sizes[by]
        place = np.repeat(heads[by] - np.cumsum(sizes) + sizes, sizes)
        place += np.arange(len(at))
        at = at[place]
        return at, full[at], np.repeat(block[by], sizes)

    def answer(self, level: int) -> None:
        """Takes in a level's answers: counts and numbers, and the weights of its contexts."""
        x, low, t = self.levels[level], self.levels[level - 1], self.totals
        highest = level == t.order  # whose n-grams are no contexts, so that nothing asks for their numbers
        x.count, x.gid = np.zeros(len(x.train), np.int64), None if highest else np.full(len(x.train), -1, np.int64)
        x.below, x.alpha = backoff(low.count, np.zeros((LARGEST, 1), np.int64), np.zeros(1), t.ratio(level))

        def weigh(contexts: np.ndarray, stats: np.ndarray) -> None:
            # the probability of seen words in the level below, whose context is one word shorter
            lower = sum(stats[LARGEST + r - 1] * (r * t.ratio(level - 1)[r]) for r in range(1, LARGEST + 1)) + stats[-1] * t.above(level - 1)
            divided = max(t.words.tokens, 1) if level == 2 else np.maximum(low.below[low.suffix[contexts]], 1)
            x.below[contexts], x.alpha[contexts] = backoff(low.count[contexts], stats[:LARGEST], lower / divided, t.ratio(level))

        at, _, block = self.asked(level)
        starts, lengths = _runs(block)
        place = {int(block[s]): at[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)}
        # a block's weights at a time: what they are made of takes more room than all else
        for part, counts, numbers, rare, *_ in self.given.pop((level, "ans"), []):
            own = place[part]
            x.count[own] = unpack_ints(counts)
            if not highest:
                x.gid[own[x.count[own] > 0]] = np.cumsum(unpack_ints(numbers)) * t.blocks + part
            contexts = x.context[own][_runs(x.context[own])[0]]
            contexts = contexts[low.count[contexts] <= t.frequent]
            weigh(contexts, unpack_ints(rare).reshape(2 * LARGEST + 1, -1))
        if frequent := self.given.pop((level, "freq"), []):
            local = {int(low.gid[i]): i for i in np.flatnonzero(low.count > t.frequent).tolist()}
            weigh(np.array([local[r[-2]] for r in frequent]), np.array([r[-1] for r in frequent], np.int64).T)

    def log_probabilities(self) -> np.ndarray:
        """log10 of each token's probability: of its longest n-gram if that is seen, else its context's
        backoff weight times the probability in the level below, down to single words. Levels are built and
        answered one after the other, and go when the next one has taken up what it needs of them."""
        t, words = self.totals, self.levels[1]
        out = np.log10(t.words.prob(words.count))[self.tokens]
        for level in range(2, t.order + 1):
            x = self.build(level)
            self.answer(level)
            seen = x.count > 0
            ratio = np.where(x.count <= LARGEST, t.ratio(level)[np.minimum(x.count, LARGEST)], 1.0)
            with np.errstate(divide="ignore"):
                own = np.where(seen, np.log10(np.where(seen, x.count, 1) * ratio / x.below[x.context]), np.log10(x.alpha)[x.context])
            del ratio
            own, seen = np.append(own, 0.0), np.append(seen, False)  # the last stands for a context that isn't known
            for s in range(0, len(out), 1 << 18):
                cut = slice(s, s + (1 << 18))
                where = x.where[cut]
                out[cut] = own[where] + np.where(seen[where], 0.0, out[cut])
            if level > 2:
                del self.levels[level - 1]
        return out


def _ask(level: int, shared):
    """A chunk's distinct n-grams of a level ('ask'), to their blocks."""

    def work(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([])
        c, chunk, rows = _Chunk(texts, answers, shared.value), texts.column("chunk")[0].as_py(), []
        for k in range(2, level):
            c.build(k)
            c.answer(k)
        x, low = c.build(level), c.levels[level - 1]
        at, full, block = c.asked(level)
        word = np.where(full, c.levels[1].gid[x.word[at]], NO_WORD)
        lower = np.where(full, low.count[x.suffix[at]], 0)
        starts, lengths = _runs(block)
        for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            own = at[s : s + n]
            heads, runs = _runs(x.context[own])
            context = x.context[own][heads]
            # contexts: numbers, how many n-grams, whether frequent; words: numbers, counts here, and of the level below
            a = [np.diff(low.gid[context], prepend=0), runs, low.count[context] > c.totals.frequent]
            b = [word[s : s + n], x.train[own], lower[s : s + n]]
            rows.append(("ask", level, int(block[s]), chunk, b"", _join(list(map(pack_ints, a))), _join(list(map(pack_ints, b))), n, [], 0))
        return _table(rows)

    return work


class _Keys:
    """Asked or known n-grams of a block by context number and word."""

    def __init__(self, a: bytes, b: bytes):
        first, self.runs, *more = map(unpack_ints, _cut(a))
        self.first = np.cumsum(first)
        self.frequent = more[0].astype(bool) if more else None
        self.word, self.count, self.lower = map(unpack_ints, _cut(b))


def _reply(level: int, highest: bool, block: int, chunk: int, q: _Keys, own: np.ndarray, at: np.ndarray, rare: np.ndarray) -> list[tuple]:
    """Answers of a block to a chunk ('ans'): counts, places in the block's table, and what the weights of
    contexts are made of; of frequent contexts which the chunk asks for ('want')."""
    numbers = at[:0] if highest else np.diff(at[own > 0], prepend=0)
    rows = [("ans", level, block, chunk, pack_ints(own), pack_ints(numbers), pack_ints(rare.reshape(-1)), 0, [], 0)]
    return rows + [("want", level, block, chunk, b"", b"", b"", int(x), [], 0) for x in q.first[q.frequent].tolist()]


def _count_grams(level: int, answers: bool = False, highest: bool = False):
    """A block's n-grams over all chunks: a row of the level's table ('gram') with contexts, words and counts,
    and of frequent contexts, which have n-grams in many blocks, what is here of their weights ('freq'). With
    answers, what _answer_grams() says as well, so that questions are shuffled, read and sorted once."""

    def work(table: pa.Table) -> pa.Table:
        block, asked = table.column("part")[0].as_py(), [_Keys(a, b) for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True)]
        lengths = [len(k.word) for k in asked]
        every = lambda name: np.concatenate([k.__dict__.pop(name) for k in asked])  # noqa: E731 - kept once, not twice
        first, word = np.concatenate([k.first for k in asked]), every("word")
        contexts, of, _ = _number(first, int(first.max()))
        bits = (int(word.max(initial=0, where=word != NO_WORD)) + 1).bit_length()  # no word is the largest, in fewer bits too
        keys = np.repeat(of, every("runs")).astype(np.int64) << bits | word & ((1 << bits) - 1)
        del first, word
        keys, which, head = _number(keys, len(contexts) << bits)
        counts = np.bincount(which, every("count"), len(keys)).astype(np.int64)
        lower = every("lower")[head]
        at = np.flatnonzero(counts)
        keys, seen, lower = keys[at], counts[at], lower[at]
        del head, at
        context = keys >> bits
        heads, runs = _runs(context)
        a = [np.diff(contexts[context[heads]], prepend=0), runs]
        b = [keys & ((1 << bits) - 1), seen, lower]
        rows = [("gram", level, block, -1, b"", _join(list(map(pack_ints, a))), _join(list(map(pack_ints, b))), int(seen.sum()), _spectrum(seen), len(keys))]
        del a, b, keys
        large = np.unique(np.concatenate([k.first[k.frequent] for k in asked]))
        stats = _statistics(context, seen, lower, len(contexts)) if answers or len(large) else None
        rows += [("freq", level, block, -1, b"", b"", b"", g, stats[:, j].tolist(), 0) for g, j in zip(large.tolist(), np.searchsorted(contexts, large).tolist(), strict=True)]
        del context, seen, lower
        if answers:
            place, n, m = np.cumsum(counts > 0) - 1, 0, 0
            for chunk, k, length in zip(table.column("chunk").to_pylist(), asked, lengths, strict=True):
                mine, own = which[n : n + length], of[m : m + len(k.first)]
                rows += _reply(level, highest, block, chunk, k, counts[mine], place[mine], stats[:, own[~k.frequent]])
                n, m = n + length, m + len(k.first)
        return _table(rows)

    return work


def _answer_grams(level: int, highest: bool):
    """Answers of a block of the level's table to each chunk."""

    def work(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _table([])
        block, rows = asked.column("part")[0].as_py(), []
        k = _Keys(known.column("a")[0].as_py(), known.column("b")[0].as_py()) if known.num_rows and known.column("distinct")[0].as_py() else None
        contexts = k.first if k else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(contexts)), k.runs) if k else contexts
        keys = of << 32 | k.word if k else contexts
        counts = np.append(k.count if k else contexts, 0)
        none = np.zeros((2 * LARGEST + 1, 1), np.int64)
        stats = np.concatenate([_statistics(of, counts[:-1], k.lower, len(contexts)), none], 1) if k else none

        def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
            if not len(table):
                return np.full(len(values), -1)
            at = np.minimum(np.searchsorted(table, values), len(table) - 1)
            return np.where(table[at] == values, at, -1)

        for chunk, a, b in zip(*(asked.column(x).to_pylist() for x in ("chunk", "a", "b")), strict=True):
            q = _Keys(a, b)
            context = find(contexts, q.first)
            at = find(keys, np.repeat(context, q.runs) << 32 | q.word)  # an unknown context is negative and finds none
            rows += _reply(level, highest, block, chunk, q, counts[at], at, stats[:, context[~q.frequent]])
        return _table(rows)

    return work


def _evaluate(shared, kind: pa.DataType):
    """Scores of a chunk's texts."""

    def work(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in (kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        c, t = _Chunk(texts, answers, shared.value), shared.value
        logs, count = c.log_probabilities(), c.levels[1].count
        base = np.log10((count + 0.5) / (t.words.tokens + 0.5 * (t.words.distinct + 1)))
        add = lambda x: np.add.reduceat(x, c.first)
        return pa.table([pa.array(c.ids, kind), pa.array(c.held), pa.array(c.sizes, pa.int64()), pa.array(add((count[c.tokens] > 0).astype(np.int64))), pa.array(add(base[c.tokens])), pa.array(add(logs))], names=names)

    return work


@dataclass
class KatzModel:
    """A trained model: the table of words (a row for each part) and one of n-grams for each level from two
    on (a row for each block), in the shared folder, with totals of fixed size."""

    totals: Totals
    parts: int
    words: DataFrame
    grams: list[DataFrame]


def _spectrum_of(rows: DataFrame) -> list[int]:
    row = rows.agg(F.sum("total"), F.sum("distinct"), *(F.sum(F.get("spectrum", F.lit(r))) for r in range(LARGEST + 2))).first()
    return [int(x or 0) for x in row]


def _run(docs: DataFrame, model: KatzModel | None, scores: bool, id_col: str, text_col: str, held: Column, order: int, chunk_tokens: int, frequent: int):
    """Trains a model (if none is given) and scores docs, level by level."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    arrow_kind = to_arrow_type(docs.schema[id_col].dataType)
    train, grams = model is None, [] if model is None else model.grams
    text = F.col(text_col).cast("string")
    parts = max(8, math.ceil((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / PART_BYTES)) if train else model.parts
    read = docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), text.alias("text"))
    chunks = materialise(read.mapInArrow(_encode(parts, arrow_kind, chunk_tokens), _PARTS.format(kind)), "chunks", ["kind"])
    texts = chunks.where("kind = 'tok'").select("chunk", "ids", "held", "sizes", "a")
    asked = chunks.where("kind = 'voc'").select("part", "chunk", "held", "a", "b")
    if train:
        words = materialise(asked.groupBy("part").applyInArrow(_count_words(parts), _REPLY), "words")
        tokens, distinct, *spectrum = _spectrum_of(words)
        totals = Totals(order, max(parts, math.ceil(tokens / BLOCK_TOKENS)), frequent, unigrams(spectrum, tokens, distinct))
    else:
        words, totals = model.words, model.totals
    given = ["kind", "level", "part", "chunk", "held", "a", "b", "total", "spectrum"]
    answers = [materialise(asked.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(_answer_words(parts), _REPLY).select(*given), "answers-1")]
    discard(chunks, "kind=voc")
    share = spark.sparkContext.broadcast
    every = lambda: reduce(DataFrame.unionByName, answers)
    for level in range(2, totals.order + 1):
        asking = texts.groupBy("chunk").cogroup(every().groupBy("chunk")).applyInArrow(_ask(level, share(totals)), _REPLY)
        asking = asking.select("part", "chunk", "a", "b", F.pmod("part", F.lit(SLICES)).alias("slice"))
        asking = materialise(asking, f"asked-{level}", ["slice"])
        highest, counted, replied = level == totals.order, [], []
        for k in range(SLICES):
            asks = asking.where(F.col("slice") == k).drop("slice").groupBy("part")
            if train:
                count_ = _count_grams(level, scores or not highest, highest)
                counted.append(materialise(asks.applyInArrow(count_, _REPLY), f"grams-{level}", ["kind"]))
                replied.append(counted[-1])
            else:
                known = grams[level - 2].where(F.pmod("part", F.lit(SLICES)) == k)
                answered = asks.cogroup(known.where("kind = 'gram'").groupBy("part")).applyInArrow(_answer_grams(level, highest), _REPLY)
                replied.append(materialise(answered.select(*given), f"replies-{level}", ["kind"]))
            discard(asking, f"slice={k}")
        if train:
            grams.append(reduce(DataFrame.unionByName, counted))
            totals = replace(totals, ratios=(*totals.ratios, discounts(_spectrum_of(grams[-1].where("kind = 'gram'"))[2:])))
        if highest and not scores:
            break
        replies = reduce(DataFrame.unionByName, [r.select(*given) for r in replied])
        # of frequent contexts the parts of all blocks, to each chunk that asks
        sums = F.array(*(F.sum(F.get("spectrum", F.lit(r))) for r in range(2 * LARGEST + 1)))
        freq = grams[level - 2].where("kind = 'freq'").groupBy("total").agg(sums.alias("spectrum"))
        want = replies.where("kind = 'want'").select("chunk", "total").distinct().join(freq, "total", "left")
        none = [F.array(*[F.lit(0).cast("long")] * (2 * LARGEST + 1)), F.lit(None).cast("binary")]
        want = want.select(F.lit("freq").alias("kind"), F.lit(level).alias("level"), F.lit(0).alias("part"), "chunk", *(none[1].alias(x) for x in ("held", "a", "b")), "total", F.coalesce("spectrum", none[0]).alias("spectrum"))
        answers.append(replies.where("kind = 'ans'").select(*given).unionByName(want))
    model = KatzModel(totals, parts, words, grams)
    if not scores:
        return model, None
    own = F.pmod(F.xxhash64("chunk"), F.lit(SLICES))
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    parts_ = [texts.where(own == k).groupBy("chunk").cogroup(every().where(own == k).groupBy("chunk")).applyInArrow(_evaluate(share(totals), arrow_kind), schema) for k in range(SLICES)]
    scored = reduce(DataFrame.unionByName, [materialise(x, "scores") for x in parts_])
    return model, scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _held(id_col: str, folds: int, held_fold: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held_fold


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, chunk_tokens: int = CHUNK_TOKENS, frequent: int = FREQUENT) -> KatzModel:
    """A model of all texts of docs, in tables of the shared folder."""
    return _run(docs, None, False, id_col, text_col, F.lit(False), order, chunk_tokens, frequent)[0]


def score(docs: DataFrame, model: KatzModel, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Scores of texts under a trained model, whose tables are read back; columns as score_texts() has them,
    held_out being true."""
    return _run(docs, model, True, id_col, text_col, F.lit(True), model.totals.order, chunk_tokens, model.totals.frequent)[1]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, order: int = 3, chunk_tokens: int = CHUNK_TOKENS, frequent: int = FREQUENT) -> DataFrame:
    """Learn from all texts outside the held-out fold and score every whole text.

    The model: words with Good-Turing discounts over the training tokens, the freed mass being the class
    of unknown words; n-grams up to `order` with Good-Turing discounts by level; for an n-gram not seen in
    training, its context's backoff weight times the probability one level below (weight 1 after a
    context not seen). Weights make each context's probabilities add up to one exactly. An n-gram
    reaches back to the END before a text's first word and not beyond. Each level's table is written to
    the shared folder and read back for the answers; what a weight is made of is kept as whole numbers,
    so tables hold no rounded weights. Tables in between go when they are used up; those of the model and
    the answers that the result is computed from stay until the shared folder is cleared.

    A row is in fold crc32(id as text) mod folds; a null id reads as empty. Null and empty texts are
    their end token alone. Repeated rows count and are scored each. An empty table gives no rows, and
    with no training rows all scores are 0. Other columns are ignored. Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.
    """
    return _run(docs, None, True, id_col, text_col, _held(id_col, folds, held_fold), order, chunk_tokens, frequent)[1]
