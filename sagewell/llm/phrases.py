"""Phrase collocations: position bitmaps of words in shards, phrases extended by shift, AND and popcount."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, raw

#: What ends a piece and what stands between words; letters A-Z become small (bytes of UTF-8).
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_TABLE = bytes(10 if b in ENDS else 32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text of a shard, and words and ends of pieces in it.
SHARD_BYTES, SHARD_WORDS = 8 << 20, 1 << 20
#: Bytes of a text that are split at once.
PART_BYTES = 2 << 20
#: Rows whose texts are Python objects at once.
ROWS_AT_ONCE = 256
#: Positions of a bitmap's word.
BITS = 16
#: Bitmap words of prefixes that are extended at once.
AT_ONCE = 1 << 15
#: Bits for each frequent pair in the filter, and bits that the filter may have at most.
BITS_A_PAIR, MOST_BITS = 16, 1 << 28
#: Parts of a language's candidates that are ranked before they meet.
RANK_PARTS = 64


class Numbers(dict):
    """Numbers words in the order they are met; ends of pieces are -1, what stands between two blanks -2."""

    def __init__(self):
        super().__init__({b"\n": -1, b"": -2})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 2
        return number

    def words(self) -> list[bytes]:
        return list(self)[2:]


class Bitmaps:
    """Positions of every word of a shard as compressed bitmaps: only bitmap words with a bit set are kept,
    sorted by word, and once more by place. Ends of pieces take a position that no word has."""

    def __init__(self, ids: np.ndarray, n_words: int):
        at = np.flatnonzero(ids >= 0).astype(np.int32)
        at = at[np.argsort(ids[at], kind="stable")]
        key = ids[at].astype(np.int64) << 32 | at // BITS
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else at
        bit = np.left_shift(np.uint16(1), (at % BITS).astype(np.uint16))
        self.mask = np.bitwise_or.reduceat(bit, first) if len(key) else bit
        self.word, self.place = (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32)
        self.n_words = n_words
        by_place = np.argsort(self.place, kind="stable")
        self.word_there, self.mask_there = self.word[by_place], self.mask[by_place]
        self.starts = np.append(0, np.cumsum(np.bincount(self.place, minlength=len(ids) // BITS + 2)))

    def counts(self) -> np.ndarray:
        """Popcounts of all words' bitmaps."""
        return np.bincount(self.word, np.bitwise_count(self.mask), self.n_words).astype(np.int64)

    def follow(self, prefix: np.ndarray, place: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shift the prefixes' bitmaps by a position and AND them with those of the words that are there.

        Returns the extended bitmaps in order of phrase (phrase, place, mask) and, for each phrase, its prefix,
        its last word and its popcount."""
        prefix, place = np.concatenate([prefix, prefix]), np.concatenate([place, place + 1])
        mask = np.concatenate([mask << 1, mask >> (BITS - 1)])
        some = np.flatnonzero(mask)
        prefix, place, mask = prefix[some], place[some], mask[some]
        many = self.starts[place + 1] - self.starts[place]
        left = np.repeat(np.arange(len(place), dtype=np.int32), many)
        right = np.arange(len(left)) + np.repeat(self.starts[place] - np.cumsum(many) + many, many)
        both = mask[left] & self.mask_there[right]
        hit = np.flatnonzero(both)
        left, right, both = left[hit], right[hit], both[hit]
        key = prefix[left].astype(np.int64) * self.n_words + self.word_there[right]
        order = np.argsort(key, kind="stable")
        key, both, place = key[order], both[order], place[left[order]]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        count = np.add.reduceat(np.bitwise_count(both).astype(np.int64), first) if len(first) else first
        return np.cumsum(new) - 1, place, both, key[first] // self.n_words, (key[first] % self.n_words).astype(np.int32), count

    def batches(self) -> Iterator[slice]:
        """Whole words' bitmaps, about AT_ONCE bitmap words at a time."""
        at = 0
        while at < len(self.word):
            end = int(np.searchsorted(self.word, self.word[min(at + AT_ONCE, len(self.word)) - 1], "right"))
            yield slice(at, end)
            at = end


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words, numbers at positions) of the texts of a task, about SHARD_BYTES at a time.

    A shard ends between texts, or within a long text where a piece ends; a piece is never cut."""
    held: dict = {}
    size = words = 0
    for b in (x.slice(s, ROWS_AT_ONCE) for x in batches for s in range(0, x.num_rows, ROWS_AT_ONCE)):
        for lang, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
            at, text = 0, text.translate(_TABLE)
            while at < len(text):
                end = text.find(b"\n", at + PART_BYTES) + 1 or len(text)
                numbers, parts = held.setdefault(lang, (Numbers(), []))
                ids = np.fromiter(map(numbers.__getitem__, text[at:end].replace(b"\n", b" \n ").split(b" ")), np.int32)
                parts.append(np.append(ids[ids > -2], np.int32(-1)))
                size, words, at = size + end - at, words + len(parts[-1]), end
                if size >= SHARD_BYTES or words >= SHARD_WORDS:
                    full, held, size, words = held, {}, 0, 0
                    yield from _shards(full)
    yield from _shards(held)


def _shards(held: dict) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    while held:
        lang, (numbers, parts) = held.popitem()
        ids = np.concatenate(parts)
        parts.clear()
        yield lang, numbers.words(), ids


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads numbers of 64 bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def pair_hashes(left: np.ndarray, right: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of word pairs of a language from hashes of their words."""
    return _mix(_mix(left + np.uint64(xxhash.xxh64_intdigest(lang.encode()))) + right)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class PairFilter:
    """A filter of bounded size that knows every frequent pair; it may take rare pairs for frequent ones, which
    costs work but changes no count."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray):
        self.bits, self.table = bits, np.zeros(bits // 64, np.uint64)
        self.table[slots] = values

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [hashes & np.uint64(bits - 1), hashes >> np.uint64(64 - bits.bit_length() + 1)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in self.places(hashes, self.bits):
            found &= (self.table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    @classmethod
    def of(cls, pairs: DataFrame) -> PairFilter:
        """From rows (lang, phrase); bits are set on the cluster, and the filter's words come to the driver."""
        bits = 1 << 10
        while bits < min(MOST_BITS, BITS_A_PAIR * pairs.count()):
            bits *= 2

        def hashed(batches):
            for b in batches:
                two = [p.split(b" ") for p in raw(b.column(1))]
                left, right = word_hashes([x for x, _ in two]), word_hashes([x for _, x in two])
                langs = b.column(0).to_pylist()
                for lang in set(langs):
                    own = np.array([x == lang for x in langs])
                    p = np.concatenate(cls.places(pair_hashes(left[own], right[own], lang), bits))
                    yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["slot", "bit"])

        rows = pairs.select("lang", "phrase").mapInArrow(hashed, "slot bigint, bit bigint").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
        return cls(bits, rows.column("slot").to_numpy(), rows.column("bits").to_numpy().view(np.uint64))


def _rows(lang: str, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(counts), AT_ONCE):
        n = counts[at : at + AT_ONCE]
        phrase = [words.take(pa.array(c[at : at + AT_ONCE])) for c in columns]
        joined = pc.binary_join_element_wise(*phrase, b" ") if len(phrase) > 1 else phrase[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), joined.cast(pa.string()), pa.array(n)], names=["lang", "phrase", "f"])


COUNTED = "lang string, phrase string, f bigint"


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Popcounts of a task's words and pairs; the empty phrase counts all words."""
    for lang, words, ids in shards(batches):
        maps, spelled = Bitmaps(ids, len(words)), pa.array(words, pa.binary())
        counts = maps.counts()
        yield from _rows(lang, pa.array([b""]), [np.zeros(1, np.int32)], counts.sum(keepdims=True))
        yield from _rows(lang, spelled, [np.arange(len(words), dtype=np.int32)], counts)
        for s in maps.batches():
            *_, left, right, count = maps.follow(maps.word[s], maps.place[s], maps.mask[s])
            yield from _rows(lang, spelled, [left.astype(np.int32), right], count)


def _count_longer(shared, longest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Popcounts of a task's phrases of three words and more whose pairs the filter knows, depth first:
        the bitmaps of a batch of prefixes are extended to the longest phrases before the next batch."""
        for lang, words, ids in shards(batches):
            maps, spelled, hashes = Bitmaps(ids, len(words)), pa.array(words, pa.binary()), word_hashes(words)

            def extend(columns: list[np.ndarray], phrase, place, mask, lang=lang, maps=maps, spelled=spelled, hashes=hashes):
                phrase, place, mask, prefix, last, count = maps.follow(phrase, place, mask)
                known = shared.value.holds(pair_hashes(hashes[columns[-1][prefix]], hashes[last], lang))
                number = np.cumsum(known) - 1
                kept = known[phrase]
                phrase, place, mask = number[phrase[kept]], place[kept], mask[kept]
                columns = [c[prefix[known]] for c in columns] + [last[known]]
                if len(columns) > 2:
                    yield from _rows(lang, spelled, columns, count[known])
                if len(columns) < longest and len(phrase):
                    yield from extend(columns, phrase, place, mask)

            every = np.arange(len(words), dtype=np.int32)
            for s in maps.batches():
                yield from extend([every], maps.word[s], maps.place[s], maps.mask[s])

    return work


def count_phrases(docs: DataFrame, longest: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Exact counts of frequent phrases per language: lang, phrase (words joined by a space), f, for phrases of
    up to `longest` words that occur min_count times or more, and all words of a language as the empty phrase.

    Each task turns its texts into shards of position bitmaps; popcounts of equal phrases are summed over
    shards. Longer phrases are only looked for where their pairs are frequent."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = lambda df: df.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    short = materialise(total(rows.mapInArrow(_count_pairs, COUNTED)).where((F.col("f") >= min_count) | (F.col("phrase") == "")), "phrases")
    if longest < 3:
        return short
    shared = docs.sparkSession.sparkContext.broadcast(PairFilter.of(short.where(F.contains("phrase", F.lit(" ")))))
    longer = materialise(total(rows.mapInArrow(_count_longer(shared, longest), COUNTED)).where(F.col("f") >= min_count), "long-phrases")
    return short.unionByName(longer)


def collocations(docs: DataFrame, longest: int = 3, min_count: int = 10, top: int = 2000, covered: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A language is what lang_col says, `und` where it is null; texts in small letters A-Z are split into pieces at
    .,;:!? and line ends, and pieces into words at blanks and tabs. Candidates have 2 to `longest` words and occur
    a >= min_count times. Of a candidate's cuts, into parts that occur l and r times, the one of smallest score
    floor(1000000 * a * a / (l * r)) counts, of equal ones the one with the shortest first part. A candidate that
    stands inside a longer one with at least `covered` per cent of its occurrences is dropped. n counts the
    language's words. Null and empty texts have no words; repeated rows count as often as they are there; an
    empty table gives no rows; other columns are ignored.
    """
    counted = count_phrases(docs, longest, min_count, text_col, lang_col)
    words = F.split("phrase", " ")
    size = F.size(words)
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    candidates = counted.where(F.contains("phrase", F.lit(" ")))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, size).alias("right"))
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counted.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0))) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda s: part(s, k))))
    inside = candidates.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    rows = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a large language is ranked in parts first, so that the last step takes a bounded number of rows
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return rows.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
