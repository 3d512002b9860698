"""Byte-level BPE by speculation: greedy tokens, pair checks, exact merging for words that fail."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw

#: The pre-tokeniser's pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, pairs and tokens kept in a worker's memos; each is emptied when it grows beyond this.
MEMO_WORDS = 500_000
#: Rank of a pair that never merges.
NO_RANK = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and added tokens of a byte-level BPE file; picklable for a broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["model"]["type"] != "BPE" or file.get("normalizer"):
            raise ValueError("only byte-level BPE without a normaliser is supported")
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens with flags are not supported")
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        pairs = [tuple(bytes(letters[c] for c in x) for x in m) for m in merges]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pieces = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}


class Codec:
    """Encodes and decodes texts; keeps memos of words, pairs and tokens already checked."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reach: dict[bytes, int] = {}  # the longest token that begins with these three bytes
        for t in vocabulary.ids:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 2))
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.single: dict[int, bool] = {}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None
        self.exact_words = self.spoken_words = 0
        self.byte_ids = np.array([vocabulary.ids[bytes([b])] for b in range(256)], np.int64)
        keys = np.array([a << 32 | b for a, b in vocabulary.merges], np.int64)
        self.keys, self.key_ranks = np.sort(keys), np.argsort(keys)  # merges stand in the order of their ranks
        self.merged = np.array([to for _, to in vocabulary.merges.values()], np.int64)

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, lowest first, leftmost first: a heap over a linked list."""
        ids, merges = [self.v.ids[word[i : i + 1]] for i in range(len(word))], self.v.merges
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merges[a, b][1], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < len(ids) and (m := merges.get((ids[x], ids[after[x]]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[after[x]]))
        return [x for x in ids if x >= 0]

    def exact_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """exact() of many short words at once: each round merges the best pair of every word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        for k, w in enumerate(words):
            if len(w) > 64:
                out[k] = tuple(self.exact(w))
        of = np.array([k for k, w in enumerate(words) if len(w) <= 64], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words[k] for k in of.tolist()), np.uint8)]
        of = np.repeat(of, [len(words[k]) for k in of.tolist()])
        rank = np.append(np.where(of[:-1] == of[1:], self.ranks(ids[:-1], ids[1:]), NO_RANK), NO_RANK) if len(ids) else ids
        while len(ids):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            sizes = np.diff(np.append(starts, len(of)))
            best = np.minimum.reduceat(rank, starts)
            ended = best == NO_RANK
            if ended.any():
                for i, n in zip(starts[ended].tolist(), sizes[ended].tolist(), strict=True):
                    out[of[i]] = tuple(ids[i : i + n].tolist())
                going = np.repeat(~ended, sizes)
                ids, of, rank, best, sizes = ids[going], of[going], rank[going], best[~ended], sizes[~ended]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.append(True, of[hits[1:]] != of[hits[:-1]])]
            ids[hits] = self.merged[rank[hits]]
            rest = np.ones(len(ids), bool)
            rest[hits + 1] = False
            rank[hits] = NO_RANK
            ids, of, rank = ids[rest], of[rest], rank[rest]
            hits -= np.arange(len(hits))
            for at in (hits[hits > 0] - 1, hits[hits < len(ids) - 1]):
                rank[at] = np.where(of[at] == of[at + 1], self.ranks(ids[at], ids[at + 1]), NO_RANK)
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], NO_RANK)

    def greedy(self, word: bytes) -> list[int]:
        out, i, ids, reach, end = [], 0, self.v.ids, self.reach, len(word)
        while i < end:
            for j in range(min(end, i + reach.get(word[i : i + 3], 2)), i, -1):
                if (t := ids.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def _hold(self, memo: dict, keys: list, pieces: list[bytes], want: list[tuple[int, ...]]) -> np.ndarray:
        new = [i for i, k in enumerate(keys) if k not in memo]
        for i, got in zip(new, self.exact_many([pieces[i] for i in new]), strict=True):
            memo[keys[i]] = got == want[i]
        return np.fromiter(map(memo.__getitem__, keys), bool, len(keys))

    def learn(self, words: list[str]) -> None:
        """Speculate on new words, verify all adjacent pairs at once, merge exactly what fails."""
        spoken = [w.encode("utf-8", "surrogatepass") for w in words]
        guess = [self.greedy(w) for w in spoken]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        tokens, where = np.unique(flat, return_inverse=True)
        alone = tokens.tolist()
        fine = self._hold(self.single, alone, [self.v.pieces[t] for t in alone], [(t,) for t in alone])[where]
        keys, where = np.unique(flat[:-1] << 32 | flat[1:], return_inverse=True)
        inner = np.ones(len(flat), bool)
        inner[starts] = False  # a pair across two words is no pair
        used = np.zeros(len(keys), bool)
        used[where[inner[1:]]] = True
        agree = np.ones(len(keys), bool)
        both = [(k >> 32, k & 0xFFFFFFFF) for k in keys[used].tolist()]
        agree[used] = self._hold(self.pairs, both, [self.v.pieces[a] + self.v.pieces[b] for a, b in both], both)
        fine[1:] &= agree[where] | ~inner[1:]
        good = np.logical_and.reduceat(fine, starts)
        failed = np.flatnonzero(~good).tolist()
        for i, ids in zip(failed, self.exact_many([spoken[i] for i in failed]), strict=True):
            guess[i] = ids
        for w, g in zip(words, guess, strict=True):
            self.words[w] = np.asarray(g, "<u4").tobytes()
        self.exact_words += len(failed)
        self.spoken_words += len(words)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for memo in (self.words, self.pairs, self.single):
            if len(memo) > MEMO_WORDS:
                memo.clear()
        cut = []
        for t in texts:
            parts = self.cut.split(t) if self.cut and any(a in t for a in self.v.added) else [t]
            cut.append([self.find(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        new = {w for parts in cut for p in parts[::2] for w in p if w not in self.words}
        if new:
            self.learn(list(new))
        get = self.words.__getitem__
        return [b"".join(b"".join(map(get, p)) if i % 2 == 0 else self.v.added[p].to_bytes(4, "little") for i, p in enumerate(parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """A worker's codec outlives its tasks, so that its memos do; it holds one vocabulary."""
    if id(shared.value) not in _codecs:
        _codecs.clear()
        _codecs[id(shared.value)] = Codec(shared.value)
    return _codecs[id(shared.value)]


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False, batch_chars: int = 2_000_000) -> DataFrame:
    """Encode every text and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256, exact.

    exact tells whether decoding gave the text back. keep_ids adds ids (array of long), keep_text
    adds decoded. The vocabulary (of fixed size) is read on the driver and broadcast. Null and empty
    texts have no tokens; repeated rows give repeated rows; an empty table gives no rows; other
    columns are ignored. Texts are worked through in groups of batch_chars characters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def work(batch: pa.RecordBatch):
        codec, texts, at = _codec(shared), raw(batch.column(1)), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= batch_chars):
                chars += len(texts[end])
                end += 1
            part = [t.decode("utf-8", "replace") for t in texts[at:end]]
            ids = codec.encode_batch(part)
            back = [codec.decode(x) for x in ids]
            out = [
                batch.column(0).slice(at, end - at),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                pa.array([x == y for x, y in zip(part, back, strict=True)]),
            ]
            out += [pa.array([np.frombuffer(x, "<u4").astype("i8") for x in ids], pa.list_(pa.int64()))] * keep_ids + [pa.array(back)] * keep_text
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"] + ["ids"] * keep_ids + ["decoded"] * keep_text)
            at = end

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<bigint>" * keep_ids + ", decoded string" * keep_text
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, schema)
