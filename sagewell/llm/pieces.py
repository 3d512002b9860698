"""Merge-type piece vocabularies: an agenda of adjacent symbol pairs in order of score, checked by the library."""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw

#: What stands for a space in pieces (a fixed value).
SPACE = "▁"
#: Bytes of words and ids that a worker's memo holds; it is emptied when it grows beyond this.
MEMO_BYTES = 192 << 20
#: Words of more characters are merged anew each time they occur.
MEMO_CHARS = 64
#: About what a memo's entry takes besides its characters and ids.
ENTRY_BYTES = 300
#: Rank of a pair that is no piece.
NO_RANK = 1 << 40


class Agenda:
    """Pieces and scores of a merge-type vocabulary, and the merging of words by score.

    Symbols are numbered: pieces by their ids, letters that are no piece but occur in some behind them. Two
    adjacent symbols are on the agenda if their letters together are a piece, however that piece came about.
    """

    def __init__(self, library):
        size = len(library)
        pieces = [library.id_to_piece(i) for i in range(size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(size)]
        self.size, self.unknown = size, library.unk_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if library.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        letters = sorted({c for p in self.ids for c in p} - self.ids.keys())
        symbols = self.ids | {c: size + i for i, c in enumerate(letters)}
        self.score = {i: -library.get_score(i) for i in self.ids.values()}
        rank = {s: i for i, s in enumerate(sorted(set(self.score.values())))}  # equal scores have equal ranks
        splits = {symbols[p[:k]] << 32 | symbols[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.keys = np.array(sorted(splits), np.int64)
        self.merged = np.array([splits[k] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([rank[self.score[i]] for i in self.merged.tolist()], np.int64)
        self.letter = np.full(1 << 21, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.letter[ord(s)] = i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair on the agenda, NO_RANK if it is on none, and its place among the keys."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK), np.zeros(len(left), np.int64)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0), self.ranks[at], NO_RANK), at

    def _spell(self, symbol: int, letter: int) -> list[int]:
        """Ids of a symbol: its own, or for a letter that is no piece those of its bytes, or the unknown id."""
        if 0 <= symbol < self.size:
            return [symbol]
        return [self.bytes[b] for b in chr(letter).encode()] if self.bytes else [self.unknown]

    def _spelled(self, symbols: list[int], letters: list[int]) -> list[int]:
        if min(symbols) >= 0 and max(symbols) < self.size:
            return symbols
        ids = [i for s, c in zip(symbols, letters, strict=True) for i in self._spell(s, c)]
        return ids if self.bytes else [x for k, x in enumerate(ids) if k == 0 or x != self.unknown or ids[k - 1] != x]

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Ids of short words, all at once: each round takes the entry of best score, the leftmost of equal ones,
        from the agenda of every word that has one left, and puts the new symbol's two pairs on it."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        of = np.repeat(np.arange(len(words)), sizes)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.letter[letters]
        rank, place = np.full(len(of), NO_RANK), np.zeros(len(of), np.int64)
        inner = np.flatnonzero(of[:-1] == of[1:])
        rank[inner], place[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        while len(of):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            sizes = np.diff(np.append(starts, len(of)))
            best = np.minimum.reduceat(rank, starts)
            ended = best == NO_RANK
            if ended.any():
                for w, i, n in zip(of[starts[ended]].tolist(), starts[ended].tolist(), sizes[ended].tolist(), strict=True):
                    out[w] = self._spelled(symbols[i : i + n].tolist(), letters[i : i + n].tolist())
                going = np.repeat(~ended, sizes)
                of, symbols, letters, rank, place = of[going], symbols[going], letters[going], rank[going], place[going]
                best, sizes = best[~ended], sizes[~ended]
                if not len(of):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.append(True, of[hits[1:]] != of[hits[:-1]])]
            symbols[hits] = self.merged[place[hits]]
            rank[hits] = rank[hits + 1]
            rest = np.ones(len(of), bool)
            rest[hits + 1] = False
            of, symbols, letters, rank, place = of[rest], symbols[rest], letters[rest], rank[rest], place[rest]
            hits -= np.arange(len(hits))
            rank[hits] = NO_RANK
            for at in (hits[hits > 0] - 1, hits[hits < len(of) - 1]):
                at = at[of[at] == of[at + 1]]
                rank[at], place[at] = self._pairs(symbols[at], symbols[at + 1])
        return out

    def merge(self, word: str) -> list[int]:
        """The same for one word of any length: the agenda is a heap.

        An entry is known by its place and its length: when either symbol has changed since it was put on the
        agenda, the lengths differ and it is passed over."""
        ids, score, symbols = self.ids, self.score, list(word)
        end = len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        agenda = [(score[m], i, len(pair)) for i in range(end - 1) if (m := ids.get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if j >= end or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j], after[i] = "", after[j]
            if after[i] < end:
                before[after[i]] = i
            for x, y in ((i, after[i]), (before[i], i)):
                if x >= 0 and y < end and (m := ids.get(pair := symbols[x] + symbols[y])) is not None:
                    heapq.heappush(agenda, (score[m], x, len(pair)))
        left = [s for s in symbols if s]
        return self._spelled([ids.get(s, -1) for s in left], [ord(s[0]) for s in left]) if left else []


class Codec:
    """Encodes and decodes texts in batches; keeps a memo of words that are merged and checked."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.agenda = Agenda(self.library)
        if self.library.normalize("a b") != f"{SPACE}a{SPACE}b" or any(SPACE in p.lstrip(SPACE) for p in self.agenda.ids):
            raise ValueError("only vocabularies that put a space before each word are supported")
        self.find = regex.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)").findall
        self.known: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    def words(self, normal: str) -> list[str]:
        """The words of a normalised text, each without the space before it; a run of spaces stands at the
        beginning of the word that follows. No piece has a space behind another letter, so that no merge
        crosses the beginning of a word."""
        cut = normal.split(SPACE)
        if "" in cut[1:]:
            cut = ["", *self.find(normal)]
        return cut[1:]

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids of new words, merged by score and compared with the library's for each word as a text."""
        ids: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= MEMO_CHARS]
        for k, merged in zip(short, self.agenda.merge_many([SPACE + words[k] for k in short]), strict=True):
            ids[k] = merged
        ids = [self.agenda.merge(SPACE + w) if x is None else x for w, x in zip(words, ids, strict=True)]
        theirs = self.library.encode([w.replace(SPACE, " ") for w in words], num_threads=1)
        for w, mine, other in zip(words, ids, theirs, strict=True):
            if w and mine != other:  # an empty text has no space before it
                raise RuntimeError(f"merging {w[:80]!r} by score gives other ids than the library")
        return {w: (np.asarray(x, "<u4").tobytes(), ",".join(map(str, x))) for w, x in zip(words, ids, strict=True)}

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Little-endian unsigned 32-bit ids of each text, and the same as decimals joined by commas."""
        cut = [self.words(t) for t in self.library.normalize(texts)]
        if self.held > MEMO_BYTES:
            self.known.clear()
            self.held = 0
        new = self.learn(list(set(itertools.chain.from_iterable(cut)).difference(self.known)))
        short = {w: ids for w, ids in new.items() if len(w) <= MEMO_CHARS}
        self.held += sum(2 * len(w) + len(a) + len(b) + ENTRY_BYTES for w, (a, b) in short.items())
        self.known |= short
        get = (self.known if len(short) == len(new) else {**self.known, **new}).__getitem__
        rows = [list(map(get, words)) for words in cut]
        return [(b"".join([a for a, _ in row]), ",".join([b for _, b in row])) for row in rows]

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        return [self.library.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in ids]


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """A worker's codec outlives its tasks, so that its memo does; it holds one vocabulary."""
    if id(shared.value) not in _codecs:
        _codecs.clear()
        _codecs[id(shared.value)] = Codec(shared.value)
    return _codecs[id(shared.value)]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False, batch_chars: int = 1_000_000) -> DataFrame:
    """Encode every text without begin or end ids and decode the ids again: doc_id, n_tokens, ids_sha256 (of
    decimal ids joined by commas), decoded_sha256, exact.

    Texts are normalised and cut before words; each distinct word of a batch is merged by an agenda of adjacent
    pairs in order of score, and the ids are compared with those of the library before they are used: ids that
    differ are an error, as the vocabulary is none of the merge type then. exact tells whether decoding gave the
    text back. keep_ids adds ids (array of long), keep_text adds decoded. The vocabulary (of fixed size) is read
    on the driver and broadcast. Null and empty texts have no tokens; repeated rows give repeated rows; an empty
    table gives no rows; other columns are ignored. Texts are worked through in groups of batch_chars characters;
    a longer text is a group of its own.
    """
    import sentencepiece

    shared = docs.sparkSession.sparkContext.broadcast(sentencepiece.SentencePieceProcessor(model_file=model_path).serialized_model_proto())

    def work(batch: pa.RecordBatch):
        codec, texts, at = _codec(shared), raw(batch.column(1)), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= batch_chars):
                chars += len(texts[end])
                end += 1
            part = [t.decode("utf-8", "replace") for t in texts[at:end]]
            ids = codec.encode_batch(part)
            back = codec.decode_batch([x for x, _ in ids])
            out = [
                batch.column(0).slice(at, end - at),
                pa.array([len(x) // 4 for x, _ in ids], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in ids]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                pa.array([x == y for x, y in zip(part, back, strict=True)]),
            ]
            out += [pa.array([np.frombuffer(x, "<u4").astype("i8") for x, _ in ids], pa.list_(pa.int64()))] * keep_ids + [pa.array(back)] * keep_text
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"] + ["ids"] * keep_ids + ["decoded"] * keep_text)
            at = end

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<bigint>" * keep_ids + ", decoded string" * keep_text
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, schema)
