"""Benchmark decontamination by winnowing: shared word windows, found by minimum k-gram hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, raw

#: Bytes that part words (all ASCII but digits and letters become a space) and A-Z in lower case.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Words per k-gram and k-grams per window of the winnowing: any ten shared words hold one window.
KGRAM, WINDOW = 5, 6
#: Bits of the filter that tells which fingerprints items have: 16 for each, up to this many (16 MB).
MOST_BITS = 1 << 27
#: Distinct windows of items that a filter of whole rows may broadcast (some 30 MB in a worker).
BROADCAST_WINDOWS = 300_000
MEMO_WORDS = 400_000


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Hashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def kgram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost minimum of each window of k-gram hashes; of the whole if it is shorter."""
    if not len(grams):
        return np.zeros(0, np.int64)
    window = min(window, len(grams))
    n = len(grams) - window + 1
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, window):
        lower = grams[i : i + n] <= best
        best[lower] = grams[i : i + n][lower]
        at[lower] = np.flatnonzero(lower) + i
    return at[np.append(True, at[1:] != at[:-1])]


def windows_of(words: list[bytes], h: np.ndarray, size: int, wanted=None) -> dict[tuple[int, bytes], list[int]]:
    """Starts of a text's windows by (fingerprint, words): the fingerprint is the smallest k-gram hash of
    the window's k-grams, so equal windows have equal ones on both sides. wanted: tells which fingerprints
    and windows may be needed (of arrays of hashes); all if None."""
    out: dict[tuple[int, bytes], list[int]] = {}
    grams = kgram_hashes(h, KGRAM)
    n = len(h) - size + 1
    if n < 1:
        return out
    picked = winnow(grams, size - KGRAM + 1)
    if wanted is not None:
        picked = picked[wanted(grams[picked])]
        if not len(picked):
            return out
    # the windows around each fingerprint met: those it may be the minimum of
    near = np.unique((picked[:, None] - np.arange(size - KGRAM + 1)[None, :]).reshape(-1))
    near = near[(near >= 0) & (near < n)]
    low = grams[near]
    for i in range(1, size - KGRAM + 1):
        low = np.minimum(low, grams[near + i])
    if wanted is not None:
        whole = np.zeros(len(near), np.uint64)
        for i in range(size):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[near + i]
            whole ^= whole >> np.uint64(29)
        fine = wanted(low) & wanted(whole)
        near, low = near[fine], low[fine]
    for s, fp in zip(near.tolist(), low.tolist(), strict=True):
        out.setdefault((fp, b" ".join(words[s : s + size])), []).append(s)
    return out


class Filter:
    """Which hashes items may have: two bits each in a table of bounded size (others may be met by chance)."""

    def __init__(self, n: int):
        self.size = min(MOST_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
        self.bits = np.zeros(self.size // 64, np.uint64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
        return np.stack([mixed >> np.uint64(33), mixed & np.uint64(0xFFFFFFFF)]).astype(np.int64) & (self.size - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(0)


_KEYS = "fp bigint, window string, n int"


def _signed(fps: list[int]) -> pa.Array:
    return pa.array([x - (x >> 63 << 64) for x in fps], pa.int64())


def _item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct windows of items: row (the item's number), item (its id as text), fp, window, n and whole
    (hash of the window's words)."""

    def work(batch):
        memo, out = Hashes(), []
        for row, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
            words = split_words(text)
            h = memo.of(words)
            n = min(size, len(words))
            found = windows_of(words, h, size) if n == size else {(int(kgram_hashes(h, n)[0]), b" ".join(words)): [0]} if n else {}
            out += [(row, item, fp, w, n, int(kgram_hashes(h[at[0] : at[0] + n], n)[0])) for (fp, w), at in found.items()]
        if out:
            row, item, fp, w, n, whole = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(item, pa.string()), _signed(fp), pa.array([x.decode() for x in w]), pa.array(n, pa.int32()), _signed(whole)], names=["row", "item", "fp", "window", "n", "whole"])

    read = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    read = read.select(F.monotonically_increasing_id().alias("row"), "item", "text")
    return materialise(map_arrow(read, work, f"row bigint, item string, {_KEYS}, whole bigint"), "item-windows")


def _filter(windows: DataFrame) -> Filter:
    """The filter over fingerprints and window hashes of items, put together on the cluster."""
    filt = Filter(2 * windows.count())

    def bits(batch):
        at = filt.places(np.concatenate([batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)])).reshape(-1)
        words, where = np.unique(at >> 6, return_inverse=True)
        values = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(values, where, np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values.view(np.int64))], names=["word", "bits"])

    parts = map_arrow(windows.select("fp", "whole"), bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for r in parts.toLocalIterator():  # at most MOST_BITS / 64 rows
        filt.bits[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return filt


def _met(words: list[bytes], h: np.ndarray, wanted, lengths: list[int], size: int):
    """Of a text: the windows that items may have, short ones of some lengths too, as (fingerprint, words,
    number of words, starts)."""
    for (fp, w), at in windows_of(words, h, size, wanted).items():
        yield fp, w, size, at
    for n in lengths:
        grams, short = kgram_hashes(h, n), {}
        for p in np.flatnonzero(wanted(grams)).tolist() if len(grams) else ():
            short.setdefault((int(grams[p]), b" ".join(words[p : p + n])), []).append(p)
        for (fp, w), at in short.items():
            yield fp, w, n, at


def _document_windows(docs: DataFrame, text_col: str, shared, lengths: list[int], size: int) -> DataFrame:
    """Of each text: sha256, n_words, and met: the windows that items may have, with their starts."""

    def work(batch):
        memo, rows = Hashes(), []
        for text in raw(batch.column(0)):
            words = split_words(text)
            h, wanted = memo.of(words), shared.value
            rows.append((len(words), [(fp, w.decode(), n, at) for fp, w, n, at in _met(words, h, wanted, lengths, size)]))
        fp, window, n, at = zip(*(m for _, met in rows for m in met), strict=True) if any(m for _, m in rows) else ([], [], [], [])
        struct = pa.StructArray.from_arrays([_signed(list(fp)), pa.array(window, pa.string()), pa.array(n, pa.int32()), pa.array(at, pa.list_(pa.int64()))], names=["fp", "window", "n", "starts"])
        met = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(m) for _, m in rows)]), pa.int32()), struct)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([k for k, _ in rows], pa.int64()), met], names=[*batch.schema.names[1:], "n_words", "met"])

    text = F.col(text_col).cast("string")
    read = docs.select(text.alias("text"), *[c for c in docs.columns if c != text_col], F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[1:])
    return map_arrow(read, work, f"{rest}, n_words bigint, met array<struct<{_KEYS.replace(' ', ':').replace(',:', ', ')}, starts:array<bigint>>>")


def _item_side(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, size: int):
    """The items' windows, lengths of short ones, and the broadcast filter over them."""
    if size < KGRAM:
        raise ValueError(f"a window has {KGRAM} words at least")
    windows = _item_windows(items, id_col, text_col, size)
    lengths = sorted(r["n"] for r in windows.where(F.col("n") < size).select("n").distinct().collect())
    return windows, lengths, docs.sparkSession.sparkContext.broadcast(_filter(windows))


def _hits(docs: DataFrame, items: DataFrame, text_col: str, item_id_col: str, item_text_col: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read documents, their windows that items have (by digest of the text), and the items' windows."""
    windows, lengths, shared = _item_side(docs, items, item_id_col, item_text_col, size)
    read = materialise(_document_windows(docs, text_col, shared, lengths, size), "document-windows")
    keys = ["fp", "window", "n"]
    met = read.where(F.size("met") > 0).select("digest", F.explode("met").alias("m")).select("digest", "m.*").dropDuplicates(["digest", *keys])
    hits = materialise(met.join(windows.select(*keys).distinct(), keys, "left_semi"), "window-hits")
    return read, hits, windows


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window_words: int = 10) -> DataFrame:
    """Words of documents inside any window of window_words consecutive words of an item.

    Winnowing keeps the smallest k-gram hash of each window on both sides; equal windows keep the same
    one, so every shared span of window_words words is met. Documents look their fingerprints up in a
    filter of bounded size, which drops nearly all, and extend those met to the windows around them;
    these join the items' windows in Spark by fingerprint and words, so hits are exact, and hits that
    touch grow together to the longest shared spans. Items with fewer words than a window are one
    window. No item comes to the driver or is broadcast; only windows that items may have are shuffled,
    once for each different text.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (disjoint [start, end) of
    hit words). Null and empty texts and items have no words and no windows; equal items are all
    reported; repeated documents come back each; an empty side gives no hits or no rows; other columns
    are ignored. A null item id reads as an empty string.
    """
    read, hits, windows = _hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, "text", item_id_col, item_text_col, window_words)

    def spans(batch):
        out = []
        for met in batch.column(1).to_pylist():
            at = np.unique(np.concatenate([np.array(m["starts"], np.int64)[:, None] + np.arange(m["n"])[None, :] for m in met], axis=None))
            cut = np.flatnonzero(np.diff(at) > 1)
            out.append((len(at), np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1], 1).tolist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.list_(pa.int64())))], names=["digest", "n_hit", "spans"])

    # a text's hits together are no longer than the text
    of_text = hits.groupBy("digest").agg(F.collect_list(F.struct("n", "starts")).alias("met"))
    of_text = map_arrow(of_text, spans, "digest string, n_hit bigint, spans array<array<bigint>>")
    found = hits.select("digest", "fp", "window", "n").join(windows, ["fp", "window", "n"]).select("digest", "row", "item").distinct()
    named = found.groupBy("digest").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = read.select("doc_id", "digest", "n_words").join(of_text.join(named, "digest"), "digest", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"),
    )


def filter_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window_words: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs without any hit, with all their columns; null and empty texts are clean.

    While items have at most broadcast_windows distinct windows, digests of these (16 bytes each) are
    broadcast beside the filter and decide where the rows are, so nothing is shuffled. More of them stay
    on the cluster: texts with hits are found as find_contamination() does, and rows meet a list of
    digests of such texts. Both give the same rows. Repeated rows stay repeated.
    """
    windows, lengths, shared = _item_side(docs, items, item_id_col, item_text_col, window_words)
    known = windows.select("window", "n").distinct()
    if known.count() > broadcast_windows:
        _, hits, _ = _hits(docs.select(text_col), items, text_col, item_id_col, item_text_col, window_words)
        digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
        return docs.withColumn("_digest", digest).join(hits.select(F.col("digest").alias("_digest")).distinct(), "_digest", "left_anti").select(*docs.columns)
    exact = docs.sparkSession.sparkContext.broadcast(frozenset(_window_digest(r["window"].encode()) for r in known.toLocalIterator()))
    at = docs.columns.index(text_col)

    def work(batch):
        memo, keep = Hashes(), []
        for text in raw(batch.column(at)):
            words = split_words(text)
            keep.append(not any(_window_digest(w) in exact.value for _, w, _, _ in _met(words, memo.of(words), shared.value, lengths, window_words)))
        yield batch.filter(pa.array(keep))

    return map_arrow(docs, work, docs.schema)


def _window_digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()
