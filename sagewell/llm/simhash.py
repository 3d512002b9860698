"""SimHash near-duplicates by Golay-code fuzzy keys of fingerprint segments."""

from __future__ import annotations

import functools
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, map_arrow, materialise, raw

#: Generator polynomial of the perfect binary Golay code of length 23 (a fixed value).
GOLAY_GENERATOR = 0b101011100011
#: A fingerprint's segments: first bit and width. Each fits a Golay word with zeros ahead.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Hashes of one text that are held at once.
HASHES_AT_ONCE = 200_000
#: Buckets up to this size compare all members; larger ones look up each member's neighbours.
SMALL_BUCKET = 256


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles, repeats included: a bit is 1 if set in over half of the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    n, counts = len(words) - k + 1, np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    for at in range(0, n, HASHES_AT_ONCE):
        h = np.fromiter(hashes, np.uint64, min(HASHES_AT_ONCE, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


@functools.cache
def _syndrome_table() -> np.ndarray:
    """The error of weight 3 at most for each of the 2048 syndromes of the perfect code."""
    errors = [sum(1 << b for b in c) for w in range(4) for c in combinations(range(23), w)]
    table = np.zeros(2048, np.int64)
    table[_syndrome(np.array(errors, np.int64))] = errors
    return table


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for b in range(22, 10, -1):
        rest ^= (rest >> b & 1) * (GOLAY_GENERATOR << (b - 11))
    return rest


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 information bits) of the only codeword within three bits of each 23-bit word."""
    return (words ^ _syndrome_table()[_syndrome(words)]) >> 11


def fuzzy_indices(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords nearest to each word and to the words one bit away: n x 24.

    Words that differ in two bits at most share one: the word between them decodes to it.
    """
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
    return golay_index(near.reshape(-1)).reshape(near.shape)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: fingerprints that differ in two bits at most share a key.

    Of three segments one has no error; of the other two the next in turn has two at most. A key
    is that segment's number and bits with a fuzzy index of the next segment.
    """
    rows, keys = [], []
    for s, (at, width) in enumerate(SEGMENTS):
        low, wide = SEGMENTS[(s + 1) % 3]
        exact = (prints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
        index = np.sort(fuzzy_indices((prints >> np.uint64(low)).astype(np.int64) & ((1 << wide) - 1)), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        r, c = np.nonzero(first)
        rows.append(r)
        keys.append(np.int64(s) << 40 | exact[r] << 12 | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def near_pairs(prints: np.ndarray, bits: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of distinct sorted fingerprints that differ in one or two bits."""
    if len(prints) <= SMALL_BUCKET:
        a, b = np.triu_indices(len(prints), 1)
        close = np.bitwise_count(prints[a] ^ prints[b]) <= bits
        return a[close], b[close]
    left, right, single = [], [], [np.uint64(1 << i) for i in range(64)]
    for mask in [*single, *(x | y for x, y in combinations(single, 2))][: 64 if bits == 1 else None]:
        other = prints ^ mask
        at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
        hit = np.flatnonzero((prints[at] == other) & (prints < other))
        left.append(hit)
        right.append(at[hit])
    return np.concatenate(left), np.concatenate(right)


def _link_runs(batches, bits: int):
    """Edges within runs of equal keys; rows come sorted by key and fingerprint. The last run of a
    batch waits for the next batch."""
    held_k, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def edges(keys, prints):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
        many = ends - starts > 1
        out_a, out_b = [], []
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            run = np.unique(prints[s:e].view(np.uint64))
            a, b = near_pairs(run, bits)
            if len(a):
                root = local_roots(len(run), a, b)
                moved = np.flatnonzero(root != np.arange(len(run)))
                out_a.append(run[moved])
                out_b.append(run[root[moved]])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([held_p, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        yield from edges(keys[:last], prints[:last]) if last else ()
        held_k, held_p = keys[last:], prints[last:]
    if len(held_k):
        yield from edges(held_k, held_p)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and signed 64-bit SimHash of every row; null and wordless texts have 0, repeated rows and null
    ids come back each, an empty table gives no rows, other columns are ignored."""

    def work(batch):
        prints = np.fromiter(map(fingerprint, raw(batch.column(1))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, f"doc_id {dict(docs.dtypes)[id_col]}, fp bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """Groups of documents whose fingerprints are linked by steps of at most two differing bits.

    Equal fingerprints are one class before any join. Each class gets its Golay keys; classes that
    share a key are compared bit by bit inside the key's run, which yields a star per local group
    and never all pairs; stars are joined to components. No two classes within the distance are
    missed. Returns doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id
    reachable, itself included).

    Null and wordless texts share fingerprint zero and are linked like any other; rows with a null
    id get a component but give it no name unless all its ids are null; repeated rows come back
    each; an empty table gives no rows; other columns are ignored.
    """
    if not 0 < bits <= 2:
        raise ValueError("keys cover distances of one or two bits")
    prints = materialise(fingerprints(docs, id_col, text_col), "prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")

    def keys(batch):
        p = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(p), 20_000):
            rows, keys = fuzzy_keys(p[at : at + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p[at : at + 20_000][rows].view(np.int64))], names=["key", "fp"])

    keyed = map_arrow(classes.select("fp"), keys, "key bigint, fp bigint")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = keyed.repartition(n, "key").sortWithinPartitions("key", "fp")
    edges = runs.mapInArrow(lambda batches: _link_runs(batches, bits), "a bigint, b bigint")
    groups = components(edges)
    rooted = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the one with the smallest id.

    Rows are numbered in a table written first, so of rows that share the smallest id the first
    stays; null ids come last.
    """
    rows = materialise(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    order = F.struct(F.col(f"doc.{id_col}").isNull().alias("no_id"), F.col(f"doc.{id_col}").alias("id"), "row")
    groups = near_duplicates(rows.select(order.alias("doc_id"), F.col(f"doc.{text_col}").alias("text")))
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
