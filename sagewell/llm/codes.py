"""Vector codes: a codebook of whole numbers for each part of the vectors, fitted by exact sums on Spark."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and components that a block may hold.
BLOCK_ROWS, BLOCK_SIZE = 4096, 1 << 22
#: Vectors whose distances to a codebook are held at once.
ROWS_AT_ONCE = 1024
#: Tensors that the last step of a reduction tree takes.
FAN_IN = 32


def largest(width: int) -> int:
    """Scaled components beyond this count as this, so that squared distances are whole numbers of 64 bits: 2**27
    for 64 components."""
    return min(math.isqrt((1 << 62) // width) // 2, (1 << 31) - 1)


def scaled(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Whole numbers of a column of vectors, a row for each component; the last parts are filled up with zeros."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    out = np.zeros((width, len(m)), np.int32)
    out[: m.shape[1]] = np.clip(np.floor(m * scale), -largest(width), largest(width)).T
    return out


def block_bytes(block: np.ndarray) -> bytes:
    """A block in the narrowest type that holds it; the first byte tells the type's width."""
    kind = "<i2" if not block.size or np.abs(block).max() < 1 << 15 else "<i4"
    return kind[2].encode() + block.astype(kind).tobytes()


def block_of(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, f"<i{blob[:1].decode()}", offset=1).reshape(width, -1)


def nearest(block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector the nearest entry (of equal ones the first) and its squared distance.

    A part's distances to all entries grow component by component. block: components x vectors; codebooks:
    parts x entries x components of a part. Both results are parts x vectors."""
    parts, entries, wide = codebooks.shape
    n = block.shape[1]
    most = max(int(np.abs(block).max(initial=0)), int(np.abs(codebooks).max(initial=0)))
    kind = np.int32 if 4 * most * most * wide < 1 << 31 else np.int64
    books = codebooks.astype(kind)
    code, distance = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for at in range(0, n, ROWS_AT_ONCE):
        some = block[:, at : at + ROWS_AT_ONCE].astype(kind)
        row = np.arange(some.shape[1])
        for p in range(parts):
            total = np.zeros((some.shape[1], entries), kind)
            for d in range(wide):
                off = some[p * wide + d][:, None] - books[p, :, d]
                total += off * off
            best = total.argmin(1)
            code[p, at : at + len(row)], distance[p, at : at + len(row)] = best, total[row, best]
    return code, distance


def _fit(blocks: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """Rounds of assignment and means: every task adds its blocks to one tensor of sums and counts, and the
    tensors, whose size depends on the codebooks alone, merge through a tree."""
    parts, entries, wide = codebooks.shape
    rdd = blocks.select("block").rdd
    depth = max(2, math.ceil(math.log(max(rdd.getNumPartitions(), 2), FAN_IN)))
    for _ in range(rounds):
        shared = blocks.sparkSession.sparkContext.broadcast(codebooks)

        def add(acc, row, shared=shared):
            sums, counts = acc or (np.zeros((parts, wide, entries), np.int64), np.zeros((parts, entries), np.int64))
            block = block_of(row["block"], parts * wide)
            code, _ = nearest(block, shared.value)
            for p in range(parts):
                np.add.at(counts[p], code[p], 1)
                for d in range(wide):
                    np.add.at(sums[p, d], code[p], block[p * wide + d].astype(np.int64))
            return sums, counts

        def merge(a, b):
            return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

        total = rdd.treeAggregate(None, add, merge, depth)
        if total is None:
            break
        sums, counts = total[0].transpose(0, 2, 1), total[1][:, :, None]
        codebooks = np.where(counts > 0, sums // np.maximum(counts, 1), codebooks)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """Hash of all entries' components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Codes of all vectors: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Components become floor(scale * x). Each part's codebook starts as that part of the vectors with the smallest
    ids (repeated ids in order of their vectors, null ids last) and is refitted `rounds` times: vectors go to the
    nearest entry, of equal ones the first, and entries become the floor of their vectors' mean; entries that
    nothing is near to stay. Vectors that are null, empty, hold nulls or components that are not finite, or have
    another length than the first one kept, have no code and are dropped. Where the length is no multiple of
    `parts`, zeros fill it up. Scaled components beyond largest() count as that. error is a vector's squared distance,
    label_error the sum of errors over equal labels, nulls (or no label column) being one label. Repeated rows give
    repeated rows; an empty table gives none; other columns are ignored.

    Vectors are written once as blocks, a row for each component. A round reads the blocks; only tensors of the
    codebooks' size are merged, through a tree. What comes to the driver is the codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    finite = F.forall("vector", lambda x: F.abs(x) < F.lit(float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where((F.size("vector") > 0) & finite)

    def smallest(rows: DataFrame) -> list:
        return [r["vector"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()]

    first = smallest(kept)
    length = len(first[0]) if first else parts
    if any(len(v) != length for v in first):
        first = smallest(kept.where(F.size("vector") == length))
    wide = math.ceil(length / parts)
    rows = max(1, min(BLOCK_ROWS, BLOCK_SIZE // (parts * wide)))

    def cut(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, rows):
            b = batch.slice(at, rows)
            one = pa.array([0, b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, b.column(0)), pa.ListArray.from_arrays(one, b.column(1)), pa.array([block_bytes(scaled(b.column(2), parts * wide, scale))])], names=["ids", "labels", "block"])

    label_kind = dict(kept.dtypes)["label"]
    blocks = materialise(map_arrow(kept.where(F.size("vector") == length), cut, f"ids array<{kinds[id_col]}>, labels array<{label_kind}>, block binary"), "code-blocks")
    start = scaled(pa.array(first, pa.list_(pa.float64())), parts * wide, scale).astype(np.int64).T if first else np.zeros((0, parts * wide), np.int64)
    codebooks = _fit(blocks, start.reshape(-1, parts, wide).transpose(1, 0, 2), rounds) if first else np.zeros((parts, 0, wide), np.int64)
    shared = spark.sparkContext.broadcast(codebooks)

    def assign(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            b = batch.slice(i, 1)
            code, distance = nearest(block_of(b.column(2)[0].as_py(), parts * wide), shared.value)
            text = code.T.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays([b.column(0).flatten(), b.column(1).flatten(), pa.array([text[x : x + 2 * parts] for x in range(0, len(text), 2 * parts)]), pa.array(distance.sum(0))], names=["vec_id", "label", "code", "error"])

    coded = materialise(map_arrow(blocks, assign, f"vec_id {kinds[id_col]}, label {label_kind}, code string, error bigint"), "codes")
    # summed before the shuffle; Spark broadcasts the sums only if the table written is small
    sums = materialise(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "code-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))

