"""Shared pieces of the training-data operators: folders, Arrow maps, packing, components."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import set_checkpoint_folder

#: Spark's setting that deletes what a query shuffled when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back; cuts lineage and pins random draws.

    What the write shuffled is deleted when it ends. The table stays until discard() or until the folder
    is cleared, as lazily returned results may still read it.
    """
    spark = df.sparkSession
    path = f"{set_checkpoint_folder(spark)}/sagewell-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._sagewell_path = path
    return table


def discard(table: DataFrame, part: str = "") -> None:
    """Deletes a table that materialise() wrote, or a partition of it, once nothing reads it any more."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table._sagewell_path}/{part}".rstrip("/"))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are skipped."""

    def over(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(over, schema)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for a worker process, which runs one task at a time."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _compress(data) -> bytes:
    return _codec()[0].compress(data)


def _decompress(blob: bytes) -> bytes:
    return _codec()[1].decompress(blob)


def pack(values, dtype: str) -> bytes:
    """Compressed little-endian array, bytes of equal weight side by side."""
    a = np.ascontiguousarray(values, dtype=dtype)
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T if len(a) else a.view(np.uint8)
    return _compress(np.ascontiguousarray(planes))


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(_decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    out = np.empty(planes.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = plane
    return out.reshape(-1).view(dtype)


def pack_ints(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in as many bytes each as the largest needs (told by the first byte)."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + pack(values, f"<u{width}")


def unpack_ints(blob: bytes) -> np.ndarray:
    return unpack(blob[1:], f"<u{blob[0]}").astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    """Words that hold no newline, compressed."""
    return _compress(b"\n".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    return _decompress(blob).split(b"\n")


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for edges among nodes 0..n-1."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        keep = a != b
        if not keep.any():
            break
        a, b, left, right = a[keep], b[keep], left[keep], right[keep]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest reachable node.

    Nodes are of any orderable type. Each round takes the smallest neighbour of every node
    (partial sums before the shuffle) and hooks the other neighbours to it, alternating larger
    and smaller neighbours, until nothing changes; joins stay plain equi-joins so that adaptive
    execution can split a hub's rows. Rounds grow with the logarithm of the longest path. Edges
    with a null end and loops are ignored; an empty input gives no rows.
    """
    spark = edges.sparkSession
    set_checkpoint_folder(spark)
    now = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        # every node points to its smallest neighbour or itself; larger neighbours follow it
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = least.select("u", F.col("m").alias("v")).union(hooked.where("u <> v")).distinct().checkpoint()
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == sign:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
