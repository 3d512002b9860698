"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: numpy draws exactly below this population; larger ones are drawn here by inversion from the mode.
NUMPY_POPULATION = 10**9


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    at = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, up, down, p_up, p_down = rng.random() - at, mode, mode, at, at
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(rows_per_part: list[int], rows_per_shard: list[int], seed: int) -> np.ndarray:
    """Exact counts part -> shard with the given margins, distributed as under a uniform permutation."""
    rng = np.random.default_rng(seed)
    left = np.array(rows_per_shard, dtype=np.int64)
    out = np.zeros((len(rows_per_part), len(left)), np.int64)
    for p, draws in enumerate(rows_per_part):
        rest = int(left.sum())
        for s, good in enumerate(left.tolist()):
            take = draws if rest == good else _hypergeometric(rng, good, rest - good, draws)
            out[p, s], draws, rest = take, draws - take, rest - good
        left -= out[p]
    return out


def shuffle_shards(docs: DataFrame, n_shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rows_per_sort: int = 1_000_000, most_parts: int = 4096) -> DataFrame:
    """Deal all rows uniformly at random into shards whose row counts differ by one at most.

    Rows, with random keys, are first written as a narrow table so that a task that runs again sees
    the same draws. The driver draws the matrix from row counts of partitions only. Each partition
    permutes its rows and cuts them by its row of the matrix; each shard permutes what it got, in
    ranges of the second key so that no task sorts a whole shard.

    Null texts count as empty; repeated rows are separate rows; null ids stay null; an empty table
    gives no rows; other columns of docs are ignored. Returns doc_id, size (UTF-8 bytes + 16),
    text_crc32, law, shard, slot (0.. without gaps), grown_shard (null under this law).
    """
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    drawn = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(binary).cast("long") + 16).alias("size"), F.crc32(binary).alias("text_crc32"), (F.spark_partition_id() % most_parts).alias("part"), F.rand(seed).alias("k1"), F.rand(seed + 1).alias("k2"))
    rows = materialise(drawn, "shuffle")
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    spark = docs.sparkSession
    cuts = spark.createDataFrame([(p, [int(x) for x in np.cumsum(m)]) for (p, _), m in zip(counts, matrix, strict=True)], "part int, cuts array<bigint>")
    local = rows.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("k1", "k2")))
    sent = local.join(cuts, "part").withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("at"))))
    ranges = max(8, math.ceil(total / n_shards / rows_per_sort))
    sent = sent.withColumn("range", F.least(F.floor(F.col("k2") * ranges), F.lit(ranges - 1)).cast("int"))
    sent = materialise(sent.select("doc_id", "size", "text_crc32", "shard", "range", "k2", "k1"), "sent")
    sums = sent.groupBy("shard", "range").agg(F.count("*").alias("n"))
    starts = sums.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("start"))
    put = sent.withColumn("at", F.row_number().over(Window.partitionBy("shard", "range").orderBy("k2", "k1"))).join(starts, ["shard", "range"])
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
