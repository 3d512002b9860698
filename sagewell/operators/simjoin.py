"""Similarity self-join: every row's nearest others at a threshold, through bands of sign hashes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import pinned
from .knn import ROWS_AT_ONCE, Best, _best, _matrix, _slices, _unit, exact_topk

#: Vectors that a bucket should hold on average, and more than which it is split.
BUCKET_ROWS = 2048
#: Bits of a band's key behind those that make its bucket; they split buckets that hold too many.
SPARE_BITS = 20
#: Bands whose rows are shuffled in one go.
BANDS_AT_ONCE = 16
#: Bands that the join may come to; more of them are an error, not an answer of less recall.
MOST_BANDS = 1024
#: Rows of a slice where all pairs are compared.
EXACT_ROWS = 16_384
#: Rows that are drawn to measure recall against exact search.
DRAWN_ROWS = 200


def plan_bands(rows: int, threshold: float, recall: float, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """Bits of a bucket and number of bands, so that a pair at the threshold shares a bucket with the wanted
    probability. Where one bucket holds all rows there are no bits, and one band is exact."""
    bits = max(0, math.ceil(math.log2(max(rows, 1) / bucket_rows)) + 1) if rows > bucket_rows else 0
    if not bits:
        return 0, 1
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    hit = same**bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit))) if hit < 1 else 1


def planes(band: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """Normal vectors of a band's hyperplanes."""
    return np.random.default_rng([seed, band, dim]).standard_normal((bits, dim))


def band_keys(m: np.ndarray, band: int, bits: int, seed: int) -> np.ndarray:
    """A band's sign hash of each row: `bits` for its bucket, then the spare ones."""
    signs = m @ planes(band, bits + SPARE_BITS, m.shape[1], seed).T >= 0
    return signs @ (1 << np.arange(bits + SPARE_BITS, dtype=np.int64)[::-1])


def _hashed(reps: DataFrame, bands: range, bits: int, seed: int) -> DataFrame:
    """A row for each vector and band: band, key, id, first, vector."""

    def work(batches):
        for b in _slices(batches, 4096):
            m = _unit(_matrix(b.column("vector")))
            for band in bands:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, band, np.int32)), pa.array(band_keys(m, band, bits, seed)), b.column("rep"), b.column("vector")], names=["band", "key", "rep", "vector"])

    kinds = dict(reps.dtypes)
    return reps.select("rep", "vector").mapInArrow(work, f"band int, key bigint, rep {kinds['rep']}, vector {kinds['vector']}")


def _meeting(keys: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows with the bucket and the pair of slices in which they meet others.

    A bucket with more rows than the bound takes as many spare bits as make it small; what still holds more
    (vectors that hardly differ) is dealt to slices, and each pair of slices is a group of its own, so that a
    group never holds more than twice the bound."""
    top = F.shiftright("key", SPARE_BITS)
    size = keys.groupBy("band", top.alias("top")).agg(F.count("*").alias("rows"))
    large = size.where(F.col("rows") > bucket_rows).select("band", "top", F.least(F.lit(SPARE_BITS), F.ceil(F.log2(F.col("rows") / bucket_rows)).cast("int") + 1).alias("more"))
    split = keys.withColumn("top", top).join(large, ["band", "top"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    split = split.withColumn("bucket", F.expr(f"shiftright(key, {SPARE_BITS} - more)")).drop("top", "key")
    again = split.groupBy("band", "more", "bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > bucket_rows).select("band", "more", "bucket", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("slices"))
    cut = split.join(again, ["band", "more", "bucket"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return cut.select("band", "more", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "vector")


def _search(threshold: float, most: int):
    def work(table: pa.Table) -> pa.Table:
        ids, kind = np.array(table.column("rep").to_pylist()), table.schema.field("rep").type
        m, out = _unit(_matrix(table.column("vector").combine_chunks())), []
        for at in range(0, len(m), 1024):
            scores = np.round(m[at : at + 1024] @ m.T, 12)
            scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
            scores[scores < threshold] = -np.inf
            i, j = _best(scores, most)
            out.append(pa.table([pa.array(ids[at + i].tolist(), kind), pa.array(ids[j].tolist(), kind), pa.array(scores[i, j])], names=["id", "other", "score"]))
        return pa.concat_tables(out)

    return work


def _nearest(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    one = found.groupBy("id", "other").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def _recall(found: DataFrame, drawn: DataFrame, truth: DataFrame) -> float | None:
    """Share of the drawn rows' true neighbours among those found; None if there is none."""
    own = found.join(F.broadcast(drawn.select(F.col("rep").alias("id"))), "id", "left_semi").select("id", "other", F.lit(1).alias("hit"))
    n, hits = truth.join(own, ["id", "other"], "left").agg(F.count("*"), F.count("hit")).first()
    return hits / n if n else None


def representatives(vectors: DataFrame, most: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """One row for each distinct vector (rep: its smallest id, firsts: the `most` + 1 smallest ids), and the
    representative of every row (id, rep). Rows that can't be compared are in neither: null ids, and vectors
    that are null, empty, zero, or hold a null or a component that isn't finite."""
    plain = F.forall("vector", lambda x: F.abs(x) < F.lit(float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & plain)
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= most + 1)
    reps = pinned(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("firsts")).select(F.col("firsts")[0].alias("rep"), "firsts", "vector"))
    return reps, rows.join(reps.select("vector", "rep"), "vector").select("id", "rep")


def _every_pair(reps: DataFrame, rows: int, threshold: float, most: int) -> DataFrame:
    """The nearest of all others, exactly: rows are dealt to slices, and each pair of slices is a group."""
    kind, slices = dict(reps.dtypes)["rep"], max(1, math.ceil(rows / EXACT_ROWS))
    own = F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int")
    dealt = reps.select("rep", "vector", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("other"))

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = (x.as_py() for x in key)
        own, ids = table.column("own").to_numpy(), table.column("rep").combine_chunks()
        m, out = _unit(_matrix(table.column("vector").combine_chunks())), []
        for a, b in {(low, high), (high, low)}:
            asking, others = np.flatnonzero(own == a), np.flatnonzero(own == b)
            names = ids.take(pa.array(asking)).to_pylist()
            best = Best(m[asking], most, ids.type, threshold)
            for at in range(0, len(others) if names else 0, ROWS_AT_ONCE):
                some = others[at : at + ROWS_AT_ONCE]
                best.add(ids.take(pa.array(some)), m[some], names=np.array(names) if a == b else None)
            out += best.batches(names, ids.type, ("id", "other", "score"))
        return pa.Table.from_batches(out, pa.schema([("id", ids.type), ("other", ids.type), ("score", pa.float64())]))

    pairs = dealt.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "vector")
    return pairs.groupBy("low", "high").applyInArrow(work, f"id {kind}, other {kind}, score double")


def near_neighbours(vectors: DataFrame, threshold: float, neighbours: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, bucket_rows: int = BUCKET_ROWS, seed: int = 42, exact: bool = False) -> DataFrame:
    """Every row's nearest other rows of cosine >= threshold, `neighbours` at most: id, other, score; of equal
    scores the smaller ids come first.

    All rows take part on both sides. Equal vectors are joined once, by a representative, and their rows take
    over its neighbours; a group of any number of copies costs a row for each. Representatives get a sign hash
    in each of several bands and meet in matrix products where their hashes agree; buckets are split so that no
    group holds more than twice bucket_rows. The number of bands follows from the threshold and the number of
    rows; then recall is measured: up to DRAWN_ROWS drawn rows are searched exactly, and bands are added until
    `recall` of their neighbours are found. If MOST_BANDS don't reach it, that is an error. With bucket_rows
    vectors or fewer there is one bucket and the answer is exact. With `exact` there are no bands: all pairs of
    representatives are compared, in groups of two slices of EXACT_ROWS.

    Vectors of one length are expected. Rows with null ids or vectors that are null, empty, zero or not finite
    have no neighbours; of rows with equal ids the one with the smallest vector counts; an empty table gives none.
    """
    reps, members = representatives(vectors, neighbours, id_col, vector_col)
    rows = reps.count()
    kind = dict(reps.dtypes)["rep"]
    if exact:
        return _expanded(pinned(_nearest(_every_pair(reps, rows, threshold, neighbours), neighbours)), reps, members, neighbours)
    bits, bands = plan_bands(rows, threshold, recall, bucket_rows)
    if bands > MOST_BANDS:
        raise ValueError(f"{bands} bands are needed for recall {recall} at {threshold} among {rows} vectors: raise the threshold")
    drawn = pinned(reps.orderBy(F.xxhash64(F.col("rep").cast("string"))).limit(DRAWN_ROWS))
    truth = None
    found, done = None, 0
    while True:
        now = range(done, min(bands, done + BANDS_AT_ONCE))
        met = _meeting(_hashed(reps, now, bits, seed), bucket_rows)
        new = met.groupBy("band", "more", "bucket", "low", "high").applyInArrow(_search(threshold, neighbours), f"id {kind}, other {kind}, score double")
        found = pinned(_nearest(new if found is None else found.unionByName(new), neighbours))
        done = now.stop
        if not bits:
            break
        if done < bands:
            continue
        if truth is None:
            exact = exact_topk(reps, drawn, neighbours, "rep", "vector", exclude_self=True).where(F.col("score") >= threshold)
            truth = pinned(exact.select(F.col("query_id").alias("id"), F.col("id").alias("other")))
        share = _recall(found, drawn, truth)
        if share is None or share >= recall:
            break
        if bands == MOST_BANDS:
            raise RuntimeError(f"recall {share:.3f} after {bands} bands")
        bands = min(MOST_BANDS, bands + max(4, bands // 2))
    return _expanded(found, reps, members, neighbours)


def _expanded(found: DataFrame, reps: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Neighbours of representatives as those of all rows: a vector's own copies have cosine 1, and of another
    vector's copies those with the smallest ids come first."""
    entry = lambda ids, score: F.transform(ids, lambda x: F.struct((-score).alias("far"), x.alias("other")))
    others = found.join(reps.select(F.col("rep").alias("other"), "firsts"), "other").select(F.col("id").alias("rep"), entry(F.slice("firsts", 1, most), F.col("score")).alias("list"))
    own = reps.where(F.size("firsts") > 1).select("rep", entry(F.col("firsts"), F.lit(1.0)).alias("list"))
    # a list for each vector, of at most `most` entries for each of its `most` neighbours and its own copies
    best = others.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("list"))), 1, most + 1).alias("list"))
    rest = F.slice(F.filter("list", lambda e: e["other"] != F.col("id")), 1, most)
    rows = members.join(best, "rep").select("id", F.explode(rest).alias("e"))
    return rows.select("id", "e.other", (-F.col("e.far")).alias("score"))
