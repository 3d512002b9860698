"""Inverted-file cells on two levels: fitted by sums on the cluster, assigned by two narrow matrix products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import pinned
from .knn import ROWS_AT_ONCE, _matrix, _slices, _unit, exact_topk, lloyd, lloyd_on_cluster, nearest_cell, search_cells, search_listed

#: Cells of the upper level, and of the lower level in each of them: no matrix is wider.
MOST_CELLS = 4096
#: Rows that the cells are fitted on for each cell.
ROWS_A_CELL = 64
#: Numbers of the lower level's centroids up to which all of them are broadcast.
BROADCAST_NUMBERS = 1 << 22


def shape(rows: int) -> tuple[int, int]:
    """Cells of the upper level and rows that a cell of the lower level should hold: both the cube root of the
    number of rows, so that a row is compared with twice the cube root of centroids."""
    root = max(1, round(rows ** (1 / 3)))
    return min(root, MOST_CELLS), root


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0))


class CellTree:
    """Two levels of cells: `top`, a small matrix on the driver, and a table `fine` (top, place, centroid) with
    the cells of each upper cell, of which a large one has more. A cell's number is top * MOST_CELLS + place.

    Vectors have one length. Null and empty vectors are in no cell; a vector with a null or not finite component,
    or of another length, counts as zero, which is in the last cell of the last upper one, as all its cosines are
    equal. An index of no rows has no cells."""

    def __init__(self, spark: SparkSession, top: np.ndarray, fine: DataFrame, id_col: str, vector_col: str):
        self.spark, self.top, self.fine, self.id, self.vector = spark, top, fine, id_col, vector_col
        self._all: list[np.ndarray] | None = None

    @classmethod
    def fit(cls, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", iterations: int = 10, top_cells: int | None = None, rows_a_cell: int | None = None) -> CellTree:
        """Fits the upper cells on ROWS_A_CELL rows each and an upper cell's lower cells on as many for each of
        them, those with the smallest hashes of their ids (all rows, where there are fewer); the first rows by
        id are the centroids to begin with, on both levels."""
        spark, rows = vectors.sparkSession, _usable(vectors, id_col, vector_col)
        n = rows.count()
        tops, target = shape(n)
        tops, target = min(top_cells or tops, MOST_CELLS), rows_a_cell or target
        first = [r["vector"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(tops).select("vector").collect()]
        if not first:
            return cls(spark, np.zeros((0, 0)), spark.createDataFrame([], "top int, place int, centroid array<double>"), id_col, vector_col)
        hashed = F.xxhash64(F.col("id").cast("string"))
        wanted = tops * ROWS_A_CELL
        sample = pinned(rows.where(F.pmod(hashed, F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, wanted / n))) if n > wanted else rows)
        top = lloyd_on_cluster(sample, _matrix(pa.array(first, pa.list_(pa.float64()))), iterations)
        placed = assign_top(rows, top)
        counts = placed.groupBy("top").agg(F.count("*").alias("rows")).withColumn("cells", F.least(F.lit(MOST_CELLS), F.ceil(F.col("rows") / target).cast("int")))
        nth = F.row_number().over(Window.partitionBy("top").orderBy(hashed, "id"))
        # the bound of a group is stated before it is gathered: Spark limits groups ahead of the shuffle
        some = placed.withColumn("nth", nth).where(F.col("nth") <= MOST_CELLS * ROWS_A_CELL).join(F.broadcast(counts), "top").where(F.col("nth") <= F.col("cells") * ROWS_A_CELL)

        def fit(table: pa.Table) -> pa.Table:
            table = table.sort_by([("id", "ascending")])
            m = _matrix(table.column("vector").combine_chunks(), top.shape[1])
            c = lloyd(m, m[: table.column("cells")[0].as_py()].copy(), iterations)
            return pa.table([pa.array([table.column("top")[0].as_py()] * len(c), pa.int32()), pa.array(range(len(c)), pa.int32()), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["top", "place", "centroid"])

        fine = pinned(some.select("top", "id", "vector", "cells").groupBy("top").applyInArrow(fit, "top int, place int, centroid array<double>"))
        return cls(spark, top, fine, id_col, vector_col)

    def __len__(self) -> int:
        """Cells of the lower level."""
        return self.fine.count()

    def _small(self) -> list[np.ndarray] | None:
        """The lower centroids of every upper cell, if they are few enough to be broadcast."""
        if self._all is None and self.fine.count() * max(1, self.top.shape[1]) <= BROADCAST_NUMBERS:
            of: dict[int, list] = {}
            for r in sorted(self.fine.collect()):
                of.setdefault(r["top"], []).append(r["centroid"])
            self._all = [np.array(of.get(t, [self.top[t]]), float) for t in range(len(self.top))]
        return self._all

    def assign(self, vectors: DataFrame, rows_per_slice: int = 50_000) -> DataFrame:
        """id, vector, cell. While the lower centroids are few they are broadcast and nothing is shuffled; beyond
        that rows meet those of their upper cell, large ones dealt to slices."""
        kinds, rows = dict(vectors.dtypes), _usable(vectors, self.id, self.vector)
        names = [F.col("id").alias(self.id), F.col("vector").alias(self.vector), "cell"]
        if not len(self.top):
            return rows.limit(0).withColumn("cell", F.lit(0).cast("bigint")).select(*names)
        schema = f"id {kinds[self.id]}, vector {kinds[self.vector]}, cell bigint"
        if (small := self._small()) is not None:
            shared = self.spark.sparkContext.broadcast((self.top, small))

            def both(batches):
                top, fine = shared.value
                for b in _slices(batches, ROWS_AT_ONCE):
                    m = _matrix(b.column(1), top.shape[1])
                    t = nearest_cell(m, top)
                    cell = np.zeros(len(m), np.int64)
                    for x in np.unique(t).tolist():
                        own = t == x
                        cell[own] = x * MOST_CELLS + nearest_cell(m[own], fine[x])
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["id", "vector", "cell"])

            return rows.mapInArrow(both, schema).select(*names)
        placed = assign_top(rows, self.top)
        slices = placed.groupBy("top").agg(F.ceil(F.count("*") / rows_per_slice).cast("int").alias("slices"))
        left = placed.join(F.broadcast(slices), "top").withColumn("slice", F.pmod(F.xxhash64("id", "vector"), F.col("slices")).cast("int"))
        right = self.fine.join(F.broadcast(slices), "top").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

        def lower(key, a: pa.Table, b: pa.Table) -> pa.Table:
            if not (a.num_rows and b.num_rows):
                return pa.table([a.column("id").slice(0, 0), a.column("vector").slice(0, 0), pa.array([], pa.int64())], names=["id", "vector", "cell"])
            b = b.sort_by([("place", "ascending")])
            c = _matrix(b.column("centroid").combine_chunks())
            cells = [nearest_cell(_matrix(x.column("vector").combine_chunks(), c.shape[1]), c) for x in _slices([a], ROWS_AT_ONCE)]
            return pa.table([a.column("id"), a.column("vector"), pa.array(np.concatenate(cells).astype(np.int64) + key[0].as_py() * MOST_CELLS)], names=["id", "vector", "cell"])

        return left.select("top", "slice", "id", "vector").groupBy("top", "slice").cogroup(right.select("top", "slice", "place", "centroid").groupBy("top", "slice")).applyInArrow(lower, schema).select(*names)

    def probes(self, queries: DataFrame, n_probe: int, n_top: int | None = None) -> DataFrame:
        """query_id, q, cell: of the cells in a query's n_top nearest upper cells, the n_probe nearest."""
        n_top = min(n_top or max(1, math.ceil(math.sqrt(n_probe)) * 2), max(1, len(self.top)))
        kinds = dict(queries.dtypes)
        asked = queries.select(F.col(self.id).alias("query_id"), F.col(self.vector).alias("q")).where("q is not null")
        shared = self.spark.sparkContext.broadcast(self.top)

        def upper(batches):
            for b in _slices(batches, ROWS_AT_ONCE):
                best = np.argsort(-(_unit(_matrix(b.column(1), shared.value.shape[1])) @ _unit(shared.value).T), axis=1, kind="stable")[:, :n_top]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "tops"])

        near = asked.mapInArrow(upper, f"query_id {kinds[self.id]}, q {kinds[self.vector]}, tops array<int>").select("query_id", "q", F.explode("tops").alias("top"))

        def lower(key, a: pa.Table, b: pa.Table) -> pa.Table:
            out = [pa.table([a.column("query_id").slice(0, 0), a.column("q").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "q", "cell", "near"])]
            if b.num_rows:
                b = b.sort_by([("place", "ascending")])
                c = _unit(_matrix(b.column("centroid").combine_chunks()))
                for x in _slices([a], ROWS_AT_ONCE):
                    s = _unit(_matrix(x.column("q").combine_chunks(), c.shape[1])) @ c.T
                    best = np.argsort(-s, axis=1, kind="stable")[:, :n_probe]
                    i = np.repeat(np.arange(len(s)), best.shape[1])
                    j = best.ravel()
                    out.append(pa.table([x.column("query_id").take(pa.array(i)), x.column("q").take(pa.array(i)), pa.array(j.astype(np.int64) + key[0].as_py() * MOST_CELLS), pa.array(s[i, j])], names=["query_id", "q", "cell", "near"]))
            return pa.concat_tables(out)

        found = near.groupBy("top").cogroup(self.fine.groupBy("top")).applyInArrow(lower, f"query_id {kinds[self.id]}, q {kinds[self.vector]}, cell bigint, near double")
        order = Window.partitionBy("query_id", "q").orderBy(F.desc("near"), "cell")
        return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n_probe).select("query_id", "q", "cell")

    def search(self, cells: DataFrame, queries: DataFrame, k: int, n_probe: int | None = 10, n_top: int | None = None, exclude_self: bool = False) -> DataFrame:
        """The k best rows of `cells` (what assign() gave) in each query's probed cells: query_id, id, score, rank.
        With n_probe None these are all cells, however many there are: queries meet every row, and no cell is listed."""
        if n_probe is None:
            return exact_topk(cells, queries, k, self.id, self.vector, exclude_self)
        if (listed := self._listed(queries, n_probe, n_top)) is None:
            return search_cells(cells, self.probes(queries, n_probe, n_top), k, self.id, self.vector, exclude_self)
        return search_listed(cells, listed, k, self.id, self.vector, exclude_self, numbers=self._numbers())

    def _numbers(self) -> np.ndarray:
        return np.concatenate([t * MOST_CELLS + np.arange(len(c)) for t, c in enumerate(self._small())])

    def _listed(self, queries: DataFrame, n_probe: int, n_top: int | None) -> DataFrame | None:
        """probes() with a bit for each cell of _numbers(), while the lower centroids are few enough to be broadcast."""
        if not len(self.top) or (small := self._small()) is None:
            return None
        kinds, n_top = dict(queries.dtypes), min(n_top or max(1, math.ceil(math.sqrt(n_probe)) * 2), len(self.top))
        asked = queries.select(F.col(self.id).alias("query_id"), F.col(self.vector).alias("q")).where("q is not null")
        shared = self.spark.sparkContext.broadcast((self.top, np.concatenate(small), self._numbers() // MOST_CELLS))

        def nearest(batches):
            top, fine, of = shared.value
            for b in _slices(batches, 512):
                q = _unit(_matrix(b.column(1), top.shape[1]))
                best = np.argsort(-(q @ _unit(top).T), axis=1, kind="stable")[:, :n_top]
                chosen = np.zeros((len(q), len(top)), bool)
                np.put_along_axis(chosen, best, True, 1)
                chosen = chosen[:, of]
                if len(many := np.flatnonzero(chosen.sum(1) > n_probe)):
                    order = np.argsort(np.where(chosen[many], -(q[many] @ _unit(fine).T), np.inf), axis=1, kind="stable")
                    chosen[many] = False
                    chosen[many[:, None], order[:, :n_probe]] = True
                lists = [x.tobytes() for x in np.packbits(chosen, axis=1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.binary())], names=["query_id", "q", "cells"])

        return asked.mapInArrow(nearest, f"query_id {kinds[self.id]}, q {kinds[self.vector]}, cells binary")


def assign_top(rows: DataFrame, top: np.ndarray) -> DataFrame:
    """Rows (id, vector) with their upper cell."""
    shared, kinds = rows.sparkSession.sparkContext.broadcast(top), dict(rows.dtypes)

    def work(batches):
        for b in _slices(batches, ROWS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest_cell(_matrix(b.column(1), shared.value.shape[1]), shared.value).astype(np.int32))], names=["id", "vector", "top"])

    return rows.mapInArrow(work, f"id {kinds['id']}, vector {kinds['vector']}, top int")
