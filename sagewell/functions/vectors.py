"""Vector kernels as Column expressions over arrays; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def let(value: Column, then) -> Column:
    """then(value) with value computed once: inside a lambda Spark computes an expression anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_squared(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: ColumnOrName, b: ColumnOrName, lengths_may_differ: bool = False) -> Column:
    """Zero where either norm is zero and, if asked for, where lengths differ."""
    length = norm(a) * norm(b)
    value = F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.lit(0.0)) if lengths_may_differ else value


def normalize(a: ColumnOrName) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(a), lambda length: F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))))


def mean_vector(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Mean of each position, per group: partial sums before the shuffle, one narrow row per position."""
    by = by or []
    long = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    means = long.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return means.groupBy(*by).agg(ordered.alias("mean"))


def mean_center(df: DataFrame, vector: str, out: str = "centered") -> DataFrame:
    """Subtracts the column means and normalises again. The mean is one row of the vectors' length."""
    mean = mean_vector(df, vector)
    return df.crossJoin(F.broadcast(mean)).withColumn(out, normalize(F.zip_with(vector, "mean", lambda x, m: x - m))).drop("mean")
