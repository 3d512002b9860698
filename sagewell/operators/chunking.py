"""Line-based chunking of texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines of a text; one trailing line end makes no further line, an empty text has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", "")
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, "\r?\n"))


def _bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once per row, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _chunk_rows(df: DataFrame, file: str, text: str, spans: Callable[[Column], Column]) -> DataFrame:
    """One row per span (s, e: 0-based, inclusive) of a text's lines; blank ones are dropped."""

    def chunks(l: Column) -> Column:  # noqa: E741
        return F.transform(spans(l), lambda x: F.struct((x["s"] + 1).cast("int").alias("start_line"), (x["e"] + 1).cast("int").alias("end_line"), F.array_join(F.slice(l, x["s"] + 1, x["e"] - x["s"] + 1), "\n").alias("content")))

    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, _bind(lines(F.col(text)), chunks).alias("chunks")).select(*keep, F.explode("chunks").alias("x")).select(*keep, "x.*")
    return rows.where(F.col("content").rlike(r"\S")).withColumn("chunk_id", F.concat_ws(":", file, "start_line", "end_line"))


def fixed_chunks(df: DataFrame, file: str, text: str, size: int = 100, overlap: int = 10, min_lines: int = 3) -> DataFrame:
    """Windows of size lines, overlapping; the first one that reaches the end is the last."""
    step = max(size - overlap, 1)

    def spans(l: Column) -> Column:  # noqa: E741
        n = F.size(l)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
        found = F.transform(starts, lambda s: F.struct(s.alias("s"), (F.least(s + size, n) - 1).alias("e")))
        return F.when(n >= max(min_lines, 1), found).otherwise(F.array().cast("array<struct<s:int,e:int>>"))

    return _chunk_rows(df, file, text, spans)


def paragraph_spans(line_array: Column) -> Column:
    """Maximal runs of lines that aren't blank, as array of struct(s, e)."""

    def runs(filled: Column) -> Column:
        at = F.transform(filled, lambda f, i: F.when(f, i))
        ends = lambda shift: F.array_compact(F.transform(at, lambda i: F.when(i.isNotNull() & ~F.coalesce(F.get(filled, i + shift), F.lit(False)), i)))
        return F.zip_with(ends(-1), ends(1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    return _bind(F.transform(line_array, lambda x: x.rlike(r"\S")), runs)


def paragraph_chunks(df: DataFrame, file: str, text: str, max_lines: int = 100, min_lines: int = 3, overlap: int = 10) -> DataFrame:
    """Neighbouring paragraphs while they span max_lines at most (blank lines between count); a longer
    paragraph is cut into overlapping windows. Only the last run of a text is held to min_lines."""
    if overlap >= max_lines:
        raise ValueError("overlap must be smaller than max_lines")
    span = "struct<s:int,e:int>"
    none = F.lit(None).cast(span)
    start = F.struct(F.array().cast(f"array<{span}>").alias("out"), none.alias("run"))
    make = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    flush = lambda acc: F.when(acc["run"].isNotNull(), F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"])

    def windows(p: Column) -> Column:
        step, n = max_lines - overlap, p["e"] - p["s"] + 1
        count = F.ceil((n - max_lines) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda i: make(p["s"] + i * step, F.least(p["s"] + i * step + max_lines - 1, p["e"])))

    def step(acc: Column, p: Column) -> Column:
        long = p["e"] - p["s"] + 1 > max_lines
        joins = acc["run"].isNotNull() & (p["e"] - acc["run"]["s"] + 1 <= max_lines)
        return (
            F.when(long, F.struct(F.concat(flush(acc), windows(p)).alias("out"), none.alias("run")))
            .when(joins, F.struct(acc["out"].alias("out"), make(acc["run"]["s"], p["e"]).alias("run")))
            .otherwise(F.struct(flush(acc).alias("out"), make(p["s"], p["e"]).alias("run")))
        )

    def end(acc: Column) -> Column:
        return F.when(acc["run"].isNotNull() & (acc["run"]["e"] - acc["run"]["s"] + 1 >= min_lines), flush(acc)).otherwise(acc["out"])

    def spans(l: Column) -> Column:  # noqa: E741
        found = F.aggregate(paragraph_spans(l), start, step, end)
        return F.when(F.size(l) >= min_lines, found).otherwise(F.array().cast(f"array<{span}>"))

    return _chunk_rows(df, file, text, spans)


def custom_chunks(df: DataFrame, file: str, text: str, strategy: Callable[[str, str], list[tuple[int, int, str]]], by_file: bool = False) -> DataFrame:
    """Plug-in: strategy(text, file) gives (start_line, end_line, content) of each chunk.

    A table function takes Arrow batches of the rows and gives chunks with the rows' other columns. by_file deals
    all rows of a file to one task, for strategies that keep something between a file's rows; others need no
    shuffle. Null texts are empty."""
    keep, kinds = [c for c in df.columns if c != text], dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "start_line int", "end_line int", "content string"])

    class Chunks:
        def eval(self, batch: pa.RecordBatch):
            texts, names = batch.column(text).to_pylist(), batch.column(file).to_pylist()
            found = [(i, x) for i, (t, f) in enumerate(zip(texts, names, strict=True)) for x in strategy(t or "", "" if f is None else str(f))]
            of = pa.array([i for i, _ in found], pa.int32())
            columns = [batch.column(c).take(of) for c in keep]
            columns += [pa.array([x[k] for _, x in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.Table.from_arrays(columns, names=[*keep, "start_line", "end_line", "content"])

    rows = df.asTable()
    out = F.arrow_udtf(Chunks, returnType=schema)(rows.partitionBy(file) if by_file else rows)
    return out.withColumn("chunk_id", F.concat_ws(":", file, "start_line", "end_line"))


def resolve(hits: DataFrame, chunks: DataFrame, hit_id: str = "id") -> DataFrame:
    """Hits with their chunks; ids without a chunk vanish."""
    return hits.join(chunks, hits[hit_id] == chunks["chunk_id"])
