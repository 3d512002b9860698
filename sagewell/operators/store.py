"""The store as tables: levels and their collisions, look-up and removal by name, index rows, the inbox as a file.

A store is a table of memories (file, body and what else there is) with a table of vectors by file. Each
function gives the table after the change; MemoryStore keeps both in a folder. Null names match nothing, an
empty table stays empty, other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import pinned
from . import embed
from .knn import exact_topk
from .lexical import text_search

#: Levels in the order in which they are read; of a file that several have, the last one counts.
LEVELS = ("project", "global")
#: Attention score of an item that is put off (a fixed value).
DEFERRED = 0.95


def union_levels(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of all levels with their level, in one table."""
    parts = [t.withColumn("level", F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def at_level(rows: DataFrame, level: str) -> DataFrame:
    """Rows of one level; any other word means both."""
    return rows.where(F.col("level") == level) if level in LEVELS else rows


def level_place(level: Column) -> Column:
    return reduce(lambda acc, i: F.when(level == LEVELS[i], i).otherwise(acc), range(len(LEVELS)), F.lit(-1))


def resolve(ranking: DataFrame, memories: DataFrame, key: str = "file") -> DataFrame:
    """A ranking's rows with the memory of their file; a file on several levels is the last level's for each
    of its places in the ranking."""
    last = Window.partitionBy(key).orderBy(F.desc(level_place(F.col("level"))))
    one = memories.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
    return ranking.join(one, key)


def first_containing(index: DataFrame, names: DataFrame, file: str = "file", place: str = "place", name: str = "name") -> DataFrame:
    """For each asked name the first index entry, by place, whose file contains it: name, file.

    Names are a stated set; they meet each entry as an array of literals."""
    asked = [r[0] for r in names.select(name).where(F.col(name).isNotNull()).distinct().collect()]
    hit = F.filter(F.array(*[F.lit(x) for x in asked]).cast("array<string>"), lambda x: F.contains(F.col(file), x))
    return index.select(file, place, F.explode(hit).alias(name)).groupBy(name).agg(F.min_by(file, place).alias(file))


def remove_first(index: DataFrame, names: DataFrame, file: str = "file", place: str = "place", name: str = "name") -> DataFrame:
    """The index without the entries that first_containing() finds."""
    return index.join(first_containing(index, names, file, place, name).select(file).distinct(), file, "left_anti")


def upsert_entries(index: DataFrame, rows: DataFrame, key: str = "file") -> DataFrame:
    """Index rows with new ones in place of those of the same file, and status kept, created or updated. Of
    several new rows of a file the last in order of all their columns stays; no size is checked."""
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in rows.columns if c != key] or [F.lit(0)])
    new = rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    old = index.select(key).distinct().withColumn("_old", F.lit(True))
    told = new.join(old, key, "left").withColumn("status", F.when(F.col("_old"), "updated").otherwise("created")).drop("_old")
    kept = index.join(new.select(key), key, "left_anti").withColumn("status", F.lit("kept"))
    return kept.unionByName(told, allowMissingColumns=True)


def forget(memories: DataFrame, vectors: DataFrame, files: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """Both tables without these files: a memory and its vector go together."""
    gone = files.select(key).distinct()
    return memories.join(gone, key, "left_anti"), vectors.join(gone, key, "left_anti")


def deferred(texts: DataFrame, id_col: str, text_col: str, now: str) -> DataFrame:
    """Texts put off for later as inbox items, all of one high score."""
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"), F.lit("deferred").alias("source"), F.lit(DEFERRED).alias("attention_score"), F.lit(now).alias("created_at"))


def requests(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON request lines as rows with `fault` null, or the reason why a line is none."""
    parsed = F.from_json(column, schema)
    bad = F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "empty request").when(F.try_parse_json(column).isNull(), "no JSON").when(~F.startswith(F.ltrim(column), F.lit("{")), "no object")
    rows = lines.select("*", parsed.alias("_r"), bad.alias("fault"))
    return rows.select(*lines.columns, "_r.*", "fault")


def reply(df: DataFrame, fault: str = "fault", keep: list[str] | None = None) -> DataFrame:
    """The envelope of each row: its data, or what was wrong with it; columns to keep stand beside it."""
    keep = keep or []
    data = [c for c in df.columns if c != fault and c not in keep]
    fine = F.to_json(F.struct(F.lit(True).alias("ok"), F.struct(*data).alias("data")))
    return df.select(*keep, F.when(F.col(fault).isNull(), fine).otherwise(F.to_json(F.struct(F.lit(False).alias("ok"), F.col(fault).alias("error")))).alias("value"))


class InboxFile:
    """The inbox as one JSON document in any folder that Spark writes: its capacity and its items.

    A missing file is an empty inbox of the default capacity; of one that is there, the stored capacity counts.
    """

    ITEM = "id string, content string, source string, attention_score double, created_at string, arrival bigint"

    def __init__(self, spark: SparkSession, path: str, capacity: int = 10):
        self.spark, self.path, self.default = spark, path, capacity

    def _stored(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(f"capacity int, items array<struct<{self.ITEM}>>").json(self.path)

    def load(self) -> tuple[int, DataFrame]:
        stored = self._stored()
        if stored is None:
            return self.default, self.spark.createDataFrame([], self.ITEM)
        return stored.select("capacity").first()[0], stored.select(F.explode("items").alias("i")).select("i.*")

    def save(self, items: DataFrame, capacity: int | None = None) -> None:
        """Keeps the capacity best items, earlier arrivals first among equals (an inbox is that small)."""
        capacity = capacity or self.load()[0]
        names = [x.split()[0] for x in self.ITEM.split(", ")]
        kept = pinned(items.select(*names).orderBy(F.desc("attention_score"), "arrival").limit(capacity))
        whole = kept.agg(F.array_sort(F.collect_list(F.struct(*names)), lambda a, b: F.when(a["attention_score"] != b["attention_score"], F.when(a["attention_score"] > b["attention_score"], -1).otherwise(1)).otherwise(F.when(a["arrival"] < b["arrival"], -1).otherwise(1))).alias("items"))
        whole.select(F.lit(capacity).alias("capacity"), "items").coalesce(1).write.mode("overwrite").json(self.path)

    def drain(self) -> DataFrame:
        """All items; the inbox is empty afterwards and keeps its capacity."""
        capacity, items = self.load()
        out = pinned(items)
        self.save(out.limit(0), capacity)
        return out


class MemoryStore:
    """Memories and their vectors as two tables in a folder, with what a caller of a store asks for."""

    def __init__(self, spark: SparkSession, folder: str, embedder: str = "hash"):
        self.spark, self.folder, self.embedder = spark, folder.rstrip("/"), embedder

    def _put(self, name: str, rows: DataFrame) -> None:
        pinned(rows).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def create(self, memories: DataFrame) -> None:
        self._put("memories", memories)
        none = self.spark.createDataFrame([], "file string, hash bigint, embedding array<float>")
        self._put("vectors", embed.sync(none, memories.select("file", F.col("body").alias("content")), self.embedder))

    def memories(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/memories")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")

    def get(self, names: DataFrame, place: str = "file") -> DataFrame:
        return self.memories().join(first_containing(self.memories().withColumn("_place", F.col(place)), names, place="_place"), "file")

    def store(self, rows: DataFrame) -> DataFrame:
        """Whole rows in place of those with the same file; returns file and status."""
        new = pinned(upsert_entries(self.memories(), rows))
        self._put("memories", new.drop("status"))
        return new.where("status <> 'kept'").select("file", "status")

    def remove(self, names: DataFrame) -> None:
        memories, vectors = (pinned(x) for x in forget(self.memories(), self.vectors(), self.get(names)))
        self._put("memories", memories)
        self._put("vectors", vectors)

    def sync(self) -> dict[str, int]:
        """Brings vectors in step with memories: how many there are and how many were embedded."""
        files = self.memories().select("file", F.col("body").alias("content"))
        work = embed.sync_plan(self.vectors(), files).groupBy("action").count()
        counts = {r["action"]: r["count"] for r in work.collect()}
        self._put("vectors", embed.sync(self.vectors(), files, self.embedder))
        return {"total": counts.get("keep", 0) + counts.get("embed", 0), "synced": counts.get("embed", 0)}

    def search_text(self, query: str) -> DataFrame:
        return text_search(self.memories(), query, "name", "description")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return exact_topk(self.vectors(), queries, k, "file", "embedding")
