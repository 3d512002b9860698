"""The inbox as a stream: each key keeps its best items, whatever order batches come in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.lifecycle import inbox, needs_consolidation

STATE = "key string, id string, attention_score double, arrival bigint"


def start_inbox(items: DataFrame, path: str, checkpoint: str, capacity: int) -> StreamingQuery:
    """Items (key, id, attention_score, arrival) stream into a table of the best `capacity` per key.

    Each micro-batch is cut to its own best rows, merged with the table of the batch before and written
    as the next version; the version's name is the batch number, so a batch that runs again overwrites
    its own output only. The table's size is keys times capacity, whatever has streamed through.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = inbox(batch.select("key", "id", "attention_score", "arrival"), capacity, by=["key"]).drop("place")
        if number:
            best = best.unionByName(spark.read.schema(STATE).parquet(f"{path}/{number - 1}"))
        inbox(best, capacity, by=["key"]).drop("place").write.mode("overwrite").parquet(f"{path}/{number}")

    return items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type, for batch or stream; late rows beyond the watermark are left out by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: The state store that keyed state needs (a setting of Spark).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "key string, version bigint, event string, place int, id string, attention_score double, arrival bigint"


class BestItems(StatefulProcessor):
    """Keeps a key's best items as its state, and a timer that rings when nothing came for a while.

    The state never holds more than `capacity` items. Each batch that brings items for a key gives its whole inbox
    (event `full` if it is eight tenths full, else `items`), numbered by a version; a timer that rings gives one row
    without an item (event `stale`)."""

    def __init__(self, capacity: int, stale_ms: int | None):
        self.capacity, self.stale_ms = capacity, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "version bigint, ids array<string>, scores array<double>, arrivals array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        version, ids, scores, arrivals = self.best.get() if self.best.exists() else (0, [], [], [])
        held = list(zip(ids, scores, arrivals, strict=True))
        for part in rows:
            held += zip(part["id"].tolist(), part["attention_score"].tolist(), part["arrival"].tolist(), strict=True)
            held = sorted(held, key=lambda x: (-x[1], x[2]))[: self.capacity]
        version += 1
        self.best.update((version, *([x[i] for x in held] for i in range(3))))
        if self.stale_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)
        event = "full" if needs_consolidation(len(held), self.capacity, None, 0) else "items"
        n = len(held)
        yield pd.DataFrame({"key": [key[0]] * n, "version": [version] * n, "event": [event] * n, "place": list(range(1, n + 1)), "id": [x[0] for x in held], "attention_score": [x[1] for x in held], "arrival": [x[2] for x in held]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        version = self.best.get()[0] if self.best.exists() else 0
        yield pd.DataFrame({"key": [key[0]], "version": [version], "event": ["stale"], "place": [0], "id": [None], "attention_score": [float("nan")], "arrival": [0]})


def start_keyed_inbox(items: DataFrame, path: str, checkpoint: str, capacity: int, stale_days: float | None = None, **trigger) -> StreamingQuery:
    """Items (key, id, attention_score, arrival) stream into keyed state; what changes is appended to a table (see
    BestItems), from which current_inbox() takes the last version of each key. Unlike start_inbox(), a batch reads
    and writes the keys that it brings items for, not all of them. Null scores are the worst, rows with null keys
    are a key of their own. With stale_days timers run by the clock: Spark then makes batches as long as the query
    runs, so that it needs a trigger other than availableNow, which is the one without."""
    items.sparkSession.conf.set(*STATE_STORE)
    rows = items.select("key", "id", F.coalesce("attention_score", F.lit(float("-inf"))).alias("attention_score"), "arrival")
    changes = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=BestItems(capacity, None if stale_days is None else int(stale_days * 86_400_000)), outputStructType=CHANGES, outputMode="Append", timeMode="None" if stale_days is None else "ProcessingTime")
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def current_inbox(changes: DataFrame) -> DataFrame:
    """The last version of every key: key, id, attention_score, arrival, place."""
    items = changes.where("event <> 'stale'")
    last = items.groupBy("key").agg(F.max("version").alias("version"))
    same = items["key"].eqNullSafe(last["key"]) & (items["version"] == last["version"])
    return items.join(last, same, "left_semi").select("key", "id", "attention_score", "arrival", "place")
