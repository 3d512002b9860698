"""Memory upkeep: inbox, promotion, association, decay, forgetting, index maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import decays, slugify
from .chunking import lines
from .knn import exact_topk
from .simjoin import BUCKET_ROWS, near_neighbours

#: Line beginnings that make a signature (fixed values).
SIGNATURES = ["pub fn ", "pub async fn ", "pub struct ", "pub enum ", "pub trait ", "pub type ", "pub const ", "pub static ", "fn ", "async fn ", "struct ", "enum ", "trait ", "impl ", "type ", "const ", "class ", "def ", "async def ", "func ", "function ", "export "]


def inbox(items: DataFrame, capacity: int, score: str = "attention_score", arrival: str = "arrival", by: list[str] | None = None) -> DataFrame:
    """The capacity best items, earlier arrivals first among equals: what pushing them one by one leaves."""
    if not by:
        return items.orderBy(F.desc(score), arrival).limit(capacity)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), arrival))
    return items.withColumn("place", nth).where(F.col("place") <= capacity)


def needs_consolidation(items: int, capacity: int, hours_since_last: float | None, auto_stale_days: int) -> bool:
    """Eight tenths full, or too long ago; a store never consolidated isn't stale."""
    return items * 10 >= capacity * 8 or hours_since_last is not None and hours_since_last / 24 > auto_stale_days


def code_cue(content: Column, max_chars: int) -> Column:
    """Signature lines until the byte budget is used up, else the beginning of the text."""
    signs = lambda x: reduce(Column.__or__, [F.startswith(F.trim(x), F.lit(p)) for p in SIGNATURES])
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + F.octet_length(x) + 1
        full = acc["full"] | (used > max_chars)
        return F.struct(F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"), F.when(full, acc["used"]).otherwise(used).alias("used"), full.alias("full"))

    kept = F.aggregate(F.filter(lines(content), signs), start, step, lambda acc: acc["kept"])
    cut = F.when(F.octet_length(content) > max_chars, F.concat(F.left(content, F.lit(max_chars)), F.lit("..."))).otherwise(content)
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("..."))).otherwise(cut)


def promote(items: DataFrame, max_chars: int = 480) -> DataFrame:
    """Inbox items (id, content, source, attention_score, created_at, file_source) to memory rows.

    Items whose slug and type collide overwrite each other, the last in order of arrival staying.
    """
    kind = F.when(F.col("source") == "learn", "reference").otherwise("feedback")
    code = F.col("file_source.kind") == "code"
    whole = F.octet_length("content") <= max_chars
    body = F.when(whole, F.col("content")).when(code, code_cue(F.col("content"), max_chars)).otherwise(F.concat(F.left("content", F.lit(max_chars)), F.lit("...")))
    span = F.concat_ws(":", "file_source.file", F.coalesce("file_source.start_line", F.lit(0)), F.coalesce("file_source.end_line", F.lit(0)))
    refs = F.when(F.col("file_source").isNull(), F.array().cast("array<string>")).otherwise(F.array(span))
    rows = items.select(slugify(F.col("id"), 4).alias("name"), kind.alias("type"), F.left("content", F.lit(120)).alias("description"), body.alias("body"), F.col("attention_score").alias("strength"), "created_at", "source", refs.alias("refs"), "arrival")
    last = F.row_number().over(Window.partitionBy("type", "name").orderBy(F.desc("arrival")))
    rows = rows.withColumn("nth", last).where("nth = 1").drop("nth", "arrival")
    return rows.withColumn("file", F.concat(F.col("type"), F.lit("_"), F.col("name"), F.lit(".md"))).withColumn("access_count", F.lit(0))


def associate(vectors: DataFrame, queries: DataFrame, threshold: float = 0.85, neighbours: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Pairs of near memories, each once: among each query's nearest neighbours, those at the threshold.

    queries is a stated set, which passes through the driver in blocks; associate_all() takes every row."""
    return _paired(exact_topk(vectors, queries, neighbours, id_col, vector_col, exclude_self=True), threshold)


def associate_all(vectors: DataFrame, threshold: float = 0.85, neighbours: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, bucket_rows: int = BUCKET_ROWS, exact: bool = False) -> DataFrame:
    """associate() with every row asking: all pairs with `exact`, else a join by bands of sign hashes whose recall is measured on drawn rows
    (see near_neighbours, which also tells what happens to odd rows); no vector comes to the driver but those."""
    near = near_neighbours(vectors, threshold, neighbours, id_col, vector_col, recall, bucket_rows, exact=exact)
    return _paired(near.select(F.col("id").alias("query_id"), F.col("other").alias("id"), "score"), threshold)


def _paired(near: DataFrame, threshold: float) -> DataFrame:
    near = near.where(F.col("score") >= threshold)
    return near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def link(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds both directions of the pairs (a, b of file names) to refs where they are missing."""
    both = pairs.select(F.col("a").alias("file"), F.col("b").alias("ref")).union(pairs.select("b", "a"))
    new = both.groupBy("file").agg(F.array_sort(F.collect_set("ref")).alias("new_refs"))
    joined = memories.join(new, "file", "left")
    return joined.withColumn("refs", F.when(F.col("new_refs").isNull(), F.col("refs")).otherwise(F.array_union("refs", "new_refs"))).drop("new_refs")


def decay_candidates(memories: DataFrame, now: str, decay_days: int = 90, protected: int = 5) -> DataFrame:
    """Memories that are old, weak and were read fewer than `protected` times."""
    return memories.where(decays(F.col("last_accessed"), F.col("created_at"), F.col("access_count"), F.col("strength"), F.col("type"), F.lit(now).cast("timestamp"), decay_days, protected))


def touch(memories: DataFrame, returned: DataFrame, now: str) -> DataFrame:
    """Counts an access of each memory that was returned directly."""
    hit = returned.select("file").distinct().withColumn("hit", F.lit(True))
    joined = memories.join(hit, "file", "left")
    seen = F.coalesce("hit", F.lit(False))
    return joined.withColumn("access_count", F.col("access_count") + seen.cast("int")).withColumn("last_accessed", F.when(seen, F.lit(now)).otherwise(F.col("last_accessed"))).drop("hit")


def upsert_memories(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """Whole-row replacement by file, with status created or updated."""
    old = memories.select("file").withColumn("old", F.lit(True))
    status = F.when(F.col("old"), "updated").otherwise("created")
    new = rows.join(old, "file", "left").withColumn("status", status).drop("old")
    return memories.join(rows.select("file"), "file", "left_anti").withColumn("status", F.lit("kept")).unionByName(new)


def add_entries(index: DataFrame, rows: DataFrame, max_lines: int = 200) -> DataFrame:
    """Index rows with new ones added; a file that is there already, or too many rows, is an error when read."""
    doubled = rows.join(index.select("file"), "file", "left_semi").agg(F.count("*").alias("doubled"))
    size = index.select("file").unionByName(rows.select("file")).agg(F.count("*").alias("size"))
    fault = F.when(F.col("doubled") > 0, "file is in the index already").when(F.col("size") > max_lines, "index is full")
    state = doubled.crossJoin(size).select(F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.lit(True)).alias("fine"))
    return index.unionByName(rows).crossJoin(F.broadcast(state)).where("fine").drop("fine")


def containing(rows: DataFrame, asked: list[str], columns: list[str], out: str, block: int = 500) -> DataFrame:
    """rows with each asked string (lower case) that one of the columns holds: a stated set of strings against
    all rows, in blocks that stand in the plan as literals."""
    text = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    found = None
    for at in range(0, max(len(asked), 1), block):
        names = F.array(*[F.lit(x) for x in asked[at : at + block]]).cast("array<string>")
        hit = F.filter(names, lambda x: reduce(Column.__or__, [F.contains(t, F.lower(x)) for t in text]))
        part = rows.withColumn(out, F.explode(hit))
        found = part if found is None else found.unionByName(part)
    return found


def resolve_forget(index: DataFrame, names: DataFrame, file: str = "file", name: str = "name") -> DataFrame:
    """What each asked name means: exact file, with .md, as the part after the type, or contained.

    The first three are joins by equality (a file has as many endings after its type as it has
    underscores); only names that none of them knows are looked for inside files, as a stated set in
    blocks. Rows: name, priority, matches, file (null unless there is one match), outcome.
    """
    asked = names.select(name).where(F.col(name).isNotNull()).distinct()
    at, parts = F.col(file), F.split(file, "_")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.when(i <= F.size(parts), F.array_join(F.slice(parts, i, F.size(parts)), "_")))
    bare = F.transform(F.array_compact(ends), lambda x: F.when(F.endswith(x, F.lit(".md")), F.left(x, F.length(x) - 3)))
    keys = F.flatten(F.array(F.array(F.struct(at.alias("key"), F.lit(1).alias("priority"))), F.when(F.endswith(at, F.lit(".md")), F.array(F.struct(F.left(at, F.length(at) - 3).alias("key"), F.lit(2).alias("priority")))).otherwise(F.array()), F.transform(F.array_compact(bare), lambda x: F.struct(x.alias("key"), F.lit(3).alias("priority")))))
    entries = index.select(file, F.explode(keys).alias("k")).select(file, F.col("k.key").alias(name), F.col("k.priority").alias("priority"))
    hits = asked.join(entries, name).select(name, file, "priority").distinct()
    rest = [r[0] for r in asked.join(hits, name, "left_anti").collect()]
    exact = containing_exactly(index.select(file), rest, file, name).select(name, file, F.lit(4).alias("priority"))
    hits = hits.unionByName(exact)
    best = hits.withColumn("r", F.rank().over(Window.partitionBy(name).orderBy("priority"))).where("r = 1").dropDuplicates([name, file])
    found = best.groupBy(name, "priority").agg(F.count("*").alias("matches"), F.min(file).alias("file"))
    outcome = F.when(F.col("matches").isNull(), "not found").when(F.col("matches") > 1, "ambiguous").otherwise("found")
    return asked.join(found, name, "left").select(name, "priority", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("file")).alias("file"), outcome.alias("outcome"))


def containing_exactly(rows: DataFrame, asked: list[str], column: str, out: str, block: int = 500) -> DataFrame:
    """rows with each asked string that a column holds, letter by letter; in blocks as containing()."""
    found = None
    for at in range(0, max(len(asked), 1), block):
        names = F.array(*[F.lit(x) for x in asked[at : at + block]]).cast("array<string>")
        part = rows.withColumn(out, F.explode(F.filter(names, lambda x: F.contains(F.col(column), x))))
        found = part if found is None else found.unionByName(part)
    return found
