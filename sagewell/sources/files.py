"""Readers and writers of memory files, index lines, code trees, conversations and answers."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import excluded
from . import ignore

MEMORY_TYPES = ("user", "feedback", "project", "reference")
MEMORY_SCHEMA = "name string, description string, type string, created_at string, last_accessed string, access_count int, strength float, consolidated_from array<string>, source string, refs array<string>, body string"
#: Path segments that a code scan leaves out by default: what begins with one of them (fixed values).
DEFAULT_EXCLUDES = [
    "dist", "build", "out", "_build",
    "node_modules", "vendor", ".venv", "venv",
    "target", "__pycache__", ".next", ".nuxt", ".turbo",
    "package-lock", "yarn.lock", "pnpm-lock", "cargo.lock", "poetry.lock",
    ".min.js", ".min.css", ".map", ".chunk.", ".bundle.",
]


def parse_memory(text: str) -> dict:
    """Front matter and body. The front matter ends at the next three hyphens, wherever they stand."""
    text = (text or "").strip()
    if not text.startswith("---") or "---" not in text[3:]:
        raise ValueError("no front matter")
    head, body = text[3:].split("---", 1)
    meta = yaml.safe_load(head) or {}
    if meta.get("type") not in MEMORY_TYPES:
        raise ValueError(f"unknown memory type {meta.get('type')!r}")
    as_text = lambda k: None if meta.get(k) is None else str(meta[k])
    return {"name": as_text("name"), "description": as_text("description"), "type": meta["type"], "created_at": as_text("created_at"), "last_accessed": as_text("last_accessed"), "access_count": int(meta.get("access_count") or 0), "strength": float(meta.get("strength") or 0), "consolidated_from": meta.get("consolidated_from"), "source": as_text("source"), "refs": list(meta.get("refs") or []), "body": body.strip()}


def read_memories(spark: SparkSession, folder: str) -> DataFrame:
    """All memory files of a folder but its index, with the file name."""
    parse = F.udf(lambda t: None if t is None else parse_memory(t), MEMORY_SCHEMA)
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), "value")
    memory = F.when(F.col("file") != "MEMORY.md", F.col("value"))  # the index never meets the parser
    return files.select("file", parse(memory).alias("m")).where("m is not null").select("file", "m.*")


def memory_text(row: dict) -> str:
    """A memory as the text of its file."""
    keys = ("name", "description", "type", "created_at", "last_accessed", "access_count", "strength", "consolidated_from", "source", "refs")
    meta = {k: row[k] for k in keys if row.get(k) not in (None, [])}
    return f"---\n{yaml.safe_dump(meta, sort_keys=False, allow_unicode=True)}---\n\n{row['body']}\n"


def write_memories(memories: DataFrame, folder: str) -> None:
    """One file per memory, in any store that Spark writes; names that leave the folder are refused.

    Spark writes each memory's text to a folder of its name beside the others; a rename, which moves no data,
    puts it in its place. An index has as few lines as a person reads, so there are as few files. Of
    several rows of one file one stays."""
    bad = F.contains("file", F.lit("..")) | F.contains("file", F.lit("/"))
    text = F.udf(lambda m: memory_text(m.asDict()), "string")
    safe = memories.withColumn("file", F.when(bad, F.raise_error(F.concat(F.lit("path escape: "), "file"))).otherwise(F.col("file")))
    spark, beside = memories.sparkSession, f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    rows = safe.select("file", F.rtrim(text(F.struct(*memories.columns))).alias("value")).dropDuplicates(["file"])
    rows.write.partitionBy("file").text(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(beside).getFileSystem(spark._jsc.hadoopConfiguration())
    for written in store.globStatus(path(f"{beside}/file=*/part-*")):
        at = path(f"{folder.rstrip('/')}/{unquote(written.getPath().getParent().getName().removeprefix('file='))}")
        store.delete(at, False)
        store.rename(written.getPath(), at)
    store.delete(path(beside), True)


def write_index(memories: DataFrame, path: str, order: str = "file") -> None:
    """The index file's lines in order, line ends within a summary as spaces (a line is an entry)."""
    flat = memories.withColumn("description", F.regexp_replace("description", r"[\r\n]+", " "))
    lines = index_lines(flat.orderBy(order).coalesce(1))
    lines.write.mode("overwrite").text(path)


def parse_index_line(line: Column) -> Column:
    """title, file and summary of an index line; null where it is malformed."""
    pattern = r"^\s*- \[([^\]]*)\]\(([^)]*)\)\s*(?:—|-)\s*(.*)$"
    parts = [F.regexp_extract(line, pattern, i) for i in (1, 2, 3)]
    return F.when(line.rlike(pattern), F.struct(parts[0].alias("title"), parts[1].alias("file"), F.trim(parts[2]).alias("summary")))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(parse_index_line(F.col("value")).alias("x")).where("x is not null").select("x.*")


def index_lines(memories: DataFrame) -> DataFrame:
    """The index as text lines: title from the name, file, first line of the description."""
    title = F.replace("name", F.lit("-"), F.lit(" "))
    return memories.select(F.concat(F.lit("- ["), title, F.lit("]("), "file", F.lit(") — "), F.coalesce("description", F.lit(""))).alias("value"))


def read_code(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, ignore_rules: list[str] | None = None, ignore_files: bool = True) -> DataFrame:
    """Text files below root: file (relative path) and content.

    Hidden files, excluded segments, what ignore files in the tree (or ignore_rules, as if they stood in the root
    before its own) leave out and files that are no UTF-8 aren't among them; include globs, if given, are the only
    ones kept. Spark lists and reads the files, so root may be any store it reads.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://")[-1].rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    named = files.withColumn("file", relative).where(~F.exists(F.split("file", "/"), lambda s: F.startswith(s, F.lit("."))))
    named = named.where(~excluded(F.col("file"), DEFAULT_EXCLUDES if exclude is None else exclude))
    if include:
        globs = F.array(*[F.lit(g) for g in include])
        named = named.where(F.exists(F.transform(globs, lambda g: ignore.glob_regex(F.when(F.contains(g, F.lit("/")), g).otherwise(F.concat(F.lit("**/"), g)))), lambda r: F.rlike(F.col("file"), r)))
    lines = spark.createDataFrame([("", i - len(ignore_rules or []), x) for i, x in enumerate(ignore_rules or [])], "folder string, place int, line string")
    if ignore_files:
        lines = lines.unionByName(ignore.read_rules(spark, root))
    if ignore_rules or ignore_files:
        named = named.join(ignore.ignored(named.select("file"), ignore.parse_rules(lines)), "file", "left_anti")
    return named.where(F.is_valid_utf8(F.col("content").cast("string"))).select("file", F.col("content").cast("string").alias("content"))


def user_text(turns: str = "turns") -> Column:
    """What the user said in a session, in order."""
    said = F.filter(turns, lambda t: t["role"] == "user")
    return F.array_join(F.transform(said, lambda t: t["content"]), " ")


def transcript(turns: str = "turns", date: str | None = None) -> Column:
    """All turns of a session; with its date, where it has one, in a line before them."""
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return text if date is None else F.concat(F.coalesce(F.concat(F.lit("[Date: "), F.col(date).cast("string"), F.lit("]\n")), F.lit("")), text)


def answer_text(raw: Column) -> Column:
    """An answer of any JSON kind as text: strings as they are, the strings of an array joined (its other
    elements are dropped; an array without strings is null), null as null."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    strings = F.filter(F.from_json(raw, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    array = F.array_join(F.transform(strings, lambda x: F.variant_get(x, "$", "string")), ", ")
    plain = F.try_variant_get(F.try_parse_json(raw), "$", "string")
    return F.when(kind.isNull() | (kind == "VOID"), None).when(kind == "STRING", plain).when(F.startswith(kind, F.lit("ARRAY")), F.nullif(array, F.lit(""))).otherwise(F.coalesce(plain, raw))


TURNS = "array<struct<role:string,content:string>>"
LONGMEM_SCHEMA = f"question_id string, question_type string, question_date string, question string, answer string, answer_session_ids array<string>, evidence_session_ids array<string>, gold_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<{TURNS}>, sessions map<string,{TURNS}>, queries array<struct<question:string,answer:string,gold_session_ids:array<string>,answer_session_ids:array<string>,evidence_session_ids:array<string>>>"


def read_conversation_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sessions (session_id, turns, date; the first one of an id wins) and queries of a conversational benchmark.

    Three layouts: entries with session ids and sessions side by side, which must be as many, else reading
    fails; entries with a map of sessions; one object with a map of sessions and a list of queries. Only the
    first names haystacks and dates; a haystack without names is empty.
    """
    raw = spark.read.schema(LONGMEM_SCHEMA).option("multiLine", True).json(path).withColumn("entry", F.monotonically_increasing_id())
    same = F.coalesce(F.size("haystack_session_ids") == F.size("haystack_sessions"), F.lit(False))
    ids = F.when(F.col("haystack_sessions").isNull(), F.array().cast("array<string>")).when(same, F.col("haystack_session_ids")).otherwise(F.raise_error(F.lit("ids and sessions differ in number")))
    checked = raw.withColumn("ids", ids)
    beside = F.arrays_zip(F.col("ids").alias("id"), F.coalesce("haystack_sessions", F.array().cast(f"array<{TURNS}>")).alias("turns"), F.coalesce("haystack_dates", F.array().cast("array<string>")).alias("date"))
    mapped = F.transform(F.map_entries(F.coalesce("sessions", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{TURNS}>")))), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("turns"), F.lit(None).cast("string").alias("date")))
    pairs = checked.select("entry", F.posexplode(F.concat(F.filter(beside, lambda x: x["id"].isNotNull()), mapped)).alias("pos", "x"))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("entry", "pos"))
    sessions = pairs.select("entry", "pos", F.col("x.id").alias("session_id"), F.col("x.turns").alias("turns"), F.col("x.date").alias("date")).withColumn("n", first).where("n = 1").select("session_id", "turns", "date")
    gold = lambda p: F.coalesce(f"{p}answer_session_ids", f"{p}evidence_session_ids", f"{p}gold_session_ids", F.array().cast("array<string>")).alias("gold_ids")
    own = checked.where("queries is null").select(F.coalesce("question_id", F.concat(F.lit("q"), F.col("entry"))).alias("query_id"), "question_type", "question_date", "question", "answer", gold(""), F.col("ids").alias("haystack_ids"), F.col("haystack_dates").alias("dates"))
    none = F.lit(None).cast("string")
    listed = checked.select("entry", F.posexplode("queries").alias("pos", "q")).select(F.concat_ws("-", F.lit("q"), "entry", "pos").alias("query_id"), none.alias("question_type"), none.alias("question_date"), "q.question", "q.answer", gold("q."), F.array().cast("array<string>").alias("haystack_ids"), F.lit(None).cast("array<string>").alias("dates"))
    return sessions, own.union(listed)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer lines of a question answering run; blank lines are skipped."""
    return spark.read.schema("question_id string, question_type string, question string, gold_answer string, model_answer string").json(path)


def envelope(df: DataFrame) -> DataFrame:
    """Rows as the JSON envelope that command-line callers print."""
    return df.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.struct(*df.columns).alias("data"))).alias("value"))
