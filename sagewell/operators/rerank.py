"""Reranking of candidates: floor, fallback, normalising, signals, diversity, budget, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import metadata_score

#: Profile of a store that was never calibrated.
UNCALIBRATED = {"similarity_floor": 0.30, "semantic_confidence": 0.5}
FALLBACK_FLOOR, FALLBACK_ROWS = 0.25, 3
PER_SOURCE = 2


def floor_filter(candidates: DataFrame, similarity_floor: Column | float) -> DataFrame:
    """Candidates at or above the floor; a query left with none keeps its best three over the fallback floor.

    Columns query_id, id, cosine; ties keep the order of pos, the candidates' input position.
    """
    passes = F.coalesce(F.col("cosine") >= similarity_floor, F.lit(False))
    query = Window.partitionBy("query_id")
    marked = candidates.withColumn("passes", passes).withColumn("any_pass", F.max("passes").over(query))
    marked = marked.withColumn("place", F.row_number().over(query.orderBy(F.desc("cosine"), "pos")))
    backup = ~F.col("any_pass") & (F.col("cosine") >= FALLBACK_FLOOR) & (F.col("place") <= FALLBACK_ROWS)
    return marked.where(F.col("passes") | backup).drop("passes", "any_pass", "place")


def rerank(candidates: DataFrame, similarity_floor: Column | float = UNCALIBRATED["similarity_floor"], semantic_confidence: Column | float = UNCALIBRATED["semantic_confidence"], per_source: int = PER_SOURCE) -> DataFrame:
    """Final score and rank of candidates, at most per_source of one source file for each query.

    Columns: query_id, id, pos, cosine, source_file, strength, age_days, source, ref_count; strength
    is null for what is no memory. Adds norm, meta, final_score, rank.
    """
    query = Window.partitionBy("query_id")
    kept = floor_filter(candidates, similarity_floor)
    low, high = F.min("cosine").over(query), F.max("cosine").over(query)
    confidence = F.lit(semantic_confidence) if not isinstance(semantic_confidence, Column) else semantic_confidence
    scored = kept.withColumn("norm", (F.col("cosine") - low) / F.greatest(high - low, F.lit(1e-6)))
    scored = scored.withColumn("meta", metadata_score(F.col("strength"), F.col("age_days"), F.col("source"), F.col("ref_count")))
    scored = scored.withColumn("final_score", F.round(confidence * F.col("norm") + (1 - confidence) * F.col("meta"), 12))
    nth = F.row_number().over(Window.partitionBy("query_id", "source_file").orderBy(F.desc("final_score"), "pos"))
    diverse = scored.withColumn("nth", nth).where(F.col("nth") <= per_source).drop("nth")
    return diverse.withColumn("rank", F.row_number().over(query.orderBy(F.desc("final_score"), "pos")))


def within_budget(ranked: DataFrame, size: str, budget: int, min_results: int) -> DataFrame:
    """The prefix of each query's ranking that fits: the first min_results rows anyway, then rows while
    what came before is below the budget and the sum stays within it. Null sizes are unreadable: skipped."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranked.where(F.col(size).isNotNull()).withColumn("total", F.sum(size).over(order)).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    before = F.col("total") - F.col(size)
    fits = (F.col("n") <= min_results) | ((before < budget) & (F.col("total") <= budget))
    return sums.where(fits).drop("n")


def cut_bytes(text: Column, most: int) -> Column:
    """A text of at most `most` bytes as it is, else as many whole letters as they hold, and three dots."""
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")), "\uFFFD+$", "")
    return F.when(F.octet_length(text) > most, F.concat(head, F.lit("..."))).otherwise(text)


def expand_references(accepted: DataFrame, memories: DataFrame, lines: DataFrame | None = None, most: int = 3, max_bytes: int = 480) -> DataFrame:
    """One hop along the first references of accepted memories.

    accepted: query_id, file, refs; memories: file, type, name, body; lines: file, line_no, line. A
    reference to a memory gives its row, one to a code span its lines, cut to max_bytes (of UTF-8, before a letter that they would split). Dangling
    references give nothing. Score is zero, the description says through which memory.
    """
    hops = accepted.select("query_id", F.col("file").alias("via"), F.posexplode("refs").alias("pos", "ref")).where(F.col("pos") < most)
    described = F.concat(F.lit("via "), "via").alias("description")
    notes = hops.where(F.endswith("ref", F.lit(".md"))).join(memories.select(F.col("file").alias("ref"), "type", "name", "body"), "ref")
    out = notes.select("query_id", "via", "pos", "ref", "type", "name", described, "body", F.lit(0.0).alias("score"))
    if lines is None:
        return out
    spans = hops.where(F.col("ref").rlike(r":\d+:\d+$")).select("*", F.regexp_extract("ref", r"^(.*):(\d+):(\d+)$", 1).alias("file"), F.regexp_extract("ref", r":(\d+):(\d+)$", 1).cast("int").alias("s"), F.regexp_extract("ref", r":(\d+):(\d+)$", 2).cast("int").alias("e"))
    got = spans.join(lines, "file").where(F.col("line_no").between(F.col("s"), F.col("e")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    bodies = got.groupBy("query_id", "via", "pos", "ref").agg(text.alias("body"))
    cut = cut_bytes(F.col("body"), max_bytes)
    code = bodies.select("query_id", "via", "pos", "ref", F.lit("ref").alias("type"), F.col("ref").alias("name"), described, cut.alias("body"), F.lit(0.0).alias("score"))
    return out.unionByName(code)
