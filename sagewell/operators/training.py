"""Preparing and checking examples for training embedders, and the losses they are judged by."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

#: Prefix tokens and weights by language and memory type (fixed values).
LANGUAGE_TOKENS = {"rust": "[RUST]", "python": "[PYTHON]", "javascript": "[JAVASCRIPT]", "typescript": "[TYPESCRIPT]", "go": "[GO]"}
TYPE_TOKENS = {"user": "[USER]", "feedback": "[FEEDBACK]", "project": "[PROJECT]", "reference": "[REFERENCE]"}
TYPE_WEIGHTS = {"feedback": 1.0, "project": 0.8, "user": 0.6, "reference": 0.4}


def _pick(key: Column, options: dict, default) -> Column:
    out = F.lit(default)
    for k, v in options.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def code_input(code: Column, language: Column) -> Column:
    return F.concat(_pick(language, LANGUAGE_TOKENS, "[OTHER]"), F.lit(" "), code)


def memory_input(kind: Column, description: Column, body: Column) -> Column:
    return F.concat(F.lit("[TYPE] "), _pick(kind, TYPE_TOKENS, "[USER]"), F.lit(" [DESC] "), description, F.lit(" [BODY] "), body)


def temporal_features(created_at: Column, last_accessed: Column, access_count: Column, kind: Column, now: Column) -> dict[str, Column]:
    days = lambda t: (F.unix_micros(now) - F.unix_micros(t)) / 86_400_000_000
    age = F.greatest(days(created_at), F.lit(0.01))
    return {"age_days": age, "recency_days": F.greatest(days(last_accessed), F.lit(0.0)), "access_frequency": access_count / age, "type_weight": _pick(kind, TYPE_WEIGHTS, 0.5)}


def temporal_score(features: dict[str, Column]) -> Column:
    """Recency decay times the damped access frequency times the type's weight."""
    boost = F.least(F.log1p(features["access_frequency"]) / 3.0, F.lit(1.0))
    return F.exp(features["recency_days"] * -0.01) * boost * features["type_weight"]


def sinusoidal(features: dict[str, Column], dim: int = 64) -> Column:
    """Each feature as sine and cosine pairs over falling frequencies."""
    each = dim // 4
    out = []
    for f in features.values():
        for i in range(each // 2):
            angle = f / 10000.0 ** (i / (each / 2))
            out += [F.sin(angle), F.cos(angle)]
    return F.array(*out)


def triplets(queries: DataFrame) -> DataFrame:
    """query, positive, negative, relevance: every relevant with every irrelevant example of a query."""
    rel = queries.select("query", "irrelevant", F.explode("relevant").alias("r"))
    return rel.select("query", "r", F.explode("irrelevant").alias("i")).select("query", F.col("r.description").alias("positive"), F.col("i.description").alias("negative"), F.coalesce("r.relevance", F.lit(1.0)).alias("relevance"))


def check_memories(rows: DataFrame) -> DataFrame:
    """One row per fault of memory examples (line, type, name, description, body)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("type", "name", "description", "body")]))
    whole = F.size(missing) == 0
    faults = F.array_compact(
        F.array(
            F.when(~whole, F.concat(F.lit("absent: "), F.array_join(missing, ", "))),
            F.when(whole & ~F.col("type").isin(*TYPE_TOKENS), F.concat(F.lit("unknown type: "), "type")),
            F.when(whole & (F.length("description") > 150), F.lit("description over 150 letters")),
        )
    )
    return rows.select("line", F.explode(faults).alias("fault"))


def check_code_pairs(rows: DataFrame) -> DataFrame:
    """One row per fault of code examples (line, language, code, description)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("language", "code", "description")]))
    whole = F.size(missing) == 0
    faults = F.array_compact(F.array(F.when(~whole, F.concat(F.lit("absent: "), F.array_join(missing, ", "))), F.when(whole & (F.length("code") < 20), F.lit("code under 20 letters")), F.when(whole & (F.length("description") < 10), F.lit("description under 10 letters"))))
    return rows.select("line", F.explode(faults).alias("fault"))


def check_temporal(rows: DataFrame) -> DataFrame:
    """One row per fault of temporal examples (line, query, candidates with temporal_relevance)."""
    few = F.coalesce(F.size("candidates"), F.lit(0)) < 2
    own = F.array_compact(F.array(F.when(F.col("query").isNull(), F.lit("no query")), F.when(few, F.lit("fewer than two candidates"))))
    value = lambda c: c["temporal_relevance"]
    each = F.transform(F.coalesce("candidates", F.array()), lambda c: F.when(value(c).isNull(), F.lit("candidate without relevance")).when(~value(c).between(0, 1), F.lit("relevance outside 0 to 1")))
    return rows.select("line", F.explode(F.concat(own, F.array_compact(each))).alias("fault"))


def objects_in_response(response: Column) -> Column:
    """JSON object lines of a model's response, inside fences or beginning with a brace, that parse."""
    trimmed = F.transform(F.split(F.trim(response), "\r?\n"), lambda x: F.trim(x))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("fenced"))

    def step(acc: Column, x: Column) -> Column:
        fence = F.startswith(x, F.lit("```"))
        takes = ~fence & (acc["fenced"] | F.startswith(x, F.lit("{"))) & F.try_parse_json(x).isNotNull()
        return F.struct(F.when(takes, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"), F.when(fence, ~acc["fenced"]).otherwise(acc["fenced"]).alias("fenced"))

    return F.aggregate(trimmed, start, step, lambda acc: acc["out"])


def pack_context(blocks: DataFrame, max_chars: int = 24_000) -> DataFrame:
    """question_id, context: blocks in order of pos while they fit; the first always does."""
    shown = blocks.withColumn("block", F.concat(F.lit("[Conversation "), F.col("pos").cast("string"), F.lit("]\n"), "content", F.lit("\n")))
    before = F.sum(F.length("block")).over(Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    # a block that does not fit ends the context, so sums, which only grow, decide
    kept = shown.withColumn("total", before).where((F.col("total") <= max_chars) | (F.col("pos") == 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda b: b["block"]), "\n")
    return kept.groupBy("question_id").agg(text.alias("context"))


def cosine_loss(pairs: DataFrame) -> DataFrame:
    """Mean squared difference of cosine(a, b) from target."""
    return pairs.agg(F.avg(F.pow(cosine("a", "b") - F.col("target"), 2)).alias("loss"))


def triplet_loss(rows: DataFrame, margin: float = 0.2) -> DataFrame:
    return rows.agg(F.avg(F.greatest(cosine("anchor", "negative") - cosine("anchor", "positive") + margin, F.lit(0.0))).alias("loss"))


def contrastive_loss(rows: DataFrame, temperature: float = 0.05) -> DataFrame:
    """Cross entropy of each anchor against all positives of its batch (columns batch, pos, anchor, positive).

    Batches are of training size; pairs arise within a batch only.
    """
    other = rows.select("batch", F.col("pos").alias("j"), F.col("positive").alias("p"))
    sims = rows.select("batch", "pos", "anchor").join(other, "batch").select("batch", "pos", "j", (cosine("anchor", "p") / temperature).alias("s"))
    top = F.max("s").over(Window.partitionBy("batch", "pos"))
    shifted = sims.withColumn("m", top).groupBy("batch", "pos").agg((F.max("m") + F.log(F.sum(F.exp(F.col("s") - F.col("m"))))).alias("all"), F.max(F.when(F.col("j") == F.col("pos"), F.col("s"))).alias("own"))
    return shifted.agg(F.avg(F.col("all") - F.col("own")).alias("loss"))
