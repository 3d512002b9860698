"""Scalar formulas of retrieval and of memory upkeep, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lloyd-Max codebooks of the unit normal for 1 to 4 bits: the boundaries and centroids are fixed values.
BOUNDARIES = {
    1: [0.0],
    2: [-0.9816, 0.0, 0.9816],
    3: [-1.7480, -1.0500, -0.5005, 0.0, 0.5005, 1.0500, 1.7480],
    4: [-2.4008, -1.8435, -1.4371, -1.0993, -0.7996, -0.5224, -0.2582, 0.0, 0.2582, 0.5224, 0.7996, 1.0993, 1.4371, 1.8435, 2.4008],
}
CENTROIDS = {
    1: [-0.7979, 0.7979],
    2: [-1.5104, -0.4528, 0.4528, 1.5104],
    3: [-2.1520, -1.3440, -0.7560, -0.2450, 0.2450, 0.7560, 1.3440, 2.1520],
    4: [-2.7326, -2.0690, -1.6180, -1.2562, -0.9424, -0.6568, -0.3880, -0.1284, 0.1284, 0.3880, 0.6568, 0.9424, 1.2562, 1.6180, 2.0690, 2.7326],
}
#: Bonus of a memory's provenance (fixed values); any other source has none.
SOURCE_BONUS = {"remember": 0.15, "memorize": 0.15, "note": 0.10, "consolidation": 0.05}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def freshness(age_days: Column) -> Column:
    """exp(-age / 100 days); the future counts as now."""
    return F.exp(F.lit(-0.01) * F.greatest(age_days, F.lit(0.0)))


def age_days(created_at: Column, now: str) -> Column:
    """Fractional days from an ISO string to now; 1 where it is missing or no date."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(created_at))
    return F.coalesce(seconds / 86400.0, F.lit(1.0))


def metadata_score(strength: Column, age: Column, source: Column, ref_count: Column) -> Column:
    """Freshness, strength, provenance and references; 0.3 where there is no memory (strength null)."""
    bonus = F.lit(0.0)
    for name, value in SOURCE_BONUS.items():
        bonus = F.when(source == name, F.lit(value)).otherwise(bonus)
    score = freshness(age) * 0.2 + F.least(strength / 2.0, F.lit(0.3)) + bonus + F.least(ref_count * 0.05, F.lit(0.15))
    return F.when(strength.isNull(), F.lit(0.3)).otherwise(score)


def attention_score(content: Column, start_line: Column, end_line: Column) -> Column:
    """Public code and longer spans draw more attention."""
    public = F.when(F.contains(content, F.lit("pub ")) | F.contains(content, F.lit("export ")), 0.2).otherwise(0.0)
    return F.lit(0.5) + public + F.least((end_line - start_line) / 100.0, F.lit(0.2))


def slugify(text: Column, words: int) -> Column:
    """The first words joined by hyphens, in lower case, without other signs."""
    first = F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, words)
    return F.regexp_replace(F.lower(F.array_join(first, "-")), r"[^\p{L}\p{N}-]", "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def chunk_id(file: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", file, start, end)


def parse_chunk_id(ident: Column) -> dict[str, Column]:
    """Parts of file:start:end from the right; null where the last two are no numbers."""
    match = lambda g: F.nullif(F.regexp_extract(ident, r"^(.*):(\d+):(\d+)$", g), F.lit(""))
    return {"file": match(1), "start_line": match(2).cast("int"), "end_line": match(3).cast("int")}


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a segment of the path begins with a pattern, whatever the case."""
    options = F.array(*[F.lit(p.lower()) for p in patterns])
    return F.exists(F.split(F.lower(path), "/"), lambda s: F.exists(options, lambda p: F.startswith(s, p)))


def decays(last_accessed: Column, created_at: Column, access_count: Column, strength: Column, kind: Column, now: Column, decay_days: int, protected: int = 5) -> Column:
    """Old, seldom read and weak. Feedback lives twice as long; a date that can't be read is infinitely old."""
    read = F.try_to_timestamp(F.coalesce(last_accessed, created_at))
    days = F.floor(F.greatest(F.unix_timestamp(now) - F.unix_timestamp(read), F.lit(0)) / 86400)
    limit = F.when(kind == "feedback", 2 * decay_days).otherwise(decay_days)
    return (read.isNull() | (days > limit)) & (access_count < protected) & (strength < 1.0)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; the whole range where n is zero."""
    p, d = successes / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least(mid + half, F.lit(1.0)))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the lower binomial tail, 1 at most.

    The tail is taken relative to its last term, which is the largest, and that term in logarithms, so no
    number of pairs underflows."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("long")
    last = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), -n * F.log(F.lit(2.0)), lambda acc, i: acc + F.when(k > 0, F.log((n - i + 1) / i)).otherwise(0.0))
    # downwards each term is the one above times i / (n - i + 1)
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(acc: Column, j: Column) -> Column:
        term = F.when(k > 0, acc["term"] * (k - j + 1) / (n - k + j)).otherwise(0.0)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(last) * tail))


def quantize_scalar(x: Column, bits: int) -> Column:
    """How many boundaries lie below x; a value on a boundary stays in the lower cell."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in BOUNDARIES[bits]]), lambda b: x > b))


def dequantize_scalar(code: Column, bits: int) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CENTROIDS[bits]]), code)


def packed_size(n: Column, bits: int) -> Column:
    return F.ceil(n * bits / 8).cast("long")


def calibrate(anisotropy: Column, similarity_range: Column) -> dict[str, Column]:
    """Confidence in similarity and the floor under it, from the shape of an embedding space."""
    floor = clamp(anisotropy * 0.5 + (1 - similarity_range) * 0.3, 0.15, 0.50)
    return {"semantic_confidence": clamp(0.9 - anisotropy, 0.1, 0.9), "similarity_floor": F.when(similarity_range > 0.01, floor).otherwise(0.25)}
