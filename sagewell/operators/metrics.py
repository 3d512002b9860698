"""Retrieval metrics, paired tests, question answering scores, and statistics of embedding spaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import mcnemar, wilson
from ..functions.tables import pinned

#: Phrases that mark an answer as an abstention (fixed values).
ABSTAINS = ["i don't know", "not mentioned", "no information", "cannot answer", "i don't have"]
#: The longer list that a judge's report goes by (fixed values).
JUDGE_ABSTAINS = ["i don't know", "i do not know", "not mentioned", "no information", "cannot answer", "can't answer", "i don't have", "i do not have", "not enough information", "no relevant information", "isn't mentioned", "is not mentioned"]


def label_grades(hits: DataFrame, asked: DataFrame, rows: DataFrame, grade: int = 2) -> tuple[DataFrame, DataFrame]:
    """Where all rows of a query's label are relevant: those among its hits (query_id, id, grade), and how many there
    are (query_id, grade, n), from counts per label instead of pairs. asked: query_id, label; rows: id, label."""
    held = hits.select("query_id", "id").join(asked, "query_id").join(rows, ["id", "label"]).select("query_id", "id", F.lit(grade).alias("grade"))
    return held, asked.join(F.broadcast(rows.groupBy("label").agg(F.count("*").alias("n"))), "label").select("query_id", F.lit(grade).alias("grade"), "n")


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int, totals: DataFrame | None = None) -> DataFrame:
    """Per query: precision, recall, rr, ndcg, recall_any, recall_all.

    hits: query_id, id, rank (the whole ranking); relevant: query_id, id, grade > 0. Precision divides
    by k even if fewer were found; queries without relevant ids have 0 everywhere; the ideal gain comes
    from the k best grades. totals (query_id, grade, n) tells how many relevant ids there are, where `relevant` holds
    only those among the hits.
    """
    judged = hits.join(relevant, ["query_id", "id"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("g")) - 1) / F.log2(F.col("rank") + 1.0)
    got = judged.groupBy("query_id").agg(
        F.sum(F.when((F.col("rank") <= k) & (F.col("g") > 0), 1).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("g") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
    )
    # equal grades share their places: the ideal follows from counts per grade, not from all rows
    grades = relevant.groupBy("query_id", "grade").agg(F.count("*").alias("n")) if totals is None else totals
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = grades.withColumn("a", before).withColumn("b", F.least(F.col("a") + F.col("n"), F.lit(k))).where("a < b")
    discount = F.aggregate(F.sequence(F.col("a") + 1, F.col("b")), F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1.0))
    ideal = tops.groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) * discount).alias("idcg"))
    total = grades.groupBy("query_id").agg(F.sum("n").alias("total"))
    out = got.join(total, "query_id", "left").join(ideal, "query_id", "left")
    found, total_ = F.col("hits"), F.coalesce("total", F.lit(0))
    return out.select(
        "query_id",
        (found / k).alias("precision") if k else F.lit(0.0).alias("precision"),
        F.when(total_ > 0, found / total_).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        (found > 0).alias("recall_any"),
        ((total_ > 0) & (found == total_)).alias("recall_all"),
    )


def summary(per_query: DataFrame) -> DataFrame:
    """Means over queries with Wilson intervals of the hit shares."""
    share = per_query.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("precision", "recall", "rr", "ndcg")), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("recall_any", "recall_all")))
    low, high = wilson(F.col("recall_any"), F.col("n"))
    return share.select("n", "precision", "recall", F.col("rr").alias("mrr"), "ndcg", (F.col("recall_any") / F.col("n")).alias("recall_any"), (F.col("recall_all") / F.col("n")).alias("recall_all"), low.alias("any_low"), high.alias("any_high"))


def paired_test(a: DataFrame, b: DataFrame, key: str = "query_id", hit: str = "hit") -> DataFrame:
    """Discordant pairs of two arms over the same keys and the exact p; a key missing on one side is an error."""
    both = a.select(key, F.col(hit).alias("x")).join(b.select(key, F.col(hit).alias("y")), key, "full_outer")
    x, y = (F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("arms differ in keys"))) for c in ("x", "y"))
    counts = both.agg(F.sum((x & ~y).cast("long")).alias("only_a"), F.sum((~x & y).cast("long")).alias("only_b"))
    return counts.withColumn("p_value", mcnemar(F.col("only_a"), F.col("only_b")))


def score_answers(answers: DataFrame) -> DataFrame:
    """Per question type and over all: n, correct, accuracy and its interval.

    An answer is correct if it holds the gold answer, whatever the case; without a gold answer if it abstains.
    """
    said = F.lower(F.coalesce("model_answer", F.lit("")))
    right = F.when(F.col("gold_answer").isNull(), abstains(F.col("model_answer"), ABSTAINS)).otherwise(F.contains(said, F.lower("gold_answer")))
    groups = answers.withColumn("right", right.cast("int")).rollup("question_type").agg(F.count("*").alias("n"), F.sum("right").alias("correct"), F.grouping("question_type").alias("is_total"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return groups.select(F.when(F.col("is_total") == 1, F.lit("overall")).otherwise(F.col("question_type")).alias("question_type"), "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"))


def abstains(answer: Column, markers: list[str] | None = None) -> Column:
    said = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*[F.lit(x) for x in markers or JUDGE_ABSTAINS]), lambda m: F.contains(said, m))


def judge_report(records: DataFrame) -> DataFrame:
    """Per type and over all: count, graded, correct, accuracy of the graded ones with interval, share of hits.

    records: question_type, correct (null where it wasn't graded), retrieval_hit.
    """
    kind = F.coalesce("question_type", F.lit("unknown"))
    rows = records.select(kind.alias("question_type"), F.col("correct").cast("int").alias("c"), F.coalesce("retrieval_hit", F.lit(False)).cast("int").alias("h"))
    groups = rows.rollup("question_type").agg(F.count("*").alias("count"), F.count("c").alias("graded"), F.coalesce(F.sum("c"), F.lit(0)).alias("correct"), F.avg("h").alias("retrieval_recall"), F.grouping("question_type").alias("is_total"))
    low, high = wilson(F.col("correct"), F.col("graded"), 1.95996)
    accuracy = F.when(F.col("graded") > 0, F.col("correct") / F.col("graded")).otherwise(0.0)
    none = F.col("graded") == 0
    return groups.select(F.when(F.col("is_total") == 1, F.lit("overall")).otherwise(F.col("question_type")).alias("question_type"), "count", "graded", "correct", accuracy.alias("accuracy"), F.when(none, 0.0).otherwise(low).alias("low"), F.when(none, 0.0).otherwise(high).alias("high"), "retrieval_recall")


def nearest_rank(df: DataFrame, value: str, percents: list[int], by: str, ranges: int = 256) -> DataFrame:
    """Percentiles by rank round(p/100 (n-1)), without interpolation.

    Equal values are counted before any shuffle of rows, and a group's values are dealt to `ranges` by
    approximate quantiles (exactness doesn't rest on them), so that no task sorts a whole group: sums of
    ranges tell which ones hold a rank, and only these are numbered. Null values are left out, a null
    group is a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.struct(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    marks = [i / ranges for i in range(1, ranges)]
    groups = df.where(F.col(value).isNotNull()).groupBy(F.struct(by).alias("g")).agg(F.percentile_approx(value, marks, 20 * ranges).alias("bounds"), F.count("*").alias("n"))
    rows = counts.join(groups, counts["g"].eqNullSafe(groups["g"])).select(groups["g"], "v", "c", "n", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("range"))
    sums = rows.groupBy("g", "range", "n").agg(F.sum("c").alias("c"))
    before = F.sum("c").over(Window.partitionBy("g").orderBy("range")) - F.col("c")
    target = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.round(F.lit(p / 100) * (F.col("n") - 1)).cast("long").alias("at")) for p in percents]))
    held = sums.select("g", "range", "c", "n", before.alias("before")).select("g", "range", "c", "before", target.alias("t")).where((F.col("t.at") >= F.col("before")) & (F.col("t.at") < F.col("before") + F.col("c")))
    held = held.groupBy("g", "range").agg(F.first("before").alias("before"), F.collect_list("t").alias("targets"))
    r = rows.alias("r")
    inside = r.join(held.alias("h"), F.col("r.g").eqNullSafe(F.col("h.g")) & (F.col("r.range") == F.col("h.range"))).select(F.col("r.g").alias("g"), F.col("r.range").alias("range"), "v", "c", "before", "targets")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("g", "range").orderBy("v"))
    found = inside.withColumn("upto", upto).select("g", "v", "upto", "c", F.explode("targets").alias("t")).where((F.col("t.at") < F.col("upto")) & (F.col("t.at") >= F.col("upto") - F.col("c")))
    return found.groupBy(F.col(f"g.{by}").alias(by)).agg(*(F.max(F.when(F.col("t.p") == p, F.col("v"))).alias(f"p{p}") for p in percents))


def space_statistics(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean cosine of all pairs, of pairs with equal and of pairs with different labels, and their gap.

    For unit vectors sums of pairs follow from squared lengths of vector sums, so one pass does it; a task
    ships one vector sum for each label that it holds. A missing side counts as 0; a null label is a
    label of its own; null vectors are left out.
    """
    kind = dict(vectors.dtypes)[label]

    def sums_of(batches):
        held: dict = {}
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            m = np.array(b.column(1).to_pylist(), float)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            u = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
            codes = b.column(0).dictionary_encode(null_encoding="encode")
            at, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            for j, name in enumerate(names):
                own = u[at == j]
                n, q, x = held.get(name, (0, 0.0, 0.0))
                held[name] = (n + len(own), q + float((own * own).sum()), x + own.sum(0))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), b.schema.field(0).type), *(pa.array([v[i] for v in held.values()], t) for i, t in ((0, pa.int64()), (1, pa.float64()))), pa.array([v[2].tolist() for v in held.values()], pa.list_(pa.float64()))], names=["label", "n", "q", "x"])

    parts = vectors.select(F.col(label).alias("label"), F.col(vector).alias("v")).mapInArrow(sums_of, f"label {kind}, n bigint, q double, x array<double>")
    sums = parts.select("label", F.posexplode("x").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"))
    inner = sums.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("s2"))
    sizes = parts.groupBy("label").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    groups = sizes.join(inner, sizes["label"].eqNullSafe(inner["label"])).agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("s2").alias("within2"), F.sum(F.col("n") * (F.col("n") - 1)).alias("within_pairs"))
    total = sums.groupBy("pos").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all2"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = lambda s, n: F.when(n > 0, s / n).otherwise(0.0)
    intra = mean(F.col("within2") - F.col("q"), F.col("within_pairs"))
    inter = mean(F.col("all2") - F.col("within2"), pairs - F.col("within_pairs"))
    return groups.crossJoin(F.broadcast(total)).select("n", mean(F.col("all2") - F.col("q"), pairs).alias("anisotropy"), intra.alias("intra"), inter.alias("inter"), (intra - inter).alias("discrimination_gap"))


def even_sample(df: DataFrame, order: str, size: int = 100) -> DataFrame:
    """Every (n / size)-th row in order, size rows in all: the sample that calibration is made on.

    order names distinct ids. They are sorted by ranges and pinned with their places, so that counts of
    ranges and picked rows belong together; only the picked ids meet the whole rows again. Null ids are
    left out."""
    keys = df.select(order).where(F.col(order).isNotNull()).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    keys = pinned(keys.select(F.col(order).alias("key"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")))
    parts = keys.groupBy("part").agg(F.min("m").alias("low"), F.count("*").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("low")).alias("shift"), F.sum("n").over(Window.partitionBy()).alias("n"))
    step = F.greatest(F.floor(F.col("n") / F.least("n", F.lit(size))), F.lit(1))
    at = F.col("m") + F.col("shift")
    picked = keys.join(starts, "part").where((at % step == 0) & (at < step * size)).select(F.col("key").alias(order), at.alias("pos"))
    return df.join(picked, order)


def similarity_range(sample: DataFrame, vector: str = "embedding") -> DataFrame:
    """Largest less smallest cosine of pairs of a sample (of bounded size: see even_sample)."""
    rows = np.array([r[0] for r in sample.select(vector).where(F.col(vector).isNotNull()).collect()], float)
    value = 0.0
    if len(rows) > 1:
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        unit = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
        pairs = (unit @ unit.T)[np.triu_indices(len(rows), 1)]
        value = float(pairs.max() - pairs.min())
    return sample.sparkSession.createDataFrame([(value,)], "similarity_range double")


def intrinsic_dimensionality(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(sum of eigenvalues)^2 / sum of squares for the covariance, through its trace and Frobenius norm.

    Per task one matrix of second moments, added up on the cluster by position.
    """

    def moments(batches):
        n, total, second = 0, None, None
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            if b.num_rows:
                m = np.array(b.column(0).to_pylist(), float)
                n += len(m)
                total = m.sum(0) if total is None else total + m.sum(0)
                second = m.T @ m if second is None else second + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([second.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "total", "second"])

    parts = vectors.select(vector).mapInArrow(moments, "n bigint, total array<double>, second array<double>")
    long = parts.select(F.lit(0).alias("what"), F.posexplode("total").alias("pos", "x")).union(parts.select(F.lit(1), F.posexplode("second"))).groupBy("what", "pos").agg(F.sum("x").alias("x"))
    n = parts.agg(F.sum("n")).first()[0] or 0
    got = {(r["what"], r["pos"]): r["x"] for r in long.collect()}  # dim + dim^2 numbers
    dim = sum(k[0] == 0 for k in got)
    value = 1.0
    if n > 1:
        mean = np.array([got[0, i] for i in range(dim)]) / n
        c = (np.array([got[1, i] for i in range(dim * dim)]).reshape(dim, dim) - n * np.outer(mean, mean)) / (n - 1)
        value = float(np.trace(c) ** 2 / (c * c).sum()) if (c * c).sum() > 0 else 1.0
    return vectors.sparkSession.createDataFrame([(value,)], "intrinsic_dimensionality double")


def evaluate_embeddings(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """All statistics of a space in one row."""
    return space_statistics(vectors, label, vector).crossJoin(intrinsic_dimensionality(vectors, vector))
