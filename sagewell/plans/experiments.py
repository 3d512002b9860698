"""Experiments that chain the operators: synthetic clusters, freshness, index against exact search."""

from __future__ import annotations

import math
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import wilson
from ..functions.tables import pinned
from ..functions.vectors import cosine
from ..operators import embed, knn, lexical, metrics, quantize
from ..operators.rerank import rerank
from ..sources.files import transcript

#: Ages in days of the newest version and of the two older ones; words dropped from these.
FRESH_AGE, STALE = 1.0, {"mid": (90.0, 20), "old": (180.0, 10)}

#: Versions of topics that a task embeds.
TOPIC_ROWS = 4096


def synthetic(spark: SparkSession, documents: int = 500, clusters: int = 10, queries: int = 50, dim: int = 32, noise: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Unit vectors around random centres, and queries nearer to them: (id, embedding, label) each."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    centres = [unit(rng.standard_normal(dim)) for _ in range(clusters)]
    make = lambda name, n, spread: [(f"{name}_{c}_{j}", unit(m + spread * rng.standard_normal(dim)).tolist(), c) for c, m in enumerate(centres) for j in range(n // max(clusters, 1))]
    schema = "id string, embedding array<double>, label int"
    return spark.createDataFrame(make("doc", documents, noise), schema), spark.createDataFrame(make("query", queries, noise / 2), schema)


def synthetic_experiment(spark: SparkSession, k: int = 10) -> DataFrame:
    return arms_experiment(*synthetic(spark), k)


def arms_experiment(docs: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """Exact, inverted-file, graph and 4-bit search of docs (id, embedding, label) for a stated set of queries of
    the same columns, rows of a query's label being relevant: metrics and overlap with exact search."""
    asked_labels, labels, n = asked.select(F.col("id").alias("query_id"), "label"), docs.select("id", "label"), asked.count()
    exact = pinned(knn.exact_topk(docs, asked, k, "id", "embedding"))
    centroids = knn.kmeans_cells(docs, 16, 20, "id", "embedding")
    lossy = quantize.mse_quantize(docs, 4, id_col="id", decoded=True).select("id", F.col("decoded").alias("embedding"))
    arms = {"exact": exact, "ivf": knn.ivf_topk(knn.assign_cells(docs, centroids, "id", "embedding"), centroids, asked, k, 10, "id", "embedding"), "graph": knn.graph_topk(docs, asked, k, 2, "id", "embedding"), "4-bit": knn.exact_topk(lossy, asked, k, "id", "embedding")}
    out = None
    for name, found in arms.items():
        hits = exact if name == "exact" else pinned(found)
        held, totals = metrics.label_grades(hits, asked_labels, labels)
        m = metrics.summary(metrics.retrieval_metrics(hits, held, k, totals)).select(F.lit(name).alias("arm"), *(F.round(c, 4).alias(c) for c in ("precision", "mrr", "ndcg")))
        same = hits.join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").agg((F.count("*") / (n * k)).alias("overlap"))
        row = m.crossJoin(same)
        out = row if out is None else out.union(row)
    return out


def drift(text, every: int):
    """The text without every n-th word."""
    return F.array_join(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w, i: (i + 1) % every != 0), " ")


def freshness_experiment(topics: DataFrame, embedder: str = "hash", most_topics: int | None = None) -> DataFrame:
    """topics: topic, text, question. Shares of topics whose newest version ranks first among its own
    versions, reranked with true ages and with equal ones, and the exact test of their difference. Every
    topic takes part unless most_topics is given."""
    chosen = pinned(topics.orderBy("topic").limit(most_topics) if most_topics else topics)
    texts, age = [F.struct(F.lit("#fresh").alias("name"), "text")], F.lit(FRESH_AGE)
    for name, (days, every) in STALE.items():
        texts.append(F.struct(F.lit(f"#{name}").alias("name"), drift(F.col("text"), every).alias("text")))
        age = F.when(F.endswith("id", F.lit(f"#{name}")), days).otherwise(age)
    # embedded once, and dealt to tasks of a bounded number of texts, a topic's versions side by side; every topic asks
    dealt = chosen.repartition(max(chosen.sparkSession.sparkContext.defaultParallelism, math.ceil(3 * chosen.count() / TOPIC_ROWS)))
    corpus = dealt.select("topic", F.explode(F.array(*texts)).alias("version")).select(F.concat(F.col("topic").cast("string"), "version.name").alias("id"), "version.text")
    vectors = pinned(embed.embed_texts(corpus, "text", embedder).select("id", "embedding"))
    asked = pinned(embed.embed_texts(chosen.select(F.col("topic").cast("string").alias("id"), F.col("question").alias("text")), "text", embedder).select("id", "embedding"))
    hits = pinned(knn.exact_topk(vectors, asked, 20, "id", "embedding")).withColumnRenamed("score", "cosine").withColumn("age", age)

    def arm(age) -> DataFrame:
        c = hits.select("query_id", "id", F.col("rank").alias("pos"), "cosine", F.col("id").alias("source_file"), F.lit(1.0).alias("strength"), age.alias("age_days"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("ref_count"))
        own = rerank(c).where(F.startswith("id", F.concat("query_id", F.lit("#"))))
        first = own.groupBy("query_id").agg(F.min_by("id", "rank").alias("first"))
        asked_ids = chosen.select(F.col("topic").cast("string").alias("query_id"))
        return asked_ids.join(first, "query_id", "left").select("query_id", F.coalesce(F.endswith("first", F.lit("#fresh")), F.lit(False)).alias("hit"))

    with_age, without = arm(F.col("age")), arm(F.lit(FRESH_AGE))
    rate = lambda d, name: d.agg(F.avg(F.col("hit").cast("int")).alias(name))
    return rate(with_age, "with_freshness").crossJoin(rate(without, "without_freshness")).crossJoin(metrics.paired_test(with_age, without))


def storage_footprint(dims: DataFrame, sizes: list[int]) -> DataFrame:
    """Bytes of n vectors (dims: one row with dim) plain and quantised to one to four bits with a norm each."""
    n, none = F.explode(F.array(*[F.lit(x).cast("long") for x in sizes])).alias("n"), F.col("bits") == 32
    rows = dims.select("dim", n).select("dim", "n", F.explode(F.array(*[F.lit(b) for b in (1, 2, 3, 4, 32)])).alias("bits"))
    each = F.when(none, F.col("dim") * 4).otherwise(F.ceil(F.col("dim") * F.col("bits") / 8) + 4)
    return rows.select("n", "bits", (F.col("n") * each).cast("long").alias("bytes"), F.when(none, 1.0).otherwise(F.round(F.col("dim") * 4.0 / each, 6)).alias("ratio"))


def latency_scaling(vectors: DataFrame, queries: DataFrame, shares: list[float], k: int = 10) -> DataFrame:
    """Seconds that exact search and search by cells take over growing shares of the rows, by hash of the id."""
    spark, out = vectors.sparkSession, []
    for share in shares:
        part = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1000)) < int(share * 1000))
        centroids = knn.kmeans_cells(part)
        cells = pinned(knn.assign_cells(part, centroids))
        for arm, search in (("exact", lambda: knn.exact_topk(part, queries, k)), ("cells", lambda: knn.ivf_topk(cells, centroids, queries, k))):
            began = time.monotonic()
            rows = search().count()
            out.append((part.count(), arm, queries.count(), rows, time.monotonic() - began))
    return spark.createDataFrame(out, "n bigint, arm string, queries bigint, hits bigint, seconds double")


def haystack_recall(questions: DataFrame, sessions: DataFrame, k: int) -> DataFrame:
    """Per question type and over all: in how many haystacks the k best sessions hold a gold one.

    questions: query_id, embedding, haystack and gold (ids), question_type; sessions: id, embedding. A
    question sees its own haystack only; ids without a session are left out."""
    pairs = questions.select("query_id", "question_type", "gold", F.col("embedding").alias("q"), F.explode("haystack").alias("id")).join(sessions, "id")
    scored = pairs.select("query_id", "question_type", "id", F.array_contains("gold", F.col("id")).alias("is_gold"), F.round(cosine("q", "embedding"), 12).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = scored.withColumn("place", place).groupBy("query_id", "question_type").agg(F.max((F.col("is_gold") & (F.col("place") <= k)).cast("int")).alias("hit"))
    groups = found.rollup("question_type").agg(F.count("*").alias("n"), F.sum("hit").alias("found"), F.avg("hit").alias("recall"), F.grouping("question_type").alias("is_total"))
    return groups.select(F.when(F.col("is_total") == 1, "overall").otherwise(F.coalesce("question_type", F.lit("unknown"))).alias("question_type"), "n", "found", "recall")


def bm25_evaluation(docs: DataFrame, queries: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Share of queries with a gold document (query_id, id) among their k best by BM25, with its interval (the
    empty one without queries)."""
    hits = lexical.bm25_topk(docs, queries, k).join(gold, ["query_id", "id"], "left_semi").select("query_id").distinct()
    counts = queries.select("query_id").distinct().join(hits.withColumn("hit", F.lit(1)), "query_id", "left").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    low, high = wilson(F.col("found"), F.col("n"), 1.95996)
    none = F.col("n") == 0
    return counts.select("n", "found", F.when(none, 0.0).otherwise(F.col("found") / F.col("n")).alias("recall"), F.when(none, 0.0).otherwise(low).alias("low"), F.when(none, 0.0).otherwise(high).alias("high"))


def report(rows: DataFrame, place: str) -> DataFrame:
    """Result rows as lines of a report and as JSON objects: column names first (no object), then values; line,
    place (a numeric column) and object. Nulls are dashes in lines and absent in objects."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns])
    head = rows.sparkSession.createDataFrame([("\t".join(rows.columns), 0, None)], "line string, place int, object string")
    return head.union(rows.select(line, F.col(place).cast("int"), F.to_json(F.struct(*rows.columns))))


def context_rows(queries: DataFrame, hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """What a reader of each question gets, for JSON lines: question_id, question_type, question, question_date,
    retrieved_context, retrieved_session_ids, gold_answer, gold_session_ids, retrieval_hit.

    queries: query_id, question_type, question, question_date, answer, gold_ids; hits: query_id, id, rank (a bounded
    number for each question); sessions: session_id, turns, date. Contexts are whole transcripts with their dates, in
    order of rank; sessions that aren't there are no context, but stay among the ids. A question without hits has
    empty lists."""
    told = sessions.select(F.col("session_id").alias("id"), transcript("turns", "date").alias("text"))
    listed = hits.join(told, "id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("hits"))
    ids = F.coalesce(F.transform("hits", lambda h: h["id"].cast("string")), F.array().cast("array<string>"))
    texts = F.coalesce(F.transform(F.filter("hits", lambda h: h["text"].isNotNull()), lambda h: h["text"]), F.array().cast("array<string>"))
    gold = F.coalesce("gold_ids", F.array().cast("array<string>"))
    rows = queries.join(listed, "query_id", "left")
    return rows.select(F.col("query_id").cast("string").alias("question_id"), "question_type", "question", "question_date", texts.alias("retrieved_context"), ids.alias("retrieved_session_ids"), F.col("answer").alias("gold_answer"), gold.alias("gold_session_ids"), F.arrays_overlap(ids, gold).alias("retrieval_hit"))
