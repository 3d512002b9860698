"""Substring search and Okapi BM25."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import pinned
from .knn import ranked

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def text_search(index: DataFrame, query: str, title: str = "title", summary: str = "summary") -> DataFrame:
    """Case-insensitive substring of title or summary; every hit scores 0.5."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower(F.coalesce(title, F.lit(""))), q) | F.contains(F.lower(F.coalesce(summary, F.lit(""))), q)
    return index.where(hit).withColumn("score", F.lit(0.5))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "query_id", query_text_col: str = "text", k1: float = 1.5, b: float = 0.75, queries_per_block: int = 1000) -> DataFrame:
    """The k best documents for each query that share a term with it: query_id, id, score, rank.

    Queries are a stated set. A first pass takes each document's length and counts of query terms (nothing
    else leaves the scan) and pins them; document frequencies are sums of these. Then each block of
    queries is broadcast as a matrix of terms and meets every batch of documents in a matrix product that
    keeps k rows for each query, so the shuffle carries k rows for each query and batch, not every
    document that holds a common term. A query term counts as often as the query has it; ties go to the
    smaller id. Null texts are empty, null ids are left out, documents without any term of a query aren't
    among its hits, and an empty side gives no rows.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    asked = queries.select(F.col(query_id_col).alias("q"), tokens(F.col(query_text_col)).alias("w")).collect()
    terms = sorted({w for r in asked for w in r["w"]})
    schema = f"query_id {dict(queries.dtypes)[query_id_col]}, id {kind}, score double"
    if not terms:
        return spark.createDataFrame([], f"{schema}, rank int")
    known = spark.sparkContext.broadcast(pa.array(terms, pa.string()))

    def count(batches):
        for batch in batches:
            w = batch.column(1)
            of = np.repeat(np.arange(len(w)), np.diff(w.offsets.to_numpy()))
            codes = pc.index_in(w.flatten(), value_set=known.value)
            held = codes.is_valid().to_numpy(zero_copy_only=False)
            keys, tf = np.unique(of[held] << 32 | codes.drop_null().to_numpy(), return_counts=True)
            ends = np.searchsorted(keys >> 32, np.arange(len(w) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (keys & 0xFFFFFFFF, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.offsets.to_numpy()), pa.int32()), *lists], names=["id", "length", "term", "tf"])

    words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    counts = pinned(words.mapInArrow(count, f"id {kind}, length int, term array<int>, tf array<int>"))
    size = counts.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    df = np.zeros(len(terms))
    for r in counts.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():  # one row for each query term at most
        df[r["t"]] = r["n"]
    idf = np.log((size["n"] - df + 0.5) / (df + 0.5) + 1)
    mean, number = size["mean"] or 1.0, {t: i for i, t in enumerate(terms)}
    found = None
    for at in range(0, len(asked), queries_per_block):
        block = asked[at : at + queries_per_block]
        own = sorted({number[w] for r in block for w in r["w"]})
        place = np.full(len(terms), -1)
        place[own] = np.arange(len(own))
        # counts as coordinates: workers keep what is broadcast, and a matrix of every block would add up there
        at_term = np.array([place[number[w]] for r in block for w in r["w"]], np.int32)
        at_query = np.repeat(np.arange(len(block), dtype=np.int32), [len(r["w"]) for r in block])
        part = counts.where(F.size("term") > 0).mapInArrow(_score(spark.sparkContext.broadcast(([r["q"] for r in block], place.astype(np.int32), idf[own], at_term, at_query)), to_arrow_type(queries.schema[query_id_col].dataType), k, k1, b, mean), schema)
        found = part if found is None else found.union(part)
    return ranked(found, k)


def _score(shared, kind: pa.DataType, k: int, k1: float, b: float, mean: float):
    """Scores of batches of documents for a block of queries: the k best of each and what ties with them."""

    def work(batches):
        names, place, idf, at_term, at_query = shared.value
        m = np.zeros((len(idf), len(names)))
        np.add.at(m, (at_term, at_query), 1)
        for batch in (x.slice(s, 1000) for x in batches for s in range(0, x.num_rows, 1000)):
            order = np.argsort(np.array(batch.column(0).to_pylist()), kind="stable")
            offsets = batch.column(2).offsets.to_numpy()
            of, term, tf = np.repeat(np.arange(batch.num_rows), np.diff(offsets)), place[batch.column(2).flatten().to_numpy()], batch.column(3).flatten().to_numpy()
            of, term, tf = of[term >= 0], term[term >= 0], tf[term >= 0]
            length = batch.column(1).to_numpy()
            w = np.zeros((batch.num_rows, len(idf)))
            w[of, term] = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[of] / mean))
            scores = np.round(w @ m, 9)[order].T
            least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.zeros(len(scores))
            q, d = np.nonzero((scores >= least[:, None]) & (scores > 0))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()], kind), batch.column(0).take(pa.array(order[d])), pa.array(scores[q, d])], names=["query_id", "id", "score"])

    return work
