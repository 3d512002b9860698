"""A kept inverted index for BM25: blocks of postings with upper bounds, of which a query reads what it needs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import pinned
from .knn import ranked
from .lexical import tokens

#: Documents of a range: a term has one block of postings in each range that has it.
RANGE_DOCS = 1024
#: Folders that terms are dealt to.
PARTS = 64
#: Best ranges of a query that give the first bound of its k-th score.
FIRST_RANGES = 4
#: Queries whose scores in a range are held at once.
QUERIES_AT_ONCE = 64


class PostingsIndex:
    """An index of documents (id, text) kept in a folder that executors share.

    Documents are dealt to ranges by hash. `blocks` holds postings, partitioned by hash of the term: each row is the
    documents of a term in a range, with the largest tf and the smallest length / tf among them, which bound what the
    term can add to a score there, whatever the mean length comes to be; the bounds of a query's terms add up to
    what any document of the range can have. `docs` holds lengths and terms, by the generation that added
    them; `dead` says which documents of which generations count no more. insert() and remove() add generations
    and dead rows and rewrite nothing; compact() writes everything anew. A generation is written before `dead`
    names what it replaces, and only counts once its mark is written last, so that an insertion that breaks off
    changes nothing.

    Null texts are empty; null ids are left out; of rows with equal ids the one with the smallest text counts;
    an id that is there is replaced.
    """

    def __init__(self, spark: SparkSession, folder: str, k1: float = 1.5, b: float = 0.75):
        self.spark, self.folder, self.k1, self.b = spark, folder.rstrip("/"), k1, b

    @classmethod
    def build(cls, docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> PostingsIndex:
        index = cls(docs.sparkSession, folder, k1, b)
        index._add(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), 0)
        return index

    # generations

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Those that are complete: whose mark is there."""
        path, fs = self._path("marks")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, generation: int) -> None:
        path, fs = self._path(f"marks/{generation}")
        fs.create(path, True).close()

    def _read(self, name: str) -> DataFrame | None:
        paths = [f"{self.folder}/{name}/{g}" for g in self.generations() if self._path(f"{name}/{g}")[1].exists(self._path(f"{name}/{g}")[0])]
        read = [self.spark.read.option("basePath", p).parquet(p).withColumn("generation", F.lit(int(p.rpartition("/")[2]))) for p in paths]
        for other in read[1:]:
            read[0] = read[0].unionByName(other)
        return read[0] if read else None

    def _add(self, docs: DataFrame, generation: int, leaving: DataFrame | None = None) -> None:
        """Writes a generation; the ids of `leaving` (those of docs, if none are given) leave older ones."""
        docs, older = docs.where(F.col("id").isNotNull()), bool(self.generations())
        ranges = max(1, math.ceil(docs.count() / RANGE_DOCS))
        dealt = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int").alias("range")).repartition("range")
        one = dealt.groupBy("range", "id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        words = one.select("id", "range", tokens(F.col("text")).alias("w"))
        forward = words.mapInArrow(_count_terms, f"id {dict(docs.dtypes)['id']}, range int, length int, terms array<struct<term: string, tf: int>>")
        forward.write.mode("overwrite").parquet(f"{self.folder}/docs/{generation}")
        forward = self.spark.read.schema(forward.schema).parquet(f"{self.folder}/docs/{generation}")
        if older:
            self._leaving(forward if leaving is None else leaving).write.mode("overwrite").parquet(f"{self.folder}/dead/{generation}")
        if not forward.isEmpty():
            self._write_blocks(forward, generation, ranges)
        self._mark(generation)

    def _write_blocks(self, forward: DataFrame, generation: int, ranges: int) -> None:
        kind = dict(forward.dtypes)["id"]
        schema = f"term string, range int, size int, max_tf int, min_ratio double, ids array<{kind}>, tfs array<int>, lengths array<int>"
        blocks = forward.select("id", "range", "length", "terms").mapInArrow(_blocks, schema)
        part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
        # few files, yet a common term's blocks in several
        dealt = blocks.withColumn("part", part).repartition(F.col("part"), F.pmod("range", F.lit(math.ceil(ranges / 1000))))
        dealt.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/blocks/{generation}")

    def _live(self) -> DataFrame:
        docs, dead = self._read("docs"), self.dead()
        return docs if dead is None else docs.join(dead.select("id", F.col("of").alias("generation")), ["id", "generation"], "left_anti")

    def dead(self) -> DataFrame | None:
        """Documents that count no more: id, of (the generation that holds them), terms."""
        return self._read("dead")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._add(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), max(self.generations(), default=-1) + 1)

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        none = self.spark.createDataFrame([], self._read("docs").select("id").schema)
        self._add(none.withColumn("text", F.lit("")), max(self.generations()) + 1, ids.select(F.col(id_col).alias("id")))

    def _leaving(self, ids: DataFrame) -> DataFrame:
        return self._live().join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("generation").alias("of"), "range", "terms", "length")

    def compact(self) -> PostingsIndex:
        """All that counts as one generation: its blocks are written anew from the kept terms, then older ones go."""
        old = self.generations()
        new = max(old) + 1
        self._add(self._live().select("id", F.array_join(F.flatten(F.transform("terms", lambda t: F.array_repeat(t["term"], t["tf"]))), " ").alias("text")), new)
        for g in old:
            for name in ("marks", "blocks", "docs", "dead"):
                path, fs = self._path(f"{name}/{g}")
                fs.delete(path, True)
        path, fs = self._path(f"dead/{new}")
        fs.delete(path, True)
        return self

    # search

    def _asked(self, queries: DataFrame, query_id_col: str, query_text_col: str) -> DataFrame:
        words = queries.select(F.col(query_id_col).alias("query_id"), F.explode(tokens(F.col(query_text_col))).alias("term"))
        return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))

    def plan(self, queries: DataFrame, k: int, query_id_col: str = "query_id", query_text_col: str = "text") -> tuple[DataFrame, DataFrame, float]:
        """The blocks that each query reads and those it could read at all (query_id, term, weight, generation, part,
        range, size, bound), and the mean length.

        The ranges whose bounds add up to most are read first: the k-th best score there is one that the k-th best
        document has at least. A range whose sum of bounds stays below it holds none of the k best."""
        asked = pinned(self._asked(queries, query_id_col, query_text_col))
        live = self._live()
        n, mean = live.agg(F.count("*"), F.avg("length")).first()
        mean = mean or 1.0
        terms = self._terms(asked)
        known = self._read("blocks").select("generation", "part", "term", "range", "size", "max_tf", "min_ratio").join(terms, "term", "left_semi")
        # a range that was read in two pieces has two blocks of a term
        known = pinned(known.groupBy("generation", "part", "term", "range").agg(F.sum("size").alias("size"), F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio")))
        df = known.groupBy("term").agg(F.sum("size").alias("df"))
        if (dead := self.dead()) is not None:
            lost = dead.select(F.explode("terms.term").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("lost"))
            df = df.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = asked.join(df.where("df > 0"), "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
        bound = F.col("weight") * (self.k1 + 1) / (1 + self.k1 * (1 - self.b) / F.col("max_tf") + self.k1 * self.b * F.col("min_ratio") / mean)
        could = pinned(weighed.join(known, "term").withColumn("bound", bound))
        key = ["query_id", "generation", "range"]
        ranges = could.groupBy(*key).agg(F.sum("bound").alias("most"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "generation", "range"))
        first = ranges.withColumn("nth", nth).where(F.col("nth") <= FIRST_RANGES + math.ceil(k / RANGE_DOCS)).select(*key)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        least = self._best(could.join(first, key), mean, k).withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        hopeful = ranges.join(least, "query_id", "left").where(F.col("most") >= F.coalesce("least", F.lit(0.0)) - 1e-6)
        return pinned(could.join(hopeful.select(*key), key)), could, mean

    def _terms(self, rows: DataFrame) -> DataFrame:
        terms = pinned(rows.select("term").distinct())
        return F.broadcast(terms) if terms.count() <= 100_000 else terms

    def _best(self, wanted: DataFrame, mean: float, k: int) -> DataFrame:
        """The k best documents of each query in each range of the wanted blocks: query_id, id, score.

        A block is read and shuffled once, whatever number of queries want it: it meets the range's other blocks,
        the weights of the queries that want them, and the range's dead documents."""
        wanted, key = pinned(wanted.select("query_id", "term", "weight", "generation", "part", "range")), ["generation", "range"]
        parts = [r["part"] for r in wanted.select("part").distinct().collect()]
        ranges = F.broadcast(wanted.select(*key).distinct())  # a row for each RANGE_DOCS documents at most
        lists = ["ids", "tfs", "lengths"]
        blocks = self._read("blocks").where(F.col("part").isin(parts)).select(*key, "term", *lists).join(self._terms(wanted), "term", "left_semi").join(ranges, key, "left_semi")
        kinds, kind = dict(wanted.dtypes), dict(self._read("docs").dtypes)["id"]
        sides = [blocks, wanted.select(*key, "term", "query_id", "weight")]
        if (dead := self.dead()) is not None:
            sides.append(dead.select(F.col("of").alias("generation"), "range", "id").join(ranges, key, "left_semi"))
        rows = sides[0].withColumns({"query_id": F.lit(None).cast(kinds["query_id"]), "weight": F.lit(None).cast("double"), "id": F.lit(None).cast(kind)})
        for other in sides[1:]:
            rows = rows.unionByName(other, allowMissingColumns=True)
        return rows.groupBy(*key).applyInArrow(_score_range(k, mean, self.k1, self.b), f"query_id {kinds['query_id']}, id {kind}, score double")

    def search(self, queries: DataFrame, k: int, query_id_col: str = "query_id", query_text_col: str = "text") -> DataFrame:
        """The k best documents for each query that share a term with it, as bm25_topk() gives them: query_id, id,
        score, rank. An empty side gives no rows."""
        if (docs := self._read("docs")) is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        if self._read("blocks") is None:
            kinds = dict(queries.dtypes)[query_id_col], dict(docs.dtypes)["id"]
            return self.spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int")
        needed, _, mean = self.plan(queries, k, query_id_col, query_text_col)
        return ranked(self._best(needed, mean, k), k)


def _count_terms(batches):
    """Lengths and counts of distinct terms of documents (id, range, words)."""
    for b in (x.slice(at, RANGE_DOCS) for x in batches for at in range(0, x.num_rows, RANGE_DOCS)):
        size = np.diff(b.column(2).offsets.to_numpy())
        words = b.column(2).flatten().dictionary_encode()
        keys, tf = np.unique(np.repeat(np.arange(len(size)), size) << 32 | words.indices.to_numpy(), return_counts=True)
        ends = np.searchsorted(keys >> 32, np.arange(len(size) + 1))
        terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(keys & 0xFFFFFFFF)), pa.array(tf, pa.int32())], names=["term", "tf"])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms)], names=["id", "range", "length", "terms"])


def _blocks(batches):
    """Blocks of postings of documents (id, range, length, terms) that come in order of their ranges."""
    held = []

    def emit(tables):
        rows = pa.Table.from_batches(tables).combine_chunks()
        terms = rows.column("terms").combine_chunks()
        flat, of = terms.flatten(), np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy()))
        if not len(flat):
            return
        words, tf = flat.field("term").dictionary_encode(), flat.field("tf").to_numpy()
        code, part, length = words.indices.to_numpy(), rows.column("range").to_numpy()[of], rows.column("length").to_numpy()[of]
        order = np.lexsort((part, code))
        code, part, of, tf, length = (x[order] for x in (code, part, of, tf, length))
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])))
        ends = np.append(starts, len(code)).astype(np.int32)
        postings = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (rows.column("id").combine_chunks().take(pa.array(of)), pa.array(tf), pa.array(length))]
        least = np.minimum.reduceat(length / tf, starts)
        columns = [words.dictionary.take(pa.array(code[starts])), pa.array(part[starts]), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, starts)), pa.array(least), *postings]
        for b in pa.Table.from_arrays(columns, names=["term", "range", "size", "max_tf", "min_ratio", "ids", "tfs", "lengths"]).to_batches(max_chunksize=10_000):
            yield b

    for b in (x.slice(at, RANGE_DOCS) for x in batches for at in range(0, x.num_rows, RANGE_DOCS)):
        part = b.column(1).to_numpy()
        other = np.flatnonzero(part != part[-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # the last range may go on in the next batch
        if cut or (held and held[-1].column(1)[-1].as_py() != part[0]):
            yield from emit([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield from emit(held)


def _score_range(k: int, mean: float, k1: float, b: float):
    """The k best documents of a range for each query that wants some of its blocks (ties by id)."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        wanted, blocks = table.filter(table.column("query_id").is_valid()), table.filter(table.column("ids").is_valid())
        codes = wanted.column("query_id").combine_chunks().dictionary_encode()
        names, number = codes.dictionary, {t: i for i, t in enumerate(pc.unique(wanted.column("term")).to_pylist())}
        lists = blocks.column("ids").combine_chunks()
        ids = lists.flatten().dictionary_encode()
        place = np.argsort(pc.rank(ids.dictionary, sort_keys="ascending", tiebreaker="first").to_numpy()) if len(ids) else np.zeros(0, np.int64)
        doc = np.empty(len(place), np.int64)
        doc[place] = np.arange(len(place))  # documents in order of their ids
        doc = doc[ids.indices.to_numpy()]
        term = np.repeat(np.array([number.get(t, -1) for t in blocks.column("term").to_pylist()], np.int64), np.diff(lists.offsets.to_numpy()))
        tf, length = (blocks.column(x).combine_chunks().flatten().to_numpy() for x in ("tfs", "lengths"))
        weight = tf * (k1 + 1.0) / (tf + k1 * (1 - b + b * length / mean))
        gone = pc.index_in(table.column("id").drop_null().combine_chunks(), value_set=ids.dictionary).drop_null().to_numpy() if len(ids) else np.zeros(0, np.int64)
        live = np.ones(len(place), bool)
        live[np.argsort(place)[gone]] = False
        query, of, each = codes.indices.to_numpy(), np.array([number[t] for t in wanted.column("term").to_pylist()], np.int64), wanted.column("weight").to_numpy()
        found = []
        for at in range(0, len(names), QUERIES_AT_ONCE):
            some = (query >= at) & (query < at + QUERIES_AT_ONCE)
            own = np.unique(of[some])
            if not len(place):
                break
            local = np.full(len(number), -1)
            local[own] = np.arange(len(own))
            m = np.zeros((len(own), min(QUERIES_AT_ONCE, len(names) - at)))
            m[local[of[some]], query[some] - at] = each[some]
            w, held = np.zeros((len(place), len(own))), (term >= 0) & (local[term] >= 0)
            w[doc[held], local[term[held]]] = weight[held]
            scores = np.where(live[:, None], w @ m, 0.0)
            hit, scores = scores > 0, np.round(scores, 9)
            best = np.argsort(np.where(hit, -scores, np.inf), axis=0, kind="stable")[:k]
            i, j = np.nonzero(np.take_along_axis(hit, best, 0))
            found.append((j + at, place[best[i, j]], scores[best[i, j], j]))
        q, d, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table([names.take(pa.array(q)), ids.dictionary.take(pa.array(d)), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    return work
