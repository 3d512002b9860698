"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, raw

#: Bytes that part words: all ASCII but letters and the apostrophe become a space, A-Z lower case.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))
MEMO_WORDS = 400_000
#: Expected severity from which a text counts as toxic.
REJECT_AT = 0.25


def text_words(text: bytes) -> set[bytes]:
    return set(text.translate(WORD_BYTES).split())


def word_features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings of four to six letters (bytes)."""
    return [word, *(b"^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


@dataclass
class OrdinalModel:
    """P(grade > k) = 1 / (1 + exp(thresholds[k] - score)); score sums the weights of distinct words' features."""

    weights: dict[bytes, float]
    thresholds: list[float]

    def severity(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the most probable grade."""
        above = 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -60, 60)))
        edges = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
        return above.sum(1), np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_cols: int, n_grades: int, l2: float = 3.0, rounds: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, and ordered thresholds, by gradient steps with momentum (Adam)."""
    n = len(grades)
    w, first, gaps = np.zeros(n_cols), 0.0, np.zeros(max(0, n_grades - 2))
    params = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, theta = params[:n_cols], params[n_cols] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_cols + 1 :]))])
        score = np.bincount(rows, w[cols], n)
        # likelihood of the grade: difference of neighbouring cumulative probabilities
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        like = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        d_score = -(slope[at, grades] - slope[at, grades + 1]) / like
        d_theta = np.zeros((n, n_grades + 1))
        d_theta[at, grades] += slope[at, grades] / like
        d_theta[at, grades + 1] -= slope[at, grades + 1] / like
        by_theta = d_theta[:, 1:-1].sum(0)
        back = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, d_score[rows], n_cols) + l2 * w, [back[0]], back[1:] * np.exp(params[n_cols + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params[:n_cols], params[n_cols] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_cols + 1 :]))])


def grade_by_density(toxic: int, hits: int, words: int) -> int:
    """Severity of a labelled text: 0 where it isn't toxic, else 1 to 3 as the share of telling words grows."""
    if not toxic:
        return 0
    share = hits / max(words, 1)
    return 1 if share < 0.01 else 2 if share < 0.04 else 3


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_features: int = 20_000, least_rows: int = 3, least_statistic: float = 10.0) -> OrdinalModel:
    """Fit on at most max_rows labelled rows, those with the smallest hash of their id; where documents repeat ids so
    often that they have more rows than that, equal rows count once and those with the smallest hash of id and text stay.

    Features are chosen on the cluster: how many toxic and other sample rows hold each, then the
    max_features with the largest likelihood ratio statistic, of those that reach least_statistic. Only the chosen features of the sample
    come to the driver. Labels that are 0/1 become grades by the density of telling words; a label
    column with values above 1 is used as grades directly. Without labelled rows of two grades, or
    documents for both, the model scores everything 0.

    Labels with a null id or grade don't count, of several labels of an id the highest does; labelled
    ids that documents lack are no sample rows, repeated documents are several, null texts have no words;
    empty tables give the model that scores 0; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    spark = docs.sparkSession
    picked = marks.select("id", "y").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_rows)
    picked = {r["id"]: r["y"] for r in picked.collect()}
    empty = OrdinalModel({}, [60.0])
    if len({min(y, 1) for y in picked.values()}) < 2:
        return empty
    shared = spark.sparkContext.broadcast(picked)

    def sample(batch):
        chosen = shared.value
        keep = [i for i, d in enumerate(batch.column(0).to_pylist()) if d in chosen]
        if keep:
            yield batch.take(pa.array(keep))

    rows = map_arrow(own, sample, f"id {dict(docs.dtypes)[id_col]}, text string")

    def counts(batch):
        found: dict[bytes, list[int]] = {}
        for d, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            y = shared.value[d] > 0
            for f in {b""} | {f for w in text_words(text) for f in word_features(w)}:
                c = found.setdefault(f, [0, 0])
                c[y] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *(pa.array([c[i] for c in found.values()], pa.int64()) for i in (0, 1))], names=["f", "n0", "n1"])

    rows = bounded_rows(materialise(rows, "labelled"), max_rows)  # read twice
    sums = map_arrow(rows, counts, "f binary, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = materialise(sums.where(F.col("n0") + F.col("n1") >= least_rows), "features")
    # no word is empty: this stands for every sample row that documents have, repeated ones too
    total = next(((r["n0"], r["n1"]) for r in sums.where("f = X''").collect()), (0, 0))
    if not all(total):
        return empty
    sums = sums.where("f <> X''")
    n0, n1, a, b = F.col("n0"), F.col("n1"), float(total[0]), float(total[1])
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    g = 2 * (part(n0, (n0 + n1) * a / (a + b)) + part(n1, (n0 + n1) * b / (a + b)) + part(a - n0, (a + b - n0 - n1) * a / (a + b)) + part(b - n1, (a + b - n0 - n1) * b / (a + b)))
    best = sums.select("f", "n0", "n1", g.alias("g")).where(F.col("g") >= least_statistic).orderBy(F.desc("g"), "f").limit(max_features).collect()
    feature = {bytes(r["f"]): i for i, r in enumerate(best)}
    telling = {bytes(r["f"]) for r in best if r["g"] > 30 and math.log((r["n1"] + 0.5) / b) - math.log((r["n0"] + 0.5) / a) > 2}
    known = spark.sparkContext.broadcast((feature, telling))

    def vectors(batch):
        feature, telling = known.value
        out = []
        for d, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            words = text.translate(WORD_BYTES).split()
            hits = sum(not telling.isdisjoint(word_features(w)) for w in words)
            cols = [feature[f] for w in set(words) for f in word_features(w) if f in feature]
            y = shared.value[d]
            out.append((np.asarray(cols, "<i4").tobytes(), y if y > 1 else grade_by_density(y, hits, len(words)), y))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["cols", "grade", "y"])

    got = map_arrow(rows, vectors, "cols binary, grade int, y int").collect()
    grades = np.array([r["y"] if max(picked.values()) > 1 else r["grade"] for r in got], np.int64)
    sizes = [len(r["cols"]) // 4 for r in got]
    cols = np.frombuffer(b"".join(r["cols"] for r in got), "<i4").astype(np.int64)
    levels, grades = np.unique(grades, return_inverse=True)
    if len(levels) < 2 or not feature:
        return empty
    w, theta = fit_ordinal(np.repeat(np.arange(len(got)), sizes), cols, grades, len(feature), len(levels))
    return OrdinalModel({f: float(w[i]) for f, i in feature.items() if abs(w[i]) > 1e-4}, theta.tolist())


def bounded_rows(rows: DataFrame, max_rows: int) -> DataFrame:
    """rows (id, text) of a written table as they are, or of more than max_rows at most so many: each once, and those
    with the smallest hash. Only hashes are sorted, and one comes to the driver."""
    if rows.count() <= max_rows:
        return rows
    one = rows.withColumn("h", F.xxhash64("id", "text")).dropDuplicates(["h", "id", "text"])
    one = materialise(one, "labelled-once")
    last = one.select("h").orderBy("h").limit(max_rows + 1).agg(F.max("h").alias("h"), F.count("*").alias("n")).first()
    if last["n"] > max_rows:
        one = one.where(F.col("h") < last["h"])
    return one.drop("h")


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, score, expected_severity, grade and toxic (expected severity of reject_at or more).

    The model (bounded by its number of features) is broadcast; whole texts are read. Null and empty
    texts have score 0, the severity of no evidence; repeated rows come back each; an empty table
    gives no rows; other columns are ignored.
    """
    judge = _judge(docs, model)

    def work(batch):
        scores, severity, grade = judge(raw(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(severity), pa.array(grade, pa.int32()), pa.array(severity >= reject_at)], names=["doc_id", "score", "expected_severity", "grade", "toxic"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, f"doc_id {dict(docs.dtypes)[id_col]}, score double, expected_severity double, grade int, toxic boolean")


def filter_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs that score() would not call toxic, with all their columns.

    Null and empty texts have the severity of no evidence and stay; repeated rows stay repeated; an empty
    table gives no rows."""
    judge, at = _judge(docs, model), docs.columns.index(text_col)

    def work(batch):
        yield batch.filter(pa.array(judge(raw(batch.column(at)))[1] < reject_at))

    return map_arrow(docs, work, docs.schema)


def _judge(docs: DataFrame, model: OrdinalModel):
    """A function of texts to scores, expected severities and grades, over a broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[bytes, float] = {}

    def weight(word: bytes) -> float:
        if (w := memo.get(word)) is None:
            get = shared.value.weights.get
            w = memo[word] = math.fsum(get(f, 0.0) for f in word_features(word))
        return w

    def judge(texts: list[bytes]):
        if len(memo) > MEMO_WORDS:
            memo.clear()
        scores = np.array([math.fsum(map(weight, text_words(t))) for t in texts])
        return scores, *shared.value.severity(scores)

    return judge
