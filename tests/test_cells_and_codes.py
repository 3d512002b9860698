"""Cells on two levels, the rotation without a matrix, packed codes and search over them."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sagewell import catalog
from sagewell.functions import rotation
from sagewell.functions.tables import pinned
from sagewell.operators import celltree, knn, quantize


def clustered(spark, n=900, dim=16, centres=40, noise=0.35, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    rows = [(i, (c[i % centres] + noise * rng.standard_normal(dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.collect()}


def test_rows_are_in_their_nearest_cells(spark):
    df = clustered(spark)
    tree = celltree.CellTree.fit(df)
    assert len(tree.top) == 10 and len(tree) > 60
    fine = {}
    for r in tree.fine.collect():
        fine.setdefault(r["top"], {})[r["place"]] = r["centroid"]
    rows = tree.assign(df).collect()
    assert len(rows) == 900
    for r in rows:
        m = np.array([r["embedding"]])
        top = int(knn.nearest_cell(m, tree.top)[0])
        own = np.array([fine[top][p] for p in range(len(fine[top]))])
        assert r["cell"] == top * celltree.MOST_CELLS + knn.nearest_cell(m, own)[0]


def test_lower_cells_by_join_are_those_by_broadcast(spark, monkeypatch):
    df = clustered(spark).union(spark.createDataFrame([(901, None), (902, []), (903, [float("nan")] * 16)], "vec_id bigint, embedding array<double>"))
    tree = celltree.CellTree.fit(df.where("vec_id < 901"))
    one = sorted((r["vec_id"], r["cell"]) for r in tree.assign(df).collect())
    monkeypatch.setattr(celltree, "BROADCAST_NUMBERS", 0)
    tree._all = None
    assert sorted((r["vec_id"], r["cell"]) for r in tree.assign(df, rows_per_slice=40).collect()) == one
    assert len(one) == 901


def test_tree_search_recall_and_exactness(spark):
    df = clustered(spark)
    tree, asked = celltree.CellTree.fit(df), df.where("vec_id % 20 = 0")
    cells = tree.assign(df).cache()
    truth = pairs(knn.exact_topk(df, asked, 10))
    assert pairs(tree.search(cells, asked, 10, n_probe=10_000, n_top=10_000)) == truth
    few = tree.search(cells, asked, 10, n_probe=12)
    assert len(pairs(few) & truth) / len(truth) >= 0.9
    assert tree.probes(asked, 12).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 12


def test_cluster_lloyd_equals_lloyd(spark):
    df = clustered(spark, 500).repartition(5)
    m = np.array([r["embedding"] for r in df.collect()])
    first = m[:7]
    got = celltree.lloyd_on_cluster(df.select(F.col("embedding").alias("vector")), first, 6)
    assert np.allclose(got, knn.lloyd(m, first, 6))


def test_a_hot_cell_gets_more_lower_cells_and_a_bounded_sample(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, (np.r_[5.0, np.zeros(7)] + 0.2 * rng.standard_normal(8)).tolist()) for i in range(600)] + [(600 + i, rng.standard_normal(8).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(celltree, "ROWS_A_CELL", 4)
    tree = celltree.CellTree.fit(df, top_cells=4, rows_a_cell=10)
    sizes = {r["top"]: r["count"] for r in tree.fine.groupBy("top").count().collect()}
    held = {r["top"]: r["count"] for r in celltree.assign_top(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), tree.top).groupBy("top").count().collect()}
    assert all(sizes[t] == -(-n // 10) for t, n in held.items())
    assert tree.assign(df).count() == 700


def test_tree_of_nothing(spark):
    df = clustered(spark, 10).limit(0)
    tree = celltree.CellTree.fit(df)
    assert tree.assign(clustered(spark, 10)).collect() == [] and len(tree) == 0


def test_many_probed_cells_are_bits(spark):
    df = clustered(spark, 900)
    tree, asked = celltree.CellTree.fit(df), df.where("vec_id % 20 = 0")
    cells, n = pinned(tree.assign(df)), len(tree)
    for n_probe, n_top in ((10_000, 10_000), (n // 2, 10_000), (5, 3)):
        listed = tree._listed(asked, n_probe, n_top).agg(F.max(F.octet_length("cells"))).first()[0]
        assert listed <= (n + 7) // 8
        plain = knn.search_cells(cells, tree.probes(asked, n_probe, n_top), 7, "vec_id", "embedding", True)
        got = tree.search(cells, asked, 7, n_probe, n_top, True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_all_cells_are_more_than_ten_thousand(spark, monkeypatch, tmp_path):
    # three upper cells of planes at right angles, a lower cell for each row; 3 to 8 are in the very last lower cell
    monkeypatch.setattr(celltree, "shape", lambda rows: (3, 1))
    n = 3500
    angle = np.arange(n) / n
    m = np.zeros((3 * n, 7))
    planes = np.r_[0, 1, np.full(n - 2, 2), np.zeros(n - 1, int), np.ones(n - 1, int), 2, 2]
    for p in range(3):
        own = np.flatnonzero(planes == p)
        m[own, 2 * p], m[own, 2 * p + 1] = np.cos(angle[: len(own)]), np.sin(angle[: len(own)])
    m[3:9] = m[-1]
    m[20] = np.eye(7)[6]  # has cosine zero with every other row: the smallest ids are next
    table = pa.table({"vec_id": pa.array(range(3 * n)), "embedding": pa.array(m.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * (3 * n), pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    emb = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert len(celltree.CellTree.fit(emb)) > 10_000
    got = catalog.QUERIES["tree_search_all_cells"](spark, str(tmp_path)).where("query_id = 20").orderBy("rank").collect()
    assert [r["id"] for r in got] == [20, *range(9)]


def test_both_sides_of_a_cell_are_dealt_to_slices(spark):
    df = clustered(spark, 400)
    c = knn.kmeans_cells(df, 3)
    cells, asked = knn.assign_cells(df, c), df.where("vec_id % 4 = 0")
    whole = knn.ivf_topk(cells, c, asked, 7, 3)
    probed = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cell"))
    cut = knn.search_cells(cells, probed, 7, "vec_id", "embedding", rows_per_slice=30, queries_per_slice=9)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("dim", [1, 5, 8, 24, 64])
def test_rotation_keeps_lengths_and_turns_back(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((6, dim))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").withColumn("turned", rotation.rotate("v", dim, 5)).withColumn("back", rotation.rotate_back("turned", dim, 5))
    for r in df.collect():
        full = np.pad(r["v"], (0, rotation.padded(dim) - dim))
        assert np.allclose(r["turned"], rotation.matrix(dim, 5) @ full) and np.allclose(r["back"], r["v"])
        assert np.isclose(np.linalg.norm(r["turned"]), np.linalg.norm(r["v"]))


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_columns_code_and_pack_as_arrays_do(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(40)] + [(40, [0.0] * 32), (41, None), (42, [1.0])]
    got = quantize.turned_codes(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), bits, 32).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(41))
    for r in got:
        codes = np.array(r["codes"])
        assert bytes(r["packed"]) == quantize.pack(codes, bits)
        if r["norm"]:
            unit = np.array(r["embedding"]) / r["norm"]
            want = np.searchsorted(np.array(quantize.BOUNDARIES[bits]), rotation.matrix(32, 42) @ unit * np.sqrt(32), side="left")
            assert (codes == want).all()
            assert np.linalg.norm(np.array(r["decoded"]) - r["embedding"]) < {1: 0.8, 2: 0.5, 3: 0.3, 4: 0.2}[bits] * r["norm"]
        else:
            assert r["decoded"] == [0.0] * 32


def test_product_codes_have_no_bias(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(300)]
    q = rng.standard_normal(64)
    got = quantize.turned_product_codes(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), 3, 64).collect()
    off = np.array([np.dot(np.array(r["decoded"]) - r["embedding"], q) for r in got])
    assert abs(off.mean()) < 3 * off.std() / np.sqrt(len(off)) and off.std() < 0.4 * np.linalg.norm(q)


@pytest.mark.parametrize("bits", [2, 4])
def test_packed_search_recall(spark, bits):
    df = clustered(spark, 800, dim=24)
    asked = df.where("vec_id % 20 = 0")
    stored = quantize.turned_codes(df, bits, 24).select("vec_id", "packed")
    truth = {(r["query_id"], r["id"]): r["score"] for r in knn.exact_topk(df, asked, 10).collect()}
    got = {(r["query_id"], r["id"]): r["score"] for r in quantize.packed_topk(stored, df, asked, 10, bits, 24, oversample=3).collect()}
    both = truth.keys() & got.keys()
    assert len(both) / len(truth) >= 0.9 and all(abs(truth[p] - got[p]) < 1e-9 for p in both)
    assert quantize.packed_topk(stored, df, asked.limit(0), 10, bits, 24).collect() == []
    with pytest.raises(ValueError, match="whole codes"):
        quantize.packed_topk(stored, df, asked, 10, 3, 24)


def test_tables_of_bytes_add_up_to_inner_products():
    rng = np.random.default_rng(6)
    q, codes = rng.standard_normal((3, 16)), rng.integers(0, 16, 16)
    packed = np.frombuffer(quantize.pack(codes, 4), np.uint8)
    table = quantize._tables(q, 4)
    scores = sum(table[:, p, packed[p]] for p in range(len(packed)))
    assert np.allclose(scores, q @ np.array(quantize.CENTROIDS[4])[codes] / 4)


@pytest.mark.parametrize("bits", [1, 4])
def test_packed_search_with_bounds_is_exact(spark, bits):
    rng = np.random.default_rng(12)
    near = rng.standard_normal(24) + 0.05 * rng.standard_normal((400, 24))  # more of nearly equal cosine than the codes tell apart
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([near, near[:60], rng.standard_normal((100, 24))]))] + [(900, [0.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked, stored = df.where("vec_id % 20 = 0"), quantize.turned_codes(df, bits, 24).select("vec_id", "packed")
    key = lambda d: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in d.collect())
    truth = key(knn.exact_topk(df, asked, 5))
    assert key(quantize.packed_topk(stored, df, asked, 5, bits, 24, exact=True)) == truth
    if bits == 1:
        assert key(quantize.packed_topk(stored, df, asked, 5, bits, 24)) != truth
