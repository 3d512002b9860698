"""The similarity self-join against exact neighbours, with copies, hot buckets and odd rows."""

import numpy as np
import pytest

from sagewell.operators import lifecycle, simjoin

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, threshold, k):
    """Every row's k best others by cosine, then by id."""
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1)[:, None]
    out = set()
    for i, s in zip(ids, np.round(m @ m.T, 12), strict=True):
        order = sorted((-x, j) for x, j in zip(s.tolist(), ids.tolist(), strict=True) if j != i and x >= threshold)
        out |= {(int(i), j) for _, j in order[:k]}
    return out


def found(spark, rows, threshold, k, **how):
    df = simjoin.near_neighbours(spark.createDataFrame(rows, SCHEMA), threshold, k, **how)
    return {(r["id"], r["other"]) for r in df.collect()}


def groups(seed, n, dim, centres, noise):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return [(i, (c[i % centres] + noise * rng.standard_normal(dim)).tolist()) for i in range(n)]


def test_one_bucket_is_exact(spark):
    rows = groups(1, 400, 24, 9, 0.7)
    for t in (0.2, 0.6, 0.95):
        assert found(spark, rows, t, 5) == brute(rows, t, 5)


@pytest.mark.parametrize(("threshold", "noise"), [(0.5, 0.6), (0.85, 0.3)])
def test_bands_reach_the_recall_they_promise(spark, threshold, noise):
    rows = groups(2, 900, 32, 90, noise)
    assert simjoin.plan_bands(len(rows), threshold, 0.97, 64)[0] > 3
    got, want = found(spark, rows, threshold, 6, bucket_rows=64), brute(rows, threshold, 6)
    assert len(got & want) / len(want) >= 0.95
    assert got <= brute(rows, threshold, len(rows))  # nothing below the threshold


def test_a_third_of_all_rows_are_copies_and_a_third_hardly_differ(spark):
    rng = np.random.default_rng(3)
    one, two = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(i, one.tolist()) for i in range(300)] + [(300 + i, (two + 1e-4 * rng.standard_normal(16)).tolist()) for i in range(300)] + [(600 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    got, want = found(spark, rows, 0.8, 4, bucket_rows=32), brute(rows, 0.8, 4)
    assert {(a, b) for a, b in got if a < 300} == {(a, b) for a, b in want if a < 300}
    assert len({a for a, _ in got if 300 <= a < 600}) == 300
    exact = found(spark, rows, 0.8, 4)
    assert {p for p in exact if not 300 <= p[0] < 600} == {p for p in want if not 300 <= p[0] < 600}


def test_groups_stay_within_the_bound(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(12)
    df = spark.createDataFrame([(i, (base + 1e-9 * rng.standard_normal(12)).tolist()) for i in range(700)], "rep bigint, vector array<double>")
    keys = simjoin._hashed(df, range(2), 3, 42)
    sizes = [r["count"] for r in simjoin._meeting(keys, 50).groupBy("band", "more", "bucket", "low", "high").count().collect()]
    assert max(sizes) <= 2 * 50 * 1.6  # slices are dealt by hash
    pairs = {tuple(sorted((a["rep"], b["rep"]))) for g in _groups(simjoin._meeting(keys.where("band = 0"), 50)).values() for a in g for b in g if a["rep"] < b["rep"]}
    assert len(pairs) >= 0.9 * 700 * 699 / 2  # all pairs of slices meet


def _groups(met):
    out = {}
    for r in met.drop("vector").collect():
        out.setdefault(tuple(r[c] for c in ("band", "more", "bucket", "low", "high")), []).append(r)
    return out


def test_odd_rows_have_no_neighbours(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0])]
    assert found(spark, rows, 0.9, 5) == {(1, 8), (8, 1), (1, 2), (2, 1), (2, 8), (8, 2)}
    assert found(spark, [], 0.9, 5) == set()


def test_too_many_bands_are_an_error(spark):
    with pytest.raises(ValueError, match="bands are needed"):
        simjoin.near_neighbours(spark.createDataFrame(groups(5, 3000, 8, 3000, 1.0), SCHEMA), 0.05, 5, bucket_rows=2)


def test_pairs_of_all_rows(spark):
    rows = groups(6, 300, 16, 40, 0.4)
    got = {(r["a"], r["b"]) for r in lifecycle.associate_all(spark.createDataFrame(rows, SCHEMA), 0.7, 5).collect()}
    assert got == {(min(p), max(p)) for p in brute(rows, 0.7, 5)}
