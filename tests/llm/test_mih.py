import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import mih


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**64, 500, dtype=np.uint64)
    codes[100:200] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    index = mih.Index(codes)
    for radius in (0, 1, 7, 8, 20, 31, 64):
        for code in codes[::97]:
            want = np.flatnonzero(np.bitwise_count(codes ^ code) <= radius)
            assert np.array_equal(index.within(code, radius), want)


def brute(ids, x, asked, k):
    out = {}
    for i in np.flatnonzero(asked):
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[ids[i]] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = mih.nearest(rows, F.col("id") % 20 == 0, k=20).collect()
    data = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], np.float64)
    want = brute(ids, x, ids % 20 == 0, 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == want.keys()
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    for q, rows in found.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(abs(x[np.searchsorted(ids, i)] @ x[np.searchsorted(ids, q)] - s) < 1e-12 for i, s in rows)


def test_lengths_count_in_inner_products(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16)) * rng.gamma(2, 1, (300, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = mih.nearest(rows, F.col("id") % 20 == 0, k=5).collect()
    want = brute(np.arange(300), x, np.arange(300) % 20 == 0, 5)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert len(got) == 75 and hits >= 0.9 * 75


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, rank int, score double, query_id long, slot int, ids int"
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 2.0, 3.0], []]
    rows = [(20 * k, v, 1, 1.0, 1, 1, 1) for k, v in enumerate(vectors)] + [(None, [1.0, 1.0], 1, 1.0, 1, 1, 1), (0, [1.0, 0.0], 1, 1.0, 1, 1, 1)]
    got = mih.nearest(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    # Both rows of id 0 are candidates, of each other too, and both are asked for.
    zero = [(0, 1, 0, 1.0), (0, 2, 20, 1.0), (0, 3, 40, 0.5)]
    want = sorted(zero + zero) + [(20, 1, 0, 1.0), (20, 2, 0, 1.0), (20, 3, 40, 0.5), (40, 1, 0, 0.5), (40, 2, 0, 0.5), (40, 3, 20, 0.5)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == want
    assert mih.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert mih.nearest(one, F.lit(True)).count() == 0
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(50)], "vec_id long, embedding array<double>")
    got = mih.nearest(same, F.col("id") == 40, k=4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3]


def test_equal_vectors_tie_wherever_they_stand(spark):
    rng = np.random.default_rng(6)
    x, v = rng.standard_normal((3000, 48)), rng.standard_normal(48)
    twins = rng.choice(3000, 40, replace=False)
    x[twins] = 3 * v
    keep, score = mih.ranked(x, v, np.arange(3000)[::-1].copy(), 40)
    assert sorted(keep) == sorted(twins) and len(set(score)) == 1
    assert list(keep) == sorted(twins, reverse=True)


def test_lengths_never_meet(spark):
    rows = [(i, [1.0] * (2 + i % 2)) for i in range(40)]
    got = mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") < 2, k=30).collect()
    assert len(got) == 38 and all((r.query_id - r.vec_id) % 2 == 0 and r.score == 2 + r.query_id % 2 for r in got)
