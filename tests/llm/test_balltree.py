import hashlib

import numpy as np
import pytest

from seqloom.llm import balltree

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, points string"


def plain(rows, clusters=8, rounds=10, size=64):
    """By all distances in Python's integers."""
    rows = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(rows, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in rows:
            own.setdefault(near(v)[1], []).append(v)
        for k, vs in own.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, k, d) for i, v in rows for d, k in [near(v)]]
    per = {}
    for _, k, d in out:
        per[k] = per.get(k, 0) + d
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, per[k], sum(per.values()), named[k]) for i, k, d in out), key=str)


def rows_of(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, balltree.clustered(df, **how).collect()), key=str)


def vectors(rng, n, spread, size=64):
    middles = rng.normal(size=(5, size))
    return [(int(k), [float(x) for x in (middles[k % 5] + spread * rng.normal(size=size)).astype(np.float32)]) for k in range(n)]


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(balltree, "TREE", 128)
    monkeypatch.setattr(balltree, "LEAF", 4)
    rows = vectors(np.random.default_rng(2), 400, spread)
    assert rows_of(spark, rows) == plain(rows)


def test_balls_go_whole_where_vectors_lie_in_groups():
    rng = np.random.default_rng(5)
    points = balltree.whole(np.array([v for _, v in vectors(rng, 2000, 0.01)]))
    order, nodes = balltree.tree(points)
    points = points[order]
    centroids = points[[int(np.flatnonzero(order == k)[0]) for k in range(5)]]
    found, owners, leaves = balltree.walked(nodes, points, centroids)
    reached = sum(len(at) for at, _ in leaves)
    assert reached < 0.05 * len(points)  # nearly all by whole balls
    own = np.empty(len(points), int)
    for node, k in zip(found, owners):
        own[nodes["begin"][node] : nodes["end"][node]] = k
    for at, k in leaves:
        own[at] = k
    assert (own == balltree.squares(points, centroids).argmin(1)).all()
    assert (nodes["sums"][0] == points.sum(0)).all()
    for a, b, s, r, c in zip(*(nodes[k] for k in ("begin", "end", "sums", "radius", "centre"))):
        assert (points[a:b].sum(0) == s).all() and np.sqrt(((points[a:b] - c) ** 2).sum(1)).max() <= r


def test_equal_distances_and_copies(spark):
    grid = [(k, [float(k % 3 - 1), float(k % 2)] + [0.0] * 62) for k in range(40)]
    assert rows_of(spark, grid) == plain(grid)
    same = [(k, [0.5] * 64) for k in range(500)] + [(7, [0.5] * 64)] * 500
    got = rows_of(spark, same)
    assert got == plain(same) and {r[1] for r in got} == {0}


def test_odd_rows(spark):
    v = [0.25] * 64
    odd = [(1, v), (2, None), (3, []), (4, v[:63]), (5, [None, *v[1:]]), (6, [float("nan"), *v[1:]]), (7, [float("-inf"), *v[1:]]), (None, [-x for x in v]), (None, v), (1, v), (8, [-1e-9] * 64), (9, v + [0.0])]
    got = rows_of(spark, odd)
    assert got == plain(odd) and len(got) == 5
    assert rows_of(spark, []) == [] and rows_of(spark, odd[1:5]) == []
    assert balltree.clustered(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(spark, odd[:1]) == plain(odd[:1])
    with pytest.raises(Exception, match="fit into a long"):
        rows_of(spark, [(1, [1e30] * 64)])
    assert rows_of(spark, [(1, [100_000.0] * 64), (2, [-100_000.0] * 64)], clusters=1) == plain([(1, [100_000.0] * 64), (2, [-100_000.0] * 64)], clusters=1)
