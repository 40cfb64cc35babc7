"""k-means over partition-local ball trees, in exact integers.

Each task builds trees over its own vectors: a ball holds the radius around a centre, the count and
the integer sum of its vectors. A round walks every tree from the root with the centroids that can
still be nearest: where the triangle inequality leaves one, the whole ball is its own, by its
count and sum alone; where it doesn't, the walk goes on to the halves and, in a leaf, to
the vectors, whose distances are exact integers. What a round hands on are the counts and sums of
each centroid, a row a task and centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.sources.shared import stored

from .common import map_batches

#: Vectors of a tree, and of a leaf.
TREE, LEAF = 2048, 24
#: The largest component, as an integer, of which sums of squared differences fit into a long.
LARGEST = 1 << 27
#: What the floating-point bounds of a ball are widened by; far above their error, far below 1 in a square.
MARGIN = 1e-6

NODES = ("begin", "end", "left", "radius", "centre", "sums")
TREES = "ids array<long>, points binary, begin binary, end binary, left binary, radius binary, centre binary, sums binary"


def kept(rows: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", size: int = 64) -> DataFrame:
    """(vec_id, v): the vectors of exactly `size` finite components."""
    v = F.col(vector_column).cast("array<double>")
    fine = (F.size(v) == size) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col(vector_column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as integers."""
    scaled = np.floor(1024 * x)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST / 1024:.0f}: squared distances don't fit into a long")
    return scaled.astype(np.int64)


def tree(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points in the tree, and its nodes: each but a leaf is followed, at `left` and
    the place behind it, by its halves along its widest direction; a leaf's left is 0."""
    order = np.arange(len(points))
    begin, end, left, at = [0], [len(points)], [], 0
    while at < len(begin):
        a, b = begin[at], end[at]
        own = points[order[a:b]]
        wide = own.max(0) - own.min(0)
        if b - a <= LEAF or not wide.any():
            left.append(0)
        else:
            m = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, wide.argmax()], m)]
            left.append(len(begin))
            begin += [a, a + m]
            end += [a + m, b]
        at += 1
    inner = points[order].astype(np.float64)
    begin_, end_ = np.array(begin), np.array(end)
    totals = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
    sums = totals[end_] - totals[begin_]
    centre = sums / (end_ - begin_)[:, None]
    radius = np.array([np.sqrt(((inner[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(begin, end, centre)])
    return order, {"begin": begin_, "end": end_, "left": np.array(left), "radius": radius * (1 + 1e-9) + MARGIN, "centre": centre, "sums": sums}


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(points, centroids) exact squared distances."""
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def walked(nodes: dict[str, np.ndarray], points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(nodes that are one centroid's, those centroids, [(points, their centroids)] of the leaves reached)."""
    level = np.array([0])
    whole_nodes, owners, leaves = [], [], []
    far = centroids.astype(np.float64)
    while len(level):
        d = np.sqrt(((nodes["centre"][level][:, None, :] - far[None]) ** 2).sum(2))
        r = nodes["radius"][level]
        near = d.argmin(1)
        others = d.copy()
        others[np.arange(len(level)), near] = np.inf
        # Any vector of the ball is nearer to `near` than to all others, with room for rounding.
        nearest = d[np.arange(len(level)), near]
        one = nearest + r < others.min(1) - r - 1e-9 * (nearest + r)
        whole_nodes.append(level[one])
        owners.append(near[one])
        rest = level[~one]
        inner = nodes["left"][rest] > 0
        ends = rest[~inner]
        if len(ends):
            at = np.concatenate([np.arange(a, b) for a, b in zip(nodes["begin"][ends], nodes["end"][ends])])
            leaves.append((at, squares(points[at], centroids).argmin(1)))
        halves = nodes["left"][rest[inner]]
        level = np.concatenate([halves, halves + 1])
    return np.concatenate(whole_nodes), np.concatenate(owners), leaves


def grown(vectors: DataFrame) -> DataFrame:
    """A row for each tree: at most TREE vectors of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, points = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            order, nodes = tree(points)
            ids, points = ids.take(pa.array(order)), points[order].astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([points.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([nodes[n].tobytes()], pa.binary()) for n in NODES]], names=["ids", "points", *NODES])

        for batch in batches:
            x = whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            for k in range(0, len(x), LEAF):
                held.append((batch.column(0).slice(k, LEAF), x[k : k + LEAF]))
                if sum(len(h[0]) for h in held) + LEAF > TREE:
                    yield out()
        if held:
            yield out()

    return stored(map_batches(vectors, run, TREES), name="trees")


def unpacked(row: dict, size: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    kinds = {"radius": np.float64, "centre": np.float64}
    nodes = {n: np.frombuffer(row[n], kinds.get(n, np.int64)) for n in NODES}
    nodes |= {n: nodes[n].reshape(-1, size) for n in ("centre", "sums")}
    return nodes, np.frombuffer(row["points"], np.int32).reshape(-1, size).astype(np.int64)


def round_sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Centroid -> (count, sums) of its vectors: a row for each centroid comes to the driver."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for row in batch.select(["points", *NODES]).to_pylist():
                nodes, points = unpacked(row, size)
                found, owners, leaves = walked(nodes, points, centroids)
                np.add.at(counts, owners, nodes["end"][found] - nodes["begin"][found])
                np.add.at(sums, owners, nodes["sums"][found])
                for at, own in leaves:
                    np.add.at(counts, own, 1)
                    np.add.at(sums, own, points[at])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centroids)), pa.int32()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = map_batches(trees, run, "cluster int, n long, sums array<long>")
    # Decimals: over many trees sums may outgrow a long.
    each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(each.collect()):
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.s))
    return out


def named(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(rows: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", size: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row.

    Rows whose vector is null, of another length, or holds null or non-finite components take no
    part. The first centroids are the vectors of the smallest hashes of `seed:vec_id` (a null id
    counts as no digits; among rows of one id the smaller vector comes first, component by component);
    with fewer vectors than `clusters` there are as many centroids as vectors. Equal distances go to the
    smaller number, a centroid without vectors stays where it is. Rounds end early only where
    no centroid moved, as no later one would then. Repeated rows count as often as they stand there; other
    columns are ignored; an empty table gives an empty result. Components beyond 131,072 raise, as their
    squared distances fit no long. However many copies a vector has, each tree holds its own.
    """
    spark = rows.sparkSession
    vectors = kept(rows, id_column=id_column, vector_column=vector_column, size=size)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.orderBy(F.sha2(text, 256), F.transform("v", lambda c: F.floor(c * 1024))).limit(clusters).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = whole(np.array([r.v for r in first], np.float64))
    trees = grown(vectors)
    for _ in range(rounds):
        moved = centroids.copy()
        for k, (n, sums) in round_sums(trees, centroids).items():
            if n:
                moved[k] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for k, row in enumerate(batch.select(["points", *NODES]).to_pylist()):
                nodes, points = unpacked(row, size)
                found, owners, leaves = walked(nodes, points, centroids)
                cluster = np.empty(len(points), np.int32)
                for node, owner in zip(found, owners):
                    cluster[nodes["begin"][node] : nodes["end"][node]] = owner
                for at, own in leaves:
                    cluster[at] = own
                distance = ((points - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids[k].values, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = stored(map_batches(trees, run, "vec_id long, cluster int, distance long"), name="assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = spark.createDataFrame([(k, sums.get(k, 0), sum(sums.values()), named(c)) for k, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # A row for each centroid.
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(size: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The same rows in DuckDB: every vector against every centroid in every round."""
    square = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i])))"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = {size} AND len(embedding) = {size})",
        f"c0 AS MATERIALIZED (SELECT c, p FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), p) - 1 AS c, p FROM v) WHERE c < {clusters})",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(p) AS p, min((d, c)) AS near FROM (SELECT r, vec_id, v.p AS p, c, {square} AS d FROM v, c{k} c) GROUP BY r)")
        if k < rounds:
            parts += [
                f"s{k} AS (SELECT near[2] AS c, i, sum(x) AS s, count(*) AS n FROM (SELECT near, unnest(p) AS x, unnest(range({size})) AS i FROM a{k}) GROUP BY 1, 2)",
                f"m{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS p FROM s{k} GROUP BY c)",
                f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.p, o.p) AS p FROM c{k} o LEFT JOIN m{k} m USING (c))",
            ]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, near[2]::INTEGER AS cluster, near[1]::BIGINT AS distance, (sum(near[1]) OVER (PARTITION BY near[2]))::BIGINT AS cluster_inertia, (sum(near[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.near[2]"""


ORACLE_SQL = oracle_sql()
