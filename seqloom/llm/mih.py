"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors become 64-bit codes: the signs of their coordinates after a rotation fitted to a bounded
sample by iterative quantisation. A code falls into eight substrings of eight bits, and each
substring of each block of codes has an index of its own. Codes within r bits of a query's have,
by the pigeonhole principle, a substring within r // 8 bits of the query's (for the first
r % 8 + 1 substrings; within one bit less for the others), so probing all such substrings
retrieves every code within the radius; these are ranked by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.shared import stored

from .common import lowest, map_batches

BITS, PARTS = 64, 8
#: Substrings by their bit counts: the ball of radius s is the first BALL[s] of them.
BY_COUNT = np.array(sorted(range(256), key=lambda v: (v.bit_count(), v)), np.int64)
BALL = np.cumsum(np.bincount([v.bit_count() for v in range(256)]))
INDEX_ROWS, QUERY_ROWS, SAMPLE = 16_384, 1024, 4096


class Coder:
    """Codes of vectors, the rotation and the search radius learned from a sample."""

    def __init__(self, sample: np.ndarray, longest: float, k: int, reach: float, rounds: int = 15):
        self.longest = longest
        lifted = self.lift(sample)
        d = lifted.shape[1]
        blocks = []
        rng = np.random.default_rng(11)
        while sum(b.shape[1] for b in blocks) < BITS:
            turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
            for _ in range(rounds):  # the rotation under which the signs lose least
                u, _, v = np.linalg.svd(np.where(lifted @ turn > 0, 1.0, -1.0).T @ lifted)
                turn = (u @ v).T
            blocks.append(turn)
        self.turn = np.hstack(blocks)[:, :BITS]
        self.radius = self.learned_radius(sample, k, reach)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more coordinate makes all vectors equally long: their angles then rank inner products."""
        rest = np.maximum(self.longest**2 - (x * x).sum(1), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]]) / max(self.longest, 1e-300)

    def codes(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        y = np.hstack([x, np.zeros((len(x), 1))]) if queries else self.lift(x)
        return np.packbits(y @ self.turn > 0, axis=1, bitorder="little").view("<u8")[:, 0]

    def learned_radius(self, sample: np.ndarray, k: int, reach: float) -> int:
        """Bits within which lie the share `reach` of the sample's own true neighbours.

        Neighbours in a sample are farther than in all rows, so the radius errs upwards.
        """
        if len(sample) < 2:
            return BITS
        some = sample[:256]
        near = some @ sample.T
        near[np.arange(len(some)), np.arange(len(some))] = -np.inf
        top = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
        bits = np.bitwise_count(self.codes(some, True)[:, None] ^ self.codes(sample)[top])
        return int(np.quantile(bits, reach, method="higher"))


class Index:
    """Substring indexes over one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint8).reshape(-1, PARTS)
        self.order = [np.argsort(parts[:, j], kind="stable") for j in range(PARTS)]
        self.start = [np.searchsorted(parts[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Numbers of all codes within the radius, in order."""
        seen = np.zeros(len(self.codes), bool)
        share, more = divmod(radius, PARTS)
        parts = np.array([code], "<u8").view(np.uint8)
        for j in range(PARTS):
            s = share if j <= more else share - 1
            if s < 0:
                continue
            probes = BY_COUNT[: BALL[min(s, 8)]] ^ int(parts[j])
            lo, n = self.start[j][probes], self.start[j][probes + 1] - self.start[j][probes]
            lo, n = lo[n > 0], n[n > 0]
            at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            seen[self.order[j][at]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # ids, row numbers, vectors, codes


def search(queries: Side, rows: Side, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, query's id, id, score): the k best of a block for each query, among the codes
    within the radius; where these are fewer than k (or than the block has), the radius grows until
    they are not."""
    ids, numbers, vectors, codes = rows
    index = Index(codes)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for q, number, x, code in zip(*queries):
        least, reach = min(k + 1, len(ids)), radius
        while len(found := index.within(code, reach)) < least and reach < BITS:
            reach += 2
        found = found[numbers[found] != number]
        best, score = ranked(vectors[found], x, ids[found], k)
        for column, values in zip(out, (np.full(len(best), number), np.full(len(best), q), ids[found[best]], score)):
            column.append(values)
    return tuple(np.concatenate(c) for c in out)


def ranked(vectors: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best and their inner products, ties to smaller ids.

    A product that is quick but depends on a row's place picks what may be among the best; their
    own sums, in an order that is the same for every row, rank them: equal vectors tie.
    """
    keep = np.arange(len(vectors))
    if len(vectors) > 4 * k:
        rough = vectors @ x
        slack = 1e-9 * (np.abs(rough).max() + 1e-300) + 1e-12 * np.sqrt((x * x).sum() * (vectors * vectors).sum(1).max())
        keep = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - slack)
    score = np.ascontiguousarray(vectors[keep] * x).sum(1)
    best = np.lexsort((ids[keep], -score))[:k]
    return keep[best], score[best]


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, row, v): the rows whose vectors are finite and not zero, numbered."""
    v = F.col(vector_column).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = rows.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where(fine)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v"))


def nearest(rows: DataFrame, asked: Column, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, reach: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `asked` picks (a condition on `id`) its k
    nearest other rows by inner product, nearest first, ties to smaller ids.

    The share `reach` of true neighbours in the sample sets the radius; recall against brute
    force is tested. All rows are indexed. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do null ids. Rows that repeat an id are rows like any
    other: each is a candidate, and each that is asked for has neighbours of its own. Inner products
    are of vectors of one length, so rows of different lengths never meet. Fewer candidates than k
    give fewer rows, an empty table none. Blocks of queries meet blocks of rows, so a task holds one
    of each, and a pair of blocks hands on k rows a query at most, whatever copies there are.
    """
    vectors = stored(usable(rows, id_column, vector_column), name="vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(squares).alias("most")).orderBy("d").collect()  # one row a length
    parts = [_nearest(vectors.where(F.size("v") == s.d), asked, s.n, float(np.sqrt(s.most)), k, reach) for s in sizes]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, parts)


def _nearest(vectors: DataFrame, asked: Column, n: int, longest: float, k: int, reach: float) -> DataFrame:
    spark = vectors.sparkSession
    sample = lowest(vectors, F.col("id"), SAMPLE, "id", "row").collect()
    shared = spark.sparkContext.broadcast(Coder(np.array([r.v for r in sample]), longest, k, reach))
    names = ["ids", "numbers", "vectors", "codes"]

    def blocks(part: DataFrame, size: int, count: int, queries: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []

            def out() -> pa.RecordBatch:
                ids, numbers, x = (np.concatenate(c) for c in zip(*held))
                held.clear()
                order = np.lexsort((numbers, ids))
                ids, numbers, x = ids[order], numbers[order], x[order]
                raw = [pa.array([c.tobytes()], pa.binary()) for c in (ids, numbers, x, shared.value.codes(x, queries))]
                return pa.RecordBatch.from_arrays([slot, *raw], names=["slot", *names])

            for batch in batches:
                slot = batch.column(3)[:1]
                ids, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                for k in range(0, len(ids), 1024):
                    held.append((ids[k : k + 1024], numbers[k : k + 1024], x[k : k + 1024]))
                    if sum(len(h[0]) for h in held) + 1024 > size:
                        yield out()
            if held:
                yield out()

        dealt = part.repartition(count).select("id", "row", "v", F.spark_partition_id().alias("slot"))
        return map_batches(dealt, run, "slot int, " + ", ".join(f"{c} binary" for c in names))

    slots = max(1, -(-n // INDEX_ROWS), min(6, -(-n // 4096)))
    index = blocks(vectors, INDEX_ROWS, slots, False)
    wanted = blocks(vectors.where(asked), QUERY_ROWS, max(1, -(-n // (20 * QUERY_ROWS))), True).drop("slot")
    wanted = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), *[F.col(c).alias(f"q_{c}") for c in names])
    work = wanted.join(index, "slot").select(*[f"q_{c}" for c in names], *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = shared.value.radius
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                sides = []
                for ids, numbers, x, codes in (row[:4], row[4:]):
                    ids, numbers = np.frombuffer(ids, np.int64), np.frombuffer(numbers, np.int64)
                    sides.append((ids, numbers, np.frombuffer(x, np.float64).reshape(len(ids), -1), np.frombuffer(codes, np.uint64)))
                got = search(*sides, radius, k)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, kinds)], names=["row", "query_id", "vec_id", "score"])

    found = map_batches(work, run, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
