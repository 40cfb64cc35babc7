"""Significance of a pair of counts under Poisson sampling of two libraries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tails(x: Column, y: Column, n1: Column, n2: Column) -> tuple[Column, Column]:
    """P(Y <= y | x) = I_p(x + 1, y + 1) and I_(1-p)(y + 1, x + 1), p = n1 / (n1 + n2).

    For whole numbers the incomplete beta function is a binomial tail over x + y + 1 trials;
    its terms are stepped through as logarithms. The second is 1 less the first, summed on its
    own so that small values stay exact.
    """
    n = x + y + 1
    p = n1 / (n1 + n2)
    odds = F.ln(p / (1 - p))
    start = F.struct((n * F.ln(1 - p)).alias("t"), F.lit(0.0).alias("hi"), F.exp(n * F.ln(1 - p)).alias("lo"))

    def step(a: Column, j: Column) -> Column:
        t = a.t + F.ln((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (a.hi + F.when(j > x, F.exp(t)).otherwise(0.0)).alias("hi"), (a.lo + F.when(j <= x, F.exp(t)).otherwise(0.0)).alias("lo"))

    found = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, step)
    return found.hi, found.lo


def audic_claverie(pairs: DataFrame) -> DataFrame:
    """`pairs` (x, y, n1, n2) with p_le = P(Y <= y | x) and p_gt = its complement."""
    low, high = tails(F.col("x"), F.col("y"), F.col("n1"), F.col("n2"))
    return pairs.withColumn("p_le", low).withColumn("p_gt", high)


#: Weights stepped through at once, and what is nothing beside the likeliest one's.
STEPS, NOTHING = 1 << 16, 1e-30


def outwards(x: int, q: float, mode: int, up: bool) -> Iterator[np.ndarray]:
    """Weights C(x + y, y) q^y of the y beyond `mode`, its own being 1, some at once: upwards, or down to 0, until
    they are nothing beside it."""
    at, last = mode, 1.0
    while last > NOTHING and (up or at > 0):
        y = np.arange(at + 1, at + 1 + STEPS, dtype=float) if up else np.arange(at, max(0, at - STEPS), -1, dtype=float)
        w = last * np.cumprod(q * (x + y) / y if up else y / (q * (x + y)))
        yield w
        at, last = at + len(y) if up else at - len(y), w[-1]


def limits(x: int | None, n1: float | None, n2: float | None, tail: float) -> tuple[int | None, int | None]:
    """The largest y with P(Y <= y | x) < tail, -1 if there is none, and the smallest with P(Y > y | x) < tail; none where
    the first library is empty.

    P(Y = y | x) goes as C(x + y, y) q^y with q = n2 / (n1 + n2): its tails at all y are one sum of these weights, of which
    those near the likeliest y, some standard deviations of them, are all that a double can tell.
    """
    if x is None or n2 is None or not n1:
        return None, None
    q, mode = n2 / (n1 + n2), int(x * n2 / n1)
    below, above = (sum(float(w.sum()) for w in outwards(x, q, mode, up)) for up in (False, True))

    def first(bound: float) -> int:
        """The smallest y up to which the weights sum up to `bound`."""
        if bound <= below:
            seen, fewer = 0.0, 1
            for w in outwards(x, q, mode, False):
                sums = seen + np.cumsum(w)
                fewer += int(np.searchsorted(sums, below - bound, "right"))
                seen = float(sums[-1])
                if seen > below - bound:
                    break
            return max(0, mode - fewer)
        seen, at = below + 1, mode
        if bound > seen:
            for w in outwards(x, q, mode, True):
                sums = seen + np.cumsum(w)
                more = int(np.searchsorted(sums, bound))
                if more < len(w):
                    return at + more + 1
                seen, at = float(sums[-1]), at + len(w)
        return at

    total = below + 1 + above
    return first(tail * total) - 1, first((1 - tail) * total)


def interval(rows: DataFrame, *, sig: float = 0.05) -> DataFrame:
    """`rows` (x, n1, n2) with y_min, the largest y whose lower tail is under sig / 2 (-1: none), and
    y_max, the smallest whose upper tail is."""
    keys = ["x", "n1", "n2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [limits(*r, sig / 2) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], pa.int32()) for i in (0, 1))], names=[*keys, "y_min", "y_max"])

    wanted = rows.select(*keys).distinct()
    return wanted.mapInArrow(run, T.StructType([*wanted.schema, T.StructField("y_min", T.IntegerType()), T.StructField("y_max", T.IntegerType())]))
