"""Motif matrices, scanning reads with them, and what positions of hits tell.

Matrices are (name, base, pos, w); hits are (sample, read_no, name, orient, pos, score), pos
0-based in the read, so that no hit ever spans two reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.align import CODE, by_length

ORIENTATIONS = ("ori", "rc", "r", "c")


def to_frequency(pwm: DataFrame, *, zero: float = 1e-6) -> DataFrame:
    """Counts to frequencies, column by column, zeros replaced, for matrices whose first column sums
    to over 1.2 or between 0 and 0.8; others are frequencies already."""
    sums = pwm.groupBy("name", "pos").agg(F.sum("w").alias("s"))
    first = sums.where("pos = 0").select("name", F.col("s").alias("first"))
    turn = (F.col("first") > 1.2) | ((F.col("first") > 0) & (F.col("first") < 0.8))
    share = F.when(F.col("w") == 0, F.lit(zero)).otherwise(F.col("w") / F.col("s"))
    return pwm.join(sums, ["name", "pos"]).join(first, "name").select("name", "base", "pos", F.when(turn, share).otherwise(F.col("w")).alias("w"))


def to_log10(pwm: DataFrame, *, zero: float = 1e-6) -> DataFrame:
    return to_frequency(pwm, zero=zero).withColumn("w", F.log10("w"))


def oriented(pwm: DataFrame, orient: str) -> DataFrame:
    """The matrix as it is (ori), reverse complement (rc), reversed (r) or complemented (c)."""
    width = pwm.groupBy("name").agg((F.max("pos") + 1).alias("m"))
    rows = pwm.join(width, "name")
    pos = F.col("m") - 1 - F.col("pos") if orient in ("rc", "r") else F.col("pos")
    base = F.translate("base", "ACGT", "TGCA") if orient in ("rc", "c") else F.col("base")
    return rows.select("name", base.alias("base"), pos.cast("int").alias("pos"), "w")


def even_background(pwm: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The matrix of a background that has the same shares at every position, in log10."""
    level = F.create_map(*[F.lit(x) for p in shares.items() for x in p])
    return to_log10(pwm.withColumn("w", level[F.col("base")]))


def log_odds(rows: list[tuple[str, str, int, float]], *, background: float = 0.25, zero: float = 1e-6) -> dict[str, np.ndarray]:
    """(4, m) arrays of log2(frequency / background)."""
    out: dict[str, np.ndarray] = {}
    for name in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == name]
        w = np.zeros((4, 1 + max(r[2] for r in own)))
        for _, base, pos, value in own:
            w["ACGT".index(base), pos] = value
        share = w / np.maximum(w.sum(0), 1e-300)
        out[name] = np.log2(np.where(share == 0, zero, share) / background)
    return out


def threshold(matrix: np.ndarray, p_value: float = 1e-4, *, step: float = 1e-3) -> float:
    """The least score whose share of all sequences of the matrix's length is at most p_value.

    Exact on scores rounded to `step`: the distribution is folded column by column. What rounding
    may have added comes off, so that every sequence of that share reaches the score, but at most
    half the way to the next lower one.
    """
    scores = np.rint(matrix / step).astype(np.int64)
    low = scores.min(0)
    dist = np.ones(1)
    for column in (scores - low).T:
        new = np.zeros(len(dist) + column.max())
        for s in column:
            new[s : s + len(dist)] += dist / 4
        dist = new
    tail = np.cumsum(dist[::-1])[::-1]
    reached = np.flatnonzero(dist > 0)
    fine = reached[tail[reached] <= p_value]
    if not len(fine):
        return float((len(dist) + low.sum()) * step)
    below = reached[reached < fine[0]]
    half = max(fine[0] - matrix.shape[1] / 2, (fine[0] + below[-1]) / 2 if len(below) else -np.inf)
    return float((half + low.sum()) * step)


def scan(reads: DataFrame, pwm: DataFrame, *, p_value: float | None = 1e-4, at_least: float | None = None, orientations: tuple[str, ...] = ORIENTATIONS, digits: int = 6) -> DataFrame:
    """Hits of all matrices in the given orientations: log2 odds over an even background.

    The threshold is each matrix's own for p_value, or `at_least` for all. Windows with N are
    no hits. Matrices, a few kilobytes, travel with the function.
    """
    matrices = log_odds([tuple(r) for r in pwm.select("name", "base", F.col("pos").cast("int"), F.col("w").cast("double")).collect()])
    plans = []
    for name, matrix in matrices.items():
        limit = at_least if at_least is not None else threshold(matrix, p_value)
        for o in orientations:
            m = matrix[:, ::-1] if o in ("rc", "r") else matrix
            plans.append((name, o, m[::-1] if o in ("rc", "c") else m, limit))
    names = ["sample", "read_no", "name", "orient", "pos", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in by_length(batch.column(2), 1):
                codes = CODE[text]
                unknown = np.concatenate([np.zeros((len(codes), 1), int), np.cumsum(codes == 4, 1)], 1)
                safe = np.minimum(codes, 3)
                for name, orient, matrix, limit in plans:
                    m = matrix.shape[1]
                    places = codes.shape[1] - m + 1
                    if places < 1:
                        continue
                    score = np.zeros((len(codes), places))
                    for k in range(m):
                        score += matrix[safe[:, k : k + places], k]
                    score = np.round(score, digits)
                    r, at = np.nonzero((score >= limit) & (unknown[:, m:] == unknown[:, :places]))
                    take = pa.array(rows[r])
                    n = len(r)
                    cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array([name] * n, pa.string()), pa.array([orient] * n, pa.string()), pa.array(at.astype(np.int32)), pa.array(score[r, at])]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = reads.select("sample", F.col("read_no").cast("long").alias("read_no"), "seq")
    return rows.mapInArrow(run, "sample string, read_no long, name string, orient string, pos int, score double")


#: Matrices whose widths travel to all tasks.
MOST_MATRICES = 100_000


def widths(pwm: DataFrame) -> DataFrame:
    """(name, m): a row a matrix, marked to travel to the hits if there are few enough."""
    found = pwm.groupBy("name").agg((F.max("pos") + 1).cast("int").alias("m"))
    return F.broadcast(found) if found.limit(MOST_MATRICES + 1).count() <= MOST_MATRICES else found


def centre_histogram(hits: DataFrame, pwm: DataFrame, reads: int, *, split: bool = False) -> DataFrame:
    """(name, orient, centre, share): hits by the motif's centre pos + (m - 1) / 2, over the number
    of reads; split puts half of an even motif's hit on each of its two middle positions."""
    rows = hits.join(widths(pwm), "name")
    if split:
        half = F.array(F.struct((F.col("pos") + F.col("m") / 2 - 1).alias("centre"), F.lit(0.5).alias("n")), F.struct((F.col("pos") + F.col("m") / 2).alias("centre"), F.lit(0.5).alias("n")))
        one = F.array(F.struct((F.col("pos") + (F.col("m") - 1) / 2).alias("centre"), F.lit(1.0).alias("n")))
        rows = rows.select("name", "orient", F.explode(F.when(F.col("m") % 2 == 0, half).otherwise(one)).alias("x")).select("name", "orient", "x.centre", "x.n")
    else:
        rows = rows.select("name", "orient", (F.col("pos") + (F.col("m") - 1) / 2).alias("centre"), F.lit(1.0).alias("n"))
    return rows.groupBy("name", "orient", "centre").agg((F.sum("n") / reads).alias("share"))


def position_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("name", "orient", "pos").agg(F.count("*").alias("n"))


def read_hits(hits: DataFrame, pwm: DataFrame) -> DataFrame:
    """(sample, read_no, name, m, ori, rc, r, c): 1-based centres of a read's hits, ascending.

    At most four a base of a read meet in a row.
    """
    rows = hits.join(widths(pwm), "name").withColumn("centre", F.col("pos") + (F.col("m") - 1) / 2 + 1)
    lists = [F.array_sort(F.collect_list(F.when(F.col("orient") == o, F.col("centre")))).alias(o) for o in ORIENTATIONS]
    return rows.groupBy("sample", "read_no", "name", "m").agg(*lists)


def consecutive_distances(hits: DataFrame) -> DataFrame:
    """(name, orient, distance, n): from each hit of a read to the next one."""
    lists = hits.groupBy("sample", "read_no", "name", "orient").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    steps = F.zip_with(F.slice("p", F.lit(2), F.size("p")), F.slice("p", F.lit(1), F.size("p") - 1), lambda b, a: b - a)
    return lists.where(F.size("p") > 1).select("name", "orient", F.explode(steps).alias("distance")).where("distance > 0").groupBy("name", "orient", "distance").agg(F.count("*").alias("n"))


def pair_spacing(by_read: DataFrame) -> DataFrame:
    """(name, first, second, at, gap, n): all ordered pairs of a read's hits on either strand; `at`
    is the first one's centre, less a half for even motifs as centres then are half integers."""

    def tag(strand: str):
        return F.transform(strand, lambda p: F.struct(F.lit(strand).alias("d"), p.alias("p")))

    tagged = F.concat(tag("ori"), tag("rc"))
    rows = by_read.select("name", "m", tagged.alias("x")).where(F.size("x") > 1)
    pairs = rows.select("name", "m", "x", F.explode("x").alias("a")).select("name", "m", "a", F.explode("x").alias("b")).where("a.p <> b.p")
    at = F.when(F.col("m") % 2 == 1, F.col("a.p")).otherwise(F.col("a.p") - 0.5)
    return pairs.groupBy("name", F.col("a.d").alias("first"), F.col("b.d").alias("second"), at.alias("at"), (F.col("b.p") - F.col("a.p")).alias("gap")).agg(F.count("*").alias("n"))
