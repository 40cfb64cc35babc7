"""Spectra of positional profiles, all in the JVM but for single-read transforms.

A profile is gathered once as an array of its few hundred points; the transform then folds that
array for each frequency, so nothing of the size points x frequencies is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import adm as adm_ops
from seqloom.operators.align import by_length

#: Fixed values of the original spectra: its value of pi, the frequency grid, the bands (in steps
#: of 1/2000) of the 10.2-base peak and of its background, the step whose phase is told.
PI = 3.14159265
STEPS, GRID = 600, 2000
PEAK, AROUND, PHASE_AT = (189, 204), (149, 250), 196
FLAT_TOP = (1.0, -1.93, 1.29, -0.388, 0.028)
BLACKMAN_HARRIS = (0.35875, -0.48829, 0.14128, -0.01168)


def window(kind: str | None, n: Column, i: Column) -> Column:
    """The weight of point i of n."""
    if kind is None:
        return F.lit(1.0)
    if kind == "welch":
        return 1 - F.pow((i - (n - 1) / 2) / ((n - 1) / 2), F.lit(2.0))
    terms = {"flat_top": FLAT_TOP, "blackman_harris": BLACKMAN_HARRIS}[kind]
    return sum((c * F.cos(2 * k * PI * i / (n - 1)) for k, c in enumerate(terms[1:], 1)), F.lit(terms[0]))


def profiles(adm: DataFrame, *, by: tuple[str, ...] = ("sample",), front: int = 0, drop: Column | None = None) -> DataFrame:
    """(by..., kmer, x): each k-mer's values in order, without `front` points at the start and
    `drop` (by default k - 1) at the end. Positions must be complete: fill zeros first."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("val").cast("double").alias("val")))), lambda p: p.val)
    drop = F.length("kmer") - 1 if drop is None else drop
    gathered = adm.groupBy(*by, "kmer").agg(pairs.alias("all"))
    return gathered.select(*by, "kmer", F.slice("all", F.lit(front + 1), F.greatest(F.size("all") - front - drop, F.lit(0))).alias("x"))


def folded(x: Column, angle: Column, f) -> Column:
    """sum of x[i] * f(angle * i)."""
    step = F.transform(x, lambda v, i: v * f(angle * i))
    return F.aggregate(step, F.lit(0.0), lambda a, v: a + v)


def dft_profile(adm: DataFrame, *, by: tuple[str, ...] = ("sample",), kind: str | None = "welch", front: int = 0, drop: Column | None = None) -> DataFrame:
    """(by..., kmer, h, freq, power, re, im) for h = 0 ... 599 at frequency h / 2000.

    The mean is removed, the window applied, power divided by mean * 5.1 * n / 10.2. A profile
    with mean 0 has null power.
    """
    rows = profiles(adm, by=by, front=front, drop=drop)
    rows = rows.withColumn("n", F.size("x")).withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x"))
    rows = rows.withColumn("y", F.transform("x", lambda v, i: (v - F.col("mean")) * window(kind, F.col("n"), i)))
    rows = rows.select(*by, "kmer", "n", "mean", "y", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("h"))
    angle = 2 * PI * F.col("h") / GRID
    rows = rows.withColumn("re", folded(F.col("y"), angle, F.cos)).withColumn("im", -folded(F.col("y"), angle, F.sin))
    norm = F.when(F.col("mean") != 0, F.col("mean") * 5.1 * F.col("n") / 10.2)
    return rows.select(*by, "kmer", "h", (F.col("h") / GRID).alias("freq"), (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / norm).alias("power"), "re", "im")


def peaks(spectrum: DataFrame, *, by: tuple[str, ...] = ("sample",), phase_offset: float = 28.0) -> DataFrame:
    """(by..., kmer, area, pct, phase): the 10.2-base peak's area, its share of its surroundings,
    and the phase at h = 196 in units of pi less the offset's, not wrapped again."""
    within = lambda band: F.sum(F.when(F.col("h").between(*band), F.col("power")))
    at = lambda c: F.max(F.when(F.col("h") == PHASE_AT, F.col(c)))
    sums = spectrum.groupBy(*by, "kmer").agg(within(PEAK).alias("area"), within(AROUND).alias("around"), at("re").alias("re"), at("im").alias("im"))
    return sums.select(*by, "kmer", "area", F.when(F.col("around") != 0, F.col("area") / F.col("around")).alias("pct"), (F.atan2("im", "re") / PI - 2 * (phase_offset / 10.204)).alias("phase"))


def padded_dft(adm: DataFrame, *, by: tuple[str, ...] = ("sample",), sampling: float = 1.0) -> DataFrame:
    """(by..., kmer, h, freq, power): zero-padded to a power of two, one-sided, no window.

    5 points at the start and 5 - (k - 1) at the end are left out.
    """
    pi = 3.14159  # the original's value here
    rows = profiles(adm, by=by, front=5, drop=5 - (F.length("kmer") - 1))
    rows = rows.withColumn("n", F.size("x")).withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x"))
    rows = rows.withColumn("np", F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("int")).withColumn("y", F.transform("x", lambda v: v - F.col("mean")))
    rows = rows.withColumn("h", F.explode(F.sequence(F.lit(0), (F.col("np") / 2).cast("int"))))
    angle = 2 * pi * F.col("h") / F.col("np")
    rows = rows.withColumn("re", folded(F.col("y"), angle, F.cos)).withColumn("im", folded(F.col("y"), angle, F.sin))
    norm = F.when(F.col("mean") != 0, F.col("mean") * 5.1 * F.col("n") / 10.2)
    return rows.select(*by, "kmer", "h", (F.col("h") / (F.col("np") / 2) / (2 * sampling)).alias("freq"), (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / norm).alias("power"))


def after_background(signal: DataFrame, background: DataFrame) -> dict[str, DataFrame]:
    """The whole course from two complete count matrices (kmer, pos, val): the mean-preserving
    background is removed, then spectrum, peaks and normalised profiles are made."""
    corrected = adm_ops.background_removed(signal, background, keep_mean=True)
    spectrum = dft_profile(corrected, by=())
    return {"corrected": corrected, "spectrum": spectrum, "peaks": peaks(spectrum, by=()), "normalised": adm_ops.normalised(corrected, by=())}


def read_power(hits: DataFrame, length: int, *, h: int = PHASE_AT, centred: bool = True) -> DataFrame:
    """`hits` (with positions p of a key in one read) with hit count n and power at h / 2000.

    The profile has 1 at each hit of `length` points; centred removes its mean first, which
    only needs two sums over all points that are the same for every read.
    """
    w = 2 * PI * h / GRID
    x = np.arange(length)
    all_cos, all_sin = float(np.cos(w * x).sum()), float(np.sin(w * x).sum())
    n = F.size("p")
    mean = n / F.lit(float(length)) if centred else F.lit(0.0)
    total = lambda f: F.aggregate(F.transform("p", lambda i: f(w * i)), F.lit(0.0), lambda a, v: a + v)
    re, im = total(F.cos) - mean * all_cos, total(F.sin) - mean * all_sin
    return hits.withColumn("n", n).withColumn("power", F.sqrt(re * re + im * im))


def read_power_summary(powers: DataFrame, *, by: tuple[str, ...] = ("sample", "kmer")) -> DataFrame:
    """(by..., ratio, mean_square): sum of power over sum of hits; mean of power^2 / hits."""
    square = F.when(F.col("n") > 0, F.col("power") * F.col("power") / F.col("n"))
    return powers.groupBy(*by).agg((F.sum("power") / F.sum("n")).alias("ratio"), F.avg(square).alias("mean_square"))


def less_background(summary: DataFrame, background: DataFrame, *, by: tuple[str, ...] = ("kmer",)) -> DataFrame:
    """`summary` with excess, its mean_square less that of the background's row of the same `by`; null
    where the background has none."""
    below = background.select(*by, F.col("mean_square").alias("_below"))
    return summary.join(below, list(by), "left").withColumn("excess", F.col("mean_square") - F.col("_below")).drop("_below")


def own_hits(text: np.ndarray, key: bytes) -> np.ndarray:
    """Where the key's non-overlapping hits, found from the left, begin in each row of letters."""
    k, places = len(key), text.shape[1] - len(key) + 1
    hit = np.zeros(text.shape, bool)
    if places < 1:
        return hit
    hit[:, :places] = True
    for j, letter in enumerate(key):
        hit[:, :places] &= text[:, j : j + places] == letter
    if any(key[:j] == key[-j:] for j in range(1, k)):  # only such a key can overlap itself
        free = np.zeros(len(text), np.int64)
        for i in range(places):
            hit[:, i] &= free <= i
            free[hit[:, i]] = i + k
    return hit


#: Points of reads that are transformed at once.
POINTS = 1 << 20


def read_fft_sums(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(sample, kmer, h, freq, power): FFT magnitudes of each read's non-overlapping hits over
    L - 1 points, summed over the reads of a sample.

    Reads of one length are transformed together. Partial sums leave each batch, so what is
    shuffled doesn't grow with reads. L is a read's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, owner = np.unique(np.array(["" if x is None else x for x in batch.column(0).to_pylist()], str), return_inverse=True)
            sums: dict[tuple[str, int], np.ndarray] = {}
            for rows, text in by_length(batch.column(1), 2):
                n = text.shape[1] - 1
                for lo in range(0, len(rows), max(1, POINTS // (n + 1))):
                    part = slice(lo, lo + max(1, POINTS // (n + 1)))
                    for key in keys:
                        power = np.abs(np.fft.fft(own_hits(text[part], key.encode())[:, :n], axis=1))
                        np.add.at(sums.setdefault((key, n), np.zeros((len(names), n))), owner[rows[part]], power)
            found = [(names[s], k, n, y[s]) for (k, n), y in sums.items() for s in np.flatnonzero(y.any(1))]
            size = [x[2] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(np.repeat(np.array([x[c] for x in found], object), size), pa.string()) for c in (0, 1)),
                    pa.array(np.repeat(np.array(size, np.int32), size)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in size] or [np.empty(0, np.int32)])),
                    pa.array(np.concatenate([x[3] for x in found] or [np.empty(0)])),
                ],
                names=["sample", "kmer", "n", "h", "power"],
            )

    parts = reads.select("sample", "seq").mapInArrow(run, "sample string, kmer string, n int, h int, power double")
    freq = F.when(F.col("h") * 2 <= F.col("n"), F.col("h") / F.col("n")).otherwise((F.col("h") - F.col("n")) / F.col("n"))
    return parts.groupBy("sample", "kmer", "n", "h").agg(F.sum("power").alias("power")).select("sample", "kmer", "h", freq.alias("freq"), "power")
