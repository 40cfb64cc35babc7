"""Pairs of motif hits: gaps between them, turning ligands, counting around the nearest hit.

Rows are motif.read_hits() joined with their reads: (..., m, ori, rc, r, c, seq); positions are
1-based centres.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import kmers


def turned(positions: Column | str, length: Column) -> Column:
    """Positions as read from the other end, ascending again."""
    return F.reverse(F.transform(positions, lambda p: length - p + 1))


def dimers(by_read: DataFrame) -> DataFrame:
    """Reads with more than one hit on the two strands."""
    return by_read.where(F.size("ori") + F.size("rc") > 1)


def gaps(rows: DataFrame, *, least: int = 0, legacy: bool = False) -> DataFrame:
    """(sample, read_no, name, kind, gap): what lies between the first two hits.

    Both on one strand: HT, turned first if that is the other one; ori before rc: HH; rc before
    ori: TT. The gap ends where the second motif begins; legacy ends it one base before that
    motif's centre and leaves turned pairs in descending order, so that they are always dropped.
    """
    length, half = F.length("seq"), (F.col("m") - 1) / 2
    one = (F.size("ori") == 0) | (F.size("rc") == 0)
    flip = one & (F.size("ori") == 0)
    back = F.transform("rc", lambda p: length - p + 1)
    own = F.when(flip, back if legacy else F.reverse(back)).otherwise(F.col("ori"))
    seq = F.when(flip, S.revcomp_iupac("seq")).otherwise(F.col("seq"))
    first = lambda x, k: F.try_element_at(x, F.lit(k))
    a = F.when(one, first(own, 1)).otherwise(F.least(first(F.col("ori"), 1), first(F.col("rc"), 1)))
    b = F.when(one, first(own, 2)).otherwise(F.greatest(first(F.col("ori"), 1), first(F.col("rc"), 1)))
    kind = F.when(one, "HT").when(first(F.col("ori"), 1) < first(F.col("rc"), 1), "HH").when(first(F.col("ori"), 1) > first(F.col("rc"), 1), "TT")
    size = b - a - (F.lit(1) if legacy else F.col("m"))
    picked = rows.select("sample", "read_no", "name", kind.alias("kind"), seq.alias("_s"), (a + half).cast("int").alias("_at"), size.cast("int").alias("_n"))
    return picked.where(F.col("kind").isNotNull() & (F.col("_n") >= least)).select("sample", "read_no", "name", "kind", F.substr("_s", F.col("_at") + 1, F.col("_n")).alias("gap"))


def nearest_left(rows: DataFrame) -> DataFrame:
    """Rows turned so that the hit nearest to an end is on the left, with min_dist (from 1),
    rotated, is_r_c (only control hits: reversed or complemented) and min_dir (ori, rc or r_c)."""
    length = F.length("seq")
    control = (F.size("ori") == 0) & (F.size("rc") == 0)
    hits = F.when(control, F.concat("r", "c")).otherwise(F.concat("ori", "rc"))
    left, right = F.array_min(hits) - 1, length - F.array_max(hits)
    flip = right < left
    out = rows.withColumn("is_r_c", control).withColumn("min_dist", F.least(left, right) + 1).withColumn("rotated", flip)
    pair = lambda x, y: F.when(flip, turned(y, length)).otherwise(F.col(x))
    new = {x: pair(x, y) for x, y in (("ori", "rc"), ("rc", "ori"), ("r", "c"), ("c", "r"))} | {"seq": F.when(flip, S.revcomp_iupac("seq")).otherwise(F.col("seq"))}
    others = [c for c in out.columns if c not in new]
    out = out.select(*others, *[v.alias(k) for k, v in new.items()])
    far = F.lit(1e5)
    nearest = F.coalesce(F.array_min("ori"), far) <= F.coalesce(F.array_min("rc"), far)
    return out.withColumn("min_dir", F.when(F.col("is_r_c"), "r_c").when(nearest, "ori").otherwise("rc"))


def counts_around(rows: DataFrame, k: int) -> DataFrame:
    """(name, min_dir, kmer, at, n): k-mers without N by their centre's distance to the nearest hit,
    rounded up, plus the read's length less 1. Rows: nearest_left()."""
    if not 1 <= k <= kmers.TABLED:
        # Exploded before anything is counted from the place, so that a row's own values are made once.
        found = rows.select("name", "min_dir", "min_dist", F.length("seq").alias("length"), F.posexplode(S.kmers("seq", k)).alias("i", "kmer")).where(~F.contains("kmer", F.lit("N")))
        at = F.ceil(F.col("i") + (k + 1) / 2 - F.col("min_dist")) + F.col("length") - 1
        return found.groupBy("name", "min_dir", "kmer", at.alias("at")).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of this task's rows, so many cells at a time."""
        spelled, groups = kmers.names(k), {}
        cells, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        others: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(groups)
            for lo in range(0, len(cells), 1 << 16):
                c, n = cells[lo : lo + (1 << 16)], counts[lo : lo + (1 << 16)]
                g = pa.array(c >> 2 * k + 32)
                yield pa.RecordBatch.from_arrays([*(pa.array([key[x] for key in keys], pa.string()).take(g) for x in (0, 1)), spelled.take(pa.array(c & 4**k - 1)), pa.array((c >> 2 * k & (1 << 32) - 1) - (1 << 31)), pa.array(n)], names=["name", "min_dir", "kmer", "at", "n"])
            if others:
                columns = list(zip(*((*key, n) for key, n in others.items())))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["name", "min_dir", "kmer", "at", "n"])

        for batch in batches:
            for part, texts in kmers.pieces(batch, 3):
                name, side, dist = (part.column(x).to_pylist() for x in range(3))
                number, place, i, odd = kmers.numbered(texts, k)
                owner = np.array([groups.setdefault(key, len(groups)) for key in zip(name, side)], np.int64)
                far = np.array([np.nan if d is None else d for d in dist], float)
                length = np.array([len(t or "") for t in texts], np.int64)
                known = ~np.isnan(far)[place]
                where = np.ceil(i[known] + (k + 1) / 2 - far[place[known]]).astype(np.int64) + length[place[known]] - 1
                cell, n = np.unique((owner[place[known]] << 32 | where + (1 << 31)) << 2 * k | number[known], return_counts=True)
                cells, back = np.unique(np.append(cells, cell), return_inverse=True)
                counts = np.bincount(back, np.append(counts, n), minlength=len(cells)).astype(np.int64)
                for r in {*odd, *np.flatnonzero(np.isnan(far)).tolist()}:  # other letters, no distance
                    t = texts[r] or ""
                    for x in range(len(t) - k + 1):
                        if "N" not in t[x : x + k]:
                            others[name[r], side[r], t[x : x + k], None if dist[r] is None else math.ceil(x + (k + 1) / 2 - dist[r]) + len(t) - 1] += 1
                if len(cells) > 1 << 21 or len(others) > 1 << 18:
                    yield from out()
                    cells, counts, others = cells[:0], counts[:0], Counter()
        yield from out()

    found = rows.select("name", "min_dir", F.col("min_dist").cast("double").alias("min_dist"), "seq").mapInArrow(run, "name string, min_dir string, kmer string, at long, n long")
    return found.groupBy("name", "min_dir", "kmer", "at").agg(F.sum("n").alias("n"))
