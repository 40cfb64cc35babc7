"""Alignments against intervals, and duplicates by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 1 << 14
#: Bins that an interval is cut into at most, but for one at its start; a level's are as many times as
#: wide as the last one's.
CUTS = 64
#: Tasks that the alignments of a bin are dealt to where bins are wide, such as whole chromosomes.
SALTS = 32


def mapped(aln: DataFrame, least: int = 20) -> DataFrame:
    return aln.where(F.col("mapq") >= least)


def levels(aln: DataFrame, bed: DataFrame, width: int) -> list[tuple[int, DataFrame]]:
    """(width of a bin, intervals with their bins) for each level that intervals need, narrow ones first.

    An alignment has the one bin that it starts in: no bin is narrower than the longest alignment,
    and an interval also has the bin before its first.
    """
    longest = aln.agg(F.max(F.col("end") - F.col("start")).alias("n")).first().n or 0
    while width < longest:
        width *= 2
    size = F.col("end") - F.col("start")
    level = F.lit(0)
    for k in (k for k in range(1, 11) if width * CUTS**k < 1 << 62):
        level = F.when(size > width * CUTS**k, k).otherwise(level)
    some = bed.where("start < end").select("chrom", "start", "end", level.alias("level"))
    out = []
    for (k,) in sorted(some.select("level").distinct().collect()):  # at most ten rows
        wide = width * CUTS**k
        cut = F.explode(F.sequence(F.floor(F.col("start") / wide) - 1, F.floor((F.col("end") - 1) / wide)))
        rows = some.where(F.col("level") == k).select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), cut.alias("_b"))
        if k:
            rows = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out.append((wide, rows))
    return out


def overlap(aln: DataFrame, bed: DataFrame, *, keep: bool = True, width: int = BIN) -> DataFrame:
    """Alignments that overlap some interval (keep) or none. Intervals are half open; empty ones, and
    empty alignments, overlap nothing.

    Intervals are cut into bins whose width goes with their own, and an alignment looks into the
    one bin of each width that it starts in: (chrom, bin) is the key of a semi- or anti-join, so
    alignments are neither multiplied nor joined to themselves. Where bins are wide, and hold much
    of a chromosome, the alignments of a bin are dealt to several tasks.
    """
    hits, rest = [], aln
    for wide, bins in levels(aln, bed, width):
        on = (F.col("chrom") == F.col("_c")) & (F.floor(F.col("start") / wide) == F.col("_b")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("end"))
        if "_salt" in bins.columns:
            on &= F.pmod(F.xxhash64("start", "end"), F.lit(SALTS)).cast("int") == F.col("_salt")
        if keep:
            hits.append(rest.join(bins, on, "left_semi"))
        rest = rest.join(bins, on, "left_anti")
    if not keep:
        return rest
    return reduce(DataFrame.union, hits) if hits else aln.limit(0)


def without_duplicates(aln: DataFrame, *, by: tuple[str, ...] = ("chrom", "start")) -> DataFrame:
    """Of the alignments at one place that of the best quality, ties by name: one grouped minimum
    with map-side combining, so a place with very many alignments is no single task's."""
    rest = [c for c in aln.columns if c not in by]
    best = aln.groupBy(*by).agg(F.min(F.struct((-F.col("mapq")).alias("_q"), *[F.col(c) for c in sorted(rest, key=lambda c: (c != "name", c))])).alias("x"))
    return best.select(*[F.col(c) if c in by else F.col(f"x.{c}").alias(c) for c in aln.columns])


def without_duplicate_pairs(mates: DataFrame) -> DataFrame:
    """Alignments (name, mate, chrom, start, end, strand, mapq, quality) without duplicate fragments: of the
    pairs whose 5' ends lie at the same two places on the same strands that of the best quality, ties
    by name; likewise of reads without a mate, which are held against reads without a mate alone.

    A read's 5' end is where it starts on the strand +, and where it ends on the strand -. Mates are
    brought together by name, a pair's two ends in order are its signature, and the best of
    each signature is a grouped minimum with map-side combining: a place with very many fragments is
    no single task's. Which of a pair's mates is the first doesn't matter. A name with more than two
    rows counts by its two outermost ends.
    """
    place = F.struct("chrom", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("five"), "strand")
    whole = mates.groupBy("name").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"), F.sum("quality").alias("quality"))
    signature = ["low", "high", "single"]
    found = whole.withColumn("single", F.col("n") == 1)
    best = found.groupBy(*signature).agg(F.min(F.struct((-F.col("quality")).alias("q"), "name")).alias("b"))
    return mates.join(best.select(F.col("b.name").alias("name")), "name", "left_semi")
