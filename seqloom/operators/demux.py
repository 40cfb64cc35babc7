"""Assigning reads to samples by the barcodes at both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = "^([A-Z]*?)(\\d+)N([A-Z]*)$"
#: Length layouts travel in the plan as literals; a sheet has a handful.
MOST_LAYOUTS = 1000


def barcodes(sheet: DataFrame, *, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """(name, front, n, rear) of each pattern like TGAACC40NCCA; rows with lower case are skipped."""
    p = F.col(pattern)
    rows = sheet.where(p.rlike(PATTERN))
    return rows.select(F.col(name).alias("name"), F.regexp_extract(p, PATTERN, 1).alias("front"), F.regexp_extract(p, PATTERN, 2).cast("int").alias("n"), F.regexp_extract(p, PATTERN, 3).alias("rear"))


def matched(reads: DataFrame, codes: DataFrame, *, exact: bool = False) -> DataFrame:
    """`reads` with name, region and, if reads have a `qual`, region_qual: one row for each barcode
    that a read matches.

    For each layout (lengths of front, random region and rear) a read's own ends are the key of
    an equi-join. exact: the read has no base more than the layout.
    """
    layouts = codes.select(F.length("front").alias("f"), "n", F.length("rear").alias("r")).distinct().limit(MOST_LAYOUTS + 1).collect()
    if len(layouts) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} barcode layouts")
    if not layouts:
        layouts = [(0, -1, 0)]
    array = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(n).alias("n"), F.lit(r).alias("r")) for f, n, r in map(tuple, layouts)])
    rows = reads.withColumn("_l", F.explode(array)).select("*", "_l.f", "_l.n", "_l.r").drop("_l")
    size = F.col("f") + F.col("n") + F.col("r")
    rows = rows.where(F.length("seq") == size if exact else F.length("seq") >= size)
    front, rear = F.substr("seq", F.lit(1), F.col("f")), F.substr("seq", F.col("f") + F.col("n") + 1, F.col("r"))
    keyed = rows.withColumn("_front", front).withColumn("_rear", rear)
    c = codes.select("name", F.col("front").alias("_front"), F.col("n").alias("_n"), F.col("rear").alias("_rear"))
    found = keyed.join(c, (keyed._front == c._front) & (keyed._rear == c._rear) & (keyed.n == c._n))
    region = lambda column: F.substr(column, F.col("f") + 1, F.col("n"))
    more = [region("qual").alias("region_qual")] if "qual" in reads.columns else []
    return found.select(*[keyed[x] for x in reads.columns], "name", region("seq").alias("region"), *more)


def unmatched(reads: DataFrame, codes: DataFrame, *, exact: bool = False, key: tuple[str, ...] = ("read_no",)) -> DataFrame:
    """Reads that no barcode matches."""
    return reads.join(matched(reads, codes, exact=exact).select(*key).distinct(), list(key), "left_anti")


def stats(reads: DataFrame, codes: DataFrame, *, exact: bool = False, key: tuple[str, ...] = ("read_no",)) -> DataFrame:
    """(reads, matched, failed, pct_failed): reads count once, however many barcodes they match."""
    hits = matched(reads, codes, exact=exact).select(*key).distinct().agg(F.count("*").alias("matched"))
    both = reads.agg(F.count("*").alias("reads")).crossJoin(hits)
    failed = F.col("reads") - F.col("matched")
    return both.select("reads", "matched", failed.alias("failed"), F.when(F.col("reads") > 0, failed * 100.0 / F.col("reads")).alias("pct_failed"))


def quarantined(rows: DataFrame, *, least_bytes: int = 3_085_760, by: str = "name") -> DataFrame:
    """(name, bytes, small): which samples' output is too small to trust."""
    return rows.groupBy(by).agg(F.sum(F.length("region") + 1).alias("bytes")).withColumn("small", F.col("bytes") < least_bytes)
