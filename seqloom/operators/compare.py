"""Comparing k-mer tables: information content, fold change, element-wise sums.

Outer joins of two or four tables are written as a union with one grouped conditional sum: one
shuffle for any number of tables, with map-side combining.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(tables: dict[str, DataFrame], *, key: str = "kmer", value: str = "freq", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, one column a table): missing values are 0."""
    tagged = [t.select(*by, key, F.lit(name).alias("side"), F.col(value).alias("v")) for name, t in tables.items()]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy(*by, key).agg(*[F.coalesce(F.sum(F.when(F.col("side") == n, F.col("v"))), F.lit(0.0)).alias(n) for n in tables])


def log_fc(sig: DataFrame, ref: DataFrame, *, pseudo: float = 20.0, low_count: int | None = None) -> DataFrame:
    """(kmer, sig_freq, ref_freq, log_fc): log2((s - r) / (r + p) + 1), p = pseudo / total of ref.

    low_count: where both counts are under it, p is five times as large. Tables: (kmer, cnt).
    """
    both = side_by_side({"s_cnt": sig.withColumn("freq", F.col("cnt")), "r_cnt": ref.withColumn("freq", F.col("cnt"))})
    totals = both.agg(F.sum("s_cnt").alias("s_all"), F.sum("r_cnt").alias("r_all"))
    rows = both.crossJoin(F.broadcast(totals)).withColumn("s", F.col("s_cnt") / F.col("s_all")).withColumn("r", F.col("r_cnt") / F.col("r_all"))
    p = F.lit(pseudo) / F.col("r_all")
    if low_count is not None:
        p = p * F.when((F.col("s_cnt") < low_count) & (F.col("r_cnt") < low_count), 5).otherwise(1)
    return rows.select("kmer", F.col("s").alias("sig_freq"), F.col("r").alias("ref_freq"), F.log2((F.col("s") - F.col("r")) / (F.col("r") + p) + 1).alias("log_fc"))


def log_fc_background(sig: DataFrame, sig0: DataFrame, ref: DataFrame, ref0: DataFrame, *, pseudo: float = 20.0) -> DataFrame:
    """(kmer, log_fc): log2 of the ratio of both samples' changes over their own backgrounds."""
    names = {"s": sig, "s0": sig0, "r": ref, "r0": ref0}
    four = side_by_side({n: t.withColumn("freq", F.col("cnt")) for n, t in names.items()})
    totals = four.agg(*[F.sum(n).alias(f"{n}_all") for n in names])
    rows = four.crossJoin(F.broadcast(totals)).select("kmer", *[(F.col(n) / F.col(f"{n}_all")).alias(n) for n in names], "r_all")
    p = F.lit(pseudo) / F.col("r_all")
    change = lambda a, b: (F.col(a) - F.col(b)) / (F.col(b) + p) + 1
    return rows.select("kmer", F.log2(change("s", "s0") / change("r", "r0")).alias("log_fc"))


def information(sig: DataFrame, background: DataFrame, universe: DataFrame, *, k: int, pseudo: float = 1.0, prefill: bool = True, read_length: int = 147, background_reads: float = 200.0) -> DataFrame:
    """(sample, info): bits of each sample's k-mer frequencies over the background's.

    The background has `pseudo` more of each k-mer. With prefill the signal starts with the
    background times background_reads * (read_length - k + 1) / its total; else with `pseudo` too.
    What a sample has not seen adds the same for all samples, so its sum is taken once and only
    the k-mers that a sample has are joined to the background.
    """
    bk = universe.join(background.groupBy("kmer").agg(F.sum("cnt").alias("cnt")), "kmer", "left").select("kmer", (F.coalesce("cnt", F.lit(0)) + pseudo).alias("b"))
    total = bk.agg(F.sum("b").alias("b_all"))
    bk = bk.crossJoin(F.broadcast(total))  # one row
    start = F.col("b") * (background_reads * (read_length - k + 1)) / F.col("b_all") if prefill else F.lit(float(pseudo))
    # sum of f log2(f / g), f = s / S: from sums over s alone.
    term = lambda s: F.when(s > 0, s * F.log2(s * F.col("b_all") / F.col("b"))).otherwise(0.0)
    unseen = bk.agg(F.sum(start).alias("S0"), F.sum(term(start)).alias("x0"))
    seen = sig.join(bk, "kmer").groupBy("sample").agg(F.sum("cnt").alias("n"), F.sum(term(F.col("cnt") + start) - term(start)).alias("d"))
    sums = seen.crossJoin(F.broadcast(unseen)).select("sample", (F.col("S0") + F.col("n")).alias("S"), (F.col("x0") + F.col("d")).alias("x"))
    return sums.select("sample", (F.col("x") / F.col("S") - F.log2("S")).alias("info"))


def information_from_tables(sig: DataFrame, background: DataFrame, *, pseudo: float = 20.0) -> DataFrame:
    """(sample, info): sum of s log2((s - b) / (b + p) + 1) over the signal's k-mers, p = pseudo / total.

    Background k-mers that the signal lacks add 0.
    """
    b_all = background.agg(F.sum("cnt").alias("b_all"))
    bk = background.groupBy("kmer").agg(F.sum("cnt").alias("b"))
    s_all = sig.groupBy("sample").agg(F.sum("cnt").alias("s_all"))
    rows = sig.join(s_all, "sample").join(bk, "kmer", "left").crossJoin(F.broadcast(b_all))
    s, b = F.col("cnt") / F.col("s_all"), F.coalesce("b", F.lit(0)) / F.col("b_all")
    return rows.groupBy("sample").agg(F.sum(s * F.log2((s - b) / (b + F.lit(pseudo) / F.col("b_all")) + 1)).alias("info"))


def merged(a: DataFrame, b: DataFrame, *, mode: str = "add", keys: tuple[str, ...] = ("kmer", "pos"), value: str = "val") -> DataFrame:
    """(keys..., value): element-wise a + b ("add"), a - b ("subtract"), or b where it has a value
    and else a ("replace"); what one side lacks counts as 0."""
    if mode not in ("add", "subtract", "replace"):
        raise ValueError(f"no such mode: {mode}")
    left, right = a.select(*keys, F.col(value).alias("x"), F.lit(0).alias("t")), b.select(*keys, F.col(value).alias("x"), F.lit(1).alias("t"))
    sign = F.when((F.col("t") == 1) & F.lit(mode == "subtract"), -F.col("x")).otherwise(F.col("x"))
    if mode == "replace":
        out = F.coalesce(F.sum(F.when(F.col("t") == 1, F.col("x"))), F.sum(F.when(F.col("t") == 0, F.col("x"))))
    else:
        out = F.sum(sign)
    return left.unionByName(right).groupBy(*keys).agg(out.alias(value))
