"""Position count matrices in long form: (sample, kmer, pos, val)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators import kmers as K

#: Longest k-mers that have a table of counts in each task; bases of reads that share one, which longer ones
#: pass by; counts and letters held at once.
TABLED, SHARED, CELLS, LETTERS = 4, 4096, 1 << 22, 1 << 21
BASES = str.maketrans("", "", "ACGTN")
CODE = np.full(256, 5, np.uint8)
CODE[list(b"ACGTN")] = range(5)


def position_counts(reads: DataFrame, ks: tuple[int, ...], *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., kmer, pos, val): how many reads have each k-mer without N at each position.

    Short k-mers are counted in tables, one a task, of which a row a count goes on; windows of
    other letters, of very long reads and of long k-mers are rows that Spark counts.
    """
    if max(ks) > TABLED:
        parts = [K.windows(reads.select(*by, "seq"), k).select(*by, "kmer", "pos") for k in ks]
        return reduce(DataFrame.unionByName, parts).groupBy(*by, "kmer", "pos").agg(F.count("*").alias("val"))
    named = {k: np.array(["".join("ACGT"[x // 4**j % 4] for j in range(k - 1, -1, -1)) for x in range(4**k)], object) for k in ks}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        tables = {k: np.zeros((0, 0, 4**k), np.int64) for k in ks}
        kinds: list[pa.DataType] = []

        def rows(keys: list[tuple], kmer: np.ndarray, pos: np.ndarray, val: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pos), 1 << 16):
                part = slice(k, k + (1 << 16))
                held = [pa.array([key[c] for key in keys[part]], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(kmer[part], pa.string()), pa.array(pos[part].astype(np.int32)), pa.array(val[part])], names=[*by, "kmer", "pos", "val"])

        def counted() -> Iterator[pa.RecordBatch]:
            keys = list(groups)
            for k, table in tables.items():
                g, pos, x = np.nonzero(table)
                yield from rows([keys[i] for i in g], named[k][x], pos, table[g, pos, x])
                tables[k] = np.zeros((0, 0, 4**k), np.int64)
            groups.clear()

        def add(part: list[tuple]) -> None:
            """Reads (text, key) side by side, filled up with N."""
            n = max(len(text) for text, _ in part)
            codes = CODE[np.frombuffer("".join(text.ljust(n, "N") for text, _ in part).encode(), np.uint8).reshape(-1, n)].astype(np.int64)
            owner = np.array([groups.setdefault(key, len(groups)) for _, key in part])
            for k in ks:
                size = n - k + 1
                if size <= 0:
                    continue
                if tables[k].shape[0] < len(groups) or tables[k].shape[1] < size:
                    grown = np.zeros((max(len(groups), 2 * tables[k].shape[0]), max(size, tables[k].shape[1]), 4**k), np.int64)
                    grown[: tables[k].shape[0], : tables[k].shape[1]] = tables[k]
                    tables[k] = grown
                some, local = np.unique(owner, return_inverse=True)
                x, fine = np.zeros((len(part), size), np.int64), np.ones((len(part), size), bool)
                for j in range(k):
                    x = x * 4 + codes[:, j : j + size]
                    fine &= codes[:, j : j + size] < 4
                x += (local[:, None] * size + np.arange(size)) * 4**k
                tables[k][some, :size] += np.bincount(x[fine], minlength=len(some) * size * 4**k).reshape(len(some), size, 4**k)

        def alone(text: str, key: tuple) -> Iterator[pa.RecordBatch]:
            for k in ks:
                for start in range(0, len(text) - k + 1, 1 << 16):
                    found = [(i, text[i : i + k]) for i in range(start, min(start + (1 << 16), len(text) - k + 1)) if "N" not in text[i : i + k]]
                    yield from rows([key] * len(found), np.array([x for _, x in found], object), np.array([i for i, _ in found], np.int64), np.ones(len(found), np.int64))

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            texts = batch.column("seq").to_pylist()
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * len(texts)
            held: list[tuple] = []
            for text, key in sorted(((t, key) for t, key in zip(texts, keys) if t), key=lambda r: len(r[0])):
                if len(text) > SHARED or text.translate(BASES):
                    yield from alone(text, key)
                    continue
                held.append((text, key))
                if len(held) * len(text) > LETTERS:
                    add(held)
                    held = []
            if held:
                add(held)
            if sum(t.size for t in tables.values()) > CELLS:
                yield from counted()
        yield from counted()

    kept = reads.select(*by, "seq")
    schema = T.StructType([*(kept.schema[c] for c in by), T.StructField("kmer", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("val", T.LongType())])
    return kept.mapInArrow(run, schema).groupBy(*by, "kmer", "pos").agg(F.sum("val").alias("val"))


def zero_filled(adm: DataFrame, universe: DataFrame, positions: int, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """All k-mers of the universe at all positions; what was not seen is 0."""
    keys = universe.select("kmer")
    if by:  # samples x k-mers x positions is what is asked for; Spark picks the side to send by its size
        keys = adm.select(*by).distinct().crossJoin(keys)
    grid = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(positions - 1))).alias("pos"))
    keys = [*by, "kmer", "pos"]
    same = reduce(Column.__and__, [F.col(f"g.`{c}`").eqNullSafe(F.col(f"a.`{c}`")) for c in keys])  # a group may be null
    return grid.alias("g").join(adm.alias("a"), same, "left").select(*(F.col(f"g.`{c}`") for c in keys), F.coalesce("a.val", F.lit(0)).alias("val"))


def trimmed(adm: DataFrame, length: int) -> DataFrame:
    """Without the k - 1 positions at the end that no k-mer can start at."""
    return adm.where(F.col("pos") < F.lit(length) - (F.length("kmer") - 1))


def without_mono(adm: DataFrame) -> DataFrame:
    """Without the rows of single bases."""
    return adm.where(F.length("kmer") > 1)


def line_count(adm: DataFrame, *, at: int = 4, k: int | None = 1, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., lines): the counts at one position over k-mers of one length (all if k is None)."""
    rows = adm.where(F.col("pos") == at)
    rows = rows if k is None else rows.where(F.length("kmer") == k)
    return rows.groupBy(*by).agg(F.sum("val").alias("lines"))


def to_frequency(adm: DataFrame, *, at: int = 4, k: int | None = 1, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Counts over the number of reads that count at position `at`."""
    lines = line_count(adm, at=at, k=k, by=by)
    joined = adm.join(F.broadcast(lines), list(by)) if by else adm.crossJoin(F.broadcast(lines))
    return joined.select(*by, "kmer", "pos", (F.col("val") / F.col("lines")).alias("val"))


def normalised(adm: DataFrame, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(x - mean) / mean of each k-mer's profile; profiles with mean 0 stay as they are."""
    means = adm.groupBy(*by, "kmer").agg(F.avg("val").alias("mean"))
    value = F.when(F.col("mean") == 0, F.col("val").cast("double")).otherwise((F.col("val") - F.col("mean")) / F.col("mean"))
    return adm.join(means, [*by, "kmer"]).select(*by, "kmer", "pos", value.alias("val"))


def background_removed(sig: DataFrame, bk: DataFrame, *, at: int = 4, k: int | None = None, keep_mean: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """sig - bk * n_sig / n_bk, n being the reads at position `at`; with keep_mean only the
    background's deviations from each k-mer's mean are removed. `bk` has no group."""
    n_sig, n_bk = line_count(sig, at=at, k=k, by=by), line_count(bk, at=at, k=k, by=()).withColumnRenamed("lines", "bk_lines")
    if keep_mean:
        bk = bk.join(bk.groupBy("kmer").agg(F.avg("val").alias("mean")), "kmer").select("kmer", "pos", (F.col("val") - F.col("mean")).alias("val"))
    ratio = n_sig.crossJoin(F.broadcast(n_bk)).select(*by, (F.col("lines") / F.col("bk_lines")).alias("ratio"))
    removed = ratio.crossJoin(bk).select(*by, "kmer", "pos", (-F.col("val") * F.col("ratio")).alias("val"))
    both = sig.select(*by, "kmer", "pos", F.col("val").cast("double").alias("val")).unionByName(removed)
    return both.groupBy(*by, "kmer", "pos").agg(F.sum("val").alias("val"))


def wide(adm: DataFrame, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., kmer, vals): values in the order of their positions, for export."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "val")))
    return adm.groupBy(*by, "kmer").agg(F.transform(pairs, lambda p: p.val).alias("vals"))


def long(wide_rows: DataFrame, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """The way back from wide()."""
    return wide_rows.select(*by, "kmer", F.posexplode("vals").alias("pos", "val"))


def log10_floored(adm: DataFrame, floor: float = 1e-20) -> DataFrame:
    """log10 of values, 0 counting as the floor."""
    return adm.withColumn("val", F.log10(F.greatest(F.col("val").cast("double"), F.lit(floor))))
