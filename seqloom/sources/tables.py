"""Reading and writing the tab-separated tables around the reads."""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.sources import reads as R
from seqloom.sources.onefile import write_lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines in the order of the file, or of a folder's one file."""
    return R.numbered_lines(spark, path).select("line", "value")


def read_table(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """A tab-separated table, every cell without blanks around it."""
    rows = spark.read.csv(path, sep="\t", header=header)
    return rows.select(*[S.trimmed(f"`{c}`").alias(c.strip()) for c in rows.columns])


def read_matrix(spark: SparkSession, path: str, *, keys: int | None = None, positions: int | None = None, log10: bool = False, floor: float = 1e-20) -> DataFrame:
    """(kmer, pos, val): a keyed matrix, key and values a line; decimal commas count as points.

    `keys` takes the first so many rows, `positions` so many values; log10 with zeros as `floor`.
    """
    rows = numbered_lines(spark, path).where(F.col("value").rlike("\\w"))
    if keys is not None:
        rows = rows.orderBy("line").limit(keys)
    cells = F.split(F.rtrim(F.regexp_replace("value", ",", ".")), "\t")
    values = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)) if positions is None else F.lit(positions)), lambda v: v.try_cast("double"))
    found = rows.select(F.trim(cells[0]).alias("kmer"), F.posexplode(values).alias("pos", "val"))
    return found.withColumn("val", F.log10(F.when(F.col("val") == 0, floor).otherwise(F.col("val")))) if log10 else found


def read_lookup(spark: SparkSession, path: str, key: int, value: int, *, skip: int = 0) -> DataFrame:
    """(key, value) of two columns; the last of repeated keys counts."""
    rows = numbered_lines(spark, path).withColumn("c", F.split("value", "\t"))
    if skip:
        rows = rows.join(rows.orderBy("line").limit(skip).select("line"), "line", "left_anti")
    return rows.groupBy(F.get("c", F.lit(key)).alias("key")).agg(F.max_by(F.get("c", F.lit(value)), "line").alias("value"))


def read_pwm(spark: SparkSession, path: str, *, name: str = "pwm", sep: str = "\t", order: str = "ACGT", keyed: bool = True) -> DataFrame:
    """(name, base, pos, w): rows in the given order of bases, with or without the base in front."""
    rows = numbered_lines(spark, path).where(F.col("value").rlike("\\w")).orderBy("line").limit(4).collect()  # four lines
    out = []
    for base, row in zip(order, rows):
        cells = [c for c in row.value.split(sep) if c.strip()]
        if keyed:
            base, cells = cells[0].strip(), cells[1:]
        out += [(name, base, p, float(c)) for p, c in enumerate(cells)]
    return spark.createDataFrame(out, "name string, base string, pos int, w double")


def read_kmer_table(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, cnt, freq, total): the total stands in the caption's fourth field."""
    lines = numbered_lines(spark, path)
    total = lines.where(F.col("value").rlike("totalCounts=")).agg(F.max(F.regexp_extract("value", "totalCounts=([0-9.eE+]+)", 1).try_cast("double")).alias("total"))
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").rlike("totalCounts=")).select(c[0].alias("kmer"), F.get(c, F.lit(1)).try_cast("double").alias("cnt"), F.get(c, F.lit(2)).try_cast("double").alias("freq"))
    return rows.crossJoin(F.broadcast(total))


def write_reads(reads: DataFrame, path: str, *, compress: bool = False) -> None:
    reads.select("seq").write.text(path, compression="gzip" if compress else "none")


def write_table(rows: DataFrame, path: str, *, columns: list[str] | None = None, order: list | None = None) -> None:
    """Tab-separated with a header; sorted by `order`, if given, in one file."""
    out = rows.select(*columns) if columns else rows
    if order:
        line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in out.columns]), {"sep": "\t", "emptyValue": '""'})
        write_lines(rows, path, line=line, order=order, head=["\t".join(out.columns)])
    else:
        out.write.csv(path, sep="\t", header=True)


def write_kmers(counts: DataFrame, path: str) -> None:
    """k-mers by descending frequency; the total is a column of its own."""
    write_table(counts, path, order=[F.desc("freq"), "kmer"])


def write_matrix(wide: DataFrame, path: str, *, caption: str | None = None, length: int | None = None, orient: str | None = None) -> None:
    """A key and its values a line, sorted by key; the row `caption` comes first; filled up with 0
    to `length` values. `orient` picks the rows of one orientation (ori, rc, r or c)."""
    if orient is not None:
        wide = wide.where(F.col("orient") == orient)
    values = F.col("vals") if length is None else F.concat("vals", F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size("vals"), F.lit(0))))
    line = F.concat_ws("\t", F.col("kmer"), F.concat_ws("\t", values.cast("array<string>")))
    first = F.when(F.col("kmer") == F.lit(caption or ""), 0).otherwise(1)
    write_lines(wide, path, line=line, order=[first, "kmer"])


def write_samples(matched: DataFrame, path: str, *, by: str = "name", least_bytes: int = 0) -> None:
    """Demultiplexed reads (name, region; header, plus and region_qual if known), a folder a barcode:
    FASTQ records below `fastq`, the sequences alone below `reads`.

    Reads without a barcode go to `unmatched`, those of samples whose sequences have fewer than
    `least_bytes` bytes to `small`.
    """
    rows = matched.withColumn("_by", F.coalesce(F.col(by), F.lit("unmatched")))
    if least_bytes:
        sizes = rows.groupBy("_by").agg(F.sum(F.length("region") + 1).alias("_bytes"))
        few = sizes.where(F.col("_bytes") < least_bytes).select("_by", F.concat(F.lit("small/"), F.col("_by")).alias("_to"))
        rows = rows.join(few, "_by", "left").withColumn("_by", F.coalesce("_to", "_by")).drop("_to")
    have = lambda c, other: F.coalesce(F.col(c), other) if c in matched.columns else other
    number = F.col("read_no") if "read_no" in matched.columns else F.monotonically_increasing_id()
    header = have("header", F.concat(F.lit("@"), number.cast("string")))
    record = F.concat_ws("\n", header, "region", have("plus", F.lit("+")), have("region_qual", F.repeat(F.lit("I"), F.length("region"))))
    # `/` in a partition's name would be escaped: small samples have a level of their own.
    small, name = F.startswith("_by", F.lit("small/")), F.regexp_replace("_by", "^small/", "")
    out = rows.select(F.when(small, "small").otherwise("whole").alias("size"), name.alias(by), record.alias("record"), "region")
    for folder, column in (("fastq", "record"), ("reads", "region")):
        out.select("size", by, column).write.partitionBy("size", by).text(f"{path}/{folder}")


def write_pwm(pwm: DataFrame, path: str) -> None:
    cells = F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x.w.cast("string"))
    rows = pwm.groupBy("name", "base").agg(F.concat_ws("\t", F.col("base"), cells).alias("value"))
    write_lines(rows, path, order=["name", "base"])


def write_provenance(spark: SparkSession, path: str) -> None:
    """Where and how this was run, beside the output."""
    said = json.dumps({"directory": os.getcwd(), "command": sys.argv})
    spark.createDataFrame([(said,)], "value string").write.mode("overwrite").text(path)


def plot_rows(adm: DataFrame, *, scale: float = 3.0, offset: float = 0.0) -> DataFrame:
    """(sample, kmer, pos, y): normalised profiles times `scale`, a step of `offset` apart by k-mer."""
    from pyspark.sql import Window

    rank = F.dense_rank().over(Window.partitionBy("sample").orderBy("kmer")) - 1
    keys = adm.select("sample", "kmer").distinct().withColumn("r", rank)
    return adm.join(keys, ["sample", "kmer"]).select("sample", "kmer", "pos", (F.col("val") * scale + F.col("r") * offset).alias("y"))


def write_spacings(gaps: DataFrame, path: str, *, by: str = "kind") -> None:
    """Gap counts (kind, gap, n), a folder a kind (HT, HH, TT or FF, FR, RF, RR), by gap."""
    gaps.repartition(by).sortWithinPartitions("gap").write.partitionBy(by).csv(path, sep="\t", header=True)


def write_spectra(rows: DataFrame, path: str, *, axis: str = "freq", value: str = "power", by: tuple[str, ...] = ("sample", "kmer")) -> None:
    """A line a spectrum, its keys and then its values along the axis, which is the first line."""
    ordered = F.array_sort(F.collect_list(F.struct(axis, value)))
    lines = rows.groupBy(*by).agg(ordered.alias("x")).select(F.lit(1).alias("f"), F.concat_ws("\t", *by, F.transform("x", lambda p: p[value].cast("string"))).alias("value"))
    head = rows.select(axis).distinct().agg(F.array_sort(F.collect_list(axis)).alias("x"))
    first = head.select(F.lit(0).alias("f"), F.concat_ws("\t", *[F.lit(c) for c in by], F.transform("x", lambda v: v.cast("string"))).alias("value"))
    write_lines(first.unionByName(lines), path, order=["f", "value"])


def spectrum_rows(spectra: DataFrame, *, by: tuple[str, ...] = ("sample", "kmer"), scale: float = 6.0, offset: float = 3.0) -> DataFrame:
    """(by..., h, y): each spectrum's powers as deviations from their mean, times `scale`, about `offset`;
    spectra of nothing stay out."""
    means = spectra.groupBy(*by).agg(F.avg("power").alias("_m")).where("_m <> 0")
    return spectra.join(means, list(by)).select(*by, "h", ((F.col("power") - F.col("_m")) / F.col("_m") * scale + offset).alias("y"))


def polar_rows(peaks: DataFrame, *, by: tuple[str, ...] = ("sample", "kmer")) -> DataFrame:
    """(by..., x, y): a peak's area in the direction of its phase, which is in units of pi."""
    angle = F.col("phase") * F.pi()
    return peaks.select(*by, (F.col("area") * F.cos(angle)).alias("x"), (F.col("area") * F.sin(angle)).alias("y"))
