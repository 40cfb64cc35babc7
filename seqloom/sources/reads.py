"""Reading sequences: text or FASTQ, gzip or plain, one sample a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.sources.gzipped import RANGE, gzip_lines
from seqloom.sources.shared import stored

#: The suffixes that count as reads, the start of the sequencer's record headers.
SUFFIXES = ("txt", "gz", "fastq", "seq")
HEADER = "@HISE"
EVERYTHING = 666666666666666666


def sample_of(path: Column) -> Column:
    """A file's name without directories and suffixes."""
    return F.regexp_extract(path, "([^/]*?)(\\.(txt|gz|fastq|seq))*$", 1)


def split_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, block, id, value): the lines of each file's splits, ids rising in each."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def numbered(lines: DataFrame) -> DataFrame:
    """(path, line, value): the lines of each file, numbered from 0, whatever store it lies in.

    A large file is read in splits: each split's lines are counted, and the sums of those
    before it (one row a split) are where its own numbers begin.
    """
    splits = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("path", "block", (before - F.col("first")).alias("shift"))
    return lines.join(starts, ["path", "block"]).select("path", (F.col("id") + F.col("shift")).alias("line"), "value")


def numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line, value) of text files."""
    return numbered(split_lines(spark, paths))


def records(lines: DataFrame) -> DataFrame:
    """(path, sample, read_no, header, seq, plus, qual): every four numbered lines; what a file cut short
    lacks is empty."""
    place = F.col("line") % 4
    part = lambda k: F.coalesce(F.max(F.when(place == k, F.rtrim("value", F.lit("\r")))), F.lit(""))
    rows = lines.groupBy("path", F.floor(F.col("line") / 4).alias("read_no")).agg(*[part(k).alias(n) for k, n in enumerate(("header", "seq", "plus", "qual"))])
    return rows.where(F.col("header") != "").select("path", sample_of(F.col("path")).alias("sample"), "read_no", "header", "seq", "plus", "qual")


def read_fastq_gz(spark: SparkSession, paths: list[str] | str, *, reads: int | None = None, bytes_of_range: int = RANGE) -> DataFrame:
    """What read_fastq gives, of gzip files: those of many members are read with many tasks. With `reads`
    only the first so many of each file, and no task decompresses more than these take."""
    lines = numbered(gzip_lines(spark, paths, bytes_of_range=bytes_of_range, lines=None if reads is None else 4 * reads))
    return records(lines if reads is None else lines.where(F.col("line") < 4 * reads))


def read_fastq(spark: SparkSession, paths: list[str] | str, *, prefix: str | None = HEADER) -> DataFrame:
    """(path, sample, read_no, header, seq, plus, qual). With a prefix of all headers the text reader
    splits at it, and nothing is shuffled; without one, lines are numbered and every four of them
    make a record, read_no then counts a file's records from 0. What a file cut short lacks is empty."""
    if prefix is None:
        return records(numbered_lines(spark, paths))
    text = spark.read.option("lineSep", "\n" + prefix).text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("read_no"))
    lines = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n", 4)
    rows = text.where(F.length("value") > 0).withColumn("l", lines)
    head = F.when(F.startswith(F.col("l")[0], F.lit(prefix)), F.col("l")[0]).otherwise(F.concat(F.lit(prefix), F.col("l")[0]))
    part = lambda k: F.get("l", F.lit(k))
    return rows.select("path", sample_of(F.col("path")).alias("sample"), "read_no", head.alias("header"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))


def read_text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, sample, read_no, seq): a sequence a line; blank lines are no reads."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("read_no"), F.rtrim("value").alias("seq"))
    return text.where(F.col("seq").rlike("\\w")).select("path", sample_of(F.col("path")).alias("sample"), "read_no", "seq")


def formats(spark: SparkSession, paths: list[str] | str) -> dict[str, bool]:
    """Path -> whether it is FASTQ, by each file's own first line: one row a file."""
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    firsts = text.where("block = 0").groupBy("path").agg(F.min_by("value", "id").alias("value"))
    return {r.path: r.value.startswith("@") for r in firsts.collect()}


def read(spark: SparkSession, paths: list[str] | str, *, lines: int | str | None = None, prefix: str | None = HEADER) -> DataFrame:
    """Reads of text or FASTQ files, each by its own first line, at most `lines` a file: (path, sample,
    read_no, seq), and header, plus and qual where all files are FASTQ."""
    kinds = formats(spark, paths)
    fastq, text = ([p for p, f in kinds.items() if f is kind] for kind in (True, False))
    if fastq and text:
        parts = [read_fastq(spark, fastq, prefix=prefix).select("path", "sample", "read_no", "seq"), read_text(spark, text)]
        rows = reduce(DataFrame.unionByName, parts)
    else:
        rows = read_fastq(spark, fastq, prefix=prefix) if fastq else read_text(spark, paths)
    return rows if lines in (None, "all", EVERYTHING) else first_of_each(rows, int(lines))


def first_of_each(rows: DataFrame, n: int, *, by: str = "path", order: str = "read_no") -> DataFrame:
    """The first n reads of each file; Spark cuts the window to n rows a task before it shuffles."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def budget(rows: DataFrame, asked: int | str) -> int:
    """The smaller of the rows asked for and those there are."""
    return rows.count() if asked == "all" else min(int(asked), rows.count())


def lengths(reads: DataFrame) -> DataFrame:
    """(sample, length): the reads' length; an error where a sample's reads differ."""
    rows = reads.groupBy("sample").agg(F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high"))
    return rows.select("sample", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.concat(F.lit("reads of different lengths in "), "sample"))).alias("length"))


def densely_numbered(reads: DataFrame, *, order: str = "read_no") -> DataFrame:
    """`reads` with their places in that order, from 0 without gaps, as read_no: ranges are sorted and
    counted, and the sums of those before them are where their own numbers begin."""
    rows = stored(reads.orderBy(order).withColumn("_id", F.monotonically_increasing_id()), name="ordered")
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row a range
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("read_no", F.col("_before") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_before")


def at_least(reads: DataFrame, length: int) -> DataFrame:
    """Without reads shorter than that."""
    return reads.where(F.length("seq") >= length)


def bad_records(fastq: DataFrame, *, prefix: str = HEADER) -> DataFrame:
    """(sample, bad): records whose header or third line isn't what it should be."""
    fine = F.startswith("header", F.lit(prefix)) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("qual"))
    return fastq.groupBy("sample").agg(F.sum(F.when(F.coalesce(fine, F.lit(False)), 0).otherwise(1)).alias("bad"))


def discover(spark: SparkSession, root: str, *, folder: str | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path): files below root with one of the suffixes, in folders whose name holds `folder`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    found = found.where(F.col("path").rlike("\\.(" + "|".join(suffixes) + ")$"))
    return found if folder is None else found.where(F.col("path").rlike(f"/[^/]*{folder}[^/]*/"))


def read_single(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, seq): one FASTA or SEQ sequence a file, whole; only A, C, G and T."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    name = F.regexp_extract("value", "^>\\s*([^\\r\\n]*)", 1)
    body = F.regexp_replace("value", "^>[^\\r\\n]*", "")
    return text.select("path", name.alias("name"), F.regexp_replace(F.upper(body), "[^ACGT]", "").alias("seq"))


def read_fasta(spark: SparkSession, paths: list[str] | str, *, piece: int = 1 << 16, overlap: int = 0, drop: str = "[^A-Z]") -> DataFrame:
    """(path, record, name, offset, seq): pieces of every record of FASTA files, of `piece` letters and
    `overlap` of what comes behind them, in capitals without what `drop` matches.

    Each window of overlap + 1 letters begins in one piece alone, so pieces can be counted like reads.
    A record may be as long as a chromosome: of each split of a file the header in force at its end and
    the letters since then are carried on to the next (a row a split), lines find their places in
    their records by them, and go to the pieces that they reach into. What comes before a first header
    is a record without a name; records without letters have no rows.
    """
    lines = split_lines(spark, paths)
    head = F.startswith("value", F.lit(">"))
    lines = lines.select("path", "block", "id", F.when(head, F.trim(F.regexp_replace(F.substr("value", F.lit(2)), "\r$", ""))).alias("header"), F.when(head, "").otherwise(F.regexp_replace(F.upper("value"), drop, "")).alias("part"))
    size = F.length("part").cast("long")
    upto = Window.partitionBy("path", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = lines.withColumn("last", F.last(F.when(F.col("header").isNotNull(), F.struct(F.col("id").alias("record"), "header")), ignorenulls=True).over(upto))
    # Letters before a line since the last header of its split, or since the split's begin.
    run = Window.partitionBy("path", "block", "last.record").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    within = within.withColumn("at", F.coalesce(F.sum(size).over(run), F.lit(0)))
    ends = within.groupBy("path", "block").agg(F.max_by("last", "id").alias("last"), F.max_by(F.col("at") + size, "id").alias("since"))
    splits = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("since").over(splits), F.lit(0))
    ends = ends.withColumn("before", before).withColumn("open", F.last(F.when(F.col("last").isNotNull(), F.struct("last", "before")), ignorenulls=True).over(splits))
    carried = ends.select("path", "block", F.col("open.last").alias("open"), (F.col("before") - F.coalesce(F.col("open.before"), F.lit(0))).alias("carry"))
    placed = within.where(size > 0).join(carried, ["path", "block"])
    place = F.col("at") + F.when(F.col("last").isNull(), F.col("carry")).otherwise(0)
    own = F.coalesce("last", "open")
    placed = placed.select("path", F.coalesce(own.record, F.lit(-1)).alias("record"), own.header.alias("name"), place.alias("at"), "part")
    first = F.floor(F.greatest(F.col("at") - overlap, F.lit(0)) / piece)
    reached = placed.withColumn("p", F.explode(F.sequence(first, F.floor((F.col("at") + F.length("part") - 1) / piece))))
    low = F.greatest(F.col("p") * piece - F.col("at"), F.lit(0))
    high = F.least(F.col("p") * piece + piece + overlap - F.col("at"), F.length("part").cast("long"))
    cells = reached.select("path", "record", "name", "p", "at", F.substr("part", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x.part), "")
    return cells.groupBy("path", "record", "name", "p").agg(joined.alias("seq")).select("path", "record", "name", (F.col("p") * piece).alias("offset"), "seq")


def random_dna(spark: SparkSession, n: int = 10_000, length: int = 10_000, *, seed: int = 1) -> DataFrame:
    """(read_no, seq): uniform random bases, made on the executors."""
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(F.lit("ACGT"), F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(4)).cast("int") + 1, F.lit(1)))
    return spark.range(n).select(F.col("id").alias("read_no"), F.concat_ws("", letters).alias("seq"))
