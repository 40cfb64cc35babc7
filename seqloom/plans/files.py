"""Queries: files written from the tables and read back, and a user's own functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import adm, curvature as curve, demux, extend, guide, kmers, spectral
from seqloom.plans import positional, rest
from seqloom.plans.register import Registry, rounded, sql_near
from seqloom.sources import fixtures as X, reads as R, tables as T
from seqloom.sources.onefile import write_lines
from seqloom.sources.shared import scratch

add = Registry()
QUERIES, ORACLE = add.queries, add.oracle


def folder(key: str) -> Column:
    """What a file's folder says of the key it was dealt out by."""
    return F.regexp_extract("path", f"{key}=([^/]+)", 1).alias(key)


def sample_files(spark: SparkSession, sf: str, line: Column, suffix: str) -> str:
    """A folder with one text file a sample, its reads in the order of their numbers."""
    path = scratch(spark, suffix)
    rows = X.reads(spark, sf).repartition("sample").sortWithinPartitions("sample", "read_no")
    rows.select("sample", line.alias("value")).write.partitionBy("sample").text(path)
    return path


@add(f"WITH {X.READS} SELECT sample, seq FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY read_no) AS r FROM reads) WHERE r <= 5")
def source_text_first_n(spark: SparkSession, sf: str) -> DataFrame:
    path = sample_files(spark, sf, F.col("seq"), "text")
    return R.read(spark, path, lines=5).select(folder("sample"), "seq")


RECORD = "'@HISE:' || read_no AS header, seq, '+' AS plus, repeat('I', length(seq)) AS qual"


def record(prefix: str) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(prefix), F.col("read_no").cast("string")), F.col("seq"), F.lit("+"), F.repeat(F.lit("I"), F.length("seq")))


@add(f"WITH {X.READS} SELECT sample, {RECORD} FROM reads")
def source_fastq(spark: SparkSession, sf: str) -> DataFrame:
    path = sample_files(spark, sf, record("@HISE:"), "fastq")
    return R.read(spark, path).select(folder("sample"), "header", "seq", "plus", "qual")


@add(f"WITH {X.READS} SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY read_no) - 1 AS read_no, '@own ' || read_no AS header, seq FROM reads")
def source_fastq_any_header(spark: SparkSession, sf: str) -> DataFrame:
    path = sample_files(spark, sf, record("@own "), "fastq")
    return R.read_fastq(spark, path, prefix=None).select(folder("sample"), "read_no", "header", "seq")


def gzip_file(spark: SparkSession, sf: str) -> str:
    """All reads as FASTQ in one gzip file of several members."""
    path = scratch(spark, "gz")
    write_lines(X.reads(spark, sf), path, line=record("@own "), order=["sample", "read_no"], compress=True)
    return path


@add(f"WITH {X.READS} SELECT row_number() OVER (ORDER BY sample, read_no) - 1 AS read_no, '@own ' || read_no AS header, seq, repeat('I', 147) AS qual FROM reads")
def source_fastq_gz(spark: SparkSession, sf: str) -> DataFrame:
    """One compressed file by ranges of 50,000 bytes."""
    return R.read_fastq_gz(spark, gzip_file(spark, sf), bytes_of_range=50_000).select("read_no", "header", "seq", "qual")


@add(f"WITH {X.READS} SELECT row_number() OVER (ORDER BY sample, read_no) - 1 AS read_no, seq FROM reads ORDER BY sample, read_no LIMIT 1000")
def source_fastq_gz_first(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_fastq_gz(spark, gzip_file(spark, sf), reads=1000, bytes_of_range=50_000).select("read_no", "seq")


@add(f"WITH {X.READS} SELECT sample, 0::BIGINT AS bad, 147 AS length, count(*) AS n FROM reads GROUP BY sample")
def source_format_and_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.read(spark, sample_files(spark, sf, record("@HISE:"), "fastq")).withColumn("sample", folder("sample"))
    counts = rows.groupBy("sample").agg(F.count("*").alias("n"))
    return R.bad_records(rows).join(R.lengths(rows), "sample").join(counts, "sample").select("sample", "bad", "length", "n")


@add(f"WITH {X.READS}, {positional.windows(2)}, {positional.letters(2)}, c AS (SELECT kmer, pos, count(*) AS n FROM w GROUP BY ALL) SELECT u.kmer, i::INTEGER AS pos, {sql_near('log10(CASE WHEN n > 0 THEN n ELSE 1e-20 END)')} AS val FROM u CROSS JOIN range(146) t(i) LEFT JOIN c ON c.kmer = u.kmer AND c.pos = i")
def sink_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix of all reads, written, and read with logarithms."""
    counts = adm.position_counts(X.reads(spark, sf), (2,), by=())
    path = scratch(spark, "matrix")
    T.write_matrix(adm.wide(adm.zero_filled(counts, kmers.universe(spark, 2), 146, by=()), by=()), path)
    return rounded(T.read_matrix(spark, path, log10=True), "val")


@add(f"WITH {X.READS}, w AS (SELECT substr(seq, i + 1, 3) AS kmer FROM reads, range(145) t(i)), c AS (SELECT kmer, count(*) AS cnt FROM w WHERE kmer NOT LIKE '%N%' GROUP BY 1) SELECT kmer, cnt::DOUBLE AS cnt, {sql_near('cnt / sum(cnt) OVER ()')} AS freq FROM c")
def sink_kmer_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "kmers")
    counts = kmers.with_frequency(kmers.count(X.reads(spark, sf), 3, by=()).withColumn("sample", F.lit("all")))
    T.write_kmers(counts.select("kmer", "cnt", "freq"), path)
    back = T.read_table(spark, path)
    return rounded(back.select("kmer", F.col("cnt").cast("double"), F.col("freq").cast("double")), "freq")


@add(f"""{rest.MATCH}, b AS (SELECT name, sum(length(region) + 1) AS bytes FROM m GROUP BY name)
SELECT CASE WHEN bytes < 20000 THEN 'small' ELSE 'whole' END AS size, name, region, '@' || read_no AS header FROM m JOIN b USING (name)""")
def sink_demultiplexed(spark: SparkSession, sf: str) -> DataFrame:
    """Samples as FASTQ, small ones apart."""
    path = scratch(spark, "demux")
    T.write_samples(demux.matched(*rest.reads_and_codes(spark, sf)), path, least_bytes=20_000)
    back = R.read_fastq(spark, f"{path}/fastq", prefix=None)
    return back.select(folder("size"), folder("name"), F.col("seq").alias("region"), "header")


@add(f"{rest.MATCH} SELECT name, region FROM m")
def sink_demultiplexed_reads(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "demux")
    T.write_samples(demux.matched(*rest.reads_and_codes(spark, sf)), path)
    return R.read_text(spark, f"{path}/reads").select(folder("name"), F.col("seq").alias("region"))


@add("SELECT n_nationkey::VARCHAR AS key, n_name AS value FROM nation")
def source_lookup(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "table")
    T.write_table(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name"), path, order=["n_nationkey"])
    return T.read_lookup(spark, path, 0, 1, skip=1)


@add(f"{positional.DFT} SELECT lang || '.' || kmer AS kmer, h AS pos, {sql_near('power')} AS val FROM s WHERE power IS NOT NULL")
def sink_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Spectra a line, read as a matrix; the line of the axis is left out."""
    path = scratch(spark, "spectra")
    out = spectral.dft_profile(positional.zero_filled(spark, sf, 2), by=("lang",)).withColumn("key", F.concat_ws(".", "lang", "kmer")).where("power is not null")
    T.write_spectra(out, path, axis="h", by=("key",))
    return rounded(T.read_matrix(spark, path).where("kmer <> 'key'"), "val")


@add(f"SELECT kind, length(gap)::INTEGER AS gap, count(*) AS n FROM ({rest.GAPS}) GROUP BY ALL")
def sink_spacings(spark: SparkSession, sf: str) -> DataFrame:
    """Gap lengths by the way two hits face each other, a folder a way, read back."""
    path = scratch(spark, "spacings")
    gaps = rest.dimer_gaps(spark, sf).groupBy("kind", F.length("gap").alias("gap")).agg(F.count("*").alias("n"))
    T.write_spacings(gaps, path)
    return spark.read.schema("gap int, n long, kind string").csv(path, sep="\t", header=True).select("kind", "gap", "n")


@add(f"WITH {X.READS}, {positional.windows(1, 2)} SELECT kmer, pos, count(*) AS val FROM w WHERE length(kmer) > 1 GROUP BY ALL")
def adm_without_mono(spark: SparkSession, sf: str) -> DataFrame:
    return adm.without_mono(adm.position_counts(X.reads(spark, sf), (1, 2), by=()))


@add(f"WITH {X.READS} SELECT DISTINCT sample, 'part.txt' AS file FROM reads WHERE regexp_matches(sample, '^src[12]')")
def source_discovered(spark: SparkSession, sf: str) -> DataFrame:
    """Files below a folder by suffix and by their folder's name."""
    path = sample_files(spark, sf, F.col("seq"), "found")
    found = R.discover(spark, path, folder="sample=src[12]")
    return found.select(folder("sample"), F.regexp_replace("path", "^.*/part-.*\\.txt$", "part.txt").alias("file"))


@add(f"WITH {X.READS}, r AS (SELECT sample, seq, row_number() OVER (PARTITION BY sample ORDER BY read_no) AS r FROM reads) SELECT sample, seq FROM r WHERE r <= 50 AND r % 3 <> 0")
def source_blank_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line is blank, and no read; of the others the first so many a file, as a test takes them."""
    rows = X.reads(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("sample").orderBy("read_no"))).where("r <= 50")
    path = scratch(spark, "blank")
    line = F.when(F.col("r") % 3 == 0, " ").otherwise(F.col("seq"))
    rows.repartition("sample").sortWithinPartitions("sample", "r").select("sample", line.alias("value")).write.partitionBy("sample").text(path)
    return R.read(spark, path, lines=50).select(folder("sample"), "seq")


@add("SELECT n_name || ' of ' || n_nationkey AS name, regexp_replace(upper(repeat(n_name || ' cat ', 300)), '[^ACGT]', '', 'g') AS seq FROM nation")
def source_fasta(spark: SparkSession, sf: str) -> DataFrame:
    """One sequence a file, of any length, only A, C, G and T."""
    path = scratch(spark, "fasta")
    rows = spark.read.parquet(f"{sf}/nation.parquet")
    text = F.concat(F.lit(">"), "n_name", F.lit(" of "), F.col("n_nationkey").cast("string"), F.lit("\n"), F.repeat(F.concat("n_name", F.lit("\ncat\n")), F.lit(300)))
    rows.select("n_nationkey", text.alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return R.read_single(spark, path).select("name", "seq")


TEXTS = f"texts AS (SELECT doc_id, source AS sample, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{X.LETTERS}', '{X.AS_BASES}') AS seq FROM documents)"


def fasta_file(spark: SparkSession, sf: str, width: int = 60) -> str:
    """All texts as records of FASTA files: their bases in lines of `width`."""
    path = scratch(spark, "fasta")
    docs = X.spread(spark.read.parquet(f"{sf}/documents.parquet"))
    bases = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), X.LETTERS, X.AS_BASES)
    lines = F.array_join(F.regexp_extract_all(bases, F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")
    docs.select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" "), F.col("source"), F.lit("\n"), lines).alias("value")).write.text(path)
    return path


@add(f"WITH {TEXTS} SELECT doc_id, length(seq) AS n, md5(seq) AS digest FROM texts WHERE seq <> ''")
def source_fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of many lines in pieces of 700 letters, and put together again."""
    pieces = R.read_fasta(spark, fasta_file(spark, sf), piece=700)
    whole = pieces.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "seq"))), lambda x: x.seq), "").alias("seq"))
    return whole.select(F.split("name", " ")[0].cast("long").alias("doc_id"), F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@add(f"WITH {TEXTS}, w AS (SELECT sample, unnest(list_transform(range(0, length(seq) - 5), lambda i: substr(seq, i + 1, 6))) AS kmer FROM texts) SELECT sample, kmer, count(*) AS cnt FROM w WHERE NOT contains(kmer, 'N') GROUP BY ALL")
def source_fasta_kmers(spark: SparkSession, sf: str) -> DataFrame:
    """6-mers of whole records, also across the borders of their pieces."""
    pieces = R.read_fasta(spark, fasta_file(spark, sf), piece=1000, overlap=5)
    return kmers.count(pieces.select(F.split("name", " ")[1].alias("sample"), "seq"), 6)


@add(f"WITH {X.READS} SELECT read_no, translate(seq, 'ACGT', 'TGCA') AS other, trim(substr(seq, 1, 5)) AS bare FROM reads")
def complement_and_trim(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\t  "), F.substring("seq", 1, 5), F.lit(" \t "))
    return X.reads(spark, sf).select("read_no", S.complement("seq").alias("other"), S.trimmed(padded).alias("bare"))


@add("SELECT n_nationkey AS pos, n_regionkey AS family FROM nation WHERE n_regionkey NOT IN (0, 1)")
def guide_not_methylated(spark: SparkSession, sf: str) -> DataFrame:
    """Regions 0 and 1 stand for methylated samples and for header rows."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("pos"), F.col("n_regionkey").alias("number"))
    named = rows.withColumn("family", F.when(F.col("number") == 0, "bZIP Methylated").when(F.col("number") == 1, "GROUP").when(F.col("number") == 2, F.lit(None).cast("string")).otherwise("ETS"))
    return guide.not_methylated(named).select("pos", F.col("number").alias("family"))


@add(f"""WITH {rest.GUIDE}, r AS (SELECT pos, row_number() OVER (ORDER BY pos) AS by_well, row_number() OVER (ORDER BY line DESC) AS by_number FROM guide) SELECT pos, by_well::VARCHAR AS by_well, by_number::VARCHAR AS by_number FROM r""")
def sheet_order(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets written in the order of wells (as strings) and of numbers, and read line by line."""
    g, found = rest.sheet(spark, sf), []
    for name, order in (("by_well", ["pos"]), ("by_number", [F.desc("line")])):
        path = scratch(spark, name)
        T.write_table(g, path, columns=["pos", "line"], order=order)
        lines = T.numbered_lines(spark, path).where("value not like 'pos%'")
        found.append(lines.select(F.split("value", "\t")[0].alias("pos"), F.row_number().over(Window.orderBy("line")).cast("string").alias(name)))  # one sheet
    return found[0].join(found[1], "pos")


@add(f"WITH {X.READS}, {positional.windows(2)}, c AS (SELECT sample, kmer, pos, count(*) AS val FROM w WHERE kmer IN ('AA', 'TA', 'TT') GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY sample ORDER BY kmer) - 1 AS r FROM c) SELECT sample, kmer, pos, {sql_near('val * 3.0::DOUBLE + r * 10.0::DOUBLE')} AS y FROM r")
def plot_rows(spark: SparkSession, sf: str) -> DataFrame:
    counts = adm.position_counts(X.reads(spark, sf), (2,)).where("kmer in ('AA', 'TA', 'TT')")
    return rounded(T.plot_rows(counts, scale=3.0, offset=10.0), "y")


@add(f"{positional.DFT}, a AS (SELECT lang, kmer, h, power, avg(power) OVER (PARTITION BY lang, kmer) AS mean FROM s) SELECT lang, kmer, h, {sql_near('(power - mean) / mean * 6 + 3')} AS y FROM a WHERE mean <> 0")
def plot_spectra(spark: SparkSession, sf: str) -> DataFrame:
    out = spectral.dft_profile(positional.zero_filled(spark, sf, 2), by=("lang",))
    return rounded(T.spectrum_rows(out, by=("lang", "kmer")), "y")


@add(f"""{positional.DFT}, k AS (SELECT lang, kmer, sum(power) FILTER (h BETWEEN 189 AND 204) AS area, atan2(max(im) FILTER (h = 196), max(re) FILTER (h = 196)) / {positional.PI} - 2 * (28 / 10.204) AS phase FROM s GROUP BY ALL)
SELECT lang, kmer, {sql_near('area * cos(phase * pi())')} AS x, {sql_near('area * sin(phase * pi())')} AS y FROM k""")
def plot_polar(spark: SparkSession, sf: str) -> DataFrame:
    found = spectral.peaks(spectral.dft_profile(positional.zero_filled(spark, sf, 2), by=("lang",)), by=("lang",))
    return rounded(T.polar_rows(found, by=("lang", "kmer")), "x", "y")


@add(f"WITH {X.READS} SELECT read_no AS id, 2 * length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS atoms FROM reads WHERE regexp_matches(seq, '[ACGT]')")
def sink_pdb(spark: SparkSession, sf: str) -> DataFrame:
    """Two phosphates a base pair, each an ATOM record of 78 columns."""
    lines = curve.pdb_records(X.reads(spark, sf))
    return lines.where(F.startswith("line", F.lit("ATOM")) & (F.length("line") == 78)).groupBy("id").agg(F.count("*").alias("atoms"))


MANY = [(k, f"NATION_{k % 2}{k if k % 3 else ''}") for k in range(60)]


@add(f"WITH {rest.table('e', 'line, entry', MANY)}, h AS (SELECT n_name AS TF, entry, line, row_number() OVER (PARTITION BY n_name ORDER BY line) AS r, count(*) OVER (PARTITION BY n_name) AS n FROM nation JOIN e ON regexp_matches(entry, '(?i)^' || n_name || '[0-9L-]*$')) SELECT TF, entry, line FROM h WHERE r < 20 OR r = n")
def pwm_of_tf_at_most_20(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("TF"))
    return guide.pwm_of(g, spark.createDataFrame(MANY, "line int, entry string")).select("TF", "entry", "line")


@add(f"WITH {X.READS} SELECT sample, count(*) AS reads, sum(length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))::BIGINT AS gc, max(read_no) AS last FROM reads GROUP BY sample")
def extend_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """A user's aggregate with a state of its own: reads, G and C, the last number."""

    def step(state: list[int], frame: pd.DataFrame) -> list[int]:
        gc = int((frame["seq"].str.count("G") + frame["seq"].str.count("C")).sum())
        return [state[0] + len(frame), state[1] + gc, max(state[2], int(frame["read_no"].max()))]

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [a[0] + b[0], a[1] + b[1], max(a[2], b[2])]

    return extend.aggregate_reads(X.reads(spark, sf), lambda: [0, 0, -1], step, merge, lambda s: [tuple(s)], "reads long, gc long, last long")


@add(f"WITH {X.READS} SELECT read_no, length(seq) - length(ltrim(seq, 'A')) AS leading FROM reads WHERE starts_with(seq, 'A')")
def extend_map_reads(spark: SparkSession, sf: str) -> DataFrame:
    """A user's function that gives some reads a row."""

    def leading(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame[frame["seq"].str.startswith("A")]
        return pd.DataFrame({"read_no": rows["read_no"], "leading": rows["seq"].str.len() - rows["seq"].str.lstrip("A").str.len()})

    return extend.map_reads(X.reads(spark, sf).select("read_no", "seq"), leading, "read_no long, leading long")


@add(f"WITH {X.READS} SELECT count(*) AS reads, sum(length(replace(seq, 'N', '')))::BIGINT AS bases FROM reads")
def extend_map_partition(spark: SparkSession, sf: str) -> DataFrame:
    """A user's function over a whole task's reads; one sum joins what the tasks give."""

    def totals(frames):
        reads = bases = 0
        for frame in frames:
            reads += len(frame)
            bases += int((frame["seq"].str.len() - frame["seq"].str.count("N")).sum())
        yield pd.DataFrame({"reads": [reads], "bases": [bases]})

    parts = extend.map_partition(X.reads(spark, sf).select("seq"), totals, "reads long, bases long")
    return parts.agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"))


@add(f"WITH {X.READS} SELECT sample, read_no % 4 AS slice, count(DISTINCT seq) AS n FROM reads GROUP BY ALL")
def extend_map_files(spark: SparkSession, sf: str) -> DataFrame:
    """A user's function over slices of each sample."""

    def distinct(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample": frame["sample"].iloc[:1], "slice": frame["read_no"].iloc[:1] % 4, "n": [frame["seq"].nunique()]})

    return extend.map_files(X.reads(spark, sf).select("sample", "read_no", "seq"), distinct, "sample string, slice long, n long", by="sample", slices=4)
