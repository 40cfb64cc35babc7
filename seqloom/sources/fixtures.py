"""Inputs derived from the driver's tables; FIXTURES.md says how."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, AS_BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "AACTTGGCACGTAACTGGCTCGTACN"


def spread(df: DataFrame) -> DataFrame:
    """Rows of a single file over all cores: its row groups, often one, bound a scan's tasks.

    Tables of several files are left alone: there a shuffle would only cost.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


#: Letters of a read, and what a document's number is multiplied by in its reads' numbers: no text has as many reads.
LENGTH, PIECES = 147, 1 << 24


def reads(spark: SparkSession, sf_dir: str, length: int = LENGTH) -> DataFrame:
    """(sample, lang, read_no, seq): all letters of each text, mapped to bases and cut into reads of
    `length`; the last is filled up with N. Texts without letters have none."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    bases = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), LETTERS, AS_BASES)
    parts = F.regexp_extract_all(bases, F.lit(f".{{1,{length}}}"), F.lit(0))
    rows = docs.select(F.col("source").alias("sample"), "lang", "doc_id", F.posexplode(parts).alias("piece", "part"))
    return rows.select("sample", "lang", (F.col("doc_id") * PIECES + F.col("piece")).alias("read_no"), F.rpad("part", length, "N").alias("seq"))


#: The same in DuckDB; queries put it before their own SQL.
READS = f"""reads AS (
  SELECT sample, lang, doc_id * {PIECES} + piece AS read_no, rpad(part, {LENGTH}, 'N') AS seq
  FROM (SELECT source AS sample, lang, doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS piece
        FROM (SELECT doc_id, source, lang, list_transform(range(0, length(s), {LENGTH}), lambda i: substr(s, i + 1, {LENGTH})) AS parts
              FROM (SELECT doc_id, source, lang, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{AS_BASES}') AS s FROM documents))))"""


#: reads without what they end with in N: a text's last read in its own length.
BARE = "bare AS (SELECT * REPLACE (rtrim(seq, 'N') AS seq) FROM reads)"


def bare(reads: DataFrame) -> DataFrame:
    return reads.withColumn("seq", F.rtrim("seq", F.lit("N")))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, chrom, start, end, mapq) from lineitem."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = F.col("l_orderkey").cast("long") * 100 + F.col("l_linenumber")
    return rows.select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("name"), (F.col("l_suppkey") % 24).cast("int").alias("chrom"), start.cast("long").alias("start"), (start + 147).cast("long").alias("end"), F.col("l_quantity").cast("int").alias("mapq"))


ALIGNMENTS = """aln AS (
  SELECT concat_ws('_', l_orderkey, l_linenumber) AS name, (l_suppkey % 24)::INTEGER AS chrom,
         (l_orderkey * 100 + l_linenumber)::BIGINT AS start, (l_orderkey * 100 + l_linenumber + 147)::BIGINT AS "end",
         l_quantity::INTEGER AS mapq FROM lineitem)"""


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, mate, chrom, start, end, strand, mapq, quality) from lineitem: an order's first two lines are a
    fragment's mates, its later ones reads without a mate; places are few, so that fragments repeat."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line, order = F.col("l_linenumber"), F.col("l_orderkey").cast("long")
    name = F.when(line <= 2, F.concat(F.lit("p"), order.cast("string"))).otherwise(F.concat_ws("_", F.lit("s"), order.cast("string"), line.cast("string")))
    start = (F.col("l_suppkey") % 7 * 100 + line).cast("long")
    return rows.select(
        name.alias("name"), F.when(line <= 2, line).otherwise(0).cast("int").alias("mate"), (F.col("l_suppkey") % 3).cast("int").alias("chrom"), start.alias("start"), (start + 50 + order % 3).alias("end"),
        F.when((order + line) % 2 == 0, "+").otherwise("-").alias("strand"), (order % 60).cast("int").alias("mapq"), F.col("l_quantity").cast("long").alias("quality"),
    )


MATES = """mates AS (
  SELECT CASE WHEN l_linenumber <= 2 THEN 'p' || l_orderkey ELSE 's_' || l_orderkey || '_' || l_linenumber END AS name, (CASE WHEN l_linenumber <= 2 THEN l_linenumber ELSE 0 END)::INTEGER AS mate,
         (l_suppkey % 3)::INTEGER AS chrom, (l_suppkey % 7 * 100 + l_linenumber)::BIGINT AS start, (l_suppkey % 7 * 100 + l_linenumber + 50 + l_orderkey % 3)::BIGINT AS "end",
         CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN '+' ELSE '-' END AS strand, (l_orderkey % 60)::INTEGER AS mapq, l_quantity::BIGINT AS quality FROM lineitem)"""


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end) from part."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    start = F.col("p_partkey").cast("long") * 500
    return rows.select((F.col("p_partkey") % 24).cast("int").alias("chrom"), start.alias("start"), (start + F.col("p_size") * 10).cast("long").alias("end"))


BLACKLIST = """blacklist AS (
  SELECT (p_partkey % 24)::INTEGER AS chrom, (p_partkey * 500)::BIGINT AS start, (p_partkey * 500 + p_size * 10)::BIGINT AS "end" FROM part)"""


def autosomes(spark: SparkSession) -> DataFrame:
    """(chrom, start, end): chromosomes 0 to 21, whole."""
    return spark.range(22).select(F.col("id").cast("int").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(1 << 60).cast("long").alias("end"))


AUTOSOMES = "autosomes AS (SELECT range::INTEGER AS chrom FROM range(22))"

#: (name, pattern): front, length of the random region, N, rear.
BARCODES = [("b1", "AA143NTT"), ("b2", "TG143NAC"), ("b3", "AC143NCA"), ("b4", "TT143NGA"), ("b5", "CA143NAA"), ("b6", "GT143NTC"), ("b7", "A144NAC"), ("b8", "aa143Ntt")]
#: (name, rows of A, C, G and T).
PWMS = {
    "m4": [[12, 1, 0, 6], [1, 15, 2, 4], [2, 1, 1, 8], [5, 3, 17, 2]],
    "m5": [[2, 14, 1, 1, 9], [3, 2, 16, 2, 4], [1, 2, 2, 1, 3], [14, 2, 1, 16, 4]],
    "m6": [[1, 12, 2, 10, 3, 5], [2, 3, 14, 2, 6, 4], [3, 1, 2, 4, 5, 6], [14, 4, 2, 4, 6, 5]],
}
#: (TF, seed, is dimer) in the order of the sheet.
SEEDS = [("NATION_0", "NNTAATTANN", "dimer"), ("Nation_0", "NTGACGTCAN", "mono"), ("NATION_1", "NGGATTAN", "mono"), ("nation_1", "NGGGGATTN", "mono"), ("NATION_2", "NTTAATN", "dimer"), ("nation_2", "NCACGTGN", "dimer"), ("nation_3", "NNGATAANN", "mono"), ("ELSEWHERE", "NCCGGAAN", "mono")]


def pwm_rows(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(name, base, pos, w) of the fixture matrices."""
    rows = [(n, b, p, float(w)) for n, m in PWMS.items() if names is None or n in names for b, ws in zip("ACGT", m) for p, w in enumerate(ws)]
    return spark.createDataFrame(rows, "name string, base string, pos int, w double")


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    say = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + ")"
