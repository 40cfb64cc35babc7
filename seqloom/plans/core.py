"""Queries: k-mer counts and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import compare, dedup, kmers
from seqloom.plans.register import Registry, rounded, sql_near
from seqloom.sources import fixtures as X

add = Registry()
QUERIES, ORACLE = add.queries, add.oracle


def windows(k: int, where: str = "kmer NOT LIKE '%N%'", source: str = "reads") -> str:
    return f"w AS (SELECT sample, lang, read_no, i AS pos, kmer FROM (SELECT sample, lang, read_no, i, substr(seq, i + 1, {k}) AS kmer FROM {source}, range(0, 147 - {k} + 1) t(i)) WHERE {where})"


RC = "reverse(translate(kmer, 'ACGT', 'TGCA'))"


@add(f"WITH {X.READS}, {windows(4)}, c AS (SELECT sample, kmer, count(*) AS cnt FROM w GROUP BY ALL) SELECT sample, kmer, cnt, {sql_near('cnt / sum(cnt) OVER (PARTITION BY sample)', 8)} AS freq FROM c")
def kmer_count_all(spark: SparkSession, sf: str) -> DataFrame:
    counts = kmers.with_frequency(kmers.count(X.reads(spark, sf), 4))
    return rounded(counts.select("sample", "kmer", "cnt", "freq"), "freq", digits=8)


@add(f"WITH {X.READS}, {windows(4)} SELECT sample, kmer, count(DISTINCT read_no) AS cnt FROM w GROUP BY ALL")
def kmer_count_per_read(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.count(X.reads(spark, sf), 4, per_read=True)


@add(f"WITH {X.READS}, {windows(4)} SELECT sample, kmer, count(*) AS cnt FROM (SELECT sample, kmer FROM w UNION ALL SELECT sample, {RC} FROM w) GROUP BY ALL")
def kmer_count_both_strands(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.count(X.reads(spark, sf), 4, both_strands=True)


@add(f"""WITH {X.READS}, {windows(4)}, c AS (SELECT sample, kmer, count(*) AS cnt FROM w GROUP BY ALL)
SELECT sample, min(kmer) AS kmer, sum(CASE WHEN kmer = {RC} THEN 2 * cnt ELSE cnt END)::BIGINT AS cnt FROM c GROUP BY sample, least(kmer, {RC})""")
def kmer_bin_rc(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.bin_strands(kmers.count(X.reads(spark, sf), 4))


@add(f"""WITH {X.READS}, {windows(4)}, c AS (SELECT sample, kmer, count(*) AS cnt FROM w GROUP BY ALL),
b AS (SELECT sample, min(kmer) AS kmer, sum(CASE WHEN kmer = {RC} THEN 2 * cnt ELSE cnt END)::BIGINT AS cnt FROM c GROUP BY sample, least(kmer, {RC}))
SELECT sample, kmer, cnt, {sql_near(f'cnt / sum(CASE WHEN kmer = {RC} THEN 1.5 * cnt ELSE cnt END) OVER (PARTITION BY sample)', 8)} AS freq FROM b""")
def kmer_bin_rc_legacy_total(spark: SparkSession, sf: str) -> DataFrame:
    counts = kmers.with_frequency(kmers.bin_strands(kmers.count(X.reads(spark, sf), 4)), legacy_palindromes=True)
    return rounded(counts.select("sample", "kmer", "cnt", "freq"), "freq", digits=8)


@add(f"WITH {X.READS}, {windows(6)} SELECT sample, kmer, string_agg(read_no, ';' ORDER BY read_no) AS ori FROM w GROUP BY ALL")
def kmer_origin_list(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.origins(X.reads(spark, sf), 6, sep=";")


@add(f"""WITH {X.READS}, {windows(5)}, c AS (SELECT sample, kmer, count(*) AS cnt FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY cnt DESC, kmer) AS rank FROM c)
SELECT sample, kmer, cnt, rank::INTEGER AS rank FROM r WHERE rank <= 20""")
def kmer_freq_top20(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("sample").orderBy(F.desc("cnt"), "kmer")
    return kmers.count(X.reads(spark, sf), 5).withColumn("rank", F.row_number().over(order)).where("rank <= 20")


@add(f"""WITH {X.READS}, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base), c AS (SELECT sample, base, sum(length(seq) - length(replace(seq, base, '')))::BIGINT AS cnt FROM reads, b GROUP BY ALL)
SELECT sample, base, cnt, {sql_near('cnt / sum(cnt) OVER (PARTITION BY sample)', 8)} AS freq FROM c""")
def mono_freq(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kmers.base_frequencies(X.reads(spark, sf)), "freq", digits=8)


@add(f"""WITH {X.READS}, {windows(4)}, c AS (SELECT sample, kmer, count(*) AS cnt FROM w GROUP BY ALL),
m AS (SELECT sample, a / (a + c + g + t) AS a, c / (a + c + g + t) AS c, g / (a + c + g + t) AS g, t / (a + c + g + t) AS t FROM
  (SELECT sample, {', '.join(f"sum(147 - length(replace(seq, '{b}', ''))) AS {b.lower()}" for b in 'ACGT')} FROM reads GROUP BY sample))
SELECT sample, kmer, {sql_near("cnt / (256.0 * " + ' * '.join(f"pow({b.lower()}, 4 - length(replace(kmer, '{b}', '')))" for b in 'ACGT') + ")")} AS cnt FROM
 (SELECT c.sample, c.kmer, c.cnt, m.a, m.c, m.g, m.t FROM c JOIN m ON c.sample = m.sample)""")
def kmer_bias_corrected(spark: SparkSession, sf: str) -> DataFrame:
    reads = X.reads(spark, sf)
    return rounded(kmers.bias_corrected(kmers.count(reads, 4), kmers.base_frequencies(reads), 4), "cnt")


SOURCES = """{w}, s AS (SELECT kmer, count(*) AS cnt FROM w WHERE lang = 'en' GROUP BY 1), r AS (SELECT kmer, count(*) AS cnt FROM w WHERE lang = 'de' GROUP BY 1),
s0 AS (SELECT kmer, count(*) AS cnt FROM w WHERE sample = 'src0' GROUP BY 1), r0 AS (SELECT kmer, count(*) AS cnt FROM w WHERE sample = 'src1' GROUP BY 1)"""
FC = """, j AS (SELECT kmer, coalesce(s.cnt, 0) AS sc, coalesce(r.cnt, 0) AS rc, coalesce(s.cnt, 0) / (SELECT sum(cnt) FROM s) AS s, coalesce(r.cnt, 0) / (SELECT sum(cnt) FROM r) AS r,
  20 / (SELECT sum(cnt) FROM r) AS p FROM s FULL JOIN r USING (kmer))"""


def four(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Counts of 5-mers: signal, reference and the background of each."""
    reads = X.reads(spark, sf)
    conditions = (F.col("lang") == "en", F.col("lang") == "de", F.col("sample") == "src0", F.col("sample") == "src1")
    return [kmers.count(reads.where(c), 5, by=()) for c in conditions]


@add(f"WITH {X.READS}, {SOURCES.format(w=windows(5))}{FC} SELECT kmer, {sql_near('s', 8)} AS sig_freq, {sql_near('r', 8)} AS ref_freq, {sql_near('log2((s - r) / (r + p) + 1)')} AS log_fc FROM j")
def log_fc_simple(spark: SparkSession, sf: str) -> DataFrame:
    s, r, _, _ = four(spark, sf)
    return rounded(rounded(compare.log_fc(s, r), "log_fc"), "sig_freq", "ref_freq", digits=8)


@add(f"WITH {X.READS}, {SOURCES.format(w=windows(5))}{FC} SELECT kmer, {sql_near('log2((s - r) / (r + CASE WHEN sc < 10 AND rc < 10 THEN 5 * p ELSE p END) + 1)')} AS log_fc FROM j")
def log_fc_lowcount5x(spark: SparkSession, sf: str) -> DataFrame:
    s, r, _, _ = four(spark, sf)
    return rounded(compare.log_fc(s, r, low_count=10).select("kmer", "log_fc"), "log_fc")


@add(f"""WITH {X.READS}, {SOURCES.format(w=windows(5))}, k AS (SELECT kmer FROM s UNION SELECT kmer FROM r UNION SELECT kmer FROM s0 UNION SELECT kmer FROM r0),
j AS (SELECT kmer, {', '.join(f'coalesce({t}.cnt, 0) / (SELECT sum(cnt) FROM {t}) AS {t}' for t in ('s', 'r', 's0', 'r0'))}, 20 / (SELECT sum(cnt) FROM r) AS p
  FROM k LEFT JOIN s USING (kmer) LEFT JOIN r USING (kmer) LEFT JOIN s0 USING (kmer) LEFT JOIN r0 USING (kmer))
SELECT kmer, CASE WHEN (s - s0) / (s0 + p) + 1 > 0 AND (r - r0) / (r0 + p) + 1 > 0 THEN {sql_near('log2(((s - s0) / (s0 + p) + 1) / ((r - r0) / (r0 + p) + 1))')} END AS log_fc FROM j""")
def log_fc_c0(spark: SparkSession, sf: str) -> DataFrame:
    s, r, s0, r0 = four(spark, sf)
    return rounded(compare.log_fc_background(s, s0, r, r0), "log_fc")


INFO = """{w}, c AS (SELECT sample, kmer, count(*) AS cnt FROM w GROUP BY ALL), u AS (SELECT concat(a.x, b.x, c.x, d.x) AS kmer FROM
  (SELECT unnest(['A', 'C', 'G', 'T']) AS x) a, (SELECT unnest(['A', 'C', 'G', 'T']) AS x) b, (SELECT unnest(['A', 'C', 'G', 'T']) AS x) c, (SELECT unnest(['A', 'C', 'G', 'T']) AS x) d),
bk AS (SELECT kmer, coalesce(cnt, 0) + {p} AS b FROM u LEFT JOIN (SELECT kmer, cnt FROM c WHERE sample = 'src0') USING (kmer)),
g AS (SELECT sample, kmer, b, b / (SELECT sum(b) FROM bk) AS bf, {start} AS pre FROM (SELECT DISTINCT sample FROM c WHERE sample <> 'src0'), bk),
f AS (SELECT sample, bf, coalesce(cnt, 0) + pre AS s FROM g LEFT JOIN c USING (sample, kmer))
SELECT sample, {near} AS info FROM (SELECT sample, bf, s / sum(s) OVER (PARTITION BY sample) AS sf FROM f) GROUP BY sample"""
KL = sql_near("sum(sf * log2(sf / bf))")


@add(f"WITH {X.READS}, " + INFO.format(w=windows(4), p="1.0", start="b * (200.0 * 144) / (SELECT sum(b) FROM bk)", near=KL))
def info_content_prefill(spark: SparkSession, sf: str) -> DataFrame:
    counts = kmers.count(X.reads(spark, sf), 4)
    out = compare.information(counts.where("sample <> 'src0'"), counts.where("sample = 'src0'"), kmers.universe(spark, 4), k=4)
    return rounded(out, "info")


@add(f"WITH {X.READS}, " + INFO.format(w=windows(4), p="50.0", start="50.0", near=KL))
def info_content_pseudo50(spark: SparkSession, sf: str) -> DataFrame:
    counts = kmers.count(X.reads(spark, sf), 4)
    out = compare.information(counts.where("sample <> 'src0'"), counts.where("sample = 'src0'"), kmers.universe(spark, 4), k=4, pseudo=50.0, prefill=False)
    return rounded(out, "info")


@add(f"""WITH {X.READS}, {windows(4)}, c AS (SELECT sample, kmer, count(*) AS cnt FROM w GROUP BY ALL), b AS (SELECT kmer, cnt, sum(cnt) OVER () AS n FROM c WHERE sample = 'src0'),
s AS (SELECT sample, kmer, cnt / sum(cnt) OVER (PARTITION BY sample) AS s FROM c WHERE sample <> 'src0')
SELECT sample, {sql_near("sum(s * log2((s - coalesce(b.cnt / b.n, 0)) / (coalesce(b.cnt / b.n, 0) + 20.0 / (SELECT sum(cnt) FROM b)) + 1))")} AS info FROM s LEFT JOIN b USING (kmer) GROUP BY sample""")
def info_content_from_tables(spark: SparkSession, sf: str) -> DataFrame:
    counts = kmers.count(X.reads(spark, sf), 4)
    return rounded(compare.information_from_tables(counts.where("sample <> 'src0'"), counts.where("sample = 'src0'")), "info")


@add(f"WITH {X.READS} SELECT DISTINCT seq FROM reads")
def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact(X.reads(spark, sf)).select("seq")


#: Conflicts of the three-anchor rule: e has (a, s) where an anchor of a lies in s and a comes first.
CONFLICTS = f"""{X.READS}, {X.BARE}, d AS MATERIALIZED (SELECT seq, least(length(seq), 20) AS w, length(seq) - least(length(seq), 20) AS last FROM (SELECT DISTINCT seq FROM bare)),
a AS (SELECT seq AS kept, unnest([substr(seq, 1, w), substr(seq, (last + 1) // 2 + 1, w), substr(seq, last + 1, w)]) AS anchor FROM d WHERE w > 0),
x AS (SELECT seq, unnest(list_transform(range(0, last + 1), lambda i: substr(seq, i + 1, w))) AS anchor FROM d WHERE w > 0),
e AS MATERIALIZED (SELECT DISTINCT kept AS a, x.seq AS s FROM x JOIN a ON a.anchor = x.anchor WHERE a.kept < x.seq)"""


@add(f"WITH {CONFLICTS} SELECT seq FROM d WHERE seq NOT IN (SELECT s FROM e)")
def dedup_anchor_strict(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.three_anchor(X.bare(X.reads(spark, sf)), strict=True).select("seq")


#: The rule over conflicts: a read stays once all that come before it in conflict are gone, and goes
#: once one of them stays (1 stays, 2 goes, 0 is undecided).
GREEDY = f"""WITH RECURSIVE {CONFLICTS},
g(seq, state) USING KEY (seq) AS (SELECT seq, CASE WHEN seq IN (SELECT s FROM e) THEN 0 ELSE 1 END FROM d UNION ALL
  SELECT u.seq, CASE WHEN bool_or(p.state = 1) THEN 2 ELSE 1 END FROM recurring.g u JOIN e ON e.s = u.seq JOIN recurring.g p ON p.seq = e.a
  WHERE u.state = 0 GROUP BY u.seq HAVING bool_or(p.state = 1) OR bool_and(p.state = 2))
SELECT seq FROM g WHERE state = 1"""


@add(GREEDY)
def dedup_anchor_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.three_anchor(X.bare(X.reads(spark, sf))).select("seq")


@add(GREEDY)
def dedup_anchor_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same by groups from the start, with blocks of 1,000 holdings."""
    return dedup.three_anchor(X.bare(X.reads(spark, sf)), early=0, bound=1000).select("seq")


@add(f"WITH {X.READS} SELECT read_no, sample, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc, rpad(seq, 160, 'N') AS padded FROM reads")
def revcomp_and_padding(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf).select("read_no", "sample", S.revcomp("seq").alias("rc"), S.pad_end("seq", 160).alias("padded"))


@add(f"WITH {X.READS}, w AS (SELECT read_no, string_agg(i, ',' ORDER BY i) AS positions FROM reads, range(0, 145) t(i) WHERE substr(seq, i + 1, 3) = 'ATA' GROUP BY read_no) SELECT read_no, coalesce(positions, '') AS positions FROM reads LEFT JOIN w USING (read_no)")
def match_positions_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    found = X.reads(spark, sf).select("read_no", S.overlapping("seq", F.lit("ATA")).alias("p"))
    return found.select("read_no", F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"))


@add(f"""WITH {X.READS}, p AS (SELECT read_no, string_split(seq, 'ATA') AS parts FROM reads),
q AS (SELECT read_no, list_transform(range(1, len(parts)), lambda j: list_sum(list_transform(parts[1:j], lambda x: length(x))) + 3 * (j - 1)) AS pos FROM p)
SELECT read_no, array_to_string(list_transform(pos, lambda x: x::BIGINT), ',') AS positions FROM q""")
def match_positions_nonoverlapping(spark: SparkSession, sf: str) -> DataFrame:
    found = X.reads(spark, sf).select("read_no", S.non_overlapping("seq", "ATA").alias("p"))
    return found.select("read_no", F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"))


@add(f"WITH {X.READS} SELECT sample, read_no, 0 AS piece, right(seq, 40) AS part FROM reads")
def cut40_last(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.cut(X.reads(spark, sf), 40, pieces="last")


@add(f"WITH {X.READS} SELECT sample, read_no, i::INTEGER AS piece, substr(seq, least(i * 40, 107) + 1, 40) AS part FROM reads, range(0, 4) t(i)")
def cut40_all(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.cut(X.reads(spark, sf), 40)
