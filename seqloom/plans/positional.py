"""Queries: position matrices, spectra, alignment to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import adm, align, compare, kmers, spectral
from seqloom.plans.register import Registry, rounded, sql_near
from seqloom.sources import fixtures as X

add = Registry()
QUERIES, ORACLE = add.queries, add.oracle

PI = spectral.PI


def windows(*ks: int, source: str = "reads") -> str:
    each = " UNION ALL ".join(f"SELECT sample, lang, read_no, i::INTEGER AS pos, substr(seq, i + 1, {k}) AS kmer FROM {source}, range(0, 147 - {k} + 1) t(i)" for k in ks)
    return f"w AS (SELECT * FROM ({each}) WHERE kmer NOT LIKE '%N%')"


def letters(k: int) -> str:
    names = "abcdef"[:k]
    return f"u AS (SELECT concat({', '.join(f'{n}.x' for n in names)}) AS kmer FROM " + ", ".join(f"(SELECT unnest(['A', 'C', 'G', 'T']) AS x) {n}" for n in names) + ")"


@add(f"WITH {X.READS}, {windows(1, 2)} SELECT sample, kmer, pos, count(*) AS val FROM w GROUP BY ALL")
def adm_counts_k12(spark: SparkSession, sf: str) -> DataFrame:
    return adm.position_counts(X.reads(spark, sf), (1, 2))


@add(f"WITH {X.READS}, {windows(3)} SELECT sample, kmer, pos, count(*) AS val FROM w GROUP BY ALL")
def adm_counts_k3(spark: SparkSession, sf: str) -> DataFrame:
    return adm.position_counts(X.reads(spark, sf), (3,))


ZERO = "z AS (SELECT g.lang, g.kmer, g.pos, coalesce(n, 0) AS val FROM (SELECT * FROM (SELECT DISTINCT lang FROM reads), u, (SELECT i::INTEGER AS pos FROM range({n}) t(i))) g LEFT JOIN (SELECT lang, kmer, pos, count(*) AS n FROM w GROUP BY ALL) c ON c.lang = g.lang AND c.kmer = g.kmer AND c.pos = g.pos)"


def zero_filled(spark: SparkSession, sf: str, k: int) -> DataFrame:
    counts = adm.position_counts(X.reads(spark, sf), (k,), by=("lang",))
    return adm.zero_filled(counts, kmers.universe(spark, k), 147 - k + 1, by=("lang",))


@add(f"WITH {X.READS}, {windows(2)}, {letters(2)}, {ZERO.format(n=146)} SELECT * FROM z")
def adm_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return zero_filled(spark, sf, 2)


@add(f"WITH {X.READS}, {windows(1, 2)}, c AS (SELECT sample, kmer, pos, count(*) AS val FROM w GROUP BY ALL) SELECT sample, kmer, pos, val FROM c WHERE pos < 100 - (length(kmer) - 1)")
def adm_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return adm.trimmed(adm.position_counts(X.reads(spark, sf), (1, 2)), 100)


@add(f"""WITH {X.READS}, {windows(1, 2)}, c AS (SELECT lang, kmer, pos, count(*) AS val FROM w GROUP BY ALL), n AS (SELECT lang, sum(val) AS n FROM c WHERE pos = 4 AND length(kmer) = 1 GROUP BY 1)
SELECT lang, kmer, pos, {sql_near('val / n', 8)} AS val FROM c JOIN n USING (lang)""")
def adm_freq(spark: SparkSession, sf: str) -> DataFrame:
    counts = adm.position_counts(X.reads(spark, sf), (1, 2), by=("lang",))
    return rounded(adm.to_frequency(counts, by=("lang",)), "val", digits=8)


@add(f"WITH {X.READS}, {windows(2)}, {letters(2)}, {ZERO.format(n=146)}, m AS (SELECT *, avg(val) OVER (PARTITION BY lang, kmer) AS m FROM z) SELECT lang, kmer, pos, {sql_near('CASE WHEN m = 0 THEN val ELSE (val - m) / m END')} AS val FROM m")
def adm_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(adm.normalised(zero_filled(spark, sf, 2), by=("lang",)), "val")


BG = f"""WITH {X.READS}, {windows(2)}, {letters(2)}, s AS (SELECT kmer, pos, count(*) AS val FROM w WHERE lang = 'en' GROUP BY ALL), b0 AS (SELECT kmer, pos, count(*) AS val FROM w WHERE lang <> 'en' GROUP BY ALL),
g AS (SELECT kmer, i::INTEGER AS pos FROM u, range(146) t(i)), b AS (SELECT kmer, pos, coalesce(val, 0) AS val FROM g LEFT JOIN b0 USING (kmer, pos)), sz AS (SELECT kmer, pos, coalesce(val, 0) AS val FROM g LEFT JOIN s USING (kmer, pos)),
r AS (SELECT (SELECT sum(val) FROM s WHERE pos = 4) / (SELECT sum(val) FROM b0 WHERE pos = 4) AS r)"""


def signal_and_background(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = adm.position_counts(X.reads(spark, sf).withColumn("en", F.col("lang") == "en"), (2,), by=("en",))
    pick = lambda c: adm.zero_filled(counts.where(c).select("kmer", "pos", "val"), kmers.universe(spark, 2), 146, by=())
    return pick("en"), pick("not en")


@add(f"{BG} SELECT sz.kmer, sz.pos, {sql_near('sz.val - b.val * r.r')} AS val FROM sz JOIN b ON b.kmer = sz.kmer AND b.pos = sz.pos, r")
def adm_bg_plain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(adm.background_removed(*signal_and_background(spark, sf)), "val")


@add(f"{BG}, d AS (SELECT kmer, pos, val - avg(val) OVER (PARTITION BY kmer) AS val FROM b) SELECT sz.kmer, sz.pos, {sql_near('sz.val - d.val * r.r')} AS val FROM sz JOIN d ON d.kmer = sz.kmer AND d.pos = sz.pos, r")
def adm_bg_meanpreserving(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(adm.background_removed(*signal_and_background(spark, sf), keep_mean=True), "val")


PROFILE = f"""WITH {X.READS}, {windows(2)}, {letters(2)}, {ZERO.format(n=146)}, p AS (SELECT lang, kmer, pos - {{front}} AS x, val FROM z WHERE pos >= {{front}} AND pos < 146 - {{drop}}),
m AS (SELECT lang, kmer, avg(val) AS m, count(*) AS n FROM p GROUP BY ALL)"""
DFT = f"""{PROFILE.format(front=0, drop=1)}, y AS (SELECT p.lang, p.kmer, x, m, n, (val - m) * (1 - pow((x - (n - 1) / 2) / ((n - 1) / 2), 2)) AS y FROM p JOIN m ON m.lang = p.lang AND m.kmer = p.kmer),
f AS (SELECT lang, kmer, h::INTEGER AS h, any_value(m) AS m, any_value(n) AS n, sum(y * cos(2 * {PI} * h * x / 2000)) AS re, -sum(y * sin(2 * {PI} * h * x / 2000)) AS im FROM y, range(600) t(h) GROUP BY ALL),
s AS (SELECT *, CASE WHEN m <> 0 THEN sqrt(re * re + im * im) / (m * 5.1 * n / 10.2) END AS power FROM f)"""


@add(f"{DFT} SELECT lang, kmer, h, {sql_near('power')} AS power FROM s")
def dft_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = spectral.dft_profile(zero_filled(spark, sf, 2), by=("lang",))
    return rounded(out.select("lang", "kmer", "h", "power"), "power")


@add(f"""{DFT} SELECT lang, kmer, {sql_near('sum(power) FILTER (h BETWEEN 189 AND 204)')} AS area, {sql_near('sum(power) FILTER (h BETWEEN 189 AND 204) / sum(power) FILTER (h BETWEEN 149 AND 250)')} AS pct,
{sql_near(f'atan2(max(im) FILTER (h = 196), max(re) FILTER (h = 196)) / {PI} - 2 * (28 / 10.204)')} AS phase FROM s GROUP BY ALL""")
def dft_peaks(spark: SparkSession, sf: str) -> DataFrame:
    out = spectral.peaks(spectral.dft_profile(zero_filled(spark, sf, 2), by=("lang",)), by=("lang",))
    return rounded(out, "area", "pct", "phase")


#: No window: the points themselves; the splice variants leave out points at the start and one at the end.
def spliced(front: int, drop: int, window: str) -> str:
    return f"""{PROFILE.format(front=front, drop=drop)}, y AS (SELECT p.lang, p.kmer, x, m, n, (val - m) * {window} AS y FROM p JOIN m ON m.lang = p.lang AND m.kmer = p.kmer),
f AS (SELECT lang, kmer, h::INTEGER AS h, any_value(m) AS m, any_value(n) AS n, sum(y * cos(2 * {PI} * h * x / 2000)) AS re, -sum(y * sin(2 * {PI} * h * x / 2000)) AS im FROM y, range(600) t(h) GROUP BY ALL),
s AS (SELECT *, CASE WHEN m <> 0 THEN sqrt(re * re + im * im) / (m * 5.1 * n / 10.2) END AS power FROM f)
SELECT lang, kmer, {sql_near('sum(power) FILTER (h BETWEEN 189 AND 204)')} AS area, {sql_near('sum(power) FILTER (h BETWEEN 189 AND 204) / sum(power) FILTER (h BETWEEN 149 AND 250)')} AS pct,
{sql_near(f'atan2(max(im) FILTER (h = 196), max(re) FILTER (h = 196)) / {PI} - 2 * ({{phase}} / 10.204)')} AS phase FROM s GROUP BY ALL"""


WELCH = "(1 - pow((x - (n - 1) / 2) / ((n - 1) / 2), 2))"


@add(spliced(5, 4, "1").format(phase=5))
def dft_unwindowed(spark: SparkSession, sf: str) -> DataFrame:
    """No window, five points off at the start, phase by these five."""
    rows = spectral.dft_profile(zero_filled(spark, sf, 2), by=("lang",), kind=None, front=5, drop=F.lit(4))
    return rounded(spectral.peaks(rows, by=("lang",), phase_offset=5.0), "area", "pct", "phase")


@add(spliced(0, 1, WELCH).format(phase=28))
def dft_splice_test(spark: SparkSession, sf: str) -> DataFrame:
    """The last point always off, whatever k."""
    rows = spectral.dft_profile(zero_filled(spark, sf, 2), by=("lang",), drop=F.lit(1))
    return rounded(spectral.peaks(rows, by=("lang",)), "area", "pct", "phase")


@add(spliced(7, 1, WELCH).format(phase=7))
def dft_phase_test(spark: SparkSession, sf: str) -> DataFrame:
    """Points off at the start, and the phase by as many."""
    rows = spectral.dft_profile(zero_filled(spark, sf, 2), by=("lang",), front=7, drop=F.lit(1))
    return rounded(spectral.peaks(rows, by=("lang",), phase_offset=7.0), "area", "pct", "phase")


@add(f"""{PROFILE.format(front=5, drop=4)}, f AS (SELECT p.lang, p.kmer, h::INTEGER AS h, any_value(m) AS m, any_value(n) AS n, sum((val - m) * cos(2 * 3.14159 * h * x / 256)) AS re, sum((val - m) * sin(2 * 3.14159 * h * x / 256)) AS im
  FROM p JOIN m ON m.lang = p.lang AND m.kmer = p.kmer, range(129) t(h) GROUP BY ALL)
SELECT lang, kmer, h, {sql_near('h / 128 / 2', 8)} AS freq, {sql_near('CASE WHEN m <> 0 THEN sqrt(re * re + im * im) / (m * 5.1 * n / 10.2) END')} AS power FROM f""")
def padded_dft(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(spectral.padded_dft(zero_filled(spark, sf, 2), by=("lang",)), "power"), "freq", digits=8)


W = f"(2 * {PI} * 196 / 2000)"


@add(f"""WITH {X.READS}, t AS (SELECT sum(cos({W} * x)) AS c, sum(sin({W} * x)) AS s FROM range(146) t(x)),
h AS (SELECT sample, read_no, i FROM reads, range(146) t(i) WHERE substr(seq, i + 1, 2) = 'TA'),
p AS (SELECT r.sample, r.read_no, count(i) AS n, coalesce(sum(cos({W} * i)), 0) - count(i) / 146 * any_value(t.c) AS re, coalesce(sum(sin({W} * i)), 0) - count(i) / 146 * any_value(t.s) AS im
  FROM reads r LEFT JOIN h ON h.sample = r.sample AND h.read_no = r.read_no, t GROUP BY ALL)
SELECT sample, {sql_near('sum(sqrt(re * re + im * im)) / sum(n)')} AS ratio, {sql_near('avg(CASE WHEN n > 0 THEN (re * re + im * im) / n END)')} AS mean_square FROM p GROUP BY sample""")
def single_read_power_h196(spark: SparkSession, sf: str) -> DataFrame:
    hits = X.reads(spark, sf).select("sample", S.overlapping("seq", F.lit("TA")).alias("p"))
    return rounded(spectral.read_power_summary(spectral.read_power(hits, 146), by=("sample",)), "ratio", "mean_square")


@add(f"""WITH {X.READS}, h AS (SELECT sample, read_no, i FROM reads, range(146) t(i) WHERE substr(seq, i + 1, 2) = 'TA'),
p AS (SELECT r.sample, r.read_no, count(i) AS n, coalesce(sum(cos({W} * i)), 0) AS re, coalesce(sum(sin({W} * i)), 0) AS im FROM reads r LEFT JOIN h ON h.sample = r.sample AND h.read_no = r.read_no GROUP BY ALL)
SELECT sample, {sql_near('sum(sqrt(re * re + im * im)) / sum(n)')} AS ratio, {sql_near('avg(CASE WHEN n > 0 THEN (re * re + im * im) / n END)')} AS mean_square FROM p GROUP BY sample""")
def single_read_power_uncentred(spark: SparkSession, sf: str) -> DataFrame:
    hits = X.reads(spark, sf).select("sample", S.overlapping("seq", F.lit("TA")).alias("p"))
    return rounded(spectral.read_power_summary(spectral.read_power(hits, 146, centred=False), by=("sample",)), "ratio", "mean_square")


@add(f"""WITH {X.READS}, k AS (SELECT unnest(['A', 'TA', 'GC', 'CAT']) AS kmer), h AS (SELECT sample, read_no, kmer, i FROM reads, k, range(146) t(i) WHERE substr(seq, i + 1, length(kmer)) = kmer),
f AS (SELECT sample, read_no, kmer, h::INTEGER AS h, sqrt(pow(sum(cos(2 * pi() * h * i / 146)), 2) + pow(sum(sin(2 * pi() * h * i / 146)), 2)) AS p FROM h, range(146) t(h) GROUP BY ALL)
SELECT sample, kmer, h, {sql_near('CASE WHEN h <= 73 THEN h / 146 ELSE (h - 146) / 146 END', 8)} AS freq, {sql_near('sum(p)', 4)} AS power FROM f GROUP BY ALL""")
def single_read_fft_sum(spark: SparkSession, sf: str) -> DataFrame:
    out = spectral.read_fft_sums(X.reads(spark, sf), ["A", "TA", "GC", "CAT"])
    seen = out.groupBy("sample", "kmer").agg(F.max("power").alias("most")).where("most > 0").drop("most")
    return rounded(rounded(out.join(seen, ["sample", "kmer"]), "power", digits=4), "freq", digits=8)


def model(spark: SparkSession, sf: str) -> DataFrame:
    """log10 frequencies of bases and dinucleotides at the first 94 positions of the English reads."""
    counts = adm.position_counts(X.reads(spark, sf).where("lang = 'en'"), (1, 2), by=()).where(F.col("pos") < 95 - F.length("kmer"))
    full = adm.zero_filled(counts.where("length(kmer) = 1"), kmers.universe(spark, 1), 94, by=()).unionByName(adm.zero_filled(counts.where("length(kmer) = 2"), kmers.universe(spark, 2), 93, by=()))
    return adm.log10_floored(adm.to_frequency(full, by=()))


MODEL = f"""WITH {X.READS}, {windows(1, 2)}, mg AS (SELECT kmer, i::INTEGER AS pos FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS kmer), range(94) t(i)
  UNION ALL SELECT concat(a.x, b.x), i::INTEGER FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS x) a, (SELECT unnest(['A', 'C', 'G', 'T']) AS x) b, range(93) t(i)),
mc AS (SELECT kmer, pos, count(*) AS n FROM w WHERE lang = 'en' GROUP BY ALL), mn AS (SELECT sum(n) AS n FROM mc WHERE pos = 4 AND length(kmer) = 1),
model AS (SELECT mg.kmer, mg.pos, log10(greatest(coalesce(mc.n, 0) / mn.n, 1e-20)) AS lp FROM mg LEFT JOIN mc ON mc.kmer = mg.kmer AND mc.pos = mg.pos, mn),
o AS (SELECT sample, read_no, seq, i AS off FROM reads, range(54) t(i) WHERE substr(seq, i + 1, 94) NOT LIKE '%N%'),
di AS (SELECT sample, read_no, off, pos, lp FROM (SELECT o.sample, o.read_no, o.off, j AS pos, substr(seq, off + j + 1, 2) AS kmer FROM o, range(93) t(j)) JOIN model USING (kmer, pos)),
tot AS (SELECT o.sample, o.read_no, o.off, any_value(seq) AS seq, sum(di.lp) + any_value(m.lp) AS total FROM o JOIN di USING (sample, read_no, off) JOIN model m ON m.pos = 0 AND m.kmer = substr(seq, off + 1, 1) GROUP BY ALL)"""


@add(f"{MODEL} SELECT sample, read_no, off::INTEGER AS \"offset\", score + 0.0 AS score FROM (SELECT *, round(total, 6) AS score, row_number() OVER (PARTITION BY sample, read_no ORDER BY round(total, 6) DESC, off) AS r FROM tot) WHERE r = 1")
def align_best_offset(spark: SparkSession, sf: str) -> DataFrame:
    out = align.best_offset(X.reads(spark, sf), model(spark, sf))
    return rounded(out.select("sample", "read_no", "offset", "score"), "score", digits=6)


@add(f"""{MODEL}, b AS (SELECT sample, read_no, repeat('N', (53 - off)::BIGINT) || seq || repeat('N', off) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY sample, read_no ORDER BY round(total, 6) DESC, off) AS r FROM tot) WHERE r = 1),
k AS (SELECT sample, substr(seq, i + 1, 2) AS kmer, i::INTEGER AS pos FROM b, range(199) t(i) UNION ALL SELECT sample, substr(seq, i + 1, 1), i::INTEGER FROM b, range(200) t(i))
SELECT sample, kmer, pos, count(*) AS val FROM k WHERE kmer NOT LIKE '%N%' GROUP BY ALL""")
def align_shift_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = align.shifted(align.best_offset(X.reads(spark, sf), model(spark, sf)))
    return adm.position_counts(out, (1, 2))


LEFT = """, pick AS (SELECT sample, read_no, w, seq, off, row_number() OVER (PARTITION BY sample, read_no, w ORDER BY round(score, 6) DESC, off) AS r FROM sc),
k AS (SELECT sample, {kmer} AS kmer, {pos} AS pos FROM pick{more} WHERE r = 1) SELECT sample, kmer, pos::INTEGER AS pos, count(*) AS val FROM k WHERE kmer NOT LIKE '%N%' GROUP BY ALL"""


@add(f"""{MODEL}, cut AS (SELECT sample, read_no, off, w, sum(lp) AS lp FROM (SELECT sample, read_no, off, lp, unnest([pos - 1, pos, pos + 1, pos + 2]) AS w FROM di) WHERE w BETWEEN 2 AND 91 GROUP BY ALL),
sc AS (SELECT sample, read_no, off, w, seq, total - lp AS score FROM cut JOIN tot USING (sample, read_no, off)){LEFT.format(kmer='substr(seq, off + w + 1, 2)', pos='w', more='')}""")
def align_leave_window_2(spark: SparkSession, sf: str) -> DataFrame:
    return align.leave_window_out(X.reads(spark, sf), model(spark, sf))


@add(f"""{MODEL}, cut AS (SELECT sample, read_no, off, 0 AS w, sum(lp) AS lp FROM di WHERE pos BETWEEN 0 AND 39 GROUP BY ALL UNION ALL SELECT sample, read_no, off, 1, sum(lp) FROM di WHERE pos BETWEEN 39 AND 79 GROUP BY ALL),
sc AS (SELECT sample, read_no, off, w, seq, total - cut.lp + e.lp - CASE WHEN w = 0 THEN f.lp ELSE 0 END AS score FROM cut JOIN tot USING (sample, read_no, off)
  JOIN model e ON e.pos = (w + 1) * 40 AND e.kmer = substr(seq, off + (w + 1) * 40 + 1, 1) JOIN model f ON f.pos = 0 AND f.kmer = substr(seq, off + 1, 1)){LEFT.format(kmer='substr(seq, off + w * 40 + i + 1, 2)', pos='w * 40 + i', more=', range(40) t(i)')}""")
def align_leave_window_40(spark: SparkSession, sf: str) -> DataFrame:
    return align.leave_window_out(X.reads(spark, sf), model(spark, sf), window=40)


@add(f"WITH {X.READS}, {windows(2)} SELECT kmer, pos, sum(CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 0 END)::BIGINT AS val FROM w WHERE lang IN ('en', 'de') GROUP BY ALL")
def merge_add(spark: SparkSession, sf: str) -> DataFrame:
    counts = adm.position_counts(X.reads(spark, sf), (2,), by=("lang",))
    return compare.merged(*[counts.where(F.col("lang") == x).drop("lang") for x in ("en", "de")])


@add(f"WITH {X.READS}, {windows(2)} SELECT kmer, pos, sum(CASE WHEN lang = 'en' THEN 1 ELSE -1 END)::BIGINT AS val FROM w WHERE lang IN ('en', 'de') GROUP BY ALL")
def merge_sub(spark: SparkSession, sf: str) -> DataFrame:
    counts = adm.position_counts(X.reads(spark, sf), (2,), by=("lang",))
    return compare.merged(*[counts.where(F.col("lang") == x).drop("lang") for x in ("en", "de")], mode="subtract")


@add(f"WITH {X.READS}, {windows(1, 2)}, c AS (SELECT sample, kmer, pos, count(*) AS val FROM w GROUP BY ALL) SELECT sample, kmer, string_agg(val, ' ' ORDER BY pos) AS vals FROM c GROUP BY ALL")
def adm_wide(spark: SparkSession, sf: str) -> DataFrame:
    out = adm.wide(adm.position_counts(X.reads(spark, sf), (1, 2)))
    return out.select("sample", "kmer", F.array_join(F.col("vals").cast("array<string>"), " ").alias("vals"))


AFTER = f"""{BG}, d AS (SELECT kmer, pos, val - avg(val) OVER (PARTITION BY kmer) AS val FROM b), c AS (SELECT sz.kmer, sz.pos, sz.val - d.val * r.r AS val FROM sz JOIN d ON d.kmer = sz.kmer AND d.pos = sz.pos, r),
m AS (SELECT kmer, avg(val) AS m, count(*) AS n FROM c WHERE pos < 145 GROUP BY 1), y AS (SELECT c.kmer, pos, m, n, (val - m) * (1 - pow((pos - (n - 1) / 2) / ((n - 1) / 2), 2)) AS y FROM c JOIN m USING (kmer) WHERE pos < 145),
f AS (SELECT kmer, h, any_value(m) AS m, any_value(n) AS n, sum(y * cos(2 * {PI} * h * pos / 2000)) AS re, -sum(y * sin(2 * {PI} * h * pos / 2000)) AS im FROM y, range(600) t(h) GROUP BY ALL),
sp AS (SELECT *, CASE WHEN m <> 0 THEN sqrt(re * re + im * im) / (m * 5.1 * n / 10.2) END AS power FROM f)"""


@add(f"""{AFTER} SELECT kmer, {sql_near('sum(power) FILTER (h BETWEEN 189 AND 204)')} AS area, {sql_near('sum(power) FILTER (h BETWEEN 189 AND 204) / sum(power) FILTER (h BETWEEN 149 AND 250)')} AS pct,
{sql_near(f'atan2(max(im) FILTER (h = 196), max(re) FILTER (h = 196)) / {PI} - 2 * (28 / 10.204)')} AS phase FROM sp GROUP BY kmer""")
def peaks_after_background(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spectral.after_background(*signal_and_background(spark, sf))["peaks"], "area", "pct", "phase")


@add(f"""WITH {X.READS} SELECT read_no, i::INTEGER AS piece, i * 50 AS "at", substr(seq, i * 50 + 1, 54) AS part FROM reads, range(3) t(i) WHERE i * 50 < 147 - 4""")
def chunks_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    made = X.reads(spark, sf).select("read_no", F.posexplode(S.overlapping_chunks("seq", 50, 2)).alias("piece", "x"))
    return made.select("read_no", "piece", F.col("x.at").cast("long").alias("at"), "x.part")
