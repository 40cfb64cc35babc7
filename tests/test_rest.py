import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import curvature, demux, dimers, genome, guide, motif, stats
from seqloom.sources import fixtures, reads as R, tables as T


def test_demultiplexing(spark):
    sheet = spark.createDataFrame([("a", "AC4NGT"), ("b", "A5NGT"), ("c", "4N"), ("d", "ac4NGT"), ("e", "TTTT")], "name string, pattern string")
    codes = demux.barcodes(sheet)
    assert sorted(r.name for r in codes.collect()) == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, "ACTTTTGT", "abcdefgh"), (2, "GGGG", "abcd"), (3, "ACTTTTGTA", "abcdefghi"), (4, "AC", "ab")], "read_no long, seq string, qual string")
    got = {(r.read_no, r.name): (r.region, r.region_qual) for r in demux.matched(rows, codes).collect()}
    assert got[1, "a"] == ("TTTT", "cdef") and got[1, "b"] == ("CTTTT", "bcdef") and got[1, "c"] == ("ACTT", "abcd")
    assert (2, "c") in got and (4, "c") not in got
    exact = {(r.read_no, r.name) for r in demux.matched(rows, codes, exact=True).collect()}
    assert exact == {(1, "a"), (1, "b"), (2, "c")}
    assert [r.read_no for r in demux.unmatched(rows, codes).collect()] == [4]
    assert tuple(demux.stats(rows, codes).first()) == (4, 3, 1, 25.0)
    assert demux.matched(rows, codes.limit(0)).count() == 0


def test_sample_sheets(spark):
    sheet = spark.createDataFrame([("A1", "x"), ("A2", "y")], "pos string, TF string")
    values = spark.createDataFrame([("A1", "0", 1), ("A1", "7", 0)], "pos string, value string, line int")
    assert {r.pos: r.info for r in guide.add_column(sheet, values, "info").collect()} == {"A1": "0", "A2": "NA"}
    seeds = spark.createDataFrame([(0, "X", "D1", "dimer"), (1, "x", "M1", "mono"), (2, "X", "M2", "mono"), (3, "Y", "D2", "dimer"), (4, "Y", "D3", "dimer")], "line int, TF string, seed string, isdimer string")
    assert {r.tf: r.seed for r in guide.best_seeds(seeds).collect()} == {"X": "M1", "Y": "D3"}
    kinds = spark.createDataFrame([("Methylated x",), ("GROUP",), (None,), ("plain",)], "family string")
    assert {r.family for r in guide.not_methylated(kinds).collect()} == {None, "plain"}
    names = spark.createDataFrame([(x,) for x in ("run7-A01-YB20.txt", "/d/batch9_TAGTTA40NGTG_3.seq")], "path string")
    rows = guide.metadata(names).collect()
    assert rows[0].well == "A1" and (rows[1].batch, rows[1].barcode, rows[1].cyc) == ("batch9", "TAGTTA40NGTG", "3")
    many = spark.createDataFrame([(i, f"HOX{i}") for i in range(30)], "line int, entry string")
    picked = guide.pwm_of(spark.createDataFrame([("hox",)], "TF string"), many)
    assert sorted(r.line for r in picked.collect()) == [*range(19), 29]


def test_motif_scan_against_plain_python(spark):
    pwm = fixtures.pwm_rows(spark)
    odds = motif.log_odds([tuple(r) for r in pwm.collect()])
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(30)) for _ in range(20)] + ["", "AC"]
    rows = spark.createDataFrame([("s", i, s) for i, s in enumerate(seqs)], "sample string, read_no long, seq string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    turn = {"ori": lambda s: s, "rc": rc, "r": lambda s: s[::-1], "c": lambda s: rc(s)[::-1]}
    want = set()
    for name, m in odds.items():
        for i, s in enumerate(seqs):
            for p in range(len(s) - m.shape[1] + 1):
                part = s[p : p + m.shape[1]]
                for o, f in turn.items():
                    if "N" not in part and round(sum(m["ACGT".index(c), k] for k, c in enumerate(f(part))), 6) >= 3:
                        want.add((i, name, o, p))
    got = {(r.read_no, r.name, r.orient, r.pos) for r in motif.scan(rows, pwm, at_least=3.0).collect()}
    assert got == want and got
    back = motif.oriented(motif.oriented(pwm, "rc"), "rc")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pwm.select("name", "base", "pos", "w").collect()))


def test_score_thresholds_are_exact():
    from itertools import product

    m = motif.log_odds([("x", b, p, float(w)) for b, ws in zip("ACGT", fixtures.PWMS["m4"]) for p, w in enumerate(ws)])["x"]
    scores = [sum(round(m[c, k], 3) for k, c in enumerate(cs)) for cs in product(range(4), repeat=4)]
    for p in (0.5, 0.05, 0.01):
        t = motif.threshold(m, p)
        assert np.mean([s >= t - 1e-9 for s in scores]) <= p
        assert np.mean([s >= t - 1e-3 - 1e-9 for s in scores]) > p or not any(abs(s - t + 1e-3) < 1e-9 for s in scores)


def by_hand(spark, ori, rc, seq, m=3, r=(), c=()):
    return spark.createDataFrame([("s", 0, "x", m, list(map(float, ori)), list(map(float, rc)), list(map(float, r)), list(map(float, c)), seq)], "sample string, read_no long, name string, m int, ori array<double>, rc array<double>, r array<double>, c array<double>, seq string")


def test_gaps_between_hits(spark):
    seq = "AAACCGGGTTTACGTACGTA"
    assert [(r.kind, r.gap) for r in dimers.gaps(by_hand(spark, [2, 10], [], seq)).collect()] == [("HT", seq[3:8])]
    assert [(r.kind, r.gap) for r in dimers.gaps(by_hand(spark, [2], [10], seq)).collect()] == [("HH", seq[3:8])]
    assert [(r.kind, r.gap) for r in dimers.gaps(by_hand(spark, [10], [2], seq)).collect()] == [("TT", seq[3:8])]
    back = dimers.gaps(by_hand(spark, [], [11, 19], seq)).collect()
    flipped = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert [(r.kind, r.gap) for r in back] == [("HT", flipped[3:8])]
    assert dimers.gaps(by_hand(spark, [], [11, 19], seq), legacy=True).count() == 0
    old = dimers.gaps(by_hand(spark, [2, 10], [], seq), legacy=True).first()
    assert old.gap == seq[3:10]
    assert dimers.gaps(by_hand(spark, [2, 10], [], seq), least=6).count() == 0
    assert dimers.dimers(by_hand(spark, [2], [], seq)).count() == 0


def test_turning_to_the_nearest_end(spark):
    seq = "A" * 10 + "C" * 10
    r = dimers.nearest_left(by_hand(spark, [15], [18], seq)).first()
    assert r.rotated and r.ori == [3.0] and r.rc == [6.0] and r.min_dist == 3.0 and r.min_dir == "ori" and r.seq == "G" * 10 + "T" * 10
    r = dimers.nearest_left(by_hand(spark, [], [4], seq)).first()
    assert not r.rotated and r.min_dir == "rc" and r.min_dist == 4.0
    r = dimers.nearest_left(by_hand(spark, [], [], seq, r=[3])).first()
    assert r.is_r_c and r.min_dir == "r_c"


def test_intervals_against_brute_force(spark):
    rng = random.Random(2)
    aln = [(f"n{i}", rng.randrange(3), s := rng.randrange(200_000), s + rng.randrange(1, 400), rng.randrange(50)) for i in range(300)]
    bed = [(rng.randrange(3), s := rng.randrange(200_000), s + rng.choice([5, 300, 20_000])) for i in range(40)] + [(2, 0, 10**12), (0, 5, 5)]
    a, b = spark.createDataFrame(aln + aln[:3], "name string, chrom int, start long, end long, mapq int"), spark.createDataFrame(bed, "chrom int, start long, end long")
    hits = lambda x: any(c == x[1] and s < x[3] and x[2] < e and s < e for c, s, e in bed)
    want = sorted(x for x in aln + aln[:3] if hits(x))
    assert sorted(map(tuple, genome.overlap(a, b, width=1024).collect())) == want
    assert sorted(map(tuple, genome.overlap(a, b, keep=False, width=1024).collect())) == sorted(x for x in aln + aln[:3] if not hits(x))
    wide = bed + [(1, 5_000, 5_000 + 1024 * 64 * 3), (0, 190_000, 190_000 + 1024 * 64**3)]
    many = spark.createDataFrame(wide, "chrom int, start long, end long")
    assert len(genome.levels(a, many, 1024)) == 4
    touched = lambda x: any(c == x[1] and s < x[3] and x[2] < e and s < e for c, s, e in wide)
    assert sorted(map(tuple, genome.overlap(a, many, width=1024).collect())) == sorted(x for x in aln + aln[:3] if touched(x))
    assert genome.overlap(a, b.limit(0)).count() == 0 and genome.overlap(a, b.limit(0), keep=False).count() == 303
    best = {}
    for x in aln:
        best[x[1], x[2]] = min(best.get((x[1], x[2]), (1, 0)), (-x[4], x[0]))
    assert {(r.chrom, r.start): (-r.mapq, r.name) for r in genome.without_duplicates(a).collect()} == best


def test_significance(spark):
    rows = spark.createDataFrame([(0, 0, 100.0, 100.0), (5, 3, 200.0, 100.0), (40, 2, 10.0, 10.0)], "x int, y int, n1 double, n2 double")
    got = stats.audic_claverie(rows).collect()
    assert abs(got[0].p_le - 0.5) < 1e-12
    assert all(abs(r.p_le + r.p_gt - 1) < 1e-12 for r in got) and got[2].p_le < 1e-8
    r = stats.interval(rows.select("x", "n1", "n2").where("x = 5")).first()
    tails = {y: stats.audic_claverie(spark.createDataFrame([(5, y, 200.0, 100.0)], rows.schema)).first() for y in (r.y_max - 1, r.y_max)}
    assert r.y_min == -1 and tails[r.y_max].p_gt < 0.025 <= tails[r.y_max - 1].p_gt


def test_significance_of_large_counts(spark, monkeypatch):
    """One sum a count: no row for each y, of as many steps, which took the square of a count and more."""
    cases = [(0, 100.0, 100.0), (0, 1.0, 4000.0), (3, 10.0, 700.0), (9, 900.0, 20.0), (40, 10.0, 10.0), (700, 5e4, 7e4), (300_000, 8e6, 5e6), (7, 5.0, 0.0)]
    rows = spark.createDataFrame([*cases, cases[0], (2, 0.0, 5.0)], "x int, n1 double, n2 double")
    got = stats.interval(rows)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.x, r.n1, r.n2): (r.y_min, r.y_max) for r in got.collect()}
    assert got.pop((2, 0.0, 5.0)) == (None, None) and got.pop((7, 5.0, 0.0)) == (-1, 0) and len(got) == 7
    for (x, n1, n2), (low, high) in got.items():
        term = lambda y: math.exp(math.lgamma(x + y + 1) - math.lgamma(x + 1) - math.lgamma(y + 1) + (x + 1) * math.log(n1 / (n1 + n2)) + y * math.log(n2 / (n1 + n2)))  # noqa: B023, E731
        sums = np.cumsum([term(y) for y in range(high + 1)])
        assert (low < 0 or sums[low] < 0.025) and sums[low + 1] >= 0.025 and 1 - sums[high] < 0.025 and (high == 0 or 1 - sums[high - 1] >= 0.025)
    monkeypatch.setattr(stats, "STEPS", 3)
    assert all(stats.limits(*key, 0.025) == found for key, found in got.items() if key[0] < 1000)


def test_curvature_goldens(spark):
    rows = spark.createDataFrame([(1, "ATGCAAATTG" * 5), (2, "ac"), (3, ""), (4, None)], "read_no long, seq string")
    got = {(r.id, r.pos): r for r in curvature.curved(rows).collect()}
    want = [[0.58061616, 0.58163338, 0.58277938, 0.583783], [0.08029914, 0.11292516, 0.07675816, 0.03166286], [0.57923902, 0.57580064, 0.57367815, 0.57349872]]
    for k, pos in enumerate(range(18, 22)):
        r = got[1, pos]
        assert np.allclose([r.curvature, r.bend_angle, r.curve_angle], [w[k] for w in want])
    assert {i for i, _ in got} == {1, 2} and got[2, 0].base == "A"
    assert curvature.oligo_windows("ATCG", 3) == ["ATC", "TCG", None] and curvature.oligo_windows("ATCG", 4) == [None, "ATCG", None]
    for name in curvature.MODELS:
        model = curvature.Model.named(name)
        assert all(np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3)) for m in model.steps.values())
    straight = curvature.laid_out(curvature.coordinates("ACGT" * 20, curvature.Model.named("straight")))
    assert np.allclose(curvature.curvature(straight, 3.38)[0], 0, atol=1e-6)
    text = "Mine\nRise 3.4\nOligo AA AC AG AT CA\n      GG CG GA GC TA\nTwist 35 35 35 35 35 35 35 35 35 35\nRoll 0 0 0 0 0\n      0 0 0 0 0\nTilt 1 1 1 1 1 1 1 1 1 1\n"
    own = curvature.read_model(text)
    assert own.rise == 3.4 and np.allclose(own.steps["TT"], curvature.turn(3.4, 35, 0, -1))
    assert curvature.pdb_lines(curvature.curved(rows.where("read_no = 1"))).count() == 100


def test_fastq_and_text(spark, tmp_path):
    records = [(f"@HISEQ:{i}", "ACGT" * 3 + "ACGTN"[i % 5], "+", "@" + "I" * 12) for i in range(7)]
    body = "".join("\n".join(r) + "\n" for r in records)
    (tmp_path / "s1.fastq").write_text(body)
    with gzip.open(tmp_path / "s2.fastq.gz", "wt") as f:
        f.write(body)
    (tmp_path / "s3.txt").write_text("ACGT\n\nGGTT\n  \nAAAA\n")
    for prefix in ("@HISE", None):
        for name in ("s1.fastq", "s2.fastq.gz"):
            got = R.read_fastq(spark, str(tmp_path / name), prefix=prefix)
            assert [(r.header, r.seq, r.plus, r.qual) for r in got.orderBy("read_no").collect()] == records
            assert {r.sample for r in got.collect()} == {name.split(".")[0]}
            assert [r.bad for r in R.bad_records(got).collect()] == [0]
    rows = R.read(spark, str(tmp_path / "s3.txt"))
    assert [r.seq for r in rows.orderBy("read_no").collect()] == ["ACGT", "GGTT", "AAAA"]
    assert R.read(spark, str(tmp_path / "s1.fastq"), lines=3).count() == 3
    assert R.budget(rows, 2) == 2 and R.budget(rows, "all") == 3
    assert R.lengths(rows).first().length == 4
    with pytest.raises(Exception, match="different lengths"):
        R.lengths(spark.createDataFrame([("x", "AC"), ("x", "A")], "sample string, seq string")).collect()
    assert R.discover(spark, str(tmp_path)).count() == 3
    (tmp_path / "one.fasta").write_text(">name here\nACGTXX\nacg\n")
    one = R.read_single(spark, str(tmp_path / "one.fasta")).first()
    assert (one.name, one.seq) == ("name here", "ACGTACG")
    dna = R.random_dna(spark, 20, 200).collect()
    assert len({r.seq for r in dna}) == 20 and all(set(r.seq) == set("ACGT") and len(r.seq) == 200 for r in dna)


def test_tables(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("A\t1\t2,5\t0\n\nC\t4\t5\t6\n")
    got = {(r.kmer, r.pos): r.val for r in T.read_matrix(spark, str(p)).collect()}
    assert got == {("A", 0): 1.0, ("A", 1): 2.5, ("A", 2): 0.0, ("C", 0): 4.0, ("C", 1): 5.0, ("C", 2): 6.0}
    logs = {(r.kmer, r.pos): r.val for r in T.read_matrix(spark, str(p), keys=1, positions=3, log10=True).collect()}
    assert set(logs) == {("A", 0), ("A", 1), ("A", 2)} and logs["A", 2] == -20
    (tmp_path / "t.tsv").write_text("pos\tTF \n A1\t x y\t\nA2\tz\n")
    rows = T.read_table(spark, str(tmp_path / "t.tsv"))
    assert rows.columns[:2] == ["pos", "TF"] and rows.first().TF == "x y"
    (tmp_path / "l.tsv").write_text("k\tv\na\t1\na\t2\nb\t3\n")
    assert {r.key: r.value for r in T.read_lookup(spark, str(tmp_path / "l.tsv"), 0, 1, skip=1).collect()} == {"a": "2", "b": "3"}
    (tmp_path / "k.tsv").write_text("kmer\tcount\tfreq\ttotalCounts=8\nAA\t6\t0.75\nAC\t2\t0.25\n")
    assert sorted(map(tuple, T.read_kmer_table(spark, str(tmp_path / "k.tsv")).collect())) == [("AA", 6.0, 0.75, 8.0), ("AC", 2.0, 0.25, 8.0)]
    pwm = fixtures.pwm_rows(spark, ["m4"])
    T.write_pwm(pwm, str(tmp_path / "pwm"))
    back = T.read_pwm(spark, str(tmp_path / "pwm"), name="m4")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pwm.collect()))
    wide = spark.createDataFrame([("C", [1, 2]), ("freq", [0, 1]), ("A", [3])], "kmer string, vals array<int>")
    T.write_matrix(wide, str(tmp_path / "w"), caption="freq", length=3)
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["freq\t0\t1\t0", "A\t3\t0\t0", "C\t1\t2\t0"]
    rows = spark.createDataFrame([("b1", "ACG"), (None, "TTT")], "name string, region string")
    T.write_samples(rows, str(tmp_path / "demux"))
    assert {r.name for r in spark.read.text(str(tmp_path / "demux/reads")).select("name").collect()} == {"b1", "unmatched"}
    counts = spark.createDataFrame([("AA", 2, 0.4), ("AC", 3, 0.6)], "kmer string, cnt long, freq double")
    T.write_kmers(counts, str(tmp_path / "kmers"))
    assert [r.kmer for r in spark.read.csv(str(tmp_path / "kmers"), sep="\t", header=True).collect()] == ["AC", "AA"]
    T.write_reads(spark.createDataFrame([("ACGT",)], "seq string"), str(tmp_path / "r"), compress=True)
    assert spark.read.text(str(tmp_path / "r")).first().value == "ACGT"
    T.write_provenance(spark, str(tmp_path / "prov"))
    assert "command" in spark.read.text(str(tmp_path / "prov")).first().value


def test_lines_of_files_in_splits(spark, tmp_path):
    """Numbers go on over the splits of a file; records that a split cuts are whole."""
    body = "".join(f"@x{i} of any kind\n{'ACGT' * (i % 7 + 1)}\n+\n{'IIII' * (i % 7 + 1)}\n" for i in range(400))
    for name in ("a.fastq", "b.fastq"):
        (tmp_path / name).write_text(body)
    (tmp_path / "cut.fastq").write_text("@x\r\nAC\r\n+\r\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = R.read_fastq(spark, str(tmp_path / "[ab].fastq"), prefix=None)
        assert R.numbered_lines(spark, str(tmp_path / "a.fastq")).rdd.getNumPartitions() > 1
        got = {(r.sample, r.read_no): (r.header, r.seq, r.plus, r.qual) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert got == {(s, i): (f"@x{i} of any kind", "ACGT" * (i % 7 + 1), "+", "IIII" * (i % 7 + 1)) for s in "ab" for i in range(400)}
    assert [tuple(r)[2:] for r in R.read_fastq(spark, str(tmp_path / "cut.fastq"), prefix=None).collect()] == [(0, "@x", "AC", "+", "")]


def test_each_file_has_its_own_format(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ACGT\nGGGG\n")
    (tmp_path / "b.fastq").write_text("@HISEQ 1\nTTTT\n+\nIIII\n")
    rows = R.read(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.fastq")])
    assert sorted((r.sample, r.seq) for r in rows.collect()) == [("a", "ACGT"), ("a", "GGGG"), ("b", "TTTT")]
    assert sorted((r.sample, r.seq) for r in R.read(spark, str(tmp_path), lines=1).collect()) == [("a", "ACGT"), ("b", "TTTT")]


def test_demultiplexed_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "ACGT", "IIII", "@h1"), (2, "a", "GG", "JJ", "@h2"), (3, "b", "T", "K", "@h3"), (4, None, "CC", "LL", "@h4")], "read_no long, name string, region string, region_qual string, header string")
    T.write_samples(rows, str(tmp_path / "out"), least_bytes=4)
    got = {(r.path.split("/")[-3], r.path.split("/")[-2], r.header, r.seq, r.qual) for r in R.read_fastq(spark, str(tmp_path / "out/fastq"), prefix=None).collect()}
    assert got == {("size=whole", "name=a", "@h1", "ACGT", "IIII"), ("size=whole", "name=a", "@h2", "GG", "JJ"), ("size=small", "name=b", "@h3", "T", "K"), ("size=small", "name=unmatched", "@h4", "CC", "LL")}
    assert {r.seq for r in R.read_text(spark, str(tmp_path / "out/reads")).collect()} == {"ACGT", "GG", "T", "CC"}


def test_functions_of_users(spark):
    from seqloom.operators import extend

    rows = spark.createDataFrame([(f"s{i % 3}" if i % 5 else None, i, "ACGT"[: i % 4 + 1]) for i in range(200)], "sample string, read_no long, seq string").repartition(7)
    longest = lambda state, frame: max([state, *frame["seq"]], key=lambda s: (len(s), s))
    got = extend.aggregate_reads(rows, lambda: "", longest, max, lambda s: [(s,), (s.lower(),)], "longest string").collect()
    assert {(r.sample, r.longest) for r in got} == {(s, x) for s in ("s0", "s1", "s2", None) for x in ("ACGT", "acgt")} and len(got) == 8
    assert extend.aggregate_reads(rows.limit(0), lambda: "", longest, max, lambda s: [(s,)], "longest string").count() == 0
    counted = extend.map_files(rows.withColumn("path", F.lit("p")), lambda f: f[["path"]].iloc[:1].assign(n=len(f)), "path string, n long", slices=3)
    assert sorted(r.n for r in counted.collect()) == [66, 67, 67]


def test_layout_of_a_helix(spark):
    """Ends on the x axis, the farthest point above it, lengths and angles as they were."""
    rng = np.random.default_rng(5)
    for name in curvature.MODELS:
        s = "".join(rng.choice(list("ACGT"), 60))
        xyz = curvature.coordinates(s, curvature.Model.named(name))
        out = curvature.laid_out(xyz)
        axis = out[0] - out[0][0]
        assert np.allclose(axis[-1, 1:], 0, atol=1e-9) and axis[-1, 0] > 0
        far = np.linalg.norm(axis[:, 1:], axis=1).argmax()
        assert np.allclose(axis[far, 1], 0, atol=1e-9) and axis[far, 2] >= 0
        for k in range(3):
            assert np.allclose(np.linalg.norm(np.diff(out[k], axis=0), axis=1), np.linalg.norm(np.diff(xyz[k], axis=0), axis=1))
        assert np.allclose(curvature.curvature(out, 3.38), curvature.curvature(xyz, 3.38))
    long = spark.createDataFrame([(1, "ACGGT" * 600)], "read_no long, seq string")
    assert curvature.curved(long).count() == 3000


def test_a_model_of_too_many_rows_is_an_error(spark):
    from seqloom.operators import align

    rows = spark.range(1000).select(F.lit("A").alias("kmer"), (F.col("id") % 5).cast("int").alias("pos"), F.lit(0.1).alias("val"))
    with pytest.raises(ValueError, match="at most"):
        align.collected(rows, 5)


def test_curvature_in_pieces_is_that_of_the_whole(spark):
    """Borders anywhere, short last pieces, one base, and what is no base."""
    rng = random.Random(11)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in enumerate((10_000, 1, 2, 11, 40, 99, 100, 101, 123, 124, 125, 147, 148, 149, 259, 300))}
    seqs |= {50: "ACGNTTGA-CA" * 30, 51: "", 52: None, 53: "A" * 500}
    rows = spark.createDataFrame(list(seqs.items()), "read_no long, seq string")
    for piece, model in ((100, "trifonov"), (1000, "nucleosome")):
        want = {(r.id, r.pos): r for r in curvature.curved(rows, model=model).collect()}
        got = {(r.id, r.pos): r for r in curvature.curved_pieces(curvature.cut(rows, piece), piece, model=model).collect()}
        assert got.keys() == want.keys()
        for key, w in want.items():
            g = got[key]
            assert g.base == w.base and np.allclose(g[3:6], w[3:6], atol=1e-6), key
            if key[0] != 53 and len(seqs[key[0]]) > 11:  # a layout about a straight axis is free to turn
                assert np.allclose(g[6:], w[6:], atol=1e-4), key
    none = spark.createDataFrame([], "read_no long, seq string")
    assert curvature.curved_pieces(curvature.cut(none), 1 << 16).count() == 0


def test_pdb_columns_of_long_sequences(spark):
    """Serials and residues keep their columns beyond 99,999 and 9,999."""
    cases = [0, 9_998, 9_999, 49_999, 60_000, 1_000_000]
    rows = spark.createDataFrame([(1, p, "A", *[1.0] * 6) for p in cases], "id long, pos long, base string, " + ", ".join(f"{p}_{c} double" for p in ("p1", "p2") for c in "xyz"))
    lines = {(r.serial - 1) // 2: r.line for r in curvature.pdb_lines(rows).where("serial % 2 = 1").collect()}
    assert {len(x) for x in lines.values()} == {len(lines[0])} and all(x[30:38] == "   1.000" for x in lines.values())
    assert [lines[p][22:26] for p in cases[:3]] == ["   1", "9999", "A000"] and [lines[p][6:11] for p in cases[2:4]] == ["19999", "99999"]
    assert lines[60_000][6:11] == "A0FFL" and lines[60_000][22:26] == "B2KX"
    with pytest.raises(Exception, match="too many atoms"):
        curvature.pdb_lines(rows.withColumn("pos", F.lit(3_000_000))).collect()


def test_products_of_blocks():
    rng = np.random.default_rng(3)
    steps = np.array([curvature.turn(3.4, *rng.normal(size=3) * 30) for _ in range(37)])
    for n in (0, 1, 2, 9, 10, 37):
        got, now = curvature.suffix_products(steps[:n]), np.eye(4)
        for k in range(n - 1, -1, -1):
            now = now @ steps[k]
            assert np.allclose(got[k], now)
        assert len(got) == n
    assert np.allclose(curvature.inverse(steps[0]) @ steps[0], np.eye(4))


@pytest.mark.parametrize("split", ["64", "1m"])
def test_fasta_records_of_any_length(spark, tmp_path, split):
    """Records across splits, lines across pieces, headers alone, text before a first header."""
    rng = random.Random(2)
    seqs = {f"chr{k} x": "".join(rng.choice("ACGTN") for _ in range(n)) for k, n in enumerate((900, 0, 1, 61, 130, 333))}
    text = "acgt\r\nAC GT\r\n" + "".join(f">{name}\r\n" + "".join(s[i : i + 60].lower() + "\r\n" for i in range(0, len(s), 60)) for name, s in seqs.items())
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">only\n" + "ACGT" * 100)
    want = {("a.fa", n): s for n, s in seqs.items() if s} | {("a.fa", None): "ACGTACGT", ("b.fa", "only"): "ACGT" * 100}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for piece, overlap in ((50, 0), (50, 7), (64, 100), (10_000, 3)):
            got = {}
            for r in R.read_fasta(spark, str(tmp_path / "*.fa"), piece=piece, overlap=overlap).collect():
                got.setdefault((r.path.rsplit("/", 1)[1], r.name), {})[r.offset] = r.seq
            assert got.keys() == want.keys()
            for key, s in want.items():
                assert got[key] == {o: s[o : o + piece + overlap] for o in range(0, len(s), piece)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_helices_side_by_side_are_those_of_each_alone(spark):
    """Values of a batch of any lengths, whole and in pieces, against each sequence by itself; digits; PDB lines
    against the column expressions."""
    rng = random.Random(4)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in enumerate((*range(1, 40), 147, 147, 150, 1000, 1300))}
    seqs |= {90: "AACGTT", 91: "", 92: None, 93: "CCNNGAxTTAC" * 20}
    rows = spark.createDataFrame(list(seqs.items()), "read_no long, seq string")
    for name in ("trifonov", "nucleosome"):
        model = curvature.Model.named(name)
        got = {}
        for r in curvature.curved(rows, model=name, columns=curvature.BENDS, digits=5).collect():
            got.setdefault(r.id, []).append(r)
        sums = {r.id: r for r in curvature.bend_sums(curvature.cut(rows, 100), 100, model=name, digits=5).collect()}
        whole = {r.id: r for r in curvature.extents(rows, model=name).collect()}
        parts = {r.id: r for r in curvature.extents_of_pieces(curvature.cut(rows, 100), 100, model=name).collect()}
        assert got.keys() == sums.keys() == whole.keys() == parts.keys() == seqs.keys() - {91, 92}
        for k, found in got.items():
            s = "".join(c for c in seqs[k].upper() if c in "ACGT")
            xyz = curvature.coordinates(s, model)
            want = curvature.curvature(xyz, model.rise)
            found.sort(key=lambda r: r.pos)
            assert "".join(r.base for r in found) == s and np.allclose(np.array([r[3:] for r in found]).T, want, atol=6e-6)
            assert np.allclose(sums[k][1:], [len(s), want[0].max(), want[1].sum(), want[2].max()], atol=6e-6 * len(s))
            out = curvature.laid_out(xyz)[0]
            for extent in (whole[k], parts[k]):
                assert extent.bases == len(s) and np.allclose(extent[2:], out.max(0) - out.min(0), atol=1e-6), (k, extent)
    lines = lambda df: {(r.id, r.serial): r.line for r in df.collect()}
    got, want = lines(curvature.pdb_records(rows)), lines(curvature.pdb_lines(curvature.curved(rows)))
    assert got == want and {len(x) for (k, _), x in got.items() if len(seqs[k]) < 300} == {78} and max(map(len, got.values())) > 78
    numbers = np.array([0, 7, 9999, 10000, 60001, 9999 + 26 * 36**3])
    held = spark.createDataFrame([(int(k),) for k in numbers], "n long").select(curvature.hybrid36(F.col("n"), 4).alias("t")).collect()
    assert [bytes(x).decode() for x in curvature.numbers36(numbers, 4)] == [r.t for r in held]
    texts, fit = curvature.decimals(np.array([-0.0004, 0.0, 12.3456, -999.999, 9999.999, -1000.0, 1e4, np.inf]))
    assert [bytes(x).decode() for x in texts[:5]] == ["  -0.000", "   0.000", "  12.346", "-999.999", "9999.999"] and fit.tolist() == [True] * 5 + [False] * 3


def test_extents_are_the_sql_s_bit_by_bit(spark):
    """Also of straight axes, two bases, whose direction across is what rounding leaves: the SQL's formulas make
    3.379 of some. Otherwise these have no extent across."""
    import duckdb

    from seqloom.plans import rest

    rows = [(k, s) for k, s in enumerate([*(a + b for a in "ACGT" for b in "ACGT"), "A", "ACG", "AATT", "ACGGT" * 30])]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE held AS SELECT * FROM {rest.X.values(rows)} t(id, seq)")
    want = con.execute(rest.extents("q AS (SELECT * FROM held)")).fetchall()
    df = spark.createDataFrame(rows, "read_no long, seq string")
    assert sorted(want) == sorted(map(tuple, curvature.extents(df, digits=5, as_found=True).collect()))
    assert any(r[4] > 1 for r in want if r[1] == 2) and all(r.y == r.z == 0 for r in curvature.extents(df, digits=5).collect() if r.bases == 2)
