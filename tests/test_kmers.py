from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import compare, dedup, kmers


def reads_of(spark, seqs, sample="s"):
    return spark.createDataFrame([(sample, i, s) for i, s in enumerate(seqs)], "sample string, read_no long, seq string")


def table(df, key="kmer", value="cnt"):
    return {r[key]: r[value] for r in df.collect()}


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_hand_computed(spark):
    reads = reads_of(spark, ["AAAA", "ACGTN", None, "", "A"])
    assert table(kmers.count(reads, 2)) == {"AA": 3, "AC": 1, "CG": 1, "GT": 1}
    assert table(kmers.count(reads, 2, per_read=True))["AA"] == 1
    assert table(kmers.count(reads, 2, both_strands=True)) == {"AA": 3, "TT": 3, "AC": 2, "GT": 2, "CG": 2}
    with pytest.raises(ValueError):
        kmers.count(reads, 2, per_read=True, both_strands=True)
    counts = spark.createDataFrame([("s", "AC", 3), ("s", "GT", 2), ("s", "AT", 4)], "sample string, kmer string, cnt long")
    binned = kmers.bin_strands(counts)
    assert table(binned) == {"AC": 5, "AT": 8}
    assert abs(sum(table(kmers.with_frequency(binned), value="freq").values()) - 1) < 1e-12
    legacy = table(kmers.with_frequency(binned, legacy_palindromes=True), value="freq")
    assert legacy["AC"] == 5 / (3 + 2 + 4 + 8)
    only = spark.createDataFrame([("s", "GT", 2)], "sample string, kmer string, cnt long")
    assert table(kmers.bin_strands(only)) == {"GT": 2}
    assert [r.ori for r in kmers.origins(reads, 2).where("kmer = 'AA'").collect()] == [[0, 0, 0]]
    assert kmers.occurrences(reads, 2).where("kmer = 'AA'").count() == 3
    with pytest.raises(ValueError, match="3 occurrences"):
        kmers.origins(reads, 2, most=2)


def test_sequence_functions(spark):
    assert one(spark, S.revcomp(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, S.revcomp_iupac(F.lit("ARYN"))) == "NRYT"
    assert one(spark, S.overlapping(F.lit("AAAAA"), F.lit("AA"))) == [0, 1, 2, 3]
    assert one(spark, S.non_overlapping(F.lit("AAAAA"), "AA")) == [0, 2]
    assert sorted(one(spark, S.iupac_expand(F.lit("AR")))) == ["AA", "AG"]
    assert one(spark, S.iupac_expand(F.lit(""))) == [] and one(spark, S.iupac_expand(F.lit("AX"))) is None
    assert one(spark, S.pad_end(F.lit("ACG"), 5)) == "ACGNN" and one(spark, S.pad_end(F.lit("ACGTA"), 3)) == "ACGTA"
    assert one(spark, S.shift(F.lit("AC"), F.lit(1), 3)) == "NNACN"
    assert one(spark, S.well(F.lit("A01 P12"))) == "A1 P12"
    assert [one(spark, p) for p in S.path_parts(F.lit("/a.b/c/d.tar.gz"))] == ["/a.b/c/", "d.tar", ".gz"]
    assert [one(spark, p) for p in S.path_parts(F.lit("plain"))] == ["", "plain", ""]
    assert one(spark, S.trimmed(F.lit("\t a b \t"))) == "a b"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGTN", max_size=30), max_size=6), st.integers(1, 4))
def test_counts_against_plain_python(spark, seqs, k):
    want = Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1) if "N" not in s[i : i + k])
    got = table(kmers.count(reads_of(spark, seqs), k))
    assert got == want
    for s in seqs:
        flipped = one(spark, S.revcomp(S.revcomp(F.lit(s))))
        assert flipped == s


def test_bias_correction_and_bases(spark):
    reads = reads_of(spark, ["AACC", "ACGT"])
    bases = {r.base: r.freq for r in kmers.base_frequencies(reads).collect()}
    assert bases == {"A": 3 / 8, "C": 3 / 8, "G": 1 / 8, "T": 1 / 8}
    got = table(kmers.bias_corrected(kmers.count(reads, 2), kmers.base_frequencies(reads), 2))
    assert abs(got["AC"] - 2 / (16 * bases["A"] * bases["C"])) < 1e-12


def test_universe_and_unique_oligos(spark):
    assert [r.kmer for r in kmers.universe(spark, 2).orderBy("kmer").collect()] == [a + b for a in "ACGT" for b in "ACGT"]
    assert {r.kmer for r in kmers.unique_oligos(spark, 2).collect()} == set("AA AG AC AT GA GG GC CA CG TA".split())


def test_cutting(spark):
    reads = reads_of(spark, ["A" * 45 + "C" * 45, "short", "   "])
    parts = {r.piece: r.part for r in kmers.cut(reads, 40).collect()}
    assert parts == {0: "A" * 40, 1: "A" * 5 + "C" * 35, 2: "C" * 40}
    assert [r.part for r in kmers.cut(reads, 40, pieces="last").collect()] == ["C" * 40]


def test_comparisons(spark):
    counts = spark.createDataFrame([("AA", 10), ("AC", 30)], "kmer string, cnt long")
    same = compare.log_fc(counts, counts).collect()
    assert all(abs(r.log_fc) < 1e-12 for r in same)
    far = {r.kmer: r.log_fc for r in compare.log_fc(counts, spark.createDataFrame([("AA", 40)], "kmer string, cnt long"), low_count=10).collect()}
    assert far["AC"] > 0 > far["AA"]
    sig = counts.withColumn("sample", F.lit("x"))
    universe = counts.select("kmer")
    info = compare.information(sig, counts, universe, k=2, pseudo=0.0, prefill=False).first().info
    assert abs(info) < 1e-12
    a, b = (spark.createDataFrame(rows, "kmer string, pos int, val long") for rows in ([("A", 0, 5)], [("A", 0, 2), ("C", 1, 3)]))
    assert {(r.kmer, r.pos): r.val for r in compare.merged(a, b).collect()} == {("A", 0): 7, ("C", 1): 3}
    assert {(r.kmer, r.pos): r.val for r in compare.merged(a, b, mode="subtract").collect()} == {("A", 0): 3, ("C", 1): -3}
    assert {(r.kmer, r.pos): r.val for r in compare.merged(a, b, mode="replace").collect()} == {("A", 0): 2, ("C", 1): 3}
    with pytest.raises(ValueError):
        compare.merged(a, b, mode="times")


def greedy(seqs, width=20):
    kept, anchors = [], set()
    for s in sorted(set(seqs)):
        w = min(len(s), width)
        last = len(s) - w
        if w and any(s[i : i + w] in anchors for i in range(last + 1)):
            continue
        kept.append(s)
        anchors |= {s[i : i + w] for i in (0, (last + 1) // 2, last)} if w else set()
    return kept


def test_three_anchor_deduplication(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(12)]
    seqs = base + [b[:20] + "".join(rng.choice("ACGT") for _ in range(40)) for b in base] + [b[7:] + "ACGTACG" for b in base] + [base[0], ""]
    got = dedup.three_anchor(reads_of(spark, seqs))
    assert sorted(r.seq for r in got.collect()) == greedy(seqs)
    again = dedup.three_anchor(got)
    assert again.count() == got.count()
    assert dedup.three_anchor(reads_of(spark, seqs), strict=True).count() <= got.count()
    assert dedup.three_anchor(reads_of(spark, [])).count() == 0
    first = dedup.exact(reads_of(spark, ["AC", "AC", "GT"])).collect()
    assert sorted((r.seq, r.read_no) for r in first) == [("AC", 0), ("GT", 2)]


def test_an_anchor_that_most_reads_share(spark):
    """Nothing grows with the square of the reads that share it."""
    rows = spark.range(4000).select(F.lit("s").alias("sample"), F.col("id").alias("read_no"), F.concat(F.lit("ACGTACGTACGTACGTACGT"), F.translate(F.hex(F.xxhash64("id")), "0123456789ABCDEF", "ACGTACGTACGTACGT"), F.translate(F.hex(F.xxhash64("id", F.lit(1))), "0123456789ABCDEF", "CATGACGTGCATACGT")).alias("seq"))
    got = dedup.three_anchor(rows).collect()
    assert [r.seq for r in got] == [rows.agg(F.min("seq")).first()[0]]
    assert dedup.holdings(rows.select(F.col("read_no").alias("id"), "seq")).count() < 2 * 4000
    got = dedup.three_anchor(rows, bound=1000, early=0).collect()
    assert [r.seq for r in got] == [rows.agg(F.min("seq")).first()[0]]


def plain_three_anchor(seqs, width):
    kept, anchors = [], set()
    for s in sorted(set(seqs)):
        w = min(len(s), width)
        last = len(s) - w
        if not s or anchors.isdisjoint(s[i : i + w] for i in range(last + 1)):
            kept.append(s)
            if s:
                anchors |= {s[i : i + w] for i in (0, (last + 1) // 2, last)}
    return kept


@pytest.mark.parametrize("early, bound, held", [(1000, 1, 1), (1000, 1, 20_000), (0, 10**6, 20_000), (0, 60, 3), (1, 25, 20_000), (0, 1, 2)])
def test_three_anchor_rule_by_rounds_and_by_groups(spark, monkeypatch, early, bound, held):
    """Rounds alone, whole groups, blocks of groups of a size; anchors of many parts; short reads."""
    import random

    rng = random.Random(7)
    seqs = ["".join(rng.choice("ACG") for _ in range(rng.choice([0, 2, 4, 9, 9, 12, 20]))) for _ in range(120)] + ["", ""]
    monkeypatch.setattr(dedup, "HELD", held)
    got = [r.seq for r in dedup.three_anchor(reads_of(spark, seqs), width=4, early=early, bound=bound).collect()]
    want = plain_three_anchor(seqs, 4)
    assert sorted(got) == want and 5 < len(want) < len(set(seqs))


def test_a_long_chain_takes_few_rounds(spark):
    """Each read is hit by the one before it: rounds alone would decide two reads each."""
    chain = [f"{'ACGT'[k // 64]}{'ACGT'[k // 16 % 4]}{'ACGT'[k // 4 % 4]}{'ACGT'[k % 4]}" for k in range(200)]
    seqs = [a + b for a, b in zip(chain, chain[1:])]
    want = plain_three_anchor(seqs, 4)
    assert 20 < len(want) < len(seqs)
    got = dedup.three_anchor(reads_of(spark, seqs), width=4, early=0, bound=10**6, rounds=2)
    assert sorted(r.seq for r in got.collect()) == want
    blocks = dedup.three_anchor(reads_of(spark, seqs), width=4, early=0, bound=250, rounds=12)
    assert sorted(r.seq for r in blocks.collect()) == want


def test_three_anchor_never_returns_a_part(spark):
    chain = ["".join(x) for x in zip("ACGTACGTAC", "CGTACGTACG", "GTACGTACGT", "TACGTACGTA", "ACGTACGTAA")]
    with pytest.raises(RuntimeError):
        dedup.three_anchor(reads_of(spark, chain * 2 + ["ACGTA", "CGTAC"]), width=2, early=9, rounds=1)
