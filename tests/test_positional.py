from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import adm, align, kmers, spectral
from seqloom.plans import rest
from seqloom.sources import fixtures


def profile(spark, values, kmer="A"):
    return spark.createDataFrame([("s", kmer, i, float(v)) for i, v in enumerate(values)], "sample string, kmer string, pos int, val double")


def test_position_matrices(spark):
    reads = spark.createDataFrame([("s", 0, "ACGN"), ("s", 1, "AAG")], "sample string, read_no long, seq string")
    got = {(r.kmer, r.pos): r.val for r in adm.position_counts(reads, (1, 2)).collect()}
    assert got == {("A", 0): 2, ("C", 1): 1, ("A", 1): 1, ("G", 2): 2, ("AC", 0): 1, ("CG", 1): 1, ("AA", 0): 1, ("AG", 1): 1}
    full = adm.zero_filled(adm.position_counts(reads, (1,)), kmers.universe(spark, 1), 4)
    assert full.count() == 16 and full.agg(F.sum("val")).first()[0] == 6
    wide = adm.wide(full)
    assert {r.kmer: r.vals for r in wide.collect()}["A"] == [2, 1, 0, 0]
    back = adm.long(wide)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, full.collect()))
    flat = adm.normalised(profile(spark, [0, 0]))
    assert [r.val for r in flat.collect()] == [0.0, 0.0]
    freq = adm.to_frequency(adm.position_counts(reads, (1,)), at=2)
    assert {(r.kmer, r.pos): r.val for r in freq.collect()}[("A", 1)] == 0.5


def test_round_trip_is_the_whole_matrix(spark, tmp_path):
    """All bases and positions, what was not seen as 0, also of texts without a source."""
    schema = "doc_id long, text string, lang string, source string"
    docs = [(1, "AB" * 100, "en", "src0"), (2, "TTTF", "de", None), (3, None, "en", "src1"), (4, "C!", None, "src2")]
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = rest.array_table_roundtrip(spark, str(tmp_path))
    rows = {(r.sample, r.kmer, r.pos): r.val for r in got.collect()}
    assert got.count() == len(rows) == 3 * 4 * 147 and {s for s, _, _ in rows} == {"src0", None, "src2"}
    want = Counter((s, b, i % 147) for _, t, _, s in docs if t for i, b in enumerate(t.replace("!", "").translate(str.maketrans(fixtures.LETTERS, fixtures.AS_BASES))) if b != "N")
    assert {k: v for k, v in rows.items() if v} == want and 0.0 in rows.values()


def test_background(spark):
    sig, bk = profile(spark, [10, 12, 14]).drop("sample"), profile(spark, [5, 6, 10]).drop("sample")
    plain = {r.pos: r.val for r in adm.background_removed(sig, bk, at=0).collect()}
    assert plain == {0: 0.0, 1: 0.0, 2: -6.0}
    kept = {r.pos: r.val for r in adm.background_removed(sig, bk, at=0, keep_mean=True).collect()}
    assert abs(sum(kept.values()) / 3 - 12) < 1e-12


def test_comb_peaks_at_a_tenth(spark):
    comb = [int(i % 10 == 0) for i in range(141)]
    rows = spectral.dft_profile(profile(spark, comb)).where("h between 100 and 300").collect()
    assert max(rows, key=lambda r: r.power).h == 200


def test_dft_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random(40) + 1
    got = {r.h: r for r in spectral.dft_profile(profile(spark, x, "AC"), kind="welch").collect()}
    y = x[:-1]
    n = len(y)
    z = (y - y.mean()) * (1 - ((np.arange(n) - (n - 1) / 2) / ((n - 1) / 2)) ** 2)
    for h in (0, 7, 196, 599):
        c = (z * np.exp(-2j * spectral.PI * h * np.arange(n) / 2000)).sum()
        assert abs(got[h].power - abs(c) / (y.mean() * 5.1 * n / 10.2)) < 1e-9
    peak = spectral.peaks(spectral.dft_profile(profile(spark, x))).first()
    assert 0 < peak.pct < 1 and peak.area > 0
    padded = spectral.padded_dft(profile(spark, x)).collect()
    want = np.abs(np.fft.rfft(np.pad(x[5:-5] - x[5:-5].mean(), (0, 2)))) / (x[5:-5].mean() * 5.1 * 30 / 10.2)
    assert np.allclose([r.power for r in sorted(padded, key=lambda r: r.h)], want, atol=1e-3) and max(r.freq for r in padded) == 0.5


def test_single_reads(spark):
    seqs = ["TATACG" * 5, "GGGGGG" * 5]
    reads = spark.createDataFrame([("s", i, s) for i, s in enumerate(seqs)], "sample string, read_no long, seq string")
    got = {(r.kmer, r.h): r.power for r in spectral.read_fft_sums(reads, ["TA"]).collect()}
    x = np.zeros(29)
    x[[i for i in range(29) if seqs[0][i : i + 2] == "TA"]] = 1
    assert np.allclose([got["TA", h] for h in range(29)], np.abs(np.fft.fft(x)))
    hits = spark.createDataFrame([([0, 10, 20],), ([],)], "p array<int>")
    powers = [r.power for r in spectral.read_power(hits, 29, centred=False).collect()]
    assert abs(powers[0] - abs(np.exp(-2j * spectral.PI * 196 * np.array([0, 10, 20]) / 2000).sum())) < 1e-9 and powers[1] == 0


def plain_best(read, mono, di, m):
    best = None
    for o in range(len(read) - m + 1):
        part = read[o : o + m]
        if "N" in part:
            continue
        s = round(mono[part[0], 0] + sum(di[part[j : j + 2], j] for j in range(m - 1)), 6)
        if best is None or s > best[1]:
            best = (o, s)
    return best


def test_alignment_against_plain_python(spark):
    rng = np.random.default_rng(3)
    m, length = 10, 16
    mono = {(b, p): -float(rng.random()) for b in "ACGT" for p in range(m)}
    di = {(a + b, p): -float(rng.random()) for a in "ACGT" for b in "ACGT" for p in range(m - 1)}
    model = spark.createDataFrame([(k, p, v) for (k, p), v in (mono | di).items()], "kmer string, pos int, val double")
    seqs = ["".join(rng.choice(list("ACGTN"), length, p=[0.24] * 4 + [0.04])) for _ in range(40)] + ["N" * length, "ACG"]
    reads = spark.createDataFrame([("s", i, s) for i, s in enumerate(seqs)], "sample string, read_no long, seq string")
    got = {r.read_no: (r.offset, r.score) for r in align.best_offset(reads, model, length=m).collect()}
    want = {i: plain_best(s, mono, di, m) for i, s in enumerate(seqs) if len(s) >= m}
    assert {i: w[0] for i, w in want.items() if w} == {i: g[0] for i, g in got.items()}
    shifted = align.shifted(align.best_offset(reads, model, length=m), length=m).collect()
    assert all(len(r.seq) == 2 * length - m and r.seq[length - m + 0 :][: m + r.offset] for r in shifted)
    counts = align.leave_window_out(reads, model, length=m).collect()
    assert {r.pos for r in counts} == set(range(2, m - 2)) and sum(r.val for r in counts if r.pos == 2) == len(got)


def test_non_overlapping_hits_of_many_reads_at_once():
    rng = np.random.default_rng(0)
    text = np.frombuffer(b"ACAT", np.uint8)[rng.integers(0, 4, (60, 40))]
    for key in (b"A", b"AA", b"ACA", b"CAT", b"AAAA", b"ACACAC", b"A" * 41):
        hit = spectral.own_hits(text, key)
        for row, marks in zip(text, hit):
            line, want, at = row.tobytes(), [], 0
            while (at := line.find(key, at)) >= 0:
                want.append(at)
                at += len(key)
            assert np.flatnonzero(marks).tolist() == want


def test_position_counts_of_tables_are_those_of_rows(spark, monkeypatch):
    """Any lengths, letters and groups, null ones too, tables that fill up, against windows as rows."""
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "acgtN", "ACÜGT", "AC*GT", "ACGTN" * 1000]
    rows = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([True, False, None]), t) for t in texts], "sample string, en boolean, seq string").repartition(3)
    for cells, by, ks in ((adm.CELLS, ("sample",), (1, 2)), (1, ("en", "sample"), (3,)), (adm.CELLS, (), (2, 4))):
        monkeypatch.setattr(adm, "CELLS", cells)
        got = adm.position_counts(rows, ks, by=by)
        plan = got._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
        monkeypatch.setattr(adm, "TABLED", 0)
        want = adm.position_counts(rows, ks, by=by)
        monkeypatch.setattr(adm, "TABLED", 4)
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_terms_position_by_position():
    """Totals and sums before each position against single look-ups; no array of reads x offsets x positions
    unless sums are asked for."""
    rng = np.random.default_rng(8)
    model = align.Model([(a + b, p, float(rng.normal())) for p in range(9) for a in "ACGT" for b in "ACGT"] + [(a, 0, float(rng.normal())) for a in "ACGT"], 10)
    reads = rng.choice(np.frombuffer(b"ACGTN", np.uint8), (20, 25), p=[0.24] * 4 + [0.04])
    total, none, bad = model.terms(reads)
    same, before, _ = model.terms(reads, sums=True)
    assert none is None and before.shape == (10, 20, 16) and (total == same).all()
    for r, read in enumerate(reads):
        for o in range(16):
            window = align.CODE[read[o : o + 10]]
            assert bad[r, o] == (window == 4).any()
            if not bad[r, o]:
                terms = [model.di[p, 4 * window[p] + window[p + 1]] for p in range(9)]
                assert np.allclose(before[:, r, o], np.cumsum([0, *terms])) and np.isclose(total[r, o], model.mono[0, window[0]] + sum(terms))
