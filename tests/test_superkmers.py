import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.operators import genome, kmers, packed, superkmers
from seqloom.sources import reads as R


def plain(rows, k):
    return Counter((s, t[i : i + k]) for s, t in rows if t for i in range(len(t) - k + 1) if set(t[i : i + k]) <= set("ACGT"))


def some(seed, alphabet="ACGTN", n=60):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 20, 21, 22, 31, 90]))) for _ in range(n)]
    return [(rng.choice(["a", "b", None]), t) for t in texts + texts[:9]] + [("a", None), ("a", "A" * 100), ("a", "ACACACACAC" * 9)]


@pytest.mark.parametrize("k, m", [(1, None), (5, None), (21, None), (21, 4), (31, None), (12, 12)])
def test_against_brute_force(spark, monkeypatch, k, m):
    rows = some(k, "ACGT" * 9 + "N")
    df = spark.createDataFrame(rows, "sample string, seq string").repartition(3)
    for held in (10**6, 3):
        got = {(r.sample, r.kmer): r.cnt for r in superkmers.count(df, k, m=m, held=held).collect()}
        assert got == plain(rows, k)


def test_runs_hold_each_kmer_once_and_share_their_minimiser():
    code, starts = superkmers.letters(pa.array(["ACGTTGCATGCCGATAGCTAGCATCGATCGACTAGCATCGACATGCAT" * 3, None, "NNACGT", "ACGTNACGTTACG"]))
    for k, m in ((7, 3), (11, 5)):
        begin, bucket, packed, length = superkmers.runs(code, k, m)
        assert (length <= superkmers.RUN).all() and (length >= k).all()
        number, owner = superkmers.taken_apart(packed, length, k)
        text = "".join("ACGTN"[c] for c in code)
        assert sorted(superkmers.spelled(number, k).to_pylist()) == sorted(text[i : i + k] for i in range(len(text) - k + 1) if "N" not in text[i : i + k])
        of = {}
        for kmer, o in zip(number.tolist(), owner):
            assert of.setdefault(kmer, bucket[o]) == bucket[o]  # equal k-mers meet
        assert len(begin) < 0.6 * len(number)
    with pytest.raises(ValueError):
        superkmers.count(None, 32)


def test_empty(spark):
    assert superkmers.count(spark.createDataFrame([], "sample string, seq string"), 21).count() == 0


def test_bitmaps_of_origins(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([2, 8, 30]))) for _ in range(90)]
    rows = [("ab"[k % 2], 700 * k, t) for k, t in enumerate(texts)] + [("a", 70_000, None)]
    df = spark.createDataFrame(rows, "sample string, read_no long, seq string").repartition(4)
    want = {(s, t[i : i + 3], n) for s, n, t in rows if t for i in range(len(t) - 2) if "N" not in t[i : i + 3]}
    bits = kmers.origin_bitmaps(df, 3)
    assert {tuple(r) for r in kmers.bitmap_numbers(bits).select("sample", "kmer", "read_no").collect()} == want
    assert {(r.sample, r.kmer): r.reads for r in kmers.bitmap_counts(bits).collect()} == Counter((s, k) for s, k, _ in want)
    dense = R.densely_numbered(df)
    assert [(r.read_no, r.seq) for r in dense.orderBy("read_no").collect()] == [(k, t) for k, t in enumerate([*texts, None])]
    assert kmers.origin_bitmaps(dense, 3).select(F.max("bucket")).first()[0] == 0 and np.log2(kmers.BITMAP) == 15


def test_duplicate_pairs(spark):
    schema = "name string, mate int, chrom int, start long, end long, strand string, mapq int, quality long"
    rows = [
        ("a", 1, 1, 100, 150, "+", 9, 30), ("a", 2, 1, 300, 350, "-", 9, 30),
        ("b", 1, 1, 300, 350, "-", 9, 40), ("b", 2, 1, 100, 155, "+", 9, 30),  # mates the other way round, another length
        ("c", 1, 1, 100, 150, "+", 9, 90), ("c", 2, 1, 300, 350, "+", 9, 90),  # another strand
        ("d", 0, 1, 100, 150, "+", 9, 99),  # no mate: held against none of them
        ("e", 0, 1, 90, 150, "-", 9, 10), ("f", 0, 1, 120, 150, "-", 9, 10),  # one 5' end
        ("g", 1, 1, 100, 150, "+", 9, 35), ("g", 2, 1, 300, 350, "-", 9, 35),
    ]
    got = genome.without_duplicate_pairs(spark.createDataFrame(rows, schema)).collect()
    assert sorted({r.name for r in got}) == ["b", "c", "d", "e"] and len(got) == 6
    assert genome.without_duplicate_pairs(spark.createDataFrame([], schema)).count() == 0


def test_hot_buckets_pass_arrays_on_and_are_summed_in_parts(spark, monkeypatch):
    rows = some(7, "ACGT" * 9 + "N", 200)
    df = spark.createDataFrame(rows, "sample string, seq string").repartition(3)
    for apart, array in ((5, 3), (1 << 18, 4096)):
        monkeypatch.setattr(superkmers, "APART", apart)
        monkeypatch.setattr(superkmers, "ARRAY", array)
        runs = superkmers.cut(df, 9, 5).cache()
        for most in (10**6, 50):
            got = {(r.by, superkmers.spelled(np.array([r.kmer]), 9)[0].as_py()): r.cnt for r in superkmers.merged(runs, 9, 4000, most=most).collect()}
            assert got == plain(rows, 9)
    plan = superkmers.count(df, 9, m=5, held=2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(by" not in plan  # no k-mer is a row of a shuffle


def test_runs_travel_as_blocks(spark, monkeypatch):
    """Equal runs of a task once, many of them a row, however often tasks hand theirs on."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT" * 20 + "N") for _ in range(147)) for _ in range(40)]
    rows = [(s, t) for t in texts for s in ("a", None, "b")] * 15
    df = spark.createDataFrame(rows, "sample string, seq string")
    found = superkmers.blocks(df.coalesce(1), 21, 11).collect()
    assert len({r.part for r in found}) == len(found) and all(sum(r.sizes) == r.runs for r in found)
    code, _ = superkmers.letters(pa.array(texts))
    _, _, bases, length = superkmers.runs(code, 21, 11)
    assert sum(r.runs for r in found) == 3 * len(set(zip(bases.tolist(), length.tolist())))
    assert sum(r.kmers for r in found) == sum(plain(rows, 21).values())
    for chunk, at_once in ((superkmers.CHUNK, superkmers.AT_ONCE), (2000, 7)):
        monkeypatch.setattr(superkmers, "CHUNK", chunk)
        monkeypatch.setattr(superkmers, "AT_ONCE", at_once)
        counts = superkmers.count(df.repartition(3), 21, m=11)
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "block" in plan and "packed" not in plan  # no run is a row of a shuffle
        assert {(r.sample, r.kmer): r.cnt for r in counts.collect()} == plain(rows, 21)


def test_numbers_as_few_bytes():
    rng = np.random.default_rng(1)
    up, small = np.sort(rng.integers(-(2**62), 2**62, 5000)), rng.integers(0, 9, 77).astype(np.int32)
    data = packed.squeezed(packed.steps(up), small)
    got, other = packed.opened(data, (np.int64, 5000), (np.int32, 77))
    assert (np.cumsum(got) == up).all() and (other == small).all() and len(data) < 8 * 5000
    none = packed.squeezed(up[:0], small[:0])
    assert [len(x) for x in packed.opened(none, (np.int64, 0), (np.int32, 0))] == [0, 0]
