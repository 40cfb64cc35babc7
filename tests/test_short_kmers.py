"""Short k-mers as numbers in the tasks: the same as windows that are rows, and no window is a row."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import dimers, kmers


@pytest.fixture
def odd_reads(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT" * 8 + "N") for _ in range(rng.choice([0, 1, 3, 5, 40, 147]))) for _ in range(150)]
    texts += ["acgtACGT", "ACGRYACGTA", "A\nCGTA", "ACGé日ACGTTACGT", "NNNN", "AAAAAAAA", None, ""]
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), k if k % 40 else None, t) for k, t in enumerate(texts + texts[:30])]
    return spark.createDataFrame(rows, "sample string, part int, read_no long, seq string").repartition(3)


def both(monkeypatch, make, limit="TABLED"):
    """What it makes as now, and by exploded windows."""
    new = make()
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(repr, new.collect()))
    with monkeypatch.context() as m:
        m.setattr(kmers, limit, 0)
        want = sorted(map(repr, make().collect()))
    assert got == want and got
    assert "Generate" not in plan


@pytest.mark.parametrize("by", [("sample",), (), ("part", "sample")])
def test_counts(odd_reads, monkeypatch, by):
    for options in ({}, {"per_read": True}, {"both_strands": True}):
        both(monkeypatch, lambda: kmers.count(odd_reads, 3, by=by, **options))
    monkeypatch.setattr(kmers, "CELLS", 100)  # tables that go on early
    monkeypatch.setattr(kmers, "LETTERS", 300)
    both(monkeypatch, lambda: kmers.count(odd_reads, 4, by=by))


def test_origins(odd_reads, monkeypatch):
    monkeypatch.setattr(kmers, "LETTERS", 300)
    for by in (("sample",), ()):
        both(monkeypatch, lambda: kmers.origins(odd_reads, 2, by=by))


def test_origins_travel_as_blocks(spark, odd_reads, monkeypatch):
    """Lists of many k-mers a row, squeezed, whatever the numbers' order, and put together again in slices."""
    far = odd_reads.withColumn("read_no", F.when(F.col("read_no") % 5 == 0, -F.col("read_no") * 2**55).otherwise(F.pmod(F.col("read_no") * 7919, F.lit(1000)) * 2**24))
    for span, together, listed in ((1 << 21, 1 << 21, 1 << 20), (300, 40, 3)):
        monkeypatch.setattr(kmers, "LETTERS", 200)
        monkeypatch.setattr(kmers, "SPAN", span)
        monkeypatch.setattr(kmers, "TOGETHER", together)
        monkeypatch.setattr(kmers, "LISTED", listed)
        for by in (("part", "sample"), ()):
            both(monkeypatch, lambda: kmers.origins(far, 3, by=by))
            both(monkeypatch, lambda: kmers.origins(far, 3, by=by, sep=";"))
    rows = [("a", 2**24 * (k // 8) + k % 8, "ACGTTGCA" * 18) for k in range(4000)]
    reads = spark.createDataFrame(rows, "sample string, read_no long, seq string").coalesce(1)
    blocks = reads.mapInArrow(kmers.in_blocks(("sample",), 3, 64), "sample string, _part int, _word string, _kmers int, _numbers int, _block binary")
    found = blocks.agg(F.count("*"), F.sum("_numbers"), F.sum(F.octet_length("_block"))).first()
    assert found[0] < 10 and found[1] == 4000 * 142 and found[2] < found[1]  # under a byte a number, which took 8
    assert "_block" in kmers.origins(reads, 3)._jdf.queryExecution().optimizedPlan().toString()


def test_bitmaps(odd_reads, monkeypatch):
    far = odd_reads.withColumn("read_no", F.col("read_no") * 1001)
    monkeypatch.setattr(kmers, "LETTERS", 300)
    monkeypatch.setattr(kmers, "OPEN", 300_000)
    for by in (("sample",), ()):
        both(monkeypatch, lambda: kmers.origin_bitmaps(far, 2, by=by), "MAPPED")
    bits = kmers.origin_bitmaps(far, 2)
    numbers = kmers.bitmap_numbers(bits).groupBy("sample", "kmer").agg(F.min("read_no").alias("first"), F.max("read_no").alias("last"), F.sum("read_no").alias("total"))
    assert sorted(map(repr, kmers.bitmap_spans(bits).collect())) == sorted(map(repr, numbers.collect()))


def test_counts_around(odd_reads, monkeypatch):
    dist = F.when(F.col("read_no") % 7 > 0, F.col("read_no") % 9 + F.col("part") / 2)
    rows = odd_reads.select(F.col("sample").alias("name"), F.when(F.col("part") == 1, "ori").otherwise("rc").alias("min_dir"), dist.alias("min_dist"), "seq")
    both(monkeypatch, lambda: dimers.counts_around(rows, 3))


def test_keys_that_are_not_plain(odd_reads):
    rows = odd_reads.withColumn("span", F.struct("sample", "part"))
    for make in (kmers.count, kmers.origins, kmers.origin_bitmaps):
        got = make(rows.where("read_no is not null"), 2, by=("span",)).select("span.*", "kmer").collect()
        want = make(rows.where("read_no is not null"), 2, by=("sample", "part")).select("sample", "part", "kmer").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
