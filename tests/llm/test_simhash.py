import numpy as np
import pytest
import xxhash
from conftest_llm import brute_components
from pyspark.sql import functions as F

from seqloom.llm import common, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprint_is_the_majority_of_shingle_hashes(spark, texts):
    for text in [None, "", " ", "One", "one two", "A b C", *list(texts.values())[:40]]:
        assert simhash.fingerprint(text) == plain(text)
    row = spark.sql("select xxhash64('one two three') h").first()
    assert simhash.fingerprint("One  two\tthree") == row.h % 2**64


def test_components_match_brute_force(spark, documents, texts):
    got = simhash.near_duplicates(documents).collect()
    codes = {i: plain(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == codes
    assert {r.doc_id: r.component_id for r in got} == brute_components(codes, 3)


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    codes = {}
    for i in range(400):
        flips = rng.choice(64, rng.integers(0, 3), replace=False)
        codes[i] = int(base[i % 40]) ^ sum(1 << int(b) for b in flips)
    rows = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c, i) for i, c in codes.items()], "fp long, rep long")
    rows = rows.groupBy("fp").agg(F.min("rep").alias("rep"))
    found = {r.node: r.component for r in common.components(simhash.links(rows, radius=3, tile=4)).collect()}
    want = brute_components(codes, 3)
    for r in rows.collect():
        assert found.get(r.rep, r.rep) == want[r.rep]


def test_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == "0" * 16 and {by[i].component_id for i in (2, 3, 4)} == {2}
    assert by[6].component_id == 1 and by[None].component_id is None and by[1].copies == 3
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 8, 9, 10]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0


@pytest.mark.parametrize("n", [2, 50])
def test_components_of_chains_and_stars(spark, n):
    chain = spark.range(1, n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(1000, 1000 + n).select(F.lit(2000).cast("long").alias("u"), F.col("id").alias("v"))
    got = {r.node: r.component for r in common.components(chain.union(star)).collect()}
    assert got == {**{i: 1 for i in range(1, n + 1)}, **{i: 1000 for i in [*range(1000, 1000 + n), 2000]}}


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    a, b, c = ("one two three four five six", "an entirely different text of this table", "and a third one that nothing resembles")
    rows = spark.createDataFrame([(1, a), (2, b), (2, a), (3, c), (3, c), (4, b)], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.deduplicated(rows).collect()))
    assert got == [(1, a), (2, b), (3, c)]
