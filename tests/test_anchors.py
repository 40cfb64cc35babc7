import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import anchors, dedup


def plain_holdings(seqs, width):
    """{(anchor, read): own} where two reads or more hold the anchor."""
    windows = {i: {s[p : p + width] for p in range(len(s) - width + 1)} for i, s in enumerate(seqs) if len(s) >= width}
    own = {i: {s[p : p + width] for p in (0, (len(s) - width + 1) // 2, len(s) - width)} for i, s in enumerate(seqs) if len(s) >= width}
    found = {}
    for a in set().union(*own.values()):
        holders = [i for i in windows if a in windows[i]]
        found |= {(a, i): a in own[i] for i in holders if len(holders) > 1}
    return found


@pytest.mark.parametrize("width, letters, held", [(20, "ACGTN", 20_000), (20, "ACGTNacRé", 3), (4, "ACN", 20_000), (30, "ACGT", 3)])
def test_holdings_of_any_letters_and_widths(spark, monkeypatch, width, letters, held):
    for name, value in (("CUT", 7), ("AT_ONCE", 5)):
        monkeypatch.setattr(anchors, name, value)
    monkeypatch.setattr(dedup, "HELD", held)
    rng = random.Random(width)
    words = ["".join(rng.choice(letters) for _ in range(width // 2 + 3)) for _ in range(6)] + ["A" * width]
    seqs = sorted({"".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"", "A", "A" * (width + 5)})
    ids = [k + (k // 9 << 33) for k in range(len(seqs))]  # as those of several partitions
    rows = spark.createDataFrame(list(zip(ids, seqs)), "id long, seq string")
    got = dedup.holdings(rows, width).collect()
    want = plain_holdings(seqs, width)
    assert len(want) > 50 and len(got) == len(want)
    assert {r.w for r in got} and sorted((r.s, r.own) for r in got) == sorted((ids[i], mine) for (_, i), mine in want.items())
    by_number, by_text = {}, {}
    for r in got:
        by_number.setdefault(r.w, []).append((r.s, r.own))
    for (a, i), mine in want.items():
        by_text.setdefault(a, []).append((ids[i], mine))
    assert sorted(map(sorted, by_number.values())) == sorted(map(sorted, by_text.values()))
    for r in got:
        assert r.parts == -(-len(by_number[r.w]) // held) and 0 <= r.part < r.parts


def test_windows_are_shuffled_as_runs(spark):
    """As text, the 128 windows of a read of 147 letters were 128 rows of 20 letters and more."""
    seqs = spark.range(2000).select("id", F.substring(F.translate(F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")), 256) for k in range(3)]), "0123456789abcdef", "ACGTACGTACGTACGN"), 1, 147).alias("seq"))
    columns = ["read", "packed", "n", "own"]
    sent = anchors.cut(seqs, 20, 64).agg(F.count("*").alias("rows"), sum(F.sum(F.coalesce(F.length(c), F.lit(0))) for c in columns).alias("bytes")).first()
    assert sent.rows < 2000 and sent.bytes < 2000 * 512
    # Runs have all windows: a read holds its own three, and its copy the same.
    twice = seqs.union(seqs.select(F.col("id") + 2000, F.concat(F.lit("C"), "seq")))
    got = dedup.holdings(twice).groupBy("s").agg(F.count("*").alias("n")).groupBy().agg(F.count("*").alias("reads"), F.min("n").alias("least")).first()
    assert got.reads == 4000 and got.least >= 3


def test_groups_are_looked_for_in_what_a_round_leaves(spark, monkeypatch):
    """A search for groups over all holdings was most of what was shuffled."""
    given = []
    real = dedup.by_components
    monkeypatch.setattr(dedup, "by_components", lambda held, bound: given.append(held.count()) or real(held, bound))
    rng = random.Random(3)
    spell = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    alike = [[head + spell(30) for _ in range(4)] for head in (spell(20) for _ in range(25))]
    # Each of these is hit by the one before it.
    chain = sorted(["A" * 5 + f"{'ACGT'[k // 4]}{'ACGT'[k % 4]}" + spell(13) for k in range(8)])
    chain = [a + b for a, b in zip(chain, chain[1:])]
    rows = spark.createDataFrame([("s", k, x) for k, x in enumerate([x for xs in alike for x in xs] + chain)], "sample string, read_no long, seq string")
    got = sorted(r.seq for r in dedup.three_anchor(rows, early=0, bound=1000).collect())
    assert got == sorted([min(xs) for xs in alike] + chain[::2])
    everything = dedup.holdings(rows.select(F.col("read_no").alias("id"), "seq")).count()
    assert len(given) == 1 and 0 < given[0] < everything / 4
