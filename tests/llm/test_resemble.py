import random

import corpus_pipeline
from conftest_llm import brute_kept
from pyspark.sql import functions as F

from seqloom.llm import resemble

SF = "/root/testdata/sf0.001"


def test_stage_against_all_pairs(spark, documents, texts):
    got = {r.doc_id for r in corpus_pipeline.near_copies_out(spark, documents, SF).collect()}
    assert got == brute_kept(texts) and len(got) < len(texts)


def edited(words, times, rng):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_about_the_threshold(spark):
    rng = random.Random(3)
    texts, line = {}, " ".join(f"line{k}" for k in range(12))
    for base in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 200]))]
        for copy in range(8):
            texts[base * 8 + copy] = edited(words, rng.choice([0, 1, 2, 3, 4]) * len(words) // 100, rng) + (f" {line}" if base % 2 else "")
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    for tile, small in ((3, 2), (3, 8), (1024, 3)):
        got = {r.doc_id for r in resemble.deduplicated(rows, tile=tile, small=small).collect()}
        assert got == brute_kept(texts) and 25 < len(got) < 190


def test_buckets_beyond_what_a_task_holds(spark, monkeypatch):
    """A token's rows in many parts: each meets the next, and all of them the comparison of the rest."""
    rng = random.Random(8)
    texts, line = {}, " ".join(f"line{k}" for k in range(12))
    for base in range(8):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        for copy in range(20):
            texts[base * 20 + copy] = edited(words, rng.choice([0, 1, 2, 3, 4]) * len(words) // 100, rng) + f" {line}"
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    name, want = "spark.sql.execution.arrow.maxRecordsPerBatch", brute_kept(texts)
    before = spark.conf.get(name)
    try:
        for held in (40, 3):
            monkeypatch.setattr(resemble, "TOGETHER", held)
            spark.conf.set(name, str(held))
            got = {r.doc_id for r in resemble.deduplicated(rows, tile=6, small=3).collect()}
            assert got == want and len(got) < 140
    finally:
        spark.conf.set(name, before)


def test_exactly_four_fifths_link(spark):
    words = [f"w{k}" for k in range(40)]  # 36 shingles; without the last 7 words 29, with 8 less 28
    rows = [(1, " ".join(words)), (2, " ".join(words[:33])), (3, " ".join(f"x{k}" for k in range(14))), (4, " ".join(f"x{k}" for k in range(12))), (5, " ".join(f"x{k}" for k in range(11)))]
    got = resemble.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    # 29/36 > 0.8; 8/10 = 0.8; 7/10 < 0.8 but 7/8 > 0.8
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_rows_are_judged_by_their_own_texts(spark):
    a, b = "one two three four five six seven", "quite another text that nothing else resembles here"
    rows = [(1, a), (1, b), (1, a), (None, a), (None, "a third text without any copy in this small table"), (7, None), (8, "")]
    rows = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id or 0), r.text or "") for r in resemble.deduplicated(rows).collect())
    assert got == [(0, "a third text without any copy in this small table"), (1, a), (1, b), (7, "")]
    assert resemble.deduplicated(rows.where(F.lit(False))).count() == 0


def test_long_texts_in_pieces_and_frequent_lines(spark):
    """Sets of many pieces, of different numbers of pieces, and shingles that many texts share."""
    rng = random.Random(5)
    line = " ".join(f"line{k}" for k in range(40))
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([300, 700, 1000]))]
        for copy in range(5):
            texts[base * 5 + copy] = line + " " + edited(words, rng.choice([0, 3, 12, 16, 25]) * len(words) // 600, rng) + " " + line * (copy % 2)
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id for r in resemble.deduplicated(rows, tile=4, piece=64, small=2).collect()}
    assert got == brute_kept(texts) and 12 <= len(got) < 50
    found = resemble.frequent(rows, 5)
    assert len(found) and set(found.tolist()) >= set(resemble.shingles(line).tolist())
    assert len(resemble.frequent(rows, 5, most=3)) <= 3
    assert [resemble.level(n, 64) for n in (0, 64, 65, 128, 129, 256, 257)] == [0, 0, 1, 1, 2, 2, 3]
    sizes = spark.range(600)
    assert [r[0] for r in sizes.select(resemble.level(F.col("id"), 64)).collect()] == [resemble.level(n, 64) for n in range(600)]


def test_op10s_fingerprints_link_and_are_checked(spark, monkeypatch):
    """Without any meeting at prefixes the fingerprints' links alone, those of similarity 0.8 or more."""
    words = [f"w{k}" for k in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(f"x{k}" for k in range(900))), (4, "a b c d"), (5, "a b c d")]
    # Of equal three-word shingles, but not of similar five-word ones: equal fingerprints, no near copies.
    rows += [(6, "p q r p q r s p q r"), (7, "p q r s p q r p q r")]
    meetings = resemble.meetings
    monkeypatch.setattr(resemble, "meetings", lambda *a: meetings(*a).limit(0))
    got = resemble.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 6, 7]


def test_a_pair_is_made_once_and_long_unlike_texts_not_at_all(spark, monkeypatch):
    rng = random.Random(4)
    line, texts = " ".join(f"line{k}" for k in range(60)), {}
    for k in range(24):  # long texts, of which 512 bits rule nothing out
        texts[k] = " ".join(f"v{rng.randrange(10**6)}" for _ in range(1500)) + f" {line}"
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for k in range(24, 60):
        texts[k] = edited(base, rng.choice([3, 4, 5]), rng) + f" {line}"
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    made, batches = [], resemble.map_batches

    def watched(df, function, schema):
        out = batches(df, function, schema)
        if schema == "u long, v long":
            made.extend(out.collect())
        return out

    monkeypatch.setattr(resemble, "map_batches", watched)
    got = {r.doc_id for r in resemble.deduplicated(rows, tile=5, small=2).collect()}
    assert got == brute_kept(texts)
    assert len(made) == len(set(made)) < 24 * 23 // 2
