import random

import numpy as np
import pyarrow as pa
from conftest_llm import edit_distance

from seqloom.llm import common, decontaminate

PASSAGE = "Which of the following gases makes up most of the atmosphere of the third planet from the sun, and why is it inert?"


def found(items, texts, rate=0.1):
    index = decontaminate.Passages(items, rate)
    return index.found(*common.utf8(pa.array(texts)))


def edited(text, n, rng):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        kind = rng.choice("ids")
        if kind == "i":
            chars.insert(k, rng.choice("qxz"))
        elif kind == "d":
            del chars[k]
        else:
            chars[k] = "#"
    return "".join(chars)


def test_finds_every_region_within_the_budget_and_no_other():
    rng, hits = random.Random(3), 0
    for trial in range(150):
        n = rng.randrange(0, 20)
        region = edited(PASSAGE.lower(), n, rng)
        text = "lorem ipsum dolor sit amet " * 4 + region + " consectetur adipiscing elit" * 3
        distance = edit_distance(PASSAGE.lower(), region)
        got = found([(5, PASSAGE)], [text])
        budget = min(int(0.1 * len(PASSAGE)), (len(PASSAGE) - 8) // 8)
        if distance <= budget:
            hits += 1
            assert got and got[0][2] <= distance
        if got:
            _, _, edits, start, stop, _ = got[0]
            assert edit_distance(PASSAGE.lower(), text[start:stop]) == edits <= budget
    assert hits > 40


def test_banded_distance_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 16)))
        best = min(edit_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in (p, t))
        got = decontaminate.distance_within(a, b, 3)
        assert (got is None) == (best > 3)
        if got:
            assert got[0] == best and edit_distance(p, t[got[1] : got[2]]) == best


def plain_distances(p, t):
    """(fewest edits, end) of p against any part of t by the whole table."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(t, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    best = min(row)
    return best, row.index(best)


def test_the_band_loses_nothing_against_the_whole_table():
    rng = random.Random(8)
    for _ in range(150):
        p = "".join(rng.choice("abcd") for _ in range(rng.randrange(20, 90)))
        t = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) + edited(p, rng.randrange(0, 14), rng) + "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12)))
        budget = rng.randrange(0, 12)
        best, end = plain_distances(p, t)
        got = decontaminate.distance_within(*(np.frombuffer(x.encode(), np.uint8) for x in (p, t)), budget)
        assert (got is None) == (best > budget)
        if got:
            assert got[0] == best and got[2] == end and edit_distance(p, t[got[1] : got[2]]) == best


def test_passages_without_a_gram_match_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "no no"), (3, PASSAGE)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "yes, and eyes, yesterday YES"), (2, "no\tno no no!"), (3, "say " + PASSAGE), (4, "noon no"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.start, r.stop) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(1, 1, 0, 0, 3), (1, 1, 0, 25, 28), (2, 2, 0, 0, 5), (2, 2, 0, 6, 11), (3, 3, 0, 4, 4 + len(PASSAGE))]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()) == [4, 5]


def test_a_very_long_passage(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1_200_000))
    index = decontaminate.Passages([(1, long), (2, "a passage with no edit")], 0.0)
    text = "before " + long + " a passage with no edit after"
    got = index.found(*common.utf8(pa.array([text])))
    assert [(o, e, start, stop) for _, o, e, start, stop, _ in got] == [(0, 0, 7, 7 + len(long)), (1, 0, 8 + len(long), 30 + len(long))]


def test_case_white_space_repeats_and_short_passages():
    text = PASSAGE.upper().replace(" ", "\n") + " -- " + PASSAGE
    got = found([(5, PASSAGE), (6, "short"), (7, "12345678")], ["", text, "ab 12345678 cd", "nothing of the kind"])
    assert [(d, o, e) for d, o, e, *_ in got] == [(1, 0, 0), (1, 0, 0), (2, 1, 0)]
    assert found([(6, "tiny"), (7, "")], ["tiny"]) == []


def test_documents(spark, documents, texts):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    fold = lambda x: decontaminate.FOLD[np.frombuffer(x.encode(), np.uint8)].tobytes()
    want = {(d, i) for d, t in texts.items() for i, p in items.items() if fold(p) in fold(t)}
    got = decontaminate.matches(documents, bench).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in got}
    left = {r.doc_id for r in decontaminate.decontaminated(documents, bench).collect()}
    assert left == set(texts) - {r.doc_id for r in got}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog"), (1, None), (None, "der hund und die katze"), (2, ""), (3, "der hund und die katze sind in")], "item_id long, text string")
    got = decontaminate.matches(odd, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 3), (1, 1), (6, 1), (6, 1), (10, 3)]
    kept = decontaminate.decontaminated(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [2, 3, 4, 5, 8, 9]
    shared = spark.createDataFrame([(1, "x " + PASSAGE), (1, "nothing of the kind"), (None, "nothing of the kind"), (None, PASSAGE)], "doc_id long, text string")
    assert [r.text for r in decontaminate.decontaminated(shared, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).collect()] == ["nothing of the kind"] * 2
    assert decontaminate.matches(none, bench).count() == 0
    assert decontaminate.decontaminated(odd, bench.limit(0)).count() == 11


def test_blocks_of_the_benchmark_change_nothing(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.matches(documents, bench).collect()))
    was, decontaminate.blocks.__defaults__ = decontaminate.blocks.__defaults__, (3000,)
    try:
        assert len(list(decontaminate.blocks(bench, "item_id", "text"))) > 1
        assert sorted(map(tuple, decontaminate.matches(documents, bench).collect())) == want
    finally:
        decontaminate.blocks.__defaults__ = was


def test_names_that_clash(spark, odd):
    from seqloom.llm import simhash

    named = odd.withColumnRenamed("rank", "_leaks").withColumnRenamed("ids", "_KEPT")
    bench = spark.createDataFrame([(3, "der hund und die katze sind in")], "item_id long, text string")
    assert decontaminate.decontaminated(named, bench).columns == named.columns
    assert simhash.deduplicated(named).count() == 7


def test_windows_of_a_long_text_lose_nothing(monkeypatch):
    filler = "lorem ipsum dolor sit amet consectetur " * 30
    text = "".join(filler[: 137 * k % 900] + PASSAGE for k in range(12))
    want = found([(5, PASSAGE)], ["x", text, text[:400]])
    assert len(want) >= 12
    monkeypatch.setattr(decontaminate, "WINDOW", 500)
    assert found([(5, PASSAGE)], ["x", text, text[:400]]) == want


def test_the_sieve_loses_no_match(spark, documents, texts, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    matched = {r.doc_id for r in decontaminate.matches(documents, bench).collect()}
    items = sorted((r.item_id, r.text) for r in bench.collect())
    sieve = decontaminate.Sieve()
    for k in range(0, len(items), 3):
        sieve.add(decontaminate.Passages(items[k : k + 3], 0.1))
    assert len(sieve.classes) <= 16
    ids = sorted(texts)
    for window in (decontaminate.WINDOW, 777):
        monkeypatch.setattr(decontaminate, "WINDOW", window)
        may = sieve.may(*common.utf8(pa.array([texts[i] for i in ids])))
        passed = {i for i, ok in zip(ids, may) if ok}
        assert matched <= passed < set(ids)  # passages and texts are of the same invented words here
    sieve.add(decontaminate.Passages([(99, "zq")], 0.1))
    assert sieve.may(*common.utf8(pa.array(["a zq b", "azq", None, ""]))).tolist() == [True, False, False, False]
