import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm import lexical


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical.TERM, lower)


def plain(docs, items, k=50):
    """By every document's counts."""
    counts = [Counter(terms(t)) for _, t in docs]
    full = sum(c.total() > 0 for c in counts)
    every = sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * full + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for (i, _), c in zip(docs, counts):
            m = 50 + (50 * c.total() * full) // max(1, every)
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(spark, docs, items, **how):
    docs = spark.createDataFrame([(*d, "x", "x", "x") for d in docs], "doc_id long, text string, term string, block string, score string").repartition(3)
    items = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, item string")
    return sorted(map(tuple, lexical.ranked(docs, items, **how).collect()), key=str)


ODD_ITEMS = [(1, "the dog, the cat & the house"), (2, None), (3, ""), (4, "12345 日本語 é́ nothing"), (4, "the"), (None, "hund und KATZE"), (5, "words that stand nowhere")]


def test_against_brute_force(spark, texts):
    docs = list(texts.items())
    items = [(k, " ".join(terms(t)[:40])) for k, (_, t) in enumerate(docs[::20])]
    assert rows_of(spark, docs, items) == plain(docs, items)


def test_small_blocks_many_rounds_and_terms_beyond_what_is_sent(spark, texts, monkeypatch):
    docs = list(texts.items())[:120]
    items = [(k, " ".join(terms(t)[:30])) for k, (_, t) in enumerate(docs[::10])]
    for name, value in (("ITEMS", 4), ("TERMS", 40), ("SENT", 1000)):
        monkeypatch.setattr(lexical, name, value)
    assert rows_of(spark, docs, items, k=7) == plain(docs, items, 7)


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(spark, docs, ODD_ITEMS) == plain(docs, ODD_ITEMS)
    assert rows_of(spark, docs, []) == [] and rows_of(spark, [], ODD_ITEMS) == []
    assert rows_of(spark, [(1, None), (2, "--")], ODD_ITEMS) == []
    assert lexical.ranked(none, none.select(F.col("doc_id").alias("item_id"), "text")).columns == ["item_id", "rank", "doc_id", "score"]


def test_copies_tie_by_id(spark):
    docs = [(5000 - k, "the same words in every one of these") for k in range(3000)] + [(None, "the same words in every one of these")] + [(9000 + k, f"other {k}") for k in range(3500)]
    items = [(1, "same words"), (2, "other 17")]
    got = rows_of(spark, docs, items)
    assert got == plain(docs, items)
    assert [r[2] for r in sorted(got, key=lambda r: r[:2]) if r[0] == 1] == list(range(2001, 2051))


def test_tokens_of_a_batch_are_those_of_the_column(spark):
    texts = ["Ab-c d", "", None, "É日本 x1y", "--", "a", "b", "ſtraße 🙂x İI"]
    found, where = lexical.tokens(pa.array(texts))
    got = [[] for _ in texts]
    for t, k in zip(found.to_pylist(), where):
        got[k].append(t)
    assert got == [terms(t) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(lexical.terms(F.col("text"))).collect()] == got
    assert [len(x) for x in lexical.tokens(pa.array([], pa.string()))] == [0, 0]
