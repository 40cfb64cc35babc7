import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import hmm


def plain_likelihood(model, text):
    """Sum over all paths."""
    total = 0.0
    for path in product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, s in zip(path, path[1:], text[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        total += p
    return math.log(total)


@pytest.fixture
def model():
    return hmm.Model.begin(3, np.array([0.4, 0.3, 0.2, 0.1]))


def test_forward_is_the_sum_over_paths(model):
    texts = [np.array(t, np.uint16) for t in ([0], [1, 2, 3, 0], [3, 3], [2, 0, 1, 1, 0, 3])]
    got = model.log_likelihoods(texts)
    assert np.allclose(got, [plain_likelihood(model, t) for t in texts])


def test_expected_counts_against_all_paths(model):
    texts = [np.array(t, np.uint16) for t in ([1, 2, 3], [0, 0], [2, 1, 0, 3])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for text in texts:
        whole = math.exp(plain_likelihood(model, text))
        for path in product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for a, b, s in zip(path, path[1:], text[1:]):
                p *= model.move[a, b] * model.emit[s, b]
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                move[a, b] += p / whole
            for s, k in zip(text, path):
                emit[s, k] += p / whole
    for a, b in zip(model.expected(texts), (start, move, emit)):
        assert np.allclose(a, b)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(0, 3, 30) + 3 * int(rng.integers(2)), 6).astype(np.uint16) for _ in range(40)]
    shares = np.bincount(np.concatenate(texts), minlength=7) / sum(map(len, texts))
    model, last = hmm.Model.begin(2, shares), -np.inf
    for _ in range(12):
        now = model.log_likelihoods(texts).sum()
        assert now > last - 1
        last = now
        model = model.maximised(*model.expected(texts), shares)
    assert last > sum(np.log(shares[t]).sum() for t in texts) + 100


def test_base_and_counts_against_brute_force(documents, texts):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = hmm.scored(documents, ~held, own=50, common=200, rounds=2).collect()
    learned = {r.doc_id for r in documents.where(~held).collect()}
    counts = Counter(w for i in learned for w in [*hmm.words(texts[i]), b""])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        tokens = [*hmm.words(texts[r.doc_id]), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert abs(r.base_score - sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)) < 1e-6 * len(tokens) + 1e-9
    new = [r for r in rows if r.doc_id not in learned]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_a_state_and_its_words_are_a_distribution(spark):
    """Over all known words and one unseen word a class, the one-token texts' probabilities sum to 1."""
    docs = spark.createDataFrame([(k, f"w{k % 5} v{k % 3} w{k % 5}") for k in range(40)], "doc_id long, text string")
    counts = Counter(w for k in range(40) for w in hmm.words(f"w{k % 5} v{k % 3} w{k % 5}"))
    ranked = [(w.decode(), c) for w, c in counts.items()]
    classes = {}
    for w, c in counts.items():
        g = hmm.spelling(w.decode())
        n, v = classes.get(g, (0, 0))
        classes[g] = n + c, v + 1
    voc = hmm.Vocabulary(ranked, 40, classes, 2)
    for g in classes:
        members = [w for w, i in voc.index.items() if i >= voc.own and hmm.spelling(w.decode()) == g]
        assert abs(sum(counts[w] + 1 for w in members) + 1 - 10 ** voc.below[g]) < 1e-6
    assert abs(voc.shares.sum() - 1) < 1e-9
    assert hmm.scored(docs, F.lit(True), own=2, rounds=1).count() == 40


def test_odd_rows(spark, odd, none):
    rows = hmm.scored(odd, F.col("doc_id") != 10, own=4, common=6, rounds=1).collect()
    assert len(rows) == 11 and all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and abs(by[2].score - by[4].score) < 1e-12
    assert by[5].n_tokens == 15 * 2500 + 1
    assert hmm.scored(none, F.lit(True)).count() == 0
    untrained = hmm.scored(odd, F.lit(False)).collect()
    assert {r.train_tokens for r in untrained} == {0} and {r.n_known for r in untrained} == {0}
    assert all(np.isfinite([r.score, r.base_score]).all() for r in untrained)


def test_long_texts_are_trained_on_whole(model, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 7, 8, 40, 41)]
    model = model.maximised(*model.expected(texts), np.full(4, 0.25))
    want, whole = model.expected(texts), model.log_likelihoods(texts)
    for size in (1, 7, 40):
        parts = [sum(x) for x in zip(*(model.expected_in_parts(t, size) for t in texts))]
        assert all(np.allclose(a, b) for a, b in zip(parts, want))
    monkeypatch.setattr(hmm, "LONGEST", 7)
    assert all(np.allclose(a, b) for a, b in zip(model.expected(texts), want))
    assert np.allclose(model.log_likelihoods(texts), whole)


@pytest.mark.parametrize("common", [0, 1, 8, 1000])
def test_the_end_counts_whatever_words_travel(spark, common):
    """Two texts: their ends are rarer than every word, and still have their count."""
    texts = {i: " ".join(f"w{k}" for k in range(8) for _ in range(20)) for i in (1, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    counts = Counter(w for t in texts.values() for w in [*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    for r in hmm.scored(docs, F.lit(True), common=common, own=4, rounds=1).collect():
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*texts[r.doc_id].split(), ""])
        assert abs(r.base_score - want) < 1e-9 and r.n_known == r.n_tokens == 161
