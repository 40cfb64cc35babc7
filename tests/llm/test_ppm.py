import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import ppm


def plain_bits(train, text):
    """PPM by the book: orders 3 to 0, escapes of method C, exclusions; a start is three marks."""
    counts = defaultdict(Counter)
    for t in train:
        s = (None,) * 3 + tuple(t)
        for i in range(3, len(s)):
            for k in range(4):
                counts[s[i - k : i]][s[i]] += 1
    s, bits = (None,) * 3 + tuple(text), 0.0
    for i in range(3, len(s)):
        ruled_out = set()
        for k in (3, 2, 1, 0):
            seen = {c: n for c, n in counts[s[i - k : i]].items() if c not in ruled_out}
            n, q = sum(seen.values()), len(seen)
            if s[i] in seen:
                bits -= math.log2(seen[s[i]] / (n + q))
                break
            if n:
                bits -= math.log2(q / (n + q))
            ruled_out |= set(seen)
        else:
            bits -= math.log2(1 / (256 - len(ruled_out)))
    return bits


def test_code_lengths_are_exact():
    samples = {"x": [b"abracadabra", b"abrakadabra!"], "y": [b"zzz top", b"the zoo", b"a"]}
    model = ppm.Model(samples)
    texts = [b"abra", b"zebra", b"", b"\xff\x00q", b"the abracadabra zoo"]
    ends = np.cumsum([0, *map(len, texts)])
    got = model.lengths(np.frombuffer(b"".join(texts), np.uint8), ends)
    for row, text in zip(got, texts):
        for value, lang in zip(row, model.langs):
            assert abs(value - plain_bits(samples[lang], text)) < 1e-3


def test_many_languages_of_many_bytes_lose_no_context():
    rng = np.random.default_rng(3)
    samples = {f"l{k}": [bytes(rng.integers(0, 256, 300, dtype=np.uint8)) for _ in range(2)] for k in range(12)}
    model = ppm.Model(samples)
    text = samples["l3"][0][:60] + samples["l7"][1][:60]
    got = model.lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert np.allclose(got, [plain_bits(samples[lang], text) for lang in model.langs], atol=1e-2)


def test_a_language_of_long_texts_alone_is_learned(spark):
    rows = [(1, "the cat sat on the mat " * 3, "en"), (2, "der hund und die katze " * 60, "de"), (3, "der hund und die katze " * 50, "de")]
    model = ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), longest=500)
    assert model.langs == ["de", "en"]


def test_languages_of_held_out_documents(documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = ppm.train(documents, ~held)
    got = ppm.identified(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd, none):
    model = ppm.train(odd, F.lit(True))
    rows = ppm.identified(odd, model).collect()
    assert len(rows) == 11
    by = {r.doc_id: r.lang_pred for r in rows}
    assert {by[2], by[3], by[4], by[8]} == {"und"} and by[1] == "en" and by[10] == "de" and by[9] != "und"
    assert ppm.identified(none, model).count() == 0
    empty = ppm.train(none, F.lit(True))
    assert {r.lang_pred for r in ppm.identified(odd, empty).collect()} == {"und"}
    wide = ppm.with_languages(odd, model)
    assert wide.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "bits"]
