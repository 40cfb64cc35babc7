import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm import common, toxicity


def test_features_are_the_distinct_ngrams_of_each_text():
    texts = ["abcab", "", "ééé", "abcabcab"]
    points, ends = common.code_points(pa.array(texts))
    row, _ = toxicity.present(points, ends)
    for k, text in enumerate(texts):
        want = {text[i : i + n] for n in toxicity.SIZES for i in range(len(text) - n + 1)}
        assert (row == k).sum() == len(want)


def test_ratios_and_gain_by_hand(spark):
    p, q = np.array([9.0, 1.0]), np.array([1.0, 9.0])
    r = toxicity.log_count_ratios(p, q, 10, 10)
    assert np.allclose(r, [np.log((10 / 12) / (2 / 12)), np.log((2 / 12) / (10 / 12))])
    rows = spark.createDataFrame([(10, 0), (5, 5), (3, 1)], "p int, q int")
    gain = [x[0] for x in rows.select(toxicity.likelihood_ratio_column(F.col("p"), F.col("q"), 10, 10)).collect()]

    def by_hand(a, b):
        cells = [(a, 10, a + b), (b, 10, a + b), (10 - a, 10, 20 - a - b), (10 - b, 10, 20 - a - b)]
        return 2 * sum(k * np.log(k * 20 / (n * m)) for k, n, m in cells if k)

    assert np.allclose(gain, [by_hand(10, 0), 0, by_hand(3, 1)])


def test_fit_reaches_the_least_loss():
    """Against plain gradient descent on the dense matrix, of as many steps as it takes."""
    rng = np.random.default_rng(1)
    x = rng.random((60, 8)) < 0.4
    ratios = rng.normal(0, 1, 8)
    y = (x @ rng.normal(0, 1, 8) + rng.normal(0, 0.5, 60) > 0).astype(float)
    dense = x * ratios
    loss = lambda w, b: np.logaddexp(0, -(2 * y - 1) * (dense @ w + b)).mean() + 1e-2 / 2 * (w @ w)
    w, b = np.zeros(8), 0.0
    for _ in range(20_000):
        off = (1 / (1 + np.exp(-(dense @ w + b))) - y) / 60
        w, b = w - 0.5 * (dense.T @ off + 1e-2 * w), b - 0.5 * off.sum()
    rows, columns = np.nonzero(x)
    got, bias = toxicity.fit(rows, columns, ratios, y, penalty=1e-2, steps=2000)
    assert loss(got / ratios, bias) <= loss(w, b) + 1e-4 and np.allclose(got, w * ratios, atol=0.05)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.train(docs, labels, ~held)
    got = toxicity.scored(docs.where(held), model).join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.85 and hit / sum(r.predicted for r in got) > 0.95


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (10, 0), (6, 1), (6, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, F.lit(True))
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    same = {r.doc_id: r.score for r in rows}
    assert same[2] == same[3] and same[1] == same[6]
    assert toxicity.scored(none, model).count() == 0
    nothing = toxicity.train(none, labels.limit(0), F.lit(True))
    assert {round(r.score, 6) for r in toxicity.scored(odd, nothing).collect()} == {0.5}
    one_kind = toxicity.train(odd, labels.where("toxic = 0"), F.lit(True))
    assert all(r.predicted == 0 for r in toxicity.scored(odd, one_kind).collect())
    assert toxicity.with_scores(odd, model).columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
