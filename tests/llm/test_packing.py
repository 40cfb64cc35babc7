import random

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import packing


def plain(sizes, capacity):
    """Best fit decreasing by looking at every row; of equal rooms the latest to get it."""
    rows, room, stamp, clock = [], [], [], 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if not sizes[i]:
            continue
        fits = [r for r in range(len(rows)) if room[r] >= sizes[i]]
        if fits:
            r = min(fits, key=lambda r: (room[r], -stamp[r]))
        else:
            rows.append([])
            room.append(capacity)
            stamp.append(0)
            r = len(rows) - 1
        clock += 1
        rows[r].append(i)
        room[r] -= sizes[i]
        stamp[r] = clock
    return rows


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randrange(1, 40)
        sizes = [rng.randrange(0, capacity + 1) for _ in range(rng.randrange(0, 60))]
        assert packing.pack(sizes, capacity) == plain(sizes, capacity)


def unpacked(rows):
    found = {}
    for r in rows:
        assert len(r.ids) == len(r.position_ids) and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert r.position_ids[a:b] == list(range(b - a))
            found.setdefault(doc, []).append((start, r.ids[a:b]))
        assert r.position_ids[r.n_tokens :] == list(range(len(r.ids) - r.n_tokens))
        assert set(r.ids[r.n_tokens :]) <= {packing.FILL}
    return {d: [i for _, part in sorted(parts) for i in part] for d, parts in found.items()}


def test_documents_come_back_whole(documents, texts):
    encoding = packing.load(packing.default_vocabulary())
    rows = packing.packed(documents, capacity=256).collect()
    assert unpacked(rows) == {d: encoding.encode_ordinary(t) for d, t in texts.items() if t}
    assert len({(r.part, r.row) for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) / (256 * len(rows)) > 0.95
    small = packing.packed(documents, capacity=256, window=2000).collect()
    assert unpacked(small) == unpacked(rows) and len({(r.part, r.row) for r in small}) == len(small)


def test_binary_files(spark, documents, tmp_path):
    rows = packing.packed(documents, capacity=128)
    packing.write(rows, str(tmp_path / "packed"))
    back = {(r.part, r.row): r for r in spark.read.parquet(str(tmp_path / "packed")).collect()}
    for r in rows.collect():
        assert np.frombuffer(back[r.part, r.row].ids, "<i4").tolist() == r.ids
        assert np.frombuffer(back[r.part, r.row].position_ids, "<i4").tolist() == r.position_ids


def test_odd_rows(odd, none):
    rows = packing.packed(odd, capacity=64).collect()
    assert {d for r in rows for d in r.doc_ids} == {1, 4, 5, 6, None, 8, 9, 10}
    assert sum(r.doc_ids.count(6) for r in rows) == 2
    assert packing.packed(none).count() == 0
    assert packing.packed(odd.where(F.col("text").isNull())).count() == 0


def test_long_runs_of_white_space():
    import re

    encoding = packing.load(packing.default_vocabulary())
    short = re.compile(packing.BLANKS.pattern.replace(str(packing.RUN), "3"))
    for text in ("   ", "a   b", "   x", "x   ", " \n\t  \n 1  \u3000\xa0\u2003\u2003!   \n", "a    b     c\r\n\r\n\r\nd", "  é   é", " \x1c\x1d\x1e\x1f  x"):
        for t in (text, text * 5, "w" + text + "w"):
            assert packing.encoded(encoding, t, short) == encoding.encode_ordinary(t)
    for run in (" ", "\n", " \n", "\u3000"):
        text = "start" + run * 20_000 + "end " + run * 5_000
        assert packing.encoded(encoding, text) == encoding.encode_ordinary(text)
    many = packing.encoded(encoding, "a" + " " * 2_000_000 + "b")
    assert encoding.decode(many) == "a" + " " * 2_000_000 + "b"


def test_a_very_long_run_is_packed_whole(spark):
    text = " " * 1_500_000 + "x"
    rows = packing.packed(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_tokens").collect()
    assert sum(r.n_tokens for r in rows) == 1_500_000
