import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm import common
from seqloom.sources import shared


def test_text_buffers_of_slices_and_nulls():
    column = pa.array(["zero", "é", None, "", "☃x", "end"]).slice(1, 4)
    raw, ends = common.utf8(column)
    assert [raw[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == ["é", "", "", "☃x"]
    raw, ends = common.utf8(pa.array(["a", "bc"], pa.large_string()).slice(1))
    assert raw.tobytes() == b"bc" and ends.tolist() == [0, 2]
    points, ends = common.code_points(column)
    assert ["".join(map(chr, points[a : b - 1])) for a, b in zip(ends, ends[1:])] == ["é", "", "", "☃x"]
    assert all(points[b - 1] == 0 for b in ends[1:])
    raw, ends = common.utf8(pa.array([], pa.string()))
    assert len(raw) == 0 and ends.tolist() == [0]


def test_segment_sums_with_empty_segments():
    got = common.segment_sums(np.arange(5.0), np.array([0, 0, 2, 2, 5, 5]))
    assert got.tolist() == [0, 1, 0, 9, 0]


def test_portions_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["x" * 1000] * 10)], names=["a", "b"])
    parts = list(common.portions([batch], most=2500))
    assert len(parts) > 1 and [v for p in parts for v in p.column(0).to_pylist()] == list(range(10))
    assert max(p.num_rows for p in parts) <= 3
    assert len(list(common.portions([batch], most=1))) == 10


def test_lowest_hashes(spark):
    rows = spark.range(5000)
    want = [r.id for r in rows.orderBy(F.xxhash64("id")).limit(50).collect()]
    assert [r.id for r in common.lowest(rows, F.col("id"), 50).collect()] == want
    assert common.lowest(rows.limit(7), F.col("id"), 50).count() == 7
    assert common.lowest(rows.limit(0), F.col("id"), 50).count() == 0
    same = spark.range(3000).select(F.lit(1).alias("k"), "id")
    assert [r.id for r in common.lowest(same, F.col("k"), 5, "id").collect()] == [0, 1, 2, 3, 4]


def test_stored_tables_are_read_back_and_discarded(spark):
    import os

    out = shared.stored(spark.range(10), name="x")
    path = out.stored_at.removeprefix("file:")
    assert out.count() == 10 and os.path.isdir(path)
    shared.discard(out)
    assert not os.path.isdir(path)
    assert shared.stored(spark.range(0)).count() == 0
    assert common.free_name(spark.range(1).withColumnRenamed("id", "ID"), "id") == "id_"
