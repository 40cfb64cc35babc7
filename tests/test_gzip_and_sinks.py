import gzip
import io
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqloom.sources import gzipped, onefile, reads as R, tables as T


def packed(text, cuts, level=6):
    """Text as gzip members that end anywhere."""
    ends = [0, *cuts, len(text)]
    return b"".join(gzip.compress(text[a:b], level) for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("seed", range(12))
def test_ranges_give_each_line_once(seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("ACGT\x1f\x8b\x08 ") for _ in range(rng.choice([0, 1, 30, 400]))).encode("latin-1") for _ in range(rng.choice([0, 1, 40, 300]))]
    text = b"\n".join(lines) + b"\n" * rng.choice([0, 1])
    cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.choice([0, 1, 9, 60])))
    # Stored without compression, the text's own signatures stand in the file.
    data = packed(text, cuts, level=rng.choice([0, 6]))
    want = text.split(b"\n")
    want = want[:-1] if want[-1] == b"" else want
    for size in (len(data) + 1, 5000, 700, 61):
        got = []
        for begin in range(0, len(data), size):
            got += [x for some in gzipped.lines_of(io_file(data), begin, min(begin + size, len(data))) for x in some]
        assert got == want, size


class io_file(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_a_file_cut_short_is_an_error_and_padding_is_none():
    whole = gzip.compress(b"one\ntwo\n")
    assert [x for some in gzipped.lines_of(io_file(whole + b"\0" * 512), 0, 600) for x in some] == [b"one", b"two"]
    with pytest.raises((EOFError, zlib.error)):
        list(gzipped.lines_of(io_file(whole[:-6]), 0, 600))


def test_compressed_fastq_by_several_tasks(spark, tmp_path):
    records = "".join(f"@r{k}\n{'ACGT' * (k % 40 + 1)}\n+\n{'I' * 4 * (k % 40 + 1)}\n" for k in range(3000)).encode()
    (tmp_path / "many.fastq.gz").write_bytes(packed(records, range(1000, len(records), 1000)))
    (tmp_path / "one.fastq.gz").write_bytes(gzip.compress(records[: records.index(b"@r100\n")]))
    lines = gzipped.gzip_lines(spark, str(tmp_path), bytes_of_range=4000)
    assert lines.rdd.getNumPartitions() > 5 and lines.where("path like '%many%'").select("block").distinct().count() > 5
    got = R.read_fastq_gz(spark, str(tmp_path), bytes_of_range=4000).collect()
    many = sorted((r.read_no, r.header, r.seq, r.qual) for r in got if r.sample == "many")
    assert many == [(k, f"@r{k}", "ACGT" * (k % 40 + 1), "I" * 4 * (k % 40 + 1)) for k in range(3000)]
    assert sorted(r.read_no for r in got if r.sample == "one") == list(range(100))
    first = R.read_fastq_gz(spark, str(tmp_path), reads=30, bytes_of_range=4000).collect()
    assert sorted((r.sample, r.read_no, r.header) for r in first) == sorted((s, k, f"@r{k}") for s in ("many", "one") for k in range(30))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.gz").write_bytes(b"")
    assert R.read_fastq_gz(spark, str(tmp_path / "none")).count() == 0


def test_one_file_equals_that_of_one_task(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), F.when(F.col("id") % 7 > 0, F.concat(F.lit('a "b"\t'), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 5 == 0, "").otherwise("x").alias("e")).repartition(7)
    T.write_table(rows, str(tmp_path / "many"), order=[F.desc("n")])
    rows.orderBy(F.desc("n")).coalesce(1).write.csv(str(tmp_path / "one"), sep="\t", header=True)
    one = next(p for p in (tmp_path / "one").iterdir() if p.name.startswith("part-"))
    files = [p for p in (tmp_path / "many").iterdir() if p.name.startswith("part-")]
    assert len(files) == 1 and files[0].read_bytes() == one.read_bytes()
    assert [p for p in os.listdir(tmp_path) if "parts" in p] == []
    with pytest.raises(FileExistsError):
        T.write_table(rows, str(tmp_path / "many"), order=["n"])
    name = onefile.write_lines(rows, str(tmp_path / "gz"), line=F.col("n").cast("string"), order=["n"], head=["head"], compress=True)
    with gzip.open(name.removeprefix("file:")) as f:
        assert f.read().decode().split() == ["head", *map(str, range(5000))]
    none = onefile.write_lines(rows.limit(0), str(tmp_path / "none"), line="text", order=["n"], head=["only"])
    assert open(none.removeprefix("file:")).read() == "only\n"


def test_first_lines_open_only_the_first_ranges(spark, tmp_path):
    with open(tmp_path / "a.gz", "wb") as f:
        for k in range(200):
            f.write(gzip.compress("".join(f"{k} {j}\n" for j in range(50)).encode()))
    size, step = (tmp_path / "a.gz").stat().st_size, 500
    for lines in (10, 3000, 20_000):
        found = gzipped.gzip_lines(spark, str(tmp_path), bytes_of_range=step, lines=lines)
        parts = found.rdd.getNumPartitions()
        assert parts == gzipped.FIRST if lines == 10 else parts <= -(-size // step)
        got = [r.value for r in found.orderBy("block", "id").collect()]
        assert got[:lines] == [f"{k} {j}" for k in range(200) for j in range(50)][:lines]
