from seqloom.operators import kmers
from seqloom.streaming import counts


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    schema = "sample string, read_no long, seq string, arrived timestamp"
    rows = spark.sql("select concat('s', id % 2) sample, id read_no, case when id % 3 = 0 then 'ACGTACGT' else 'TTTTAAAA' end seq, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) arrived from range(20)")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(counts.kmer_counts(stream, 3), "streamed", "complete")
    want = kmers.count(spark.read.schema(schema).parquet(str(tmp_path / "in")), 3)
    assert sorted(map(tuple, got.select("sample", "kmer", "cnt").collect())) == sorted(map(tuple, want.collect()))
    once = run(counts.watched(stream), "once", "append")
    assert once.count() == 4
