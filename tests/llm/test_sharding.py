import zlib

import duckdb

from seqloom.llm import sharding

SF = "/root/testdata/sf0.001"


def plain(rows, shards):
    rows = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    total, at, slots, out = sum(r[2] for r in rows), 0, {}, []
    for (known, i), crc, size in rows:
        shard = at * shards // total
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i if known else None, size, crc, "bytes", shard, slots[shard], None))
        at += size
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(documents, texts):
    got = sharding.sharded(documents, shards=24)
    assert rows_of(got) == sorted(plain(texts.items(), 24), key=str)
    sizes = {}
    for r in got.collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    longest = max(len(t.encode()) + 8 for t in texts.values())
    assert max(abs(s - sum(sizes.values()) / 24) for s in sizes.values()) <= longest


def test_oracle(spark, documents):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.sql(sharding.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, found), key=str) == rows_of(sharding.sharded(documents))


def test_odd_rows(spark, odd, none):
    got = sharding.sharded(odd, shards=5, ranges=3)
    want = plain([(r.doc_id, r.text) for r in odd.collect()], 5)
    assert rows_of(got) == sorted(want, key=str)
    assert sharding.sharded(none).count() == 0
    same = spark.createDataFrame([(7, "abc")] * 1000, "doc_id long, text string")
    rows = sharding.sharded(same, shards=10, ranges=7).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(10) for k in range(100)]


def test_plan_is_native(odd):
    plan = sharding.sharded(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
