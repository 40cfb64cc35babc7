"""Contiguous shards of near-equal bytes from global prefix sums, in DataFrame operations alone.

Rows are dealt into contiguous ranges of the order (id, checksum, size); each range is summed
once, the sums of the ranges before it are added to the running sum inside it, and the global
byte position of a row decides its shard: equal targets of total / shards bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.shared import stored


ORDER = ["doc_id", "text_crc32", "size", "tie"]


def before(totals: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Sums over all smaller keys: `totals` has a row for each range or shard, a bounded number."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"{s}_before") for s in sums])


def ranged(rows: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """`rows` with the number of their contiguous range, written down so that it never changes."""
    return stored(rows.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in order]).withColumn("range", F.spark_partition_id()), name="ranges")


def sharded(docs: DataFrame, *, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", overhead: int = 8, ranges: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each input row.

    size is the UTF-8 bytes of the text (null: none) plus `overhead`; text_crc32 is unsigned (a
    null text has that of no bytes, 0). Rows are in the order of id (null first), checksum and
    size; a shard holds the rows whose first byte falls into its equal part of all bytes, so
    shards are contiguous, and their sizes differ from the target by less than one row. slot
    counts a shard's rows from 0 in that order. Rows equal in all three are alike: which of
    them comes first doesn't matter, and no group of them, however large, has to meet in one
    task. With fewer rows than shards some shards stay empty. grown_shard is null, as the law
    is `bytes`. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        # Spreads rows that are equal in all else over several ranges.
        F.monotonically_increasing_id().alias("tie"),
    )
    if ranges is None:
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    placed = ranged(rows, ORDER, ranges)
    # One row for each range: small by construction, whatever the input.
    totals = before(placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "range", ["bytes", "n"])
    inside = Window.partitionBy("range").orderBy(*[F.col(c).asc_nulls_first() for c in ORDER]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = placed.agg(F.sum("size").alias("total"))
    summed = placed.join(F.broadcast(totals), "range").crossJoin(F.broadcast(total))
    first = F.sum("size").over(inside) - F.col("size") + F.col("bytes_before")
    number = F.row_number().over(inside) - 1 + F.col("n_before")
    cut = stored(
        summed.withColumn("first", first).withColumn("number", number.cast("long")).withColumn("shard", part(F.col("first"), F.col("total"), shards)).select("doc_id", "size", "text_crc32", "shard", "number"),
        name="shards",
    )
    starts = cut.groupBy("shard").agg(F.min("number").alias("start"))
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def part(first: Column, total: Column, shards: int) -> Column:
    """floor(first * shards / total) without rounding."""
    return F.floor(first.cast("decimal(38,0)") * F.lit(shards) / total.cast("decimal(38,0)")).cast("int")


#: The same rows in DuckDB; its CRC-32 is spelled out, byte by byte, over the UTF-8 bytes.
ORACLE_SQL = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
rows AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
         xor(reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(coalesce(text, '')))),
             lambda j: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * j + 1, 2))::BIGINT)),
             lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), summed AS (
  SELECT *, sum(size) OVER w - size AS first, row_number() OVER w - 1 AS number, sum(size) OVER () AS total
  FROM rows WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), cut AS (SELECT *, ((first * 24) // total)::INTEGER AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (number - min(number) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
