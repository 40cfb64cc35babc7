"""What several operators share: Arrow text buffers, samples, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators.components import components  # noqa: F401 - for the operators beside this module
from seqloom.sources.fixtures import spread

#: Rows of a batch that a Python worker gets at once, and bytes that it works on at once: both bound
#: its memory where texts are very long. A single text is never cut.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, modulus: int):
    """crc32 of a key as text, modulo: a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches that stay small when texts are long."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: function(portions(batches)), schema)


def portions(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some `most` bytes."""
    for batch in batches:
        rows = max(1, batch.num_rows // max(1, -(-batch.nbytes // most)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df with more columns behind its own."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T.DataType.fromDDL(v)) for k, v in columns.items())])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and n + 1 offsets into them; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text column, every text followed by one zero, and n + 1 offsets."""
    texts = ["" if x is None else x for x in column.to_pylist()]
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=ends[1:])
    joined = "\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), ends


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[ends[i]:ends[i + 1]]; empty segments sum to zero."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = np.add.reduceat(values, ends[full], axis=0, dtype=np.float64)
    return out


def lowest(df: DataFrame, key: Column, n: int, *more: str) -> DataFrame:
    """The n rows of df with the lowest hash of `key` (ties: by `more`): a bounded sample that
    depends on the rows alone.

    Hashes beyond a bound that more than n rows almost surely stay under are filtered first, so
    that the candidates that are sorted don't grow with the number of partitions.
    """
    h = F.xxhash64(key)
    total = df.count()
    share = min(1.0, (n + 8 * n**0.5 + 8) / max(total, 1))
    near = df.where(h <= min(2**63 - 1, int(-(2**63) + share * 2**64))) if share < 1 else df
    if share < 1 and near.limit(n).count() < n:
        near = df
    return near.orderBy(h, *more).limit(n)
