"""The same counts over arriving reads, for ingest: plain streaming aggregations.

Nothing here is order dependent, so the batch operators' results and these agree once all reads
have arrived; the three-anchor rule depends on all reads and stays a batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import adm, kmers


def watched(reads: DataFrame, *, time: str = "arrived", late: str = "1 hour") -> DataFrame:
    """Reads with a watermark on their arrival, and each (sample, sequence) once within it."""
    return reads.withWatermark(time, late).dropDuplicatesWithinWatermark(["sample", "seq"])


def kmer_counts(reads: DataFrame, k: int, *, per_read: bool = False) -> DataFrame:
    """(sample, kmer, cnt), growing; state is at most 4^k rows a sample."""
    return kmers.count(reads, k, per_read=per_read)


def position_counts(reads: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(sample, kmer, pos, val), growing; state is bounded by read length times 4^k a sample."""
    return adm.position_counts(reads, ks)


def windowed_kmer_counts(reads: DataFrame, k: int, *, time: str = "arrived", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """(window, sample, kmer, cnt) of each span of arrival; spans end when the watermark passes them."""
    spans = reads.withWatermark(time, late).withColumn("window", F.window(time, width))
    return kmers.count(spans, k, by=("window", "sample"))
