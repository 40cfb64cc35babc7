"""A user's own functions over reads: aggregates with partial states, rows from batches, partitions.

Functions get pandas frames of reads, some thousand at once, never a single row. Aggregates
follow the same two steps as built-in ones: a state for each task and group, then merging, in
two levels, so that no task gets the states of all tasks of a large job at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States of a group that the first level merges in one task.
TOGETHER = 64


def keyed(reads: DataFrame, by: tuple[str, ...], **more: str) -> T.StructType:
    """The fields of `by` and more of the given types."""
    return T.StructType([*(reads.schema[c] for c in by), *(T.StructField(k, T.DataType.fromDDL(v)) for k, v in more.items())])


def aggregate_reads(reads: DataFrame, zero: Callable[[], Any], step: Callable[[Any, pd.DataFrame], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], list[tuple]], schema: str, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., schema): what `finish` makes of each group's state.

    `step` adds a frame of a group's reads to a state that begins as `zero()`; `merge` joins two
    states and must not care for their order; `finish` gives the group's rows. States are pickled.
    A group without reads has no row; null keys are a group; an empty table gives no rows.
    """
    keys = list(by)
    partial = keyed(reads, by, state="binary", slot="int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}
        for frame in frames:
            for key, rows in frame.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                states[key] = step(states[key] if key in states else zero(), rows)
        for key, state in states.items():
            yield pd.DataFrame([[*key, pickle.dumps(state), 0]], columns=[*keys, "state", "slot"])

    def merged(frame: pd.DataFrame) -> Any:
        state = zero()
        for raw in sorted(frame["state"]):  # in an order of their own, wherever the tasks ran
            state = merge(state, pickle.loads(raw))
        return state

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1].assign(state=[pickle.dumps(merged(frame))])

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [[*frame.iloc[0][keys], *r] for r in finish(merged(frame))]
        return pd.DataFrame(rows, columns=out.names)

    out = T.StructType([*keyed(reads, by).fields, *T.DataType.fromDDL(schema).fields])
    states = reads.mapInPandas(run, partial)
    parts = max(1, reads.sparkSession.sparkContext.defaultParallelism // TOGETHER)
    dealt = states.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(parts)))
    return dealt.groupBy(*by, "slot").applyInPandas(first, partial).groupBy(*by).applyInPandas(last, out)


def map_reads(reads: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that `function` makes of each frame of reads: any number, of any kind."""
    return reads.mapInPandas(lambda frames: (function(f) for f in frames), schema)


def map_partition(reads: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The rows that `function` makes of a whole task's frames, which it gets one after the other."""
    return reads.mapInPandas(function, schema)


def map_files(reads: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, by: str = "path", slices: int = 1) -> DataFrame:
    """The rows that `function` makes of each file's reads; with `slices` a file is dealt to so many
    calls by read number, for files that don't fit in one."""
    dealt = reads.withColumn("_slice", F.pmod(F.col("read_no"), F.lit(slices)))
    return dealt.groupBy(by, "_slice").applyInPandas(lambda frame: function(frame.drop(columns="_slice")), schema)
