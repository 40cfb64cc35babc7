"""Token-id sequences packed into fixed rows by best fit decreasing.

Texts are tokenised, those longer than a row split into full rows and a rest without loss, and
the pieces packed longest first, each into the fullest open row that still has room. A segment
tree over capacities finds that row: a leaf tells how many open rows have exactly so much room.
Pieces are packed within windows of consecutive texts of a partition, so a window's memory is
bounded, nothing is shuffled, and a task that is run again packs the same rows again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

ROW = 2048
#: Tokens that are packed together: some 1,000 rows of 2,048, which best fit fills almost wholly.
WINDOW = 1 << 21
#: The id that fills what is left of a row; it belongs to no text.
FILL = 50256


@lru_cache(maxsize=2)
def load(path: str):
    """A byte-level BPE vocabulary in ranks; no special tokens: their strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: A run of white space of so many characters goes to the merges as the one piece that the pattern makes
#: of it: the pattern's engine remembers every character of a run and fails at a million of them.
RUN = 4096
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % RUN)


def encoded(encoding, text: str, blanks: re.Pattern = BLANKS) -> list[int]:
    """The ids of a text: those of encode_ordinary(), however long its runs of white space are.

    The pattern makes one piece of such a run, but leaves its last character to what follows.
    """
    out, at = [], 0
    for m in blanks.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : stop].encode("utf-8", "replace"))
        at = stop
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


class Capacities:
    """Open rows by the room they have left; finds the least room that suffices in log steps."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.counts[k] += by
            k >>= 1

    def put(self, row: int, room: int) -> None:
        if room:
            self.rows[room].append(row)
            self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the least room of at least `size`, and that room; the latest opened of several."""
        k = size + self.leaves
        if not self.counts[k]:
            while k > 1 and (k & 1 or not self.counts[k + 1]):  # up to a right sibling with rows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.counts[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: numbers of the pieces of each row. Ties: earlier pieces first."""
    open_rows, rows = Capacities(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[piece]
        if not size:
            continue
        found = open_rows.take(size)
        if found is None:
            rows.append([piece])
            open_rows.put(len(rows) - 1, capacity - size)
        else:
            row, room = found
            rows[row].append(piece)
            open_rows.put(row, room - size)
    return rows


SCHEMA = "part int, row int, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, n_tokens int, ids array<int>, position_ids array<int>"


def packed(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = ROW, window: int = WINDOW, fill: int = FILL, vocabulary: str | None = None) -> DataFrame:
    """Packed rows: (part, row, doc_ids, starts, cu_seqlens, n_tokens, ids, position_ids).

    ids has exactly `capacity` token ids, filled up with `fill`; cu_seqlens are the cumulative
    lengths of its segments from 0 to n_tokens; segment k are the ids of doc_ids[k] from
    token starts[k] on; position_ids restart at 0 with every segment and with the filling.
    part and row number the rows (row is unique in a part). Each token of each text is in one
    segment, so texts come back whole by joining their segments by `starts`. Null and empty texts
    have no tokens and no segment; repeated rows are packed as often as they come; null ids
    stay null in doc_ids. Other columns are ignored; an empty table gives an empty result.
    The vocabulary is a file that every executor has (an installed package's, by default).
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path)
        part, made = None, 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            whose, starts = [], []
            for k, t in enumerate(tokens):
                for a in range(0, len(t), capacity):
                    whose.append(k)
                    starts.append(a)
            sizes = [min(capacity, len(tokens[k]) - a) for k, a in zip(whose, starts)]
            rows = pack(sizes, capacity)
            for k in range(0, len(rows), 256):
                yield batch_of(rows[k : k + 256], whose, starts, sizes, made + k)
            made += len(rows)
            ids.clear()
            tokens.clear()
            held = 0

        def batch_of(rows: list[list[int]], whose: list[int], starts: list[int], sizes: list[int], first: int) -> pa.RecordBatch:
            matrix = np.full((len(rows), capacity), fill, np.int32)
            places = np.empty((len(rows), capacity), np.int32)
            ramp = np.arange(capacity, dtype=np.int32)
            cumulative = []
            for r, row in enumerate(rows):
                at, edges = 0, [0]
                for p in row:
                    n = sizes[p]
                    matrix[r, at : at + n] = tokens[whose[p]][starts[p] : starts[p] + n]
                    places[r, at : at + n] = ramp[:n]
                    at += n
                    edges.append(at)
                places[r, at:] = ramp[: capacity - at]
                cumulative.append(edges)
            flat = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, capacity, dtype=np.int32)), pa.array(m.ravel()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), part, np.int32)),
                    pa.array(np.arange(first, first + len(rows), dtype=np.int32)),
                    pa.array([[ids[whose[p]] for p in row] for row in rows], pa.list_(pa.int64())),
                    pa.array([[starts[p] for p in row] for row in rows], pa.list_(pa.int32())),
                    pa.array(cumulative, pa.list_(pa.int32())),
                    pa.array([c[-1] for c in cumulative], pa.int32()),
                    flat(matrix),
                    flat(places),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

        for batch in batches:
            part = batch.column(2)[0].as_py() if part is None and batch.num_rows else part
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ids.append(i)
                tokens.append(np.array(encoded(encoding, text), np.int32))
                held += len(tokens[-1])
                if held >= window:
                    yield from out()
        if tokens:
            yield from out()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return map_batches(rows, run, SCHEMA)


def write(rows: DataFrame, path: str) -> None:
    """Packed rows as binary: Parquet with the matrices' rows as little-endian 32-bit integers."""
    turned = rows.select("part", "row", "doc_ids", "starts", "cu_seqlens", "n_tokens", "ids", "position_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k) for k in range(6)]
            for k in (6, 7):
                cols.append(pa.array([np.array(x, "<i4").tobytes() for x in batch.column(k).to_pylist()], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    schema = SCHEMA.replace("ids array<int>, position_ids array<int>", "ids binary, position_ids binary")
    map_batches(turned, run, schema).write.parquet(path)
