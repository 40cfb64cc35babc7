"""Windows of reads that equal another read's anchor, its head, middle or end window.

Windows of A, C, G, T and N are numbers, five letters a digit. Neighbouring windows share most of their
letters, so reads are cut into runs of windows with one minimiser (see superkmers) before the shuffle; equal
windows have equal minimisers, so they meet. A part is told its anchors first and then its runs, some at a
time: it holds its anchors, never the windows, however many reads share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.operators.superkmers import SPREAD, runs

#: Letters of a run in one number, and how many there are.
ROOM, LETTERS = 27, 5
POWERS = LETTERS ** np.arange(ROOM + 1, dtype=np.int64)
#: Reads cut at once, reads of a part, and runs of a part that are looked up at once.
CUT, PART, AT_ONCE = 8192, 20_000, 1 << 16
#: Deals minimisers, which are the least by SPREAD.
DEAL = np.uint64(0xC2B2AE3D27D4EB4F)

_CODE = np.full(256, LETTERS, np.uint8)
for _k, _b in enumerate(b"ACGTN"):
    _CODE[_b] = _k

CUT_ROWS = "part int, kind byte, base long, read binary, packed binary, n binary, own binary"


def minimiser(width: int) -> int:
    """Letters of a minimiser: a run of windows with one fits a number."""
    return max(2 * width - ROOM, min(width, 13))


def sliced(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of data between starts, one value each."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def cut(reads: DataFrame, width: int, parts: int) -> DataFrame:
    """Reads (id, seq) as rows of some reads and a part: kind 0 has their anchors, kind 1 their runs.

    A row's reads are told by 16 bits beyond its base; all windows of a read in a part are in one row.
    """
    m = minimiser(width)

    def rows(part: np.ndarray, kind: int, base: int, *columns: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        n = len(starts) - 1
        values = [sliced(x[order], starts) for x in columns]
        values = [pa.nulls(n, pa.binary()), *values, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())] if kind == 0 else values
        return pa.RecordBatch.from_arrays([pa.array(part[starts[:-1]]), pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, base, np.int64)), *values], names=["part", "kind", "base", "read", "packed", "n", "own"])

    def pieces(ids: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        starts = np.append(0, ends[:-1])
        code = _CODE[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        begin, bucket, packed, n = runs(code, width, m, base=LETTERS, room=ROOM)
        if not len(begin):
            return
        last = ends - 1 - starts - width
        starts, last = starts[last >= 0], last[last >= 0]
        own = np.unique(np.concatenate([starts, starts + (last + 1) // 2, starts + last]))
        run = np.maximum(np.searchsorted(begin, own, "right") - 1, 0)
        step = own - begin[run]
        inside = (step >= 0) & (step <= n[run] - width)
        run, step = run[inside], step[inside]
        mask = np.zeros(len(begin), np.uint8)
        np.bitwise_or.at(mask, run, np.left_shift(1, step).astype(np.uint8))
        part = ((bucket.astype(np.uint64) * DEAL >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
        if len(run):
            yield rows(part[run], 0, 0, packed[run] // POWERS[n[run] - width - step] % POWERS[width])
        base = int(ids[0]) >> 16 << 16
        read = (ids - base).astype(np.uint16)[np.searchsorted(ends, begin, "right")]
        yield rows(part, 1, base, read, packed, n.astype(np.uint8), mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, texts = table.column("id").to_numpy(), [(x or "").encode() for x in table.column("seq").to_pylist()]
            ends = [*(np.flatnonzero(ids[1:] >> 16 != ids[:-1] >> 16) + 1).tolist(), len(ids)]
            for lo, hi in zip([0, *ends], ends):
                yield from pieces(ids[lo:hi], texts[lo:hi])

        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CUT):
                held.append(batch.slice(lo, CUT))
                size += held[-1].num_rows
                if size >= CUT:
                    yield from out(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield from out(pa.Table.from_batches(held))

    return reads.select("id", "seq").mapInArrow(run, CUT_ROWS)


def taken_apart(packed: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of runs as numbers, the run of each and its place there."""
    size = length.astype(np.int64) - width + 1
    run = np.repeat(np.arange(len(packed)), size)
    step = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    return packed[run] // POWERS[size[run] - 1 - step] % POWERS[width], run, step


class Part:
    """The anchors of a part and how many reads hold each; the first holder waits for a second."""

    def __init__(self, anchors: list[bytes]):
        self.anchors = np.unique(np.frombuffer(b"".join(anchors), np.int64))
        self.shift = np.uint64(64 - max(10, 4 + len(self.anchors).bit_length()))
        self.maybe = np.zeros(1 << 64 - int(self.shift), bool)
        self.maybe[self.slot(self.anchors)] = True
        self.holders = np.zeros(len(self.anchors), np.int64)
        self.first = np.zeros(len(self.anchors), np.int64)
        self.mine = np.zeros(len(self.anchors), bool)

    def slot(self, values: np.ndarray) -> np.ndarray:
        return (values.view(np.uint64) + np.uint64(1)) * SPREAD >> self.shift

    def met(self, rows: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(w, s, own): anchors that reads of these runs hold, of those that two reads or more are known to hold."""
        read, packed, n, mask = (np.frombuffer(b"".join(x), t) for x, t in zip(list(zip(*rows))[1:], (np.uint16, np.int64, np.uint8, np.uint8)))
        ids = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[3]) for r in rows]) + read
        values, run, step = taken_apart(packed, n, width)
        some = np.flatnonzero(self.maybe[self.slot(values)])
        at = np.searchsorted(self.anchors, values[some])
        at[at == len(self.anchors)] = 0
        same = self.anchors[at] == values[some]
        some, at = some[same], at[same]
        s, own = ids[run[some]], mask[run[some]] >> step[some].astype(np.uint8) & 1 > 0
        order = np.lexsort((s, at))
        at, s, own = at[order], s[order], own[order]
        # A window that a read has twice is held once.
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (s[1:] != s[:-1]))) if len(at) else some
        own = np.logical_or.reduceat(own, new) if len(at) else own
        at, s = at[new], s[new]
        groups, start, times = np.unique(at, return_index=True, return_counts=True)
        before = self.holders[groups]
        self.holders[groups] += times
        waits = groups[(before == 1)]
        alone = start[self.holders[groups] == 1]
        self.first[at[alone]], self.mine[at[alone]] = s[alone], own[alone]
        shared = self.holders[at] > 1
        w = np.append(self.anchors[at[shared]], self.anchors[waits])
        return w, np.append(s[shared], self.first[waits]), np.append(own[shared], self.mine[waits])


def met(reads: DataFrame, width: int, count: int, held: int) -> DataFrame:
    """(w, s, own, n): which of the reads (id, seq), `count` in all, hold which anchor of A, C, G, T and N, their own or
    another's, where at least two do. An anchor of more than `held` has a row without read, with their number, besides.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(w: np.ndarray, s: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(s), pa.array(own), pa.nulls(len(w), pa.int64())], names=["w", "s", "own", "n"])

        def many(part: Part) -> pa.RecordBatch:
            hot = np.flatnonzero(part.holders > held)
            return pa.RecordBatch.from_arrays([pa.array(part.anchors[hot]), pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.bool_()), pa.array(part.holders[hot])], names=["w", "s", "own", "n"])

        number, part, anchors, rows, size = None, None, [], [], 0
        for batch in batches:
            for of, kind, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if of != number or size >= AT_ONCE:
                    if part and rows:
                        yield out(*part.met(rows, width))
                    rows, size = [], 0
                if of != number:
                    if part:
                        yield many(part)
                    number, part, anchors = of, None, []
                if kind == 0:
                    anchors.append(row[2])
                    continue
                part = part or (Part(anchors) if anchors else None)
                if part:
                    rows.append(tuple(row))
                    size += len(row[3])
        if part:
            if rows:
                yield out(*part.met(rows, width))
            yield many(part)

    dealt = cut(reads, width, max(256, count // PART)).repartition("part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(look, "w long, s long, own boolean, n long")
