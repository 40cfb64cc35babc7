"""Counting k-mers too long for all 4^k to be seen: packed bases, cut by minimiser.

Neighbouring k-mers share most of their bases, so shuffling each by itself moves a base up to k
times. Here a read is cut into runs of k-mers with one minimiser, the m-mer of the least hash in
them; a run is one number, two bits a base, and goes to the group of its minimiser, where equal
k-mers meet, as equal k-mers have equal minimisers. What a task has for a group goes out as one block: equal
runs once, in order and compressed. Each group is counted by itself. Groups with very
many runs are taken apart before the shuffle instead: each task counts some of their k-mers at once and passes
on arrays of numbers, dealt by the k-mers themselves, so that a k-mer is no row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.packed import opened, squeezed, steps
from seqloom.sources.shared import stored

#: Bases of a run: 62 bits.
RUN = 31
#: Runs of a group that one task counts at once: some 300 MB.
HELD = 1_000_000
#: Groups of minimisers, and runs that a task deals to them at once: some 150 MB.
GROUPS, CHUNK = 1 << 13, 1 << 21
#: k-mers of hot buckets that a task merges at once, of one array, and runs that it takes apart at once.
MERGED, ARRAY, APART = 1 << 22, 4096, 1 << 18
#: Spreads m-mers, so that runs of one base aren't the least.
SPREAD = np.uint64(0x9E3779B97F4A7C15)

_CODE = np.full(256, 4, np.uint8)
for _k, _b in enumerate(b"ACGT"):
    _CODE[_b] = _k


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bases as 0 to 3, others 4, with one such behind each sequence; and where each sequence begins."""
    texts = [(x or "").encode() for x in column.to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return _CODE[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)], starts


def numbered(code: np.ndarray, k: int, base: int) -> np.ndarray:
    """The k digits from each place on as a number, by ever longer stretches."""
    found, have, stretch, size = np.zeros(len(code), np.int64), 0, code.astype(np.int64), 1
    while True:
        if k & size:  # stretches begin where what is found ends
            found = found[: len(stretch) - have] * base**size + stretch[have:]
            have += size
        if have == k:
            return found
        stretch = stretch[:-size] * base**size + stretch[size:]
        size *= 2


def runs(code: np.ndarray, k: int, m: int, *, base: int = 4, room: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where it begins, minimiser, packed bases, bases) of each run of k-mers with one minimiser.

    Bases are digits below `base`; others are in no k-mer. At most `room` are packed into a number.
    """
    windows = len(code) - k + 1
    none = np.empty(0, np.int64)
    if windows < 1:
        return none, none, none, none
    bad = np.concatenate([[0], np.cumsum(code >= base)])
    fine = bad[k:] == bad[:-k]
    short = numbered(code, m, base).view(np.uint64)
    least = (short + np.uint64(1)) * SPREAD
    at = np.arange(len(least))
    span = 1
    while span < k - m + 1:  # the least of a span and of one that overlaps it
        step = min(span, k - m + 1 - span)
        lower = least[step:] < least[:-step]
        least = np.where(lower, least[step:], least[:-step])
        at = np.where(lower, at[step:], at[:-step])
        span += step
    fresh = fine & ~np.concatenate([[False], fine[:-1] & (at[1:] == at[:-1])])
    begin = np.flatnonzero(fresh)
    # A run ends where the next begins or its k-mers do; one of too many bases is cut.
    number = np.cumsum(fresh) - 1
    size = np.bincount(number[fine], minlength=len(begin))
    most = room - k + 1
    times = -(-size // most)
    begin = np.repeat(begin, times) + most * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    size = np.minimum(np.repeat(size, times) - (begin - np.repeat(np.flatnonzero(fresh), times)), most)
    length = size + k - 1
    packed = numbered(code, k, base)[begin]
    for j in range(k, room):
        inside = np.flatnonzero(j < length)
        if not len(inside):
            break
        packed[inside] = packed[inside] * base + code[begin[inside] + j]
    return begin, short[at[begin]].astype(np.int64), packed, length


def taken_apart(packed: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of runs as numbers, and the run of each."""
    size = length - k + 1
    owner = np.repeat(np.arange(len(packed)), size)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return packed[owner] >> 2 * (size[owner] - 1 - step) & (1 << 2 * k) - 1, owner


def spelled(numbers: np.ndarray, k: int) -> pa.Array:
    """k-mers as letters."""
    digits = numbers[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3
    data = np.frombuffer(b"ACGT", np.uint8)[digits]
    return pa.Array.from_buffers(pa.string(), len(numbers), [None, pa.py_buffer(np.arange(0, (len(numbers) + 1) * k, k, dtype=np.int32) if k else np.zeros(len(numbers) + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def cut(reads: DataFrame, k: int, m: int, *, by: str = "sample") -> DataFrame:
    """(by, bucket, packed, n): the runs of all reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                code, starts = letters(part.column(1))
                begin, bucket, packed, length = runs(code, k, m)
                owner = np.searchsorted(starts, begin, "right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(bucket), pa.array(packed), pa.array(length.astype(np.int8))], names=["by", "bucket", "packed", "n"])

    return reads.select(F.col(by).cast("string").alias("by"), "seq").mapInArrow(run, "by string, bucket long, packed long, n byte")


def group_of(bucket: np.ndarray) -> np.ndarray:
    """The group of each minimiser, by other bits than those that made it the least."""
    x = bucket.view(np.uint64)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ x >> np.uint64(33)) % np.uint64(GROUPS)).astype(np.int64)


def blocks(reads: DataFrame, k: int, m: int, *, by: str = "sample") -> DataFrame:
    """(part, names, sizes, runs, kmers, block): the runs of all reads by groups of their minimisers. A block has `runs` different ones
    in order, sizes[i] of them of names[i], with `kmers` k-mers in all: their lengths, how often each occurs, packed bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str | None, int] = {}

        def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            group, own, n, packed = (np.concatenate(x) for x in zip(*held))
            own = (group * len(names) + own) << 5 | n
            order = np.lexsort((packed, own))
            own, packed = own[order], packed[order]
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (packed[1:] != packed[:-1]))) if len(own) else np.empty(0, np.int64)
            times = np.diff(np.append(new, len(own)))
            own, packed = own[new], packed[new]
            n, own = (own & 31).astype(np.int8), own >> 5
            kmers = np.append(0, np.cumsum(times * (n.astype(np.int64) - (k - 1))))
            of = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)) if len(own) else np.zeros(1, np.int64)
            group, name, size = own[of[:-1]] // len(names), own[of[:-1]] % len(names), np.diff(of)
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() if len(group) else []
            known, rows = list(names), []
            for a, b in zip(cuts, [*cuts[1:], len(group)]):
                lo, hi = int(of[a]), int(of[b])
                rows.append((int(group[a]), [known[x] for x in name[a:b]], size[a:b].tolist(), hi - lo, int(kmers[hi] - kmers[lo]), squeezed(n[lo:hi], times[lo:hi].astype(np.int32), packed[lo:hi])))
                if len(rows) == 256 or b == len(group):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), KINDS.values())], names=list(KINDS))
                    rows = []

        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                own = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()], np.int64)
                code, starts = letters(part.column(1))
                begin, bucket, packed, length = runs(code, k, m)
                held.append((group_of(bucket), own[np.searchsorted(starts, begin, "right") - 1], length, packed))
                size += len(begin)
                if size >= CHUNK:
                    yield from out(held)
                    held, size = [], 0
                    names.clear()
        if size:
            yield from out(held)

    return reads.select(F.col(by).cast("string").alias("by"), "seq").mapInArrow(run, "part int, names array<string>, sizes array<int>, runs int, kmers long, block binary")


#: Columns of blocks.
KINDS = {"part": pa.int32(), "names": pa.list_(pa.string()), "sizes": pa.list_(pa.int32()), "runs": pa.int32(), "kmers": pa.int64(), "block": pa.binary()}


def unpacked(block: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bases, times, packed) of a block's runs."""
    n, times, packed = opened(block, (np.int8, size), (np.int32, size), (np.int64, size))
    return n.astype(np.int64), times.astype(np.int64), packed


def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(by, packed, n), each run by itself, of blocks (names, sizes, runs, block)."""
    for batch in batches:
        for names, sizes, size, block in zip(*(x.to_pylist() for x in batch.columns)):
            n, times, packed = unpacked(block, size)
            own = np.repeat(np.repeat(np.arange(len(names)), sizes), times)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(own)), pa.array(np.repeat(packed, times)), pa.array(np.repeat(n, times).astype(np.int8))], names=["by", "packed", "n"])


def merged(rows: DataFrame, k: int, kmers: int, *, most: int = MERGED) -> DataFrame:
    """(by, kmer, cnt) of runs (by, packed, n), or blocks of them, some `kmers` in all: counted in the tasks, some runs at
    once, and summed in parts of some `most` k-mers, each part and sample by itself."""
    parts = max(1, -(-kmers // most))
    whole = "block" in rows.columns

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            keys = table.column("by").combine_chunks().dictionary_encode()
            names = pa.concat_arrays([keys.dictionary, pa.nulls(1, pa.string())])
            own = keys.indices.fill_null(len(keys.dictionary)).to_numpy()
            kmer, owner = taken_apart(*(table.column(c).to_numpy().astype(np.int64) for c in ("packed", "n")), k)
            own = own[owner].astype(np.int64)
            order = np.lexsort((kmer, own))
            own, kmer = own[order], kmer[order]
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (kmer[1:] != kmer[:-1]))) if len(kmer) else np.empty(0, np.int64)
            n = np.diff(np.append(new, len(kmer)))
            own, kmer = own[new], kmer[new]
            part = (((kmer.view(np.uint64) + np.uint64(1)) * SPREAD >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(own * parts + part, kind="stable")
            own, kmer, n, part = own[order], kmer[order], n[order], part[order]
            cuts = np.flatnonzero((own[1:] != own[:-1]) | (part[1:] != part[:-1])) + 1
            starts = np.append(0, cuts) if len(kmer) else cuts
            ends = np.append(cuts, len(kmer))
            spans = [(x, min(x + ARRAY, e)) for b, e in zip(starts.tolist(), ends.tolist()) for x in range(b, e, ARRAY)]
            for lo in range(0, len(spans), 256):
                some = spans[lo : lo + 256]
                at = [b for b, _ in some]
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), names.take(pa.array(own[at])), pa.array([e - b for b, e in some], pa.int32()), pa.array([squeezed(steps(kmer[b:e]), n[b:e]) for b, e in some], pa.binary())], names=["part", "by", "kmers", "block"])

        held, size = [], 0
        for batch in alone(batches) if whole else batches:
            held.append(batch)
            size += batch.num_rows
            if size >= APART:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            kmer, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(kmer)
            kmer, n = kmer[order], n[order]
            new = np.flatnonzero(np.append(True, kmer[1:] != kmer[:-1]))
            kmer, n = kmer[new], np.add.reduceat(n, new)
            for lo in range(0, len(kmer), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(kmer[some]), pa.string()), pa.array(kmer[some]), pa.array(n[some])], names=["by", "kmer", "cnt"])

        for batch in batches:
            for part, by, size, block in zip(*(x.to_pylist() for x in batch.columns)):
                if key != (part, by):
                    if held:
                        yield from out()
                    key, held = (part, by), []
                kmer, n = opened(block, (np.int64, size), (np.int64, size))
                held.append((np.cumsum(kmer), n))
        if held:
            yield from out()

    found = rows.select("names", "sizes", "runs", "block") if whole else rows.select("by", "packed", "n")
    dealt = found.mapInArrow(counted, "part long, by string, kmers int, block binary").repartition("part").sortWithinPartitions("part", "by")
    return dealt.mapInArrow(summed, "by string, kmer long, cnt long")


def count(reads: DataFrame, k: int, *, m: int | None = None, by: str = "sample", held: int = HELD) -> DataFrame:
    """(by, kmer, cnt): occurrences of each k-mer of A, C, G and T alone, k up to 31; what kmers.count gives.

    See numbers(), of which these are the k-mers as letters.
    """
    return numbers(reads, k, m=m, by=by, held=held, as_letters=True).withColumnRenamed("by", by)


def numbers(reads: DataFrame, k: int, *, m: int | None = None, by: str = "sample", held: int = HELD, as_letters: bool = False) -> DataFrame:
    """(by, kmer, cnt): occurrences of each k-mer of A, C, G and T alone, as a number of two bits a base; k up to 31.

    m-mers of `m` bases are the minimisers, by default so many that the longest run fits a number.
    Null and short reads have none. Groups of over `held` runs a minimiser, and of over HELD in all, are counted k-mer by k-mer.
    """
    if not 1 <= k <= RUN:
        raise ValueError(f"k-mers of 1 to {RUN} bases")
    m = min(k, max(1, 2 * k - RUN, min(k, 9))) if m is None else m
    most = min(held * max(1, 4**m // GROUPS), max(held, HELD))
    pieces = stored(blocks(reads, k, m, by=by), name="runs")
    sizes = pieces.groupBy("part").agg(F.sum("runs").alias("runs"), F.sum("kmers").alias("kmers"))
    large = sizes.where(F.col("runs") > most).collect()  # at most GROUPS rows
    kind = "string" if as_letters else "long"

    def shown(kmer: np.ndarray) -> pa.Array:
        return spelled(kmer, k) if as_letters else pa.array(kmer)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            own, n, times, packed = (np.concatenate(x) for x in zip(*found))
            kmer, owner = taken_apart(packed, n, k)
            own = own[owner]
            order = np.argsort(own << 2 * k | kmer) if len(names) <= 1 << 62 - 2 * k else np.lexsort((kmer, own))
            own, kmer = own[order], kmer[order]
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (kmer[1:] != kmer[:-1])))
            own, kmer, cnt = own[new], kmer[new], np.add.reduceat(times[owner[order]], new)
            known = pa.array(list(names), pa.string())
            for lo in range(0, len(new), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([known.take(pa.array(own[some])), shown(kmer[some]), pa.array(cnt[some])], names=["by", "kmer", "cnt"])

        names: dict[str | None, int] = {}
        found, rows, last = [], 0, None
        for batch in batches:
            for part, own, sizes, size, block in zip(*(x.to_pylist() for x in batch.columns)):
                if part != last and rows >= AT_ONCE:  # whole groups
                    yield from out(found)
                    names, found, rows = {}, [], 0
                last = part
                found.append((np.repeat(np.array([names.setdefault(x, len(names)) for x in own], np.int64), sizes), *unpacked(block, size)))
                rows += size
        if found:
            yield from out(found)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), shown(batch.column(1).to_numpy()), batch.column(2)], names=["by", "kmer", "cnt"])

    hot = F.col("part").isin([r.part for r in large])
    dealt = (pieces.where(~hot) if large else pieces).select("part", "names", "sizes", "runs", "block").repartition("part").sortWithinPartitions("part")
    rows = dealt.mapInArrow(counted, f"by string, kmer {kind}, cnt long")
    if not large:
        return rows
    apart = merged(pieces.where(hot), k, sum(r.kmers for r in large))
    return rows.unionByName(apart.mapInArrow(spell, "by string, kmer string, cnt long") if as_letters else apart)


#: Runs that a task counts together, whole groups of them.
AT_ONCE = 200_000
