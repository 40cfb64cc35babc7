"""Counting k-mers: all or once a read, both strands, origins, strand bins, bias correction.

Reads are (sample, read_no, seq); counts are (sample, kmer, cnt). Windows with N are dropped
before anything is exploded, and counting combines on the map side, so what is shuffled are at
most 4^k rows a sample and task, however many reads there are. Short k-mers are numbers, found in
a batch of reads at once: no window of A, C, G and T is a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import seq as S
from seqloom.operators.packed import opened, squeezed, steps


def windows(reads: DataFrame, k: int, *, keep_n: bool = False) -> DataFrame:
    """`reads` with (pos, kmer) for each window."""
    found = S.kmers("seq", k)
    exploded = reads.select("*", F.posexplode(found).alias("pos", "kmer")) if keep_n else None
    if exploded is None:
        pairs = F.filter(F.transform(found, lambda x, i: F.struct(i.alias("pos"), x.alias("kmer"))), lambda p: ~F.contains(p.kmer, F.lit("N")))
        exploded = reads.select("*", F.explode(pairs).alias("w")).select(*reads.columns, "w.pos", "w.kmer")
    return exploded


#: Longest k-mers that are numbers in the tasks, letters that are looked at together, and cells of a task's table.
TABLED, LETTERS, CELLS = 8, 1 << 20, 1 << 22
_CODE = np.full(256, 5, np.uint8)
_CODE[list(b"ACGTN")] = range(5)
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


def numbered(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(k-mer as a number, its text's place, its own in the text) for the windows of A, C, G and T, text by text, and the places
    of the texts that have letters beyond these and N, which are left to the caller."""
    raw = "\n".join([*(t or "" for t in texts), ""]).encode("utf-8", "surrogatepass")
    code = _CODE[np.frombuffer(raw, np.uint8)]
    ends = np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts])
    odd = np.unique(np.searchsorted(ends, np.flatnonzero(code == 5), "right")) if len(texts) else np.empty(0, np.int64)
    # The line feeds between the texts are 5 as well: a text is odd if it has one besides.
    fives = np.add.reduceat(code == 5, np.append(0, ends[:-1]), dtype=np.int64) if len(texts) else np.empty(0, np.int64)
    odd = odd[fives[odd] > 1]
    size = len(code) - k + 1
    if size < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), odd.tolist()
    number, fine = np.zeros(size, np.int64), np.ones(size, bool)
    for j in range(k):
        number = number << 2 | code[j : j + size]
        fine &= code[j : j + size] < 4
    at = np.flatnonzero(fine)
    place = np.searchsorted(ends, at, "right")
    if len(odd):
        ok = ~np.isin(place, odd)
        at, place = at[ok], place[ok]
    return number[at], place, at - np.append(0, ends)[place], odd.tolist()


def in_tasks(reads: DataFrame, k: int, by: tuple[str, ...], most: int) -> bool:
    """Whether k-mers are short enough to be numbers, and the keys plain: spans of time are not, and what
    arrives as a stream keeps its watermark only in Spark's own operators."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return 1 <= k <= most and not reads.isStreaming and not any(isinstance(reads.schema[c].dataType, nested) for c in by)


def names(k: int) -> pa.Array:
    """The k-mers of A, C, G and T in the order of their numbers."""
    digits = np.arange(4**k)[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3
    return pa.array([x.decode() for x in np.frombuffer(b"ACGT", np.uint8)[digits].view(f"S{k}").ravel()], pa.string())


def other_windows(text: str, k: int) -> list[str]:
    return [w for w in (text[i : i + k] for i in range(len(text) - k + 1)) if "N" not in w]


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch in slices of some LETTERS letters."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for end, t in enumerate(texts, 1):
        size += len(t or "") + 1
        if size >= LETTERS or end == len(texts):
            yield batch.slice(start, end - start), texts[start:end]
            start, size = end, 0


def count(reads: DataFrame, k: int, *, per_read: bool = False, both_strands: bool = False, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., kmer, cnt): occurrences of each k-mer without N.

    per_read counts a k-mer once in each read; both_strands also counts each occurrence's
    reverse complement (of all occurrences, hence not with per_read). Null and short reads
    have no k-mers. Those of up to TABLED letters are counted in a table a task.
    """
    if per_read and both_strands:
        raise ValueError("both strands are counted over all occurrences")
    if not in_tasks(reads, k, by, TABLED):
        found = F.filter(S.kmers("seq", k), lambda x: ~F.contains(x, F.lit("N")))
        if per_read:
            found = F.array_distinct(found)
        if both_strands:
            found = F.concat(found, F.transform(found, S.revcomp))
        return reads.select(*by, F.explode(found).alias("kmer")).groupBy(*by, "kmer").agg(F.count("*").alias("cnt"))
    cells = 4**k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        table = np.zeros((0, cells), np.int64)
        others: Counter = Counter()
        kinds: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, spelled = list(groups), names(k)
            g, x = np.nonzero(table[: len(keys)])
            if both_strands:
                mirrored = np.zeros(cells, np.int64)
                for j in range(k):
                    mirrored = mirrored << 2 | 3 - (np.arange(cells) >> 2 * j & 3)
                both = table[: len(keys)] + table[: len(keys), mirrored]
                g, x = np.nonzero(both)
            n = (both if both_strands else table)[g, x]
            for lo in range(0, len(g), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                held = [pa.array([key[c] for key in keys], kind).take(pa.array(g[some])) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*held, spelled.take(pa.array(x[some])), pa.array(n[some])], names=[*by, "kmer", "cnt"])
            rows = list(others.items())
            for lo in range(0, len(rows), 1 << 16):
                some = rows[lo : lo + (1 << 16)]
                held = [pa.array([keys[i][c] for (i, _), _ in some], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*held, pa.array([w for (_, w), _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=[*by, "kmer", "cnt"])

        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            for part, texts in pieces(batch, len(by)):
                own = zip(*(c.to_pylist() for c in part.columns[:-1])) if by else [()] * len(texts)
                owner = np.array([groups.setdefault(key, len(groups)) for key in own], np.int64)
                number, place, _, odd = numbered(texts, k)
                if per_read:
                    seen = np.unique(place * cells + number)
                    place, number = seen // cells, seen % cells
                if len(groups) > len(table):
                    table = np.concatenate([table, np.zeros((max(len(groups) - len(table), len(table)), cells), np.int64)])
                some, local = np.unique(owner, return_inverse=True)
                if len(some) * cells <= CELLS:
                    table[some] += np.bincount(local[place] * cells + number, minlength=len(some) * cells).reshape(len(some), cells)
                else:
                    cell, n = np.unique(owner[place] * cells + number, return_counts=True)
                    table[cell // cells, cell % cells] += n
                for r in odd:
                    found = other_windows(texts[r], k)
                    found = list(dict.fromkeys(found)) if per_read else found
                    if both_strands:
                        found = found + [w.encode("utf-8", "surrogatepass").translate(_COMPLEMENT).decode("utf-8", "surrogatepass")[::-1] for w in found]
                    others.update((int(owner[r]), w) for w in found)
                if len(table) * cells > CELLS or len(others) > 1 << 18:
                    yield from out()
                    groups, table, others = {}, np.zeros((0, cells), np.int64), Counter()
        if groups:
            yield from out()

    kinds_ = [T.StructField(c, reads.schema[c].dataType) for c in by]
    counted = reads.select(*by, "seq").mapInArrow(run, T.StructType([*kinds_, T.StructField("kmer", T.StringType()), T.StructField("cnt", T.LongType())]))
    return counted.groupBy(*by, "kmer").agg(F.sum("cnt").alias("cnt"))


def occurrences(reads: DataFrame, k: int, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., kmer, read_no): a row for each occurrence, as origins() without lists."""
    return windows(reads, k).select(*by, "kmer", "read_no")


#: Occurrences of which a task makes blocks at once, those that the lists of a block's k-mers have together, k-mers of a
#: block at most, and numbers of the lists that a task merges at once.
SPAN, TOGETHER, BLOCK, LISTED = 1 << 21, 1 << 21, 64, 1 << 19
#: Odd: what k-mers' numbers are multiplied by, so that those of a block are no neighbours, which are often frequent together.
MIXED = 0x9E3779B1
#: Bytes of blocks that a Python worker gets at once: Spark holds a batch some times over.
BATCH_BYTES = 4 << 20
#: Columns of blocks beside the groups'.
KINDS = {"_part": pa.int32(), "_word": pa.string(), "_kmers": pa.int32(), "_numbers": pa.int32(), "_block": pa.binary()}


def in_blocks(by: tuple[str, ...], k: int, together: int):
    """What makes blocks (by..., _part, _word, _kmers, _numbers, _block) of (by..., read_no, seq): the read numbers of the k-mers
    that a part of `together` k-mers has there, in order; those of a k-mer of other letters have a block of their own."""
    cells = 4**k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        words: dict[tuple[int, str], list[int]] = {}
        held: list[tuple[np.ndarray, ...]] = []  # k-mers and their reads, counted from the first one held
        seen: list[tuple[np.ndarray, ...]] = []  # those reads' groups and numbers, and whether they have one
        kinds: list[pa.DataType] = []

        def blocks() -> Iterator[tuple]:
            number, at = (np.concatenate(x) for x in zip(*held))
            owner, n, known = (np.concatenate(x) for x in zip(*seen))
            held.clear()
            n = n[at]
            keys = (number, owner.astype(np.uint16 if len(groups) <= 1 << 16 else np.int32)[at])
            order = np.lexsort(keys if (n[1:] >= n[:-1]).all() else (n, *keys))
            at, known = at[order], known[at[order]]
            key, n = owner[at] * cells + number[order], n[order][known]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            ends = np.append(0, np.cumsum(known))[np.append(new, len(key))]
            kmer = key[new]
            cuts = np.flatnonzero(np.append(True, np.diff(kmer // together) > 0)).tolist() if len(kmer) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(kmer)]):
                size, some = np.diff(ends[lo : hi + 1]), n[ends[lo] : ends[hi]]
                yield int(kmer[lo] // cells), int(kmer[lo] % cells // together), None, hi - lo, len(some), squeezed((kmer[lo:hi] % together).astype(np.uint8), size.astype(np.int32), steps(some))
            for (g, word), some in words.items():
                yield g, -1, word, 1, len(some), squeezed(np.zeros(1, np.uint8), np.array([len(some)], np.int32), steps(np.sort(np.array(some, np.int64))))

        def out() -> Iterator[pa.RecordBatch]:
            own = list(groups)
            for rows in batched(blocks(), 256):
                which, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(pa.array([own[g][c] for g in which], kind) for c, kind in enumerate(kinds)), *(pa.array(x, kind) for x, kind in zip(columns, KINDS.values()))], names=[*by, *KINDS])

        size = reads = 0
        for batch in batches:
            kinds = [c.type for c in batch.columns[: len(by)]]
            for part, texts in pieces(batch, len(by) + 1):
                at = part.column(len(by))
                own = zip(*(c.to_pylist() for c in part.columns[: len(by)])) if by else [()] * len(texts)
                owner = np.array([groups.setdefault(key, len(groups)) for key in own], np.int64)
                number, place, _, odd = numbered(texts, k)
                known, n = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy()
                seen.append((owner, n, known))
                held.append(((number * MIXED & cells - 1).astype(np.uint16), (place + reads).astype(np.int32)))
                size += len(number)
                for r in odd:
                    found = other_windows(texts[r], k)
                    fine = [int(w.translate(DIGIT), 4) * MIXED & cells - 1 for w in found if not w.translate(PLAIN)]
                    held.append((np.array(fine, np.uint16), np.full(len(fine), reads + r, np.int32)))
                    for w in found:
                        if w.translate(PLAIN):
                            words.setdefault((int(owner[r]), w), []).extend([int(n[r])] if known[r] else [])
                    size += len(found)
                reads += len(texts)
                if size + reads >= SPAN:
                    yield from out()
                    groups, words, held, seen, size, reads = {}, {}, [], [], 0, 0
        if size:
            yield from out()

    return run


#: Letters of k-mers that are numbers, as digits and as nothing.
DIGIT, PLAIN = str.maketrans("ACGT", "0123"), str.maketrans("", "", "ACGT")


def in_lists(by: tuple[str, ...], k: int, together: int, sep: str | None):
    """What makes rows (by..., kmer, ori) of blocks in order: those of one part meet, whichever tasks made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = names(k)
        kinds: list[pa.DataType] = []

        def lists(key: list, found: list[tuple[int, int, bytes]], lo: int, hi: int) -> pa.RecordBatch:
            """Those of the part's k-mers from lo to hi."""
            *own, part, word = key
            some = []
            for kmers, size, block in found:
                which, sizes, numbers = opened(block, (np.uint8, kmers), (np.int32, kmers), (np.int64, size))
                a, b = np.searchsorted(which, [lo, hi])
                ends = np.append(0, np.cumsum(sizes))
                some.append((which[a:b], sizes[a:b], np.cumsum(numbers)[ends[a] : ends[b]].copy()))
            some.sort(key=lambda f: f[2][:1].tolist())  # tasks mostly have reads behind each other
            which = np.concatenate([np.repeat(w, size) for w, size, _ in some])
            order = np.argsort(which, kind="stable")
            which, n = which[order], np.concatenate([f[2] for f in some])[order]
            if ((n[1:] < n[:-1]) & (which[1:] == which[:-1])).any():
                n = n[np.lexsort((n, which))]
            there = np.unique(np.concatenate([f[0] for f in some])).astype(np.int64)
            kmers = spelled.take(pa.array((part * together + there) * pow(MIXED, -1, 4**k) & 4**k - 1)) if word is None else pa.array([word])
            ends = pa.array(np.append(0, np.cumsum(np.bincount(which, minlength=together)[there])).astype(np.int32))
            ori = pa.ListArray.from_arrays(ends, pa.array(n)) if sep is None else pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(n).cast(pa.string())), sep)
            return pa.RecordBatch.from_arrays([*(pa.array([v] * len(there), kind) for v, kind in zip(own, kinds)), kmers, ori], names=[*by, "kmer", "ori"])

        def out(key: list, found: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            """Blocks stay squeezed and are opened for some k-mers at a time if they have many numbers together."""
            if sum(size for _, size, _ in found) <= LISTED:
                yield lists(key, found, 0, together)
                return
            have, there = np.zeros(together, np.int64), np.zeros(together, bool)
            for kmers, size, block in found:
                which, sizes, _ = opened(block, (np.uint8, kmers), (np.int32, kmers), (np.int64, size))
                have[which] += sizes
                there[which] = True
            ends = np.append(0, np.cumsum(have))
            lo = 0
            while lo < together:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + LISTED, "right")) - 1)
                if there[lo:hi].any():
                    yield lists(key, found, lo, hi)
                lo = hi

        last, found = None, []
        for batch in batches:
            kinds = [c.type for c in batch.columns[: len(by)]]
            for row in range(batch.num_rows):  # one block at a time
                *key, some, size, block = (c[row].as_py() for c in batch.columns)
                if key != last:
                    if found:
                        yield from out(last, found)
                    last, found = key, []
                found.append((some, size, block))
        if found:
            yield from out(last, found)

    return run


def origins(reads: DataFrame, k: int, *, by: tuple[str, ...] = ("sample",), most: int = 10_000_000, sep: str | None = None) -> DataFrame:
    """(by..., kmer, ori): the numbers of the reads with each k-mer, one an occurrence, ascending; as a text if `sep` is
    to stand between them.

    A list is one row, made in one task: where a k-mer has over `most` occurrences, counted
    first, it raises; occurrences() has the same rows without lists, however many there are.
    Short k-mers' numbers are shuffled as what each is more than the one before, a byte or two.
    """
    longest, total, lists = count(reads, k, by=by).agg(F.max("cnt"), F.sum("cnt"), F.count("*")).first()
    if (longest or 0) > most:
        raise ValueError(f"a {k}-mer has {longest} occurrences, more than {most} for one list")
    if not in_tasks(reads, k, by, TABLED) or any(isinstance(reads.schema[c].dataType, T.FractionalType) for c in by):
        rows = occurrences(reads, k, by=by).groupBy(*by, "kmer").agg(F.array_sort(F.collect_list("read_no")).alias("ori"))
        return rows if sep is None else rows.withColumn("ori", F.array_join(F.col("ori").cast("array<string>"), sep))
    together = min(BLOCK, 4**k)
    while together > 1 and together * (total or 0) > TOGETHER * lists:
        together //= 2
    kept = [T.StructField(c, reads.schema[c].dataType) for c in by]
    columns = [T.StructField(c, kind) for c, kind in zip(KINDS, (T.IntegerType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.BinaryType()))]
    blocks = reads.select(*by, F.col("read_no").cast("long").alias("read_no"), "seq").mapInArrow(in_blocks(by, k, together), T.StructType([*kept, *columns]))
    keys = [*by, "_part", "_word"]
    conf, limit = reads.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(limit).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(limit, str(BATCH_BYTES))  # stays so: Spark reads it once the query runs
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)
    kind = T.ArrayType(T.LongType(), False) if sep is None else T.StringType()
    return dealt.mapInArrow(in_lists(by, k, together, sep), T.StructType([*kept, T.StructField("kmer", T.StringType()), T.StructField("ori", kind)]))


#: Read numbers of a bitmap: what Spark's bitmaps hold.
BITMAP = 32_768


#: Longest k-mers of which a task holds all bitmaps of a bucket, and bytes of those it holds at once.
MAPPED, OPEN = 6, 64 << 20


def mapped(by: tuple[str, ...], k: int):
    """What makes rows (by..., kmer, bucket, bits) of (by..., read_no, seq): a bucket's bitmaps are held until others
    need the room, so of reads in order each is made once or twice."""
    cells = 4**k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, held = names(k), {}
        kinds: list[pa.DataType] = []

        def row(key: tuple, kmers: pa.Array, bits: list[bytes]) -> pa.RecordBatch:
            own = [pa.array([v] * len(bits), kind) for v, kind in zip(key, kinds)]
            return pa.RecordBatch.from_arrays([*own, kmers, pa.array([key[-1]] * len(bits), pa.int64()), pa.array(bits, pa.binary())], names=[*by, "kmer", "bucket", "bits"])

        def out(key: tuple) -> Iterator[pa.RecordBatch]:
            bits = held.pop(key)
            some = np.flatnonzero(bits.any(1))
            for lo in range(0, len(some), 512):
                at = some[lo : lo + 512]
                yield row(key, spelled.take(pa.array(at)), [x.tobytes() for x in bits[at]])

        for batch in batches:
            kinds = [c.type for c in batch.columns[: len(by)]]
            for part, texts in pieces(batch, len(by) + 1):
                n = part.column(len(by)).to_numpy()
                own = list(zip(*(c.to_pylist() for c in part.columns[: len(by)]))) if by else [()] * len(texts)
                groups: dict[tuple, int] = {}
                owner = np.array([groups.setdefault((*key, int(b)), len(groups)) for key, b in zip(own, n >> 15)], np.int64)
                number, place, _, odd = numbered(texts, k)
                at = n[place] % BITMAP
                cell = (owner[place] * cells + number) * (BITMAP // 8) + (at >> 3)
                order = np.argsort(cell)
                cell, bit = cell[order], np.left_shift(1, at[order] & 7).astype(np.uint8)
                new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
                cell, bit = cell[new], np.bitwise_or.reduceat(bit, new) if len(new) else bit
                size = cells * BITMAP // 8
                cuts = np.searchsorted(cell, np.arange(len(groups) + 1) * size)
                for g, key in enumerate(groups):
                    if key not in held:
                        while held and (len(held) + 1) * size > OPEN:
                            yield from out(next(iter(held)))
                        held[key] = np.zeros((cells, BITMAP // 8), np.uint8)
                    held[key].ravel()[cell[cuts[g] : cuts[g + 1]] - g * size] |= bit[cuts[g] : cuts[g + 1]]
                for r in odd:
                    one = np.zeros(BITMAP // 8, np.uint8)
                    one[int(n[r]) % BITMAP >> 3] = 1 << (int(n[r]) & 7)
                    words = list(dict.fromkeys(other_windows(texts[r], k)))
                    for lo in range(0, len(words), 512):
                        yield row((*own[r], int(n[r]) >> 15), pa.array(words[lo : lo + 512], pa.string()), [one.tobytes()] * len(words[lo : lo + 512]))
        for key in list(held):
            yield from out(key)

    return run


def origin_bitmaps(reads: DataFrame, k: int, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., kmer, bucket, bits): which reads have each k-mer, each read once, as bitmaps of BITMAP read
    numbers: number n is bit n % BITMAP of bucket n // BITMAP. Numbers are not negative, and are
    dense (reads.densely_numbered), as a bitmap takes its 4 kB whatever it holds.

    Bitmaps are built on the map side and merge like sums: a k-mer that every read has costs a bit
    a read and no list, and no row grows beyond a bucket.
    """
    at = F.col("read_no")
    if in_tasks(reads, k, by, MAPPED):
        found = reads.where(at.isNotNull()).select(*by, at.cast("long").alias("read_no"), "seq")
        kept = [T.StructField(c, reads.schema[c].dataType) for c in by]
        parts = found.mapInArrow(mapped(by, k), T.StructType([*kept, T.StructField("kmer", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())]))
        return parts.groupBy(*by, "kmer", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    seen = reads.where(at.isNotNull()).select(*by, at, F.explode(F.array_distinct(F.filter(S.kmers("seq", k), lambda x: ~F.contains(x, F.lit("N"))))).alias("kmer"))
    return seen.groupBy(*by, "kmer", F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at % BITMAP).alias("bits"))


def bitmap_counts(bitmaps: DataFrame, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., kmer, reads): how many reads have each k-mer."""
    return bitmaps.groupBy(*by, "kmer").agg(F.sum(F.bitmap_count("bits")).alias("reads"))


def bitmap_spans(bitmaps: DataFrame, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., kmer, first, last, total): the smallest and largest number of the reads with each k-mer, and their
    sum; every bitmap is unpacked in its task, and one row of it goes on."""
    keys = [*by, "kmer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for bucket, bits in zip(batch.column("bucket").to_pylist(), batch.column("bits").to_pylist()):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                found.append((bucket * BITMAP + int(at[0]), bucket * BITMAP + int(at[-1]), bucket * BITMAP * len(at) + int(at.sum())) if len(at) else (None, None, None))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(x, pa.int64()) for x in zip(*found))] if found else [*(batch.column(k) for k in keys), *[pa.array([], pa.int64())] * 3], names=[*keys, "first", "last", "total"])

    kinds = [bitmaps.schema[k] for k in keys]
    rows = bitmaps.select(*keys, "bucket", "bits").mapInArrow(run, T.StructType([*kinds, *(T.StructField(c, T.LongType()) for c in ("first", "last", "total"))]))
    return rows.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("total").alias("total"))


def bitmap_numbers(bitmaps: DataFrame, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., kmer, read_no): the way back, a row a bit; a batch's bitmaps are unpacked at once."""
    keys = [*by, "kmer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                ones = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) for b in part.column("bits").to_pylist()]
                owner = np.repeat(np.arange(part.num_rows), [len(x) for x in ones])
                numbers = np.concatenate(ones) + part.column("bucket").to_numpy()[owner] * BITMAP
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(owner)) for k in keys), pa.array(numbers, pa.int64())], names=[*keys, "read_no"])

    kinds = [bitmaps.schema[k] for k in keys]
    return bitmaps.select(*keys, "bucket", "bits").mapInArrow(run, T.StructType([*kinds, T.StructField("read_no", T.LongType())]))


def with_frequency(counts: DataFrame, *, by: tuple[str, ...] = ("sample",), legacy_palindromes: bool = False) -> DataFrame:
    """`counts` with total and freq = cnt / total; totals are one row a group, joined back.

    legacy_palindromes: palindromes' counts, doubled by bin_strands, enter the total three times
    halved, as the tool that this replaces had it; frequencies then don't sum to 1.
    """
    weight = F.when(F.lit(legacy_palindromes) & (F.col("kmer") == S.revcomp("kmer")), F.col("cnt") * 1.5).otherwise(F.col("cnt"))
    totals = counts.groupBy(*by).agg(F.sum(weight).alias("total"))
    return counts.join(totals, list(by)).withColumn("freq", F.col("cnt") / F.col("total"))


def bin_strands(counts: DataFrame, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Counts of both strands under the smaller name; a k-mer seen on one strand alone keeps its
    own, a palindrome counts twice."""
    canon = F.least("kmer", S.revcomp("kmer"))
    doubled = F.when(F.col("kmer") == S.revcomp("kmer"), 2 * F.col("cnt")).otherwise(F.col("cnt"))
    return counts.withColumn("canon", canon).withColumn("n", doubled).groupBy(*by, "canon").agg(F.min("kmer").alias("kmer"), F.sum("n").alias("cnt")).drop("canon")


def base_frequencies(reads: DataFrame, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by..., base, cnt, freq) over A, C, G and T; sums only, nothing is exploded before them."""
    sums = reads.groupBy(*by).agg(*[F.sum(S.base_count("seq", b)).alias(b) for b in S.BASES])
    total = sum((F.col(b) for b in S.BASES), F.lit(0))
    pairs = F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("cnt"), (F.col(b) / total).alias("freq")) for b in S.BASES])
    return sums.select(*by, F.explode(pairs).alias("x")).select(*by, "x.base", "x.cnt", "x.freq")


def bias_corrected(counts: DataFrame, bases: DataFrame, k: int, *, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Counts over what base composition alone would give, times 4^-k; N rows are dropped."""
    wide = bases.groupBy(*by).agg(*[F.max(F.when(F.col("base") == b, F.col("freq"))).alias(f"p{b}") for b in S.BASES])
    expected = F.lit(float(4**k))
    for b in S.BASES:
        expected = expected * F.pow(F.col(f"p{b}"), S.base_count("kmer", b))
    fine = counts.where(~F.contains("kmer", F.lit("N"))).join(wide, list(by))
    return fine.select(*by, "kmer", (F.col("cnt") / expected).alias("cnt"))


def universe(spark: SparkSession, k: int) -> DataFrame:
    """(kmer): all 4^k, from the digits of a range: no join."""
    digits = F.transform(F.sequence(F.lit(k - 1), F.lit(0), F.lit(-1)), lambda i: F.substr(F.lit(S.BASES), (F.floor(F.col("id") / F.pow(F.lit(4.0), i)) % 4).cast("int") + 1, F.lit(1)))
    return spark.range(4**k).select(F.concat_ws("", digits).alias("kmer"))


def unique_oligos(spark: SparkSession, k: int) -> DataFrame:
    """(kmer): of each strand pair the one that comes first in the order A, G, C, T."""
    rank = lambda s: F.translate(s, "AGCT", "0123")
    return universe(spark, k).where(rank(F.col("kmer")) <= rank(S.revcomp("kmer")))


def cut(reads: DataFrame, size: int = 40, *, pieces: str = "all") -> DataFrame:
    """(sample, read_no, piece, part): starts 0, size, 2 size, ..., the last piece ends with the read.

    pieces="last" gives the last one alone. Blank reads and reads shorter than a piece go.
    """
    rows = reads.where(F.col("seq").rlike("\\w") & (F.length("seq") >= size))
    if pieces == "last":
        return rows.select("sample", "read_no", F.lit(0).alias("piece"), F.right("seq", F.lit(size)).alias("part"))
    full = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int"))
    starts = F.transform(full, lambda i: F.least(i * size, F.length("seq") - size))
    return rows.select("sample", "read_no", "seq", F.posexplode(starts).alias("piece", "at")).select("sample", "read_no", "piece", F.substr("seq", F.col("at") + 1, F.lit(size)).alias("part"))
