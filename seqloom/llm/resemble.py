"""Near copies by the similarity of their word shingles, found without loss.

SimHash's comparison, exclusive-or and bit counts tile against tile, on a fingerprint that can't
lose: 64 majority bits can't tell a similarity of 0.8 (such pairs lie 10 bits apart give or take 3,
and a radius that spans them all lets one of a thousand unrelated pairs through), so here a bit is
the parity of how many shingles fall on it. Each shingle that only one set has flips one bit, so
two sets differ in no fewer shingles than their fingerprints in bits, and what these rule out is
ruled out for sure. A text has a short fingerprint for tiles and a long one, as long as it needs.

First op10's own fingerprints (simhash.py: 64 majority bits, compared tile against tile) link texts at 3
or fewer differing bits, and what they link is checked exactly. What majority bits can't reach is
found besides, as follows.

Texts meet where they share a shingle of their prefixes: in any order of all shingles, of two sets
whose Jaccard similarity is at least t the first n - ceil(t * n) + 1 of either hold a common one.
The order is by hash, but frequent shingles come last, so that lines and passages which many texts
share bring few texts together. Of a few texts that meet all pairs are tried, of more some; what
these connect needs no further comparison, so that large groups of copies don't make all their
pairs, and the others are compared tile against tile, but for tiles whose sizes are too different.
Pairs that their fingerprints, as long as the texts need, don't rule out are passed on, each by
one of the tokens that they share, and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.sources.shared import discard, stored

from . import simhash
from .common import components, free_name, map_batches

#: Words of 64 bits that a parity sketch has.
SKETCH = 8
#: Words of a sketch that a tile holds at most: 8 kB.
TILED = 1024
#: Words of sketches that are compared at once.
COMPARED = 1 << 21
#: Nodes whose texts are asked for without a shuffle of all texts.
FEW = 200_000
#: Frequent shingles that are put last, 2 MB of hashes; texts of a window that make one frequent there,
#: and shingles of a window.
FREQUENT, OFTEN, SEEN_AT_ONCE = 1 << 18, 4, 1 << 21
#: Nodes that share a shingle of which all pairs are tried.
SMALL = 8
#: Rows (token, node, n) that a task holds to join them; a token of more nodes is joined part by part.
TOGETHER = 1 << 18
#: Hashes of a text that are compared at once: longer sets are compared in pieces by their leading bits.
PIECE = 4096


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; tokens as simhash.fingerprint() has them."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(tokens), np.cumsum([len(x) + 1 for x in tokens]) - 1
    starts = [0, *(ends[: max(0, len(tokens) - words)] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[min(words, len(tokens)) - 1 :].tolist())], np.uint64))


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The parity of how many hashes fall on each bit of `size` words."""
    odd = np.bincount((hashes % np.uint64(64 * size)).astype(np.int64), minlength=64 * size) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def fine(hashes: np.ndarray) -> np.ndarray:
    """A sketch of two bits or more for each hash, its size a power of two: see folded()."""
    return sketch(hashes, 1 << max(0, (2 * len(hashes) - 1) // (64 * SKETCH)).bit_length() + 3)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch of fewer words, a divisor of its own number, of the same hashes."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def frequent(texts: DataFrame, words: int, most: int = FREQUENT) -> np.ndarray:
    """Hashes of shingles that many texts hold, the rarest first; at most `most` of them.

    Each task counts windows of texts and passes on what occurs in several of one window, so that a
    shuffle carries little of the corpus; the most frequent stay. The list only orders the
    shingles of each text: whatever is in it, no pair of similar texts is lost.
    """

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many], pa.int64())], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, words))
                size += len(held[-1])
                if size > SEEN_AT_ONCE:
                    yield counts(held)
                    held, size = [], 0
        if held:
            yield counts(held)

    found = stored(map_batches(texts.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), name="frequent")
    steps = found.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()  # a few hundred rows
    least, total = None, 0
    for row in steps:
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    rows = found.where(F.floor(F.log2("n") * 8) >= least).toPandas() if least is not None else None
    discard(found)
    return rows.sort_values(["n", "token"])["token"].to_numpy(np.int64).view(np.uint64) if rows is not None else np.empty(0, np.uint64)


def prefixes(sets: list[np.ndarray], sorted_frequent: np.ndarray, ranks: np.ndarray, percent: int) -> list[np.ndarray]:
    """The first n - ceil(t * n) + 1 hashes of each set: those that aren't frequent by value, then
    the frequent ones, the rarest first."""
    out = []
    for s in sets:
        if len(sorted_frequent) and len(s):
            at = np.minimum(np.searchsorted(sorted_frequent, s), len(sorted_frequent) - 1)
            known = sorted_frequent[at] == s
            s = np.concatenate([s[~known], s[known][np.argsort(ranks[at[known]])]])
        out.append(s[: len(s) + (-len(s) * percent // 100) + 1])
    return out


#: Bytes of sets that a task gathers before it passes them on.
GATHERED = 32 << 20
WIDE = "node long, none boolean, id long, h long, n long, fine binary, prefix binary, fp long"


def gathered(rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
    """Rows of WIDE, those of equal nodes in one, with the least (none, id, h), as far as they come
    within GATHERED bytes."""
    fields = [c.split() for c in WIDE.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def out(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        rows = list(held.values())
        for k in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*rows[k : k + 512]), fields)], names=[name for name, _ in fields])

    held: dict[int, list] = {}
    size = 0
    for row in rows:
        was = held.setdefault(row[0], row)
        if row[1:4] < was[1:4]:
            was[1:4] = row[1:4]
        size += len(row[5]) + len(row[6]) + 100 if was is row else 0
        if size > GATHERED:
            yield from out(held)
            held, size = {}, 0
    yield from out(held)


def heads(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows of WIDE, in each task one for each different set of (id, h, text): its least (none, id, h),
    where none tells null ids. Sets are told apart by a hash."""
    common = frequent(docs, words)
    ranks = np.argsort(common)
    in_order = common[ranks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            for batch in batches:
                for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                    s = shingles(text, words)
                    node = xxhash.xxh64_intdigest(s.tobytes(), 7)
                    node -= (node >> 63) << 64
                    fp = simhash.fingerprint(text)
                    yield [node, i is None, i or 0, h, len(s), fine(s).tobytes(), prefixes([s], in_order, ranks, percent)[0].tobytes(), fp - (fp >> 63 << 64)]

        return gathered(rows())

    return map_batches(docs, run, WIDE)


def meetings(seen: DataFrame, percent: int, small: int = SMALL) -> DataFrame:
    """(u, v, token, rank, n): pairs of nodes that share a prefix hash (token and rank null), all of them
    where at most `small` nodes share it; where more do, each with the next larger and with the one
    in the middle, and these nodes (v null) with their rank by size in that token's bucket.

    A node that several tasks saw counts once. Rows come sorted by token and size, so a task holds
    TOGETHER of them, however many share a token; each part of a larger bucket has a middle of its own.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            times = [len(x) for x in parts]
            columns = [np.concatenate(parts or [np.empty(0, np.int64)]), *(np.repeat(batch.column(k).to_numpy(), times) for k in (0, 1))]
            for k in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)], pa.int64()) for x in columns], names=["token", "node", "n"])

    together = TOGETHER

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        open_: tuple[int, int, int, int] | None = None  # token, rows so far, last node and size of a bucket cut in parts

        def part(token: np.ndarray, node: np.ndarray, n: np.ndarray, more: bool) -> Iterator[pa.RecordBatch]:
            """Whole buckets; the first may go on from the part before, and the last (`more`) into the next."""
            nonlocal open_
            before = open_ if open_ and len(token) and open_[0] == token[0] else None
            new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])) if len(token) else np.empty(0, bool)
            if before and node[0] == before[2]:
                new[0] = False
            token, node, n = token[new], node[new], n[new]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
            size = np.diff(np.append(first, len(token)))
            at, own = np.arange(len(token)), np.repeat(np.arange(len(first)), size)
            rank = at - first[own]
            large = size > small
            if len(first):
                large[0] |= bool(before)
                large[-1] |= more
            big = large[own]
            pairs = [(at[ok], at[ok] + step) for step in range(1, small) for ok in ((rank + step < size[own]) & (~big | (step == 1)),)]
            pairs.append((at[big], (first + size // 2)[own[big]]))
            i, j = (np.concatenate(x) for x in zip(*pairs))
            u, v, least, most = node[i], node[j], np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            if before and len(token):
                u, v = np.append(u, before[2]), np.append(v, node[0])
                least, most = np.append(least, min(before[3], n[0])), np.append(most, max(before[3], n[0]))
                rank[own == 0] += before[1]
            ok = (u != v) & (least * 100 >= percent * most)
            found = np.unique(np.stack([np.minimum(u[ok], v[ok]), np.maximum(u[ok], v[ok])]), axis=1)
            for k in range(0, found.shape[1], 1 << 16):
                u, v = found[:, k : k + (1 << 16)]
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none, none], names=["u", "v", "token", "rank", "n"])
            big = np.flatnonzero(big)
            for k in range(0, len(big), 1 << 16):
                some = big[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), *(pa.array(x[some]) for x in (token, rank, n))], names=["u", "v", "token", "rank", "n"])
            if more:
                open_ = (int(token[-1]), int(rank[-1]) + 1, int(node[-1]), int(n[-1])) if len(token) else open_

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(3)])
            rows += batch.num_rows
            if rows < together:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            start = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
            # Whole buckets; of one that fills all of it, what is there.
            yield from part(*(x[:start] if start else x for x in columns), more=not start)
            held, rows = [[x[start:] for x in columns]] if start else [], rows - start if start else 0
        if held:
            yield from part(*(np.concatenate(x) for x in zip(*held)), more=False)

    dealt = map_batches(seen.select("node", "n", "prefix"), tokens, "token long, node long, n long").repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(meet, "u long, v long, token long, rank long, n long")


def fingerprint_links(nodes: DataFrame, *, radius: int = 3) -> DataFrame:
    """(u, v): what op10's comparison links, a star for equal fingerprints and its edges between different ones."""
    distinct = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep")), name="distinct")
    same = nodes.join(distinct, "fp").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    both = same.union(simhash.links(distinct, radius=radius))
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def of_nodes(wanted: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, n, fine) of the nodes that `wanted` has, each from the row that stands for it.

    Some wanted nodes go to where the rows are; only many make the rows move.
    """
    chosen = stored(nodes.join(wanted.select("node").distinct(), "node", "left_semi").hint("rebalance"), name="wanted")
    rows = seen.select("node", "none", "id", "h", "n", "fine")
    return rows.join(F.broadcast(chosen) if chosen.count() <= FEW else chosen, ["node", "none", "id", "h"], "left_semi").select("node", "n", "fine")


def not_ruled_out(x: list, y: list, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two tiles (node, n, label, sketch) of the pairs that labels, sizes and sketches leave; of one
    tile with itself each pair once. Sketches are compared at 8 words, then at twice as many and so on."""
    low, high = np.minimum(x[1][:, None], y[1]), np.maximum(x[1][:, None], y[1])
    ok = (x[2][:, None] != y[2]) & (x[0][:, None] != y[0]) & (low * 100 >= percent * high)
    i, j = np.nonzero(np.triu(ok) if same else ok)
    sizes = [np.array([len(b) for b in t[3]], np.int64) for t in (x, y)]
    words = SKETCH
    while len(i):
        deep = (sizes[0][i] >= words) & (sizes[1][j] >= words)
        if not deep.any():
            break
        bits, at = [], []
        for t, own in zip((x, y), (i[deep], j[deep])):
            rows, back = np.unique(own, return_inverse=True)
            bits.append(np.stack([folded(t[3][r], words) for r in rows]))
            at.append(back)
        apart = np.empty(len(at[0]), np.int64)
        step = max(1, COMPARED // words)
        for k in range(0, len(apart), step):
            apart[k : k + step] = np.bitwise_count(bits[0][at[0][k : k + step]] ^ bits[1][at[1][k : k + step]]).sum(1, dtype=np.int64)
        left = np.ones(len(i), bool)
        left[deep] = apart * (100 + percent) <= (x[1][i[deep]] + y[1][j[deep]]) * (100 - percent)
        i, j, words = i[left], j[left], 2 * words
    return i, j


def crossing(rows: DataFrame, nodes: DataFrame, seen: DataFrame, percent: int, tile: int) -> DataFrame:
    """(u, v): pairs of a token's rows (token, rank, node, n, label) whose labels differ and that sizes
    and fingerprints don't rule out; tiles of too different sizes don't meet. A pair comes from the
    least of the tokens that both have here, so that it is made once, however many these are."""
    mixed = rows.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("token")
    dealt = rows.join(mixed, "token", "left_semi")
    dealt = stored(dealt.hint("rebalance"), name="mixed")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [folded(b, min(len(b), TILED)).tobytes() for b in (np.frombuffer(x, "<u8") for x in batch.column("fine").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.binary())], names=["node", "sketch"])

    sketches = map_batches(of_nodes(dealt, nodes, seen).select("node", "fine"), short, "node long, sketch binary").dropDuplicates(["node"])
    held = dealt.groupBy("node").agg(F.array_sort(F.collect_set("token")).alias("tokens"))  # of a text's prefix
    marked = dealt.join(sketches.join(held, "node"), "node").withColumn("part", F.floor(F.col("rank") / tile))
    together = F.collect_list(F.struct("node", "n", "label", "sketch", "tokens")).alias("rows")
    tiles = stored(marked.groupBy("token", "part").agg(together, F.min("n").alias("low"), F.max("n").alias("high")), name="tiles")
    left, right = (tiles.select("token", *(F.col(c).alias(c + k) for c in ("part", "low", "high"))) for k in "12")
    pairs = left.join(right, "token").where(f"part1 < part2 and high1 * 100 >= {percent} * low2 or part1 = part2").select("token", "part1", "part2")
    for k in "12":
        pairs = pairs.join(tiles.select("token", F.col("part").alias(f"part{k}"), F.col("rows").alias(f"rows{k}")), ["token", f"part{k}"])

    def unpack(column: pa.Array) -> tuple[list, np.ndarray, list[np.ndarray]]:
        flat, at = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        node, n, label = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        tokens = flat.field(4)
        cuts = np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        return [node, n, label, [np.frombuffer(b, "<u8") for b in flat.field(3).to_pylist()]], at, np.split(tokens.flatten().to_numpy(zero_copy_only=False), cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, p, own), (b, q, other) = unpack(batch.column(2)), unpack(batch.column(3))
            for k, (token, same) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x, y = [c[p[k] : p[k + 1]] for c in a], [c[q[k] : q[k + 1]] for c in b]
                i, j = not_ruled_out(x, y, same, percent)
                first = [np.intersect1d(own[r], other[c], assume_unique=True)[0] == token for r, c in zip(p[k] + i, q[k] + j)]
                u, v = x[0][i[first]], y[0][j[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return map_batches(pairs.select("token", F.expr("part1 = part2").alias("same"), "rows1", "rows2"), run, "u long, v long").distinct()


def finely_ruled_out(pairs: DataFrame, nodes: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """(u, v, nu, nv): pairs without those that the fine sketches, as long as texts need, rule out."""
    pairs = stored(pairs.hint("rebalance"), name="pairs")
    fine_of = of_nodes(pairs.select(F.col("u").alias("node")).union(pairs.select("v")), nodes, seen)
    for side in "uv":
        pairs = pairs.join(fine_of.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("fine").alias(f"f{side}")).hint("shuffle_hash"), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
            both = zip(*([np.frombuffer(x, "<u8") for x in batch.column(f"f{s}").to_pylist()] for s in "uv"))
            apart = [int(np.bitwise_count(folded(x, k) ^ folded(y, k)).sum(dtype=np.int64)) for x, y in both for k in (min(len(x), len(y)),)]
            yield batch.select(["u", "v", "nu", "nv"]).filter(pa.array(np.array(apart, np.int64) * (100 + percent) <= sizes * (100 - percent)))

    return map_batches(pairs, run, "u long, v long, nu long, nv long").distinct()


def level(n, piece: int = PIECE):
    """How many leading bits part a set of n hashes into pieces of some `piece`; n: number or column."""
    if isinstance(n, int):
        return max(0, -(-n // piece) - 1).bit_length()
    return F.when(n > piece, F.length(F.bin(F.ceil(n / piece) - 1))).otherwise(0)


def verified(pairs: DataFrame, nodes: DataFrame, seen: DataFrame, texts: DataFrame, words: int, percent: int, piece: int) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets are alike.

    Sets of over `piece` hashes are compared piece by piece, so that no row grows with a text.
    """
    pairs = stored(finely_ruled_out(pairs, nodes, seen, percent), name="candidates")
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    chosen = nodes.join(needed, "node", "left_semi").select("node", F.col("id").alias("id_"), F.col("h").alias("h_"), F.col("none").alias("none_"))
    chosen = stored(chosen.hint("rebalance"), name="chosen")
    found = texts.join(F.broadcast(chosen) if chosen.count() <= FEW else chosen, (F.col("h") == F.col("h_")) & F.col("id").eqNullSafe(F.when(~F.col("none_"), F.col("id_"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text, words)
                # A partner may be larger and so be parted once more.
                for bits in {level(len(s), piece), level(len(s) * 100 // percent, piece)}:
                    cuts = np.searchsorted(s, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                    parts = [x.tobytes() for x in np.split(s, cuts)]
                    k = len(parts)
                    yield pa.RecordBatch.from_arrays([pa.array([node] * k, pa.int64()), pa.array([bits] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=["node", "bits", "piece", "hashes"])

    # Rows of the same id and text have the same set: one of each node will do.
    have = stored(map_batches(found.select("node", "text"), sets, "node long, bits int, piece int, hashes binary").dropDuplicates(["node", "bits", "piece"]), name="sets")
    work = pairs.withColumn("bits", level(F.greatest("nu", "nv"), piece)).withColumn("piece", F.explode(F.expr("sequence(0, shiftleft(1, bits) - 1)")))
    for side in "uv":
        work = work.join(have.select(F.col("node").alias(side), "bits", "piece", F.col("hashes").alias(f"h{side}")).hint("shuffle_hash"), [side, "bits", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*([np.frombuffer(x, np.uint64) for x in batch.column(f"h{s}").to_pylist()] for s in "uv"))
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "v", "nu", "nv")), pa.array(common, pa.int64())], names=["u", "v", "nu", "nv", "common"])

    counted = map_batches(work.select("u", "v", "nu", "nv", "hu", "hv"), run, "u long, v long, nu long, nv long, common long").groupBy("u", "v").agg(F.sum("common").alias("common"), F.first("nu").alias("nu"), F.first("nv").alias("nv"))
    return stored(counted.where(f"common * 100 >= {percent} * (nu + nv - common)").select("u", "v"), name="edges")


def deduplicated(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80, tile: int = 256, piece: int = PIECE, small: int = SMALL) -> DataFrame:
    """One row of each class of near copies: the one with the smallest id, null ids last.

    Two texts link if the Jaccard similarity of their sets of word shingles is `percent` hundredths
    or more; classes are what links connect. Texts without words are copies of each other. Each row
    is judged by its own text, also where ids repeat or are null; of rows that have the same id and
    the same text one stays.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    seen = stored(heads(texts, words, percent), name="heads")
    nodes = seen.groupBy("node").agg(F.min(F.struct("none", "id", "h", "fp")).alias("least")).select("node", "least.*")
    nodes = stored(nodes.hint("rebalance"), name="nodes")
    repeats = texts.groupBy("id", "h").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("_rid"), F.col("h").alias("_rh"))
    repeats = stored(repeats, name="repeats")
    met = stored(meetings(seen, percent, small).hint("rebalance"), name="meetings")
    first = fingerprint_links(nodes).union(met.where("v is not null").select("u", "v"))
    edges = verified(first.distinct(), nodes, seen, texts, words, percent, piece)
    reached = stored(components(edges).withColumnRenamed("node", "k"), name="reached")
    rows = met.where("v is null").select("token", "rank", F.col("u").alias("node"), "n")
    if not rows.isEmpty():
        rows = rows.join(reached, rows.node == reached.k, "left").select("token", "rank", "node", "n", F.coalesce("component", "node").alias("label"))
        more = verified(crossing(rows, nodes, seen, percent, tile), nodes, seen, texts, words, percent, piece)
        # Of what is connected already only the classes' own numbers are joined once more.
        for side in "uv":
            more = more.join(reached.select(F.col("k").alias(side), F.col("component").alias(f"c{side}")), side, "left")
        ends = components(more.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))).select(F.col("node").alias("class"), F.col("component").alias("end"))
        known = reached.join(ends, reached.component == F.col("class"), "left").select("k", F.coalesce("end", "component").alias("component"))
        reached = known.union(ends.join(reached, F.col("class") == F.col("k"), "left_anti").select("class", "end"))
    least = F.min(F.struct("none", "id", "h")).alias("least")
    named = nodes.select("node", "none", "id", "h").join(reached, nodes.node == reached.k, "left").withColumn("component", F.coalesce("component", "node"))
    keep = named.groupBy("component").agg(least).select(F.when(~F.col("least.none"), F.col("least.id")).alias("_kid"), F.col("least.h").alias("_kh"))
    own, mine = F.xxhash64(text), F.col(id_column).cast("long")

    def of(ids: DataFrame, i: str, h: str) -> DataFrame:
        i2, h2 = free_name(docs, i), free_name(docs, h)
        ids = ids.select(F.col(i).alias(i2), F.col(h).alias(h2)).hint("shuffle_hash")  # texts need no sorting
        return docs.join(ids, (own == F.col(h2)) & mine.eqNullSafe(F.col(i2)), "left_semi")

    if repeats.isEmpty():
        return of(keep, "_kid", "_kh")
    # Only rows whose id and text occur more than once need a second look.
    same = (F.col("_kh") == F.col("_rh")) & F.col("_kid").eqNullSafe(F.col("_rid"))
    again, once = keep.join(repeats, same, "left_semi"), keep.join(repeats, same, "left_anti")
    h = free_name(docs, "_own")
    first = of(again, "_kid", "_kh").withColumn(h, own).dropDuplicates([id_column, h]).select(*docs.columns)
    return of(once, "_kid", "_kh").unionByName(first)
