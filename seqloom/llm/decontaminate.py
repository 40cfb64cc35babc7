"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A text region within `budget` edits of a benchmark passage of m bytes shares at least
m - q + 1 - q * budget of its q-grams, all on diagonals that differ by at most the budget.
Shared q-grams are counted in overlapping bands of diagonals; only bands that meet the bound
are aligned, with a banded dynamic programme over the passage and the region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.sources.shared import stored

from .common import free_name, map_batches, utf8

Q = 8
SLOTS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to a-z, ASCII white space to a blank; lengths don't change.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32
#: Bytes that words are made of.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Bytes of a text that are gone through at once.
WINDOW = 4 << 20
#: Bits of a hashed q-gram in the sieve before several blocks.
SIEVE_SLOTS = 24
#: Bytes of benchmark passages that travel to every task at once, their index taking some 40 times
#: as many; beyond it they go in blocks.
BLOCK_BYTES = 1 << 20


def folded(raw: np.ndarray) -> np.ndarray:
    return FOLD[raw]


def grams(text: np.ndarray) -> np.ndarray:
    """All runs of eight bytes, exactly, as integers."""
    if len(text) < Q:
        return np.empty(0, np.uint64)
    two = text[:-1].astype(np.uint64) | text[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def slot(g: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    return (g * MULTIPLIER >> np.uint64(64 - slots)).astype(np.int32)


def crowded(at: np.ndarray, classes: list[tuple[int, int]]) -> np.ndarray:
    """Which of the places `at`, ascending, lie in a run of `least` that fits in `width`, for some class
    (least, width)."""
    near = np.zeros(len(at), bool)
    for least, width in classes:
        runs = len(at) - least + 1
        if runs > 0:
            full = (at[least - 1 :] - at[:runs] < width).astype(np.int32)
            spread = np.zeros(len(at) + 1, np.int32)
            spread[:runs] += full
            spread[least : least + runs] -= full
            near |= np.cumsum(spread[:-1]) > 0
    return near


def distance_within(passage: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits of the passage against any part of `region` (free ends), and that part.

    None beyond the budget. Of equally good parts the one that ends first, then the one that
    starts last. Banded: within the budget a path starts on a diagonal of 0 or more and ends on
    one of len(region) - len(passage) or less, so it never leaves these by more than the budget.
    """
    m, n = len(passage), len(region)
    far = budget + 1
    if n + budget < m:
        return None
    low, width = -budget, n - m + 2 * budget + 1
    ramp = np.arange(width, dtype=np.int64)
    # Cell d of row i stands for the first i bytes of the passage and the first i + low + d of the region.
    j = ramp + low
    dist = np.where((j >= 0) & (j <= n), 0, far)
    start = np.clip(j, 0, n)
    padded = np.full(m + width + budget + 1, 256, np.int16)
    padded[budget : budget + n] = region  # padded[k] is region[k + low]
    for i in range(1, m + 1):
        diagonal = dist + (padded[i - 1 : i - 1 + width] != passage[i - 1])
        up = np.append(dist[1:], far) + 1
        best = np.minimum(diagonal, up)
        origin = np.where(diagonal <= up, start, np.append(start[1:], 0))
        best[(ramp < -low - i) | (ramp > n - low - i)] = far + m
        # Runs of insertions: the least of best[k] + (d - k) over k <= d, of several the last k.
        run = np.minimum.accumulate((best - ramp) * (width + 1) + (width - ramp))
        dist = run // (width + 1) + ramp
        start = origin[width - run % (width + 1)]
        dist[(ramp < -low - i) | (ramp > n - low - i)] = far
        if dist.min() >= far:
            return None
    end = int(dist.argmin())
    return (int(dist[end]), int(start[end]), m + low + end) if dist[end] < far else None


def apart(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping (edits, start, stop, shared) the best: fewest edits, then first."""
    taken: list[tuple[int, int, int, int]] = []
    for x in sorted(spans, key=lambda x: (*x[:3], -x[3])):
        if all(x[2] <= t[1] or x[1] >= t[2] for t in taken):
            taken.append(x)
    return taken


def whole_words(raw: np.ndarray, ends: np.ndarray, short: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item, start, end, 0) of passages without a q-gram: only exact, and only where
    neither neighbour goes on with a word."""
    if short:
        for d in range(len(ends) - 1):
            own = folded(raw[ends[d] : ends[d + 1]]).tobytes()
            for item, passage in short:
                free = 0
                at = own.find(passage)
                while at >= 0:
                    stop = at + len(passage)
                    if at >= free and not (at and WORD[own[at - 1]] and WORD[own[at]]) and not (stop < len(own) and WORD[own[stop]] and WORD[own[stop - 1]]):
                        yield d, item, at, stop, 0
                        free = stop
                    at = own.find(passage, at + 1)


class Sieve:
    """Tells texts that can't hold a passage of any block, by the places of its q-grams' hashes alone."""

    def __init__(self):
        self.hit = np.zeros(1 << SIEVE_SLOTS, bool)
        self.classes: list[tuple[int, int]] = []
        self.short: list[tuple[int, bytes]] = []

    def add(self, block: Passages) -> None:
        self.short += block.short
        if block.size:
            self.hit[slot(block.distinct, SIEVE_SLOTS)] = True
            self.classes = sorted({*self.classes, *block.classes}, key=lambda c: (c[1], c[0]))
            while len(self.classes) > 16:  # a class of the least of both and the widest of both loses nothing
                (a, _), (b, wide), *rest = self.classes
                self.classes = [(min(a, b), wide), *rest]

    def may(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each text may match."""
        at = [k + np.flatnonzero(self.hit[slot(grams(folded(raw[k : k + WINDOW + Q - 1])), SIEVE_SLOTS)]) for k in range(0, len(raw), WINDOW)]
        at = np.concatenate(at or [np.empty(0, np.int64)])
        out = np.zeros(len(ends) - 1, bool)
        out[np.searchsorted(ends, at[crowded(at, self.classes)], side="right") - 1] = True
        out[[d for d, *_ in whole_words(raw, ends, self.short)]] = True
        return out


class Passages:
    """An index of benchmark passages: which q-gram stands where."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids, self.texts, self.budget, self.bound, self.short = [], [], [], [], []
        keys, owners, places = [], [], []
        for item, text in items:
            t = folded(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
            g = grams(t)
            if not len(g):
                if len(t):
                    self.short.append((item, t.tobytes()))
                continue
            # The budget that leaves at least one shared q-gram by the lemma.
            budget = min(int(rate * len(t)), (len(g) - 1) // Q)
            keys.append(g)
            owners.append(np.full(len(g), len(self.ids), np.int32))
            places.append(np.arange(len(g), dtype=np.int32))
            self.ids.append(item)
            self.texts.append(t)
            self.budget.append(budget)
            self.bound.append(len(g) - Q * budget)
        self.size = len(self.ids)
        if not self.size:
            return
        key, owner, place = (np.concatenate(x) for x in (keys, owners, places))
        order = np.lexsort((place, owner, key))
        self.key, self.owner, self.place = key[order], owner[order], place[order]
        self.distinct, self.first = np.unique(self.key, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.key)))
        self.hit = np.zeros(1 << SLOTS, bool)
        self.hit[slot(self.distinct)] = True
        self.bounds, self.budgets = np.array(self.bound), np.array(self.budget)
        self.lengths = np.array([len(t) for t in self.texts])
        # Classes of passages of like length: the least bound, the widest window.
        order = np.argsort(self.lengths, kind="stable")
        self.classes = [(int(self.bounds[c].min()), int((self.lengths[c] + self.budgets[c]).max())) for c in np.array_split(order, min(8, self.size))]

    def regions(self, text: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text number, passage number, edits, start, end, shared q-grams) of each region found."""
        g = grams(text)
        at = np.flatnonzero(self.hit[slot(g)])
        if not len(at):
            return
        # A first pass over hashed q-grams (too many at most): keep what lies in a window with
        # enough of them for some class of lengths, as runs of `least` hits that fit in.
        near = crowded(at, self.classes)
        at = at[near]
        where = np.searchsorted(self.distinct, g[at])
        where[where == len(self.distinct)] = 0
        ok = self.distinct[where] == g[at]
        at, where = at[ok], where[ok]
        doc = np.searchsorted(ends, at, side="right") - 1
        ok = at + Q <= ends[doc + 1]
        at, where, doc = at[ok], where[ok], doc[ok]
        step = max(1, int((1 << 21) // max(1, self.count.max())))
        parts = np.searchsorted(doc, np.unique(doc)) if len(doc) else np.empty(0, int)
        k = 0
        while k < len(at):  # whole texts at a time, so that no region is cut
            stop = k + step
            later = parts[parts >= stop]
            stop = int(later[0]) if len(later) else len(at)
            yield from self._banded(text, ends, at[k:stop], where[k:stop], doc[k:stop])
            k = stop

    def found(self, raw: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """regions() of whole texts; a very long one is gone through in overlapping windows."""
        if not self.size or not len(raw):
            return []
        beyond = 4 * int((self.lengths + self.budgets).max()) + Q
        pieces = []
        for d in range(len(ends) - 1):
            for k in range(int(ends[d]), int(ends[d + 1]), WINDOW):
                if k == ends[d] or ends[d + 1] - k > beyond:
                    pieces.append((d, k, min(k + WINDOW + beyond, int(ends[d + 1]))))
        if all(b - a == ends[d + 1] - ends[d] for d, a, b in pieces):
            return list(self.regions(folded(raw), ends))
        best: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for d, a, b in pieces:
            for _, o, edits, start, stop, shared in self.regions(folded(raw[a:b]), np.array([0, b - a])):
                best.setdefault((d, o), []).append((edits, start + a - int(ends[d]), stop + a - int(ends[d]), shared))
        return [(d, o, *x) for (d, o), spans in sorted(best.items()) for x in apart(spans)]

    def _banded(self, text: np.ndarray, ends: np.ndarray, at: np.ndarray, where: np.ndarray, doc: np.ndarray):
        n = self.count[where]
        index = np.repeat(self.first[where] - np.cumsum(n) + n, n) + np.arange(n.sum())
        owner, place = self.owner[index], self.place[index].astype(np.int64)
        at, doc = np.repeat(at, n), np.repeat(doc, n)
        # Overlapping bands: each is twice the budget + 1 wide and starts every budget + 1, so
        # any run of budget + 1 diagonals lies in one of them.
        wide = self.budgets[owner] + 1
        diagonal = at - ends[doc] - place + (1 << 20)
        pair = doc * self.size + owner
        found: list[tuple[int, int, int, int, int]] = []
        for shift in (0, 1):
            band = (diagonal // wide + shift) // 2
            order = np.lexsort((band, pair))
            change = np.flatnonzero(np.append(True, (pair[order[1:]] != pair[order[:-1]]) | (band[order[1:]] != band[order[:-1]])))
            size = np.diff(np.append(change, len(order)))
            first = order[change]
            for k in np.flatnonzero(size >= self.bounds[owner[first]]):
                own = order[change[k] : change[k] + size[k]]
                # A q-gram of the passage counts once, however often the band repeats it.
                shared, o = len(np.unique(place[own])), int(owner[first[k]])
                if shared >= self.bound[o]:
                    diagonals, times = np.unique(diagonal[own], return_counts=True)
                    low = (int(diagonal[first[k]] // wide[first[k]] + shift) // 2 * 2 - shift) * (self.budget[o] + 1) - (1 << 20)
                    found.append((int(doc[first[k]]), o, -shared, low, int(diagonals[times.argmax()]) - (1 << 20)))
        best: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for d, o, less, low, main in sorted(set(found)):
            passage, budget, spans = self.texts[o], self.budget[o], best.setdefault((d, o), [])
            if any(e == 0 and abs(a - low) <= 3 * (budget + 1) for e, a, *_ in spans):
                continue  # a neighbouring band of a region that is known to be equal
            own = text[ends[d] : ends[d + 1]]
            if main >= 0 and np.array_equal(own[main : main + len(passage)], passage):
                spans.append((0, main, main + len(passage), -less))
                continue
            lo, hi = max(0, low - budget), min(len(own), low + 2 * (budget + 1) + len(passage) + budget)
            if lo < hi and (got := distance_within(passage, own[lo:hi], budget)):
                spans.append((got[0], lo + got[1], lo + got[2], -less))
        for (d, o), spans in sorted(best.items()):
            for span in apart(spans):
                yield d, o, *span


def blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's passages in blocks of a bounded size, each small enough to travel to all tasks.

    They are read block by block; an id's repeated texts all count; null and empty texts don't.
    """
    rows = benchmark.select(F.col(id_column).cast("long").alias("item"), F.col(text_column).cast("string").alias("text"))
    rows = rows.where("item is not null and text is not null and octet_length(text) > 0").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(1, -(-size // block_bytes))
    for k in range(parts):
        yield sorted((r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect())


def matches(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", rate: float = 0.1) -> DataFrame:
    """(doc_id, item_id, edits, start, stop, shared): each region of a text that holds a passage.

    A region matches if at most `rate` of the passage's UTF-8 bytes have to be inserted, deleted
    or replaced, after A-Z are lower-cased and each white space character counts as a blank;
    for short passages the budget is what the q-gram lemma allows ((m - 8) // 8). start and
    stop are bytes of the text, shared the q-grams that its band shares with it. Overlapping regions of one passage give the best one alone.
    Passages under eight bytes match exactly alone, as whole words (shared is 0). Null or empty
    texts have no match; repeated rows give repeated matches; rows with a null id match too.
    A benchmark beyond one block (1 MB) goes block after block over the documents that a sieve over
    all of its q-grams lets through, which loses none.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    context, sieve, number = docs.sparkSession.sparkContext, Sieve(), 0
    for items in blocks(benchmark, item_column, "text"):
        block, number = Passages(items, rate), number + 1
        sieve.add(block)
    if number == 1:
        return _matched(rows, context.broadcast(block))
    # All documents are gone through once; each block then meets those that may match alone.
    sent = context.broadcast(sieve)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.may(*utf8(batch.column(1)))))

    left, out = stored(map_batches(rows, sift, "doc_id long, text string"), name="sifted"), None
    for items in blocks(benchmark, item_column, "text"):
        shared = context.broadcast(Passages(items, rate))
        part = stored(_matched(left, shared), name="matches")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _matched(rows: DataFrame, shared: Broadcast[Passages]) -> DataFrame:
    """(doc_id, item_id, ...) of rows (doc_id, text) and one block of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = shared.value
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            found = passages.found(raw, ends)
            doc, owner, edits, start, stop, times = (np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 6
            ids = pa.array([passages.ids[o] for o in owner], pa.int64())
            exact = list(whole_words(raw, ends, passages.short))
            if exact:
                d, item, *span = (np.array(x, np.int64) for x in zip(*exact))
                doc, edits, start, stop, times = (np.concatenate(x) for x in zip((doc, edits, start, stop, times), (d, np.zeros(len(d), np.int64), *span)))
                ids = pa.concat_arrays([ids, pa.array(item, pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), ids, *(pa.array(x.astype(np.int32)) for x in (edits, start, stop, times))], names=["doc_id", "item_id", "edits", "start", "stop", "shared"])

    return map_batches(rows, run, "doc_id long, item_id long, edits int, start int, stop int, shared int")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", rate: float = 0.1) -> DataFrame:
    """The rows of `docs` that hold no benchmark passage; the columns stay as they are.

    Each row is judged by its own text, also where rows share an id or have none; rows that can't
    match (null text) are kept.
    """
    leaks, text = free_name(docs, "_leaks"), F.col(text_column).cast("string")
    own = F.xxhash64(F.col(id_column).cast("long"), text)  # copies of a text are different rows by their ids
    found = matches(docs.select(own.alias("row"), text.alias("text")), benchmark, id_column="row", item_column=item_column, rate=rate)
    found = stored(found.select(F.col("doc_id").alias(leaks)).distinct(), name="leaks")
    return docs.join(found, own == F.col(leaks), "left_anti")
