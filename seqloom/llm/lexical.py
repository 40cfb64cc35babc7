"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt into blocks, each with a bitmap a term and bit of the term's impact: bit b of
document d's impact stands at place d of slice b. Only those 64-bit words of a term's bitmaps are kept
that hold one of its documents. An item's scores are the sums of its terms' impacts, added for
all documents of a block at once by bitwise carries; the best of a block come out slice by slice
from the most significant bit down, and the best of all blocks are the best of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.shared import stored

from .common import map_batches, utf8

#: Documents of a block, and postings after which a block is closed early: both bound a task's memory.
BLOCK, POSTINGS = 2048, 1_000_000
#: Bytes of terms that are sent to every task; more are joined by a shuffle.
SENT = 16 << 20
#: Items that are asked at once, and different terms of them whose bitmaps are laid side by side.
ITEMS, TERMS = 512, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms(text: Column) -> Column:
    """All terms of a text in order, repeats included."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a batch of texts, and the text that each stands in."""
    raw, ends = utf8(column)
    inside = _IN_TERM[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    fresh = ends[:-1][ends[:-1] < len(raw)]
    starts[fresh] = inside[fresh]  # texts follow each other without a gap
    at = np.flatnonzero(starts)
    letters = _FOLD[raw[inside]]
    before = np.cumsum(inside)[at] - 1 if len(at) else np.empty(0, np.int64)
    offsets = np.append(before, len(letters)).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return found, np.searchsorted(ends, at, "right") - 1


LISTS = "block long, term string, slots array<int>, tfs array<long>, ns array<long>, ids array<long>"
INDEX = "block long, term string, words array<int>, slices array<long>, ids array<long>"


def listed(docs: DataFrame, id_column: str, text_column: str, wanted: list[str] | None) -> DataFrame:
    """A row for each block and term: places in the block, occurrences, lengths of the documents; and one
    without a term for each block, with the lengths and ids of all its documents.

    A block is made of documents of one task, so nothing is shuffled.
    """
    spark = docs.sparkSession
    shared = None if wanted is None else spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if shared is None else pa.array(shared.value, pa.string())
        block = TaskContext.get().partitionId() << 32
        number: dict[str, int] = {}
        codes, slots, tfs, ns, ids, lengths = ([] for _ in range(6))
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            code, slot, tf, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (codes, slots, tfs, ns))
            order = np.lexsort((slot, code))
            ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(number)))])
            names = list(number)
            pick = lambda x, a, b, kind: pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), pa.array(x[order[ends[a] : ends[b]]], kind))
            for a in range(0, len(names), 256):
                b = min(a + 256, len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * (b - a), pa.int64()), pa.array(names[a:b], pa.string()), pick(slot, a, b, pa.int32()), pick(tf, a, b, pa.int64()), pick(n, a, b, pa.int64()), pa.nulls(b - a, pa.list_(pa.int64()))],
                    names=["block", "term", "slots", "tfs", "ns", "ids"],
                )
            own, long = pa.concat_arrays(ids), np.concatenate(lengths)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), one(pa.array(long, pa.int64())), one(own)],
                names=["block", "term", "slots", "tfs", "ns", "ids"],
            )

        for batch in batches:
            found, where = tokens(batch.column(1))
            length = np.bincount(where, minlength=batch.num_rows)
            coded = found.dictionary_encode()
            code, dictionary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            use = np.ones(len(dictionary), bool) if only is None else pc.is_in(dictionary, value_set=only).to_numpy(zero_copy_only=False)
            mine = use[code] if len(code) else np.empty(0, bool)
            pairs, times = np.unique(where[mine] * len(dictionary) + code[mine], return_counts=True)
            doc, code = np.divmod(pairs, max(1, len(dictionary)))
            renamed = np.zeros(len(dictionary), np.int64)
            now = np.flatnonzero(use)
            for lo in range(0, batch.num_rows, 64):
                hi = min(lo + 64, batch.num_rows)
                a, b = np.searchsorted(doc, [lo, hi])
                if ids and (sum(map(len, ids)) + hi - lo > BLOCK or size + b - a > POSTINGS):
                    yield from out()
                    block, size = block + 1, 0
                    for x in (number, codes, slots, tfs, ns, ids, lengths):
                        x.clear()
                if not number or lo == 0:
                    renamed[now] = [number.setdefault(t, len(number)) for t in dictionary.take(pa.array(now)).to_pylist()]
                codes.append(renamed[code[a:b]])
                slots.append(doc[a:b] - lo + sum(map(len, ids)))
                tfs.append(times[a:b])
                ns.append(length[doc[a:b]])
                ids.append(batch.column(0).slice(lo, hi - lo))
                lengths.append(length[lo:hi])
                size += b - a
        if ids:
            yield from out()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return stored(map_batches(rows, run, LISTS).where("term is null or size(slots) > 0"), name="lists")


def sliced(weighted: DataFrame, documents: int, all_terms: int) -> DataFrame:
    """Lists (with w) as bitmaps: `words` are the 64-bit words that hold a document, `slices` for each
    of them its bits of the impacts, least significant first, BITS a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, tf, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slots", "tfs", "lengths"))
            counts = pc.fill_null(pc.list_value_length(batch.column("slots")), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), counts)
            w = batch.column("w").fill_null(0).to_numpy(zero_copy_only=False)[row]
            m = 50 + (50 * n * documents) // max(1, all_terms)
            impact = w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            word = row * BLOCK + (slots >> 6)  # slots rise within a row
            first = np.flatnonzero(np.diff(word, prepend=-1))
            place = (slots & 63).astype(np.uint64)
            out = np.zeros((len(first), BITS), np.uint64)
            for b in range(BITS if len(first) else 0):
                out[:, b] = np.bitwise_or.reduceat(((impact >> b) & 1).astype(np.uint64) << place, first)
            per = np.bincount(row[first], minlength=batch.num_rows)
            ends = np.concatenate([[0], np.cumsum(per)])
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((slots[first] >> 6).astype(np.int32)))
            slices = pa.ListArray.from_arrays(pa.array(ends * BITS, pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("term"), words, slices, batch.column("ids")], names=["block", "term", "words", "slices", "ids"])

    return map_batches(weighted.select("block", "term", "slots", "tfs", F.when(F.col("term").isNotNull(), F.col("ns")).alias("lengths"), "ids", "w"), run, INDEX)


#: Bits of an impact: a weight of at most 2^17 (N up to 2^180) times less than 2^20.
BITS = 37


def small(df: DataFrame, size: Column) -> DataFrame:
    """`df` to be broadcast if its bytes, counted here, are few; else as it is, for a shuffle join."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= SENT else df


def index(docs: DataFrame, vocabulary: DataFrame | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index of all documents, for the terms of `vocabulary` (term) or for all: (block, term, words,
    slices, ids), and for each block a row without a term that has its documents' ids.

    Counts of documents and terms are over all documents whatever the vocabulary. Documents without
    a term, null texts among them, count for neither and are never found.
    """
    wanted = None
    if vocabulary is not None:
        vocabulary = stored(vocabulary.select("term").distinct(), name="vocabulary")
        if (vocabulary.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) <= SENT:
            wanted = [r.term for r in vocabulary.collect()]
    lists = listed(docs, id_column, text_column, wanted)
    if vocabulary is not None and wanted is None:
        lists = lists.where("term is null").unionByName(lists.join(vocabulary, "term", "left_semi").select(lists.columns))
    total = lists.where("term is null").agg(
        F.sum(F.size(F.filter("ns", lambda n: n > 0))).alias("n"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")
    ).first()
    documents, all_terms = total.n or 0, total.l or 0
    share = F.lit(float(2 * documents + 2)) / (2 * F.sum(F.size("slots")).cast("double") + 1)
    weights = lists.where("term is not null").groupBy("term").agg(F.floor(1000 * F.ln(share)).cast("long").alias("w"))
    weighted = lists.join(small(stored(weights, name="weights"), F.octet_length("term") + 24), "term", "left")
    return stored(sliced(weighted, documents, all_terms), name="slices")


def added(total: np.ndarray, more: np.ndarray, which: np.ndarray, items: int) -> None:
    """total[:, :items] += more[:, which] in bit-sliced numbers: slices first, carries rippling upward."""
    carry = np.zeros((items, total.shape[2]), np.uint64)
    for b in range(len(total)):
        x = total[b, :items]
        if b < len(more):
            y = more[b][which]
            both = x ^ y
            carry, total[b, :items] = (x & y) | (carry & both), both ^ carry
        else:
            if not carry.any():
                return
            carry, total[b, :items] = carry & x, x ^ carry


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(surely among the k best, equal last ones) as bitmaps for each item, of documents above 0."""
    some = np.bitwise_or.reduce(total, axis=0)
    sure, tied = np.zeros_like(some), some
    for b in range(len(total) - 1, -1, -1):
        have = sure | (tied & total[b])
        n = np.bitwise_count(have).sum(1)
        many, few = (n > k)[:, None], (n < k)[:, None]
        tied = np.where(many, tied & total[b], np.where(few, tied & ~total[b], np.uint64(0)))
        sure = np.where(many, sure, have)
    return sure, tied


def asked(bitmaps: dict[str, tuple[np.ndarray, np.ndarray]], ids: pa.Array, items: list[tuple[int, list[str]]], k: int) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score): the k best of a block for each item."""
    width = -(-len(ids) // 64)
    keys, missing = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    items = sorted(((n, [t for t in ts if t in bitmaps]) for n, ts in items), key=lambda x: -len(x[1]))
    items = [x for x in items if x[1]]
    at = 0
    while at < len(items):
        number: dict[str, int] = {}
        stop = at
        while stop < len(items) and (stop == at or len(number) + len(items[stop][1]) <= TERMS):
            for t in items[stop][1]:
                number.setdefault(t, len(number))
            stop += 1
        part, at = items[at:stop], stop
        slices = np.zeros((BITS, len(number), width), np.uint64)
        for t, j in number.items():
            words, own = bitmaps[t]
            slices[:, j, words] = own.T
        total = np.zeros((BITS + len(part[0][1]).bit_length(), len(part), width), np.uint64)
        for j in range(len(part[0][1])):
            n = sum(len(ts) > j for _, ts in part)  # items come with their terms falling
            added(total, slices, np.array([number[ts[j]] for _, ts in part[:n]]), n)
        sure, tied = best(total, k)
        spread = lambda x: np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").astype(bool)
        sure, tied = spread(sure), spread(tied)
        for i, (item, _) in enumerate(part):
            mine, last = np.flatnonzero(sure[i]), np.flatnonzero(tied[i])
            last = last[np.lexsort((keys[last], missing[last]))][: k - len(mine)]
            mine = np.concatenate([mine, last])
            scores = np.zeros(len(mine), np.int64)
            for b in range(len(total)):
                scores |= ((total[b, i, mine >> 6] >> (mine & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(mine), pa.int64()), ids.take(pa.array(mine)), pa.array(scores)], names=["item", "doc_id", "score"])


def found(slices: DataFrame, items: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """The k best of each block for items (number, terms) that were collected for it."""
    spark = slices.sparkSession
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, wanted = shared.value, {t for _, ts in shared.value for t in ts}
        block, ids, bitmaps = None, None, {}
        for batch in batches:
            numbers, names = batch.column("block").to_pylist(), batch.column("term").to_pylist()
            for k_, (b, name) in enumerate(zip(numbers, names)):
                if b != block:
                    if ids is not None:
                        yield from asked(bitmaps, ids, mine, k)
                    block, ids, bitmaps = b, None, {}
                if name is None:
                    ids = batch.column("ids")[k_].values
                elif name in wanted:
                    own = batch.column("slices")[k_].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    bitmaps[name] = batch.column("words")[k_].values.to_numpy(zero_copy_only=False), own.reshape(-1, BITS)
        if ids is not None:
            yield from asked(bitmaps, ids, mine, k)

    asked_for = spark.createDataFrame([(t,) for t in sorted({t for _, ts in items for t in ts})], "term string")
    rows = slices.where("term is null").unionByName(slices.join(small(asked_for, F.octet_length("term") + 16), "term", "left_semi").select(slices.columns))
    return map_batches(rows.repartition("block").sortWithinPartitions("block"), run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Terms are runs of digits, letters and all that isn't ASCII, A-Z lower-cased. A term of df documents
    weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms scores for a term that it has
    tf times w * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N) div L. Equal scores go by ascending
    id, null ids last. Null texts have no terms; items without terms have no rows. Every row is a
    document and every row of `items` an item, also where ids repeat. Other columns are ignored; an empty
    table gives an empty result. Items are asked some ITEMS at a time against all blocks.
    """
    asking = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_column).cast("long").alias("item_id"), F.array_distinct(terms(F.col(item_text))).alias("terms")), name="items")
    slices = index(docs, asking.select(F.explode("terms").alias("term")), id_column=id_column, text_column=text_column)
    size = asking.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "terms"))), F.lit(0)).alias("bytes")).first()
    rounds = max(1, -(-size.n // ITEMS), -(-size.bytes // SENT))
    parts = None
    for r in range(rounds):
        batch = asking if rounds == 1 else asking.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r)
        got = found(slices, [(x.item, x.terms) for x in batch.where(F.size("terms") > 0).select("item", "terms").collect()], k)
        parts = got if parts is None else parts.unionByName(got)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(small(asking.select("item", "item_id"), F.lit(16)), "item").select("item_id", "rank", "doc_id", "score")


#: The same rows in DuckDB.
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
all_ AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM d),
q AS MATERIALIZED (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(w) AS term FROM (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM benchmark))),
p AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, all_ GROUP BY term, docs),
impacts AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(w)::BIGINT * docs) // total)))) AS impact FROM p JOIN weights USING (term) JOIN d USING (r), all_),
scores AS (SELECT item, item_id, r, sum(impact)::BIGINT AS score FROM q JOIN impacts USING (term) GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""
