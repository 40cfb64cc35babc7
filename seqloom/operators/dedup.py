"""Removing repeated and nearly repeated reads.

Three-anchor rule: a read goes if any of its windows of w bases equals the head, middle or end
window of a read that was kept before it. The order is that of the sequences, so the outcome is
deterministic. Decisions are made in rounds: a read that no smaller undecided one hits stays, and
what it hits goes. After a few rounds what is left falls apart into groups of reads that share no
anchor with others: each is settled in order by itself, many at once, and of a group beyond
a bound its first block in the order, before the next round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import anchors
from seqloom.operators.components import components
from seqloom.sources.shared import discard, stored


def exact(reads: DataFrame) -> DataFrame:
    """One row of each sequence: the smallest (sample, read_no)."""
    others = [c for c in reads.columns if c != "seq"]
    best = reads.groupBy("seq").agg(F.min(F.struct("sample", "read_no", *[c for c in others if c not in ("sample", "read_no")])).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) if c != "seq" else F.col("seq") for c in reads.columns])


#: Holders of an anchor that one task meets; an anchor that more reads hold is dealt to several.
HELD = 20_000
#: Holdings of a group that are settled in order at once: some 10 MB.
BOUND = 200_000
#: Rounds before groups are looked for: each leaves a small part of the reads, while looking costs as much as some rounds.
EARLY = 6
#: Shares of a group's order at which its first block may end.
SHARES = [0.5**k for k in range(1, 31)]


def holdings(numbered: DataFrame, width: int = 20) -> DataFrame:
    """(w, s, own, part, parts): which reads hold which anchor, their own or another's, where at least two
    do; an anchor is a number. Reads are (id, seq), distinct, the ids in the order of the sequences.

    Reads meet at anchors, never each other: the table grows with the reads, however many of
    them share an anchor, and the holders of one anchor are dealt to as many parts as they need. Reads
    shorter than `width` hold only themselves, so they are left out.
    """
    long = numbered.where(F.length("seq") >= width).select("id", "seq")
    odd = "(?s)." if width > anchors.ROOM else "[^ACGTN]"
    seen = long.agg(F.count("*").alias("n"), F.max(F.col("seq").rlike(odd)).alias("odd")).first()
    found = stored(anchors.met(long, width, seen.n, HELD), name="held") if width <= anchors.ROOM else None
    if seen.odd:
        others = spelled_out(long.where(F.col("seq").rlike(odd)), width, odd)
        found = others if found is None else found.union(others)
    elif found is None:
        return long.select(*[F.lit(0).cast(t).alias(c) for c, t in (("w", "long"), ("s", "long"), ("own", "boolean"), ("part", "int"), ("parts", "int"))]).limit(0)
    # One row in some HELD at most, so they go to all tasks.
    many = F.broadcast(found.where("s is null").select("w", F.ceil(F.col("n") / HELD).cast("int").alias("many")))
    parts = F.coalesce("many", F.lit(1))
    held = found.where("s is not null").join(many, "w", "left").select("w", "s", "own", F.pmod(F.xxhash64("s"), parts).cast("int").alias("part"), parts.alias("parts"))
    held.stored_at = getattr(found, "stored_at", None)
    return held


def spelled_out(reads: DataFrame, width: int, odd: str) -> DataFrame:
    """The same of windows with a letter that is no base or N, or too long for a number: (w, s, own, n), anchors numbered below 0."""
    last = F.length("seq") - width
    three = [F.substr("seq", i + 1, F.lit(width)) for i in (F.lit(0), F.floor((last + 1) / 2).cast("int"), last)]
    sources = reads.select(F.explode(F.array_distinct(F.array(*three))).alias("text"))
    windows = reads.select(F.col("id").alias("s"), *[x.alias(f"a{k}") for k, x in enumerate(three)], F.explode(F.array_distinct(S.kmers("seq", width))).alias("text")).where(F.col("text").rlike(odd))
    windows = windows.select("text", "s", ((F.col("text") == F.col("a0")) | (F.col("text") == F.col("a1")) | (F.col("text") == F.col("a2"))).alias("own"))
    # Of the hashed side each anchor is one row, so it is even whatever the reads; windows, many times as many, stay unsorted.
    held = stored(windows.join(sources.distinct().hint("shuffle_hash"), "text", "left_semi"), name="held")
    shared = held.groupBy("text").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(shared.select((-1 - F.monotonically_increasing_id()).alias("w"), "text", "n"), name="shared")
    rows = held.join(shared, "text").select("w", "s", "own", F.lit(None).cast("long").alias("n"))
    return stored(rows.union(shared.where(F.col("n") > HELD).select("w", F.lit(None).cast("long"), F.lit(None).cast("boolean"), "n")), name="held")


def to_parts(of_anchor: DataFrame) -> DataFrame:
    """A row a part of each anchor: what many holders are joined with, part by part."""
    return of_anchor.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def hit(held: DataFrame, sources: DataFrame) -> DataFrame:
    """(s): reads that hold an anchor of a smaller read among the sources, which are holdings of their own."""
    least = sources.groupBy("w").agg(F.min("s").alias("a"), F.first("parts").alias("parts"))
    return held.join(to_parts(least), ["w", "part"]).where("a < s").select("s").distinct()


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rule itself over rows (component, s, w, own), by component and in the order of reads: (s, goes).

    It holds the anchors kept in one component at a time.
    """
    kept: set[int] = set()
    decided: list[tuple[int, bool]] = []
    component = read = None
    windows: list[int] = []
    own: list[int] = []

    def decide() -> None:
        goes = not kept.isdisjoint(windows)
        if not goes:
            kept.update(own)
        decided.append((read, goes))

    def out() -> pa.RecordBatch:
        columns = list(zip(*decided)) or [(), ()]
        decided.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_())], names=["s", "goes"])

    for batch in batches:
        for c, s, w, mine in zip(*(x.to_pylist() for x in batch.columns)):
            if (c, s) != (component, read):
                if read is not None:
                    decide()
                if c != component:
                    kept.clear()
                component, read = c, s
                windows, own = [], []
            windows.append(w)
            if mine:
                own.append(w)
        yield out()
    if read is not None:
        decide()
    yield out()


def by_components(held: DataFrame, bound: int) -> DataFrame:
    """(s, goes): decisions on all reads of groups of at most `bound` holdings, and on the first such block
    of larger ones. Reads of a group share no anchor with those of another, and no read
    behind a block has a say in it, so both are those of the whole order."""
    least = held.groupBy("w").agg(F.min("s").alias("m"), F.first("parts").alias("parts"))
    stars = held.join(to_parts(least), ["w", "part"]).where("s <> m").select(F.col("s").alias("u"), F.col("m").alias("v"))
    group = components(stars)
    placed = held.join(group, held.s == group.node, "left").select(F.coalesce("component", "s").alias("component"), "s", "w", "own")
    placed = stored(placed, name="placed")
    large = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > bound)
    # The first share of a large group's order that stays within the bound; sketches merge on the map side.
    ends = placed.join(large, "component").groupBy("component").agg(F.first("n").alias("n"), F.percentile_approx("s", SHARES, 10_000).alias("ends"))
    which = F.least(F.greatest(F.ceil(F.log2(F.col("n") / bound)), F.lit(1)), F.lit(len(SHARES))).cast("int")
    ends = stored(ends.select("component", F.element_at("ends", which).alias("end")), name="blocks")
    first = placed.join(ends, "component", "left").where("end is null or s <= end").select("component", "s", "w", "own")
    dealt = first.repartition("component").sortWithinPartitions("component", "s")
    return stored(dealt.mapInArrow(in_order, "s long, goes boolean"), name="decided")


def three_anchor(reads: DataFrame, *, width: int = 20, strict: bool = False, rounds: int = 1000, bound: int = BOUND, early: int = EARLY) -> DataFrame:
    """Distinct reads that the rule keeps; strict drops every read that a smaller one's anchor hits,
    kept or not. Empty sequences never conflict; a read shorter than `width` is its own anchor.

    Each round keeps the undecided reads that no smaller undecided one hits (the smallest is
    always among them) and drops what these hit. After `early` rounds groups of at most `bound`
    holdings are settled in order first, and a block of that size of each larger one, so that a long
    chain of decisions costs no long row of rounds. Beyond `rounds` it raises: a part of a result
    is never returned.
    """
    unique = exact(reads)
    numbered = stored(unique.orderBy("seq").withColumn("_id", F.monotonically_increasing_id()), name="numbered")
    held = holdings(numbered.select(F.col("_id").alias("id"), "seq"), width)
    parts = [hit(held, held.where("own"))] if strict else []

    def without(rows: DataFrame, *decided: DataFrame) -> DataFrame:
        left = rows
        for d in decided:
            left = left.join(d.select(F.col("s").alias("d")), F.col("s") == F.col("d"), "left_anti")
        left = stored(left, name="anchors")
        discard(rows)
        return left

    def drops(rows: DataFrame, kept: DataFrame) -> DataFrame:
        """What the kept reads among `rows` hit."""
        gone = stored(hit(rows, rows.where("own").join(kept.select(F.col("s").alias("k")), F.col("s") == F.col("k"), "left_semi")), name="dropped")
        parts.append(gone)
        return gone

    for number in range(0 if strict else rounds):
        if held.isEmpty():
            break
        free = stored(held.select("s").distinct().join(hit(held, held.where("own")), "s", "left_anti"), name="kept")
        held = without(held, free, drops(held, free))
        discard(free)
        # Groups are looked for in what a round leaves, some eighth of the holdings here.
        if number >= early and not held.isEmpty():
            decided = by_components(held, bound)
            parts.append(decided.where("goes").select("s"))
            held = without(held, decided, drops(held, decided.where("not goes")))
    else:
        if not strict:
            raise RuntimeError(f"the three-anchor rule did not settle in {rounds} rounds")
    dropped = reduce(DataFrame.union, parts) if parts else numbered.select(F.col("_id").alias("s")).limit(0)
    return numbered.join(dropped, numbered._id == dropped.s, "left_anti").drop("_id")
