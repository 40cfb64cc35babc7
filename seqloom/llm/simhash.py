"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile against tile.

Every distinct fingerprint is put into a tile of fingerprints whose four 16-bit blocks have
the same population counts. Two fingerprints that differ in at most `radius` bits have block
counts that differ by at most `radius` in sum, so a pair of tiles beyond that is skipped
without loss; all other pairs are compared with exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sources.shared import stored

from .common import components, free_name, map_batches

BLOCKS = 4
WIDTH = 64 // BLOCKS


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; zero without words.

    A-Z are lower-cased, words are runs of anything but ASCII white space; a text of fewer
    words than a shingle takes is one shingle. A bit is set if over half the hashes set it.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(x) + 1 for x in tokens])
    starts = [0, *ends[: len(tokens) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """(id, h, fp): one row per input row; fp is the fingerprint as a signed 64-bit integer, h a hash
    of the text.

    A null text counts as empty, its fingerprint is zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["id", "h", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_hash(text_column).alias("h"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, run, "id long, h long, fp long")


def text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def tile_links(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all of a and b whose codes differ in at most `radius` bits.

    They are a spanning star of each component of the pair of tiles: at most one per code.
    """
    rows, cols = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        if len(i):
            rows.append(i + k)
            cols.append(j)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate(rows), np.concatenate(cols)
    if len(i) > 64:  # many links: labels settle to the smallest id of each component
        low_a, low_b = a_ids.copy(), b_ids.copy()
        while True:
            was = low_a.sum(), low_b.sum()
            np.minimum.at(low_b, j, low_a[i])
            np.minimum.at(low_a, i, low_b[j])
            if was == (low_a.sum(), low_b.sum()):
                break
        i, j = np.unique(i), np.unique(j)
        u, v = np.concatenate([a_ids[i], b_ids[j]]), np.concatenate([low_a[i], low_b[j]])
    else:
        u, v = a_ids[i], b_ids[j]
    keep = u != v
    return u[keep], v[keep]


def near_offsets(radius: int) -> list[list[int]]:
    """Differences of block counts that a pair within the radius can have, one of each +- pair."""
    reach = range(-radius, radius + 1)
    return [list(x) for x in product(reach, repeat=BLOCKS) if sum(map(abs, x)) <= radius and x >= (0,) * BLOCKS]


def links(distinct: DataFrame, *, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(u, v) edges over distinct fingerprints (fp, rep) that connect all within the radius."""
    low = (1 << WIDTH) - 1
    base = WIDTH + 1
    bits = [F.bit_count(F.shiftrightunsigned("fp", WIDTH * k).bitwiseAND(F.lit(low))) for k in range(BLOCKS)]
    kind = sum((b * base**k for k, b in enumerate(bits)), F.lit(0)).cast("int")
    rows = distinct.select("fp", "rep", kind.alias("kind"))
    sizes = rows.groupBy("kind").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    # At most (WIDTH + 1) ** BLOCKS rows, whatever the input: this side is safe to broadcast.
    sizes = stored(sizes, name="tiles")
    dealt = rows.join(F.broadcast(sizes), "kind").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = stored(dealt.groupBy("kind", "part").agg(F.collect_list(F.struct("fp", "rep")).alias("codes")), name="tiles")
    steps = F.array(*[F.array(*map(F.lit, x)) for x in near_offsets(radius)])
    counts = F.array(*[(F.floor(F.col("kind") / base**k) % base).cast("int") for k in range(BLOCKS)])
    moved = tiles.select("kind", "part", F.explode(steps).alias("step")).withColumn("at", F.zip_with(counts, "step", lambda x, y: x + y))
    moved = moved.where(F.forall("at", lambda x: (x >= 0) & (x <= WIDTH)))
    other = sum((F.col("at")[k] * base**k for k in range(BLOCKS)), F.lit(0)).cast("int")
    pairs = moved.select("kind", "part", other.alias("kind2")).join(F.broadcast(sizes.withColumnRenamed("kind", "kind2")), "kind2")
    pairs = pairs.select("kind", "part", "kind2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))
    pairs = pairs.where("kind <> kind2 or part <= part2")
    right = tiles.select(F.col("kind").alias("kind2"), F.col("part").alias("part2"), F.col("codes").alias("codes2"))
    work = pairs.join(tiles, ["kind", "part"]).join(right, ["kind2", "part2"]).select("codes", "codes2")

    def unpack(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        flat, at = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        fp, rep = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        return [(fp[p:q].view(np.uint64), rep[p:q]) for p, q in zip(at[:-1], at[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [tile_links(*x, *y, radius) for x, y in zip(unpack(batch.column(0)), unpack(batch.column(1)))]
            if got:
                u, v = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return map_batches(work, run, "u long, v long")


def classes(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(id, h, fp, component_id, copies) for each input row: see near_duplicates()."""
    seen = stored(fingerprints(docs, id_column=id_column, text_column=text_column, words=words), name="fingerprints")
    distinct = stored(seen.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), name="distinct")
    reached = components(links(distinct, radius=radius, tile=tile))
    named = distinct.join(reached, distinct.rep == reached.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "copies")
    return seen.join(named, "fp", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies): near-duplicate classes of a corpus.

    component_id is the smallest id reachable over links of at most `radius` differing bits.
    Equal fingerprints are compared once; nothing about pairs of copies is ever spelled out.
    Null or empty texts have fingerprint zero and link like any other. Repeated rows stay;
    a row with a null id keeps its fingerprint, gets a null component and links nothing.
    An empty table gives an empty result; other columns of the input are ignored.
    `copies` counts the rows that have exactly this fingerprint.
    """
    out = classes(docs, id_column=id_column, text_column=text_column, words=words, radius=radius, tile=tile)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


def deduplicated(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate class: of the rows with its smallest id that of the least text hash.

    Each row is judged by its own text, also where rows share an id; of rows with the same id
    and text one stays. Rows with a null id are kept: nothing tells which row they would repeat.
    """
    found = classes(docs, id_column=id_column, text_column=text_column, **options).where("id = component_id")
    kept, own = free_name(docs, "_kept"), free_name(docs, "_own")
    keep = found.groupBy("component_id").agg(F.min("h").alias(own)).withColumnRenamed("component_id", kept)
    marked = docs.withColumn("_h" + own, text_hash(text_column))
    first = marked.join(keep, (F.col(id_column).cast("long") == F.col(kept)) & (F.col("_h" + own) == F.col(own)), "left_semi").dropDuplicates([id_column])
    return first.select(*docs.columns).unionByName(docs.where(F.col(id_column).isNull()))
