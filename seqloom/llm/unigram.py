"""Unigram tokenisation: Viterbi over a double-array trie of scored pieces, and its inverse.

A text gets one leading space, spaces become the marker U+2581, and the segmentation with the
highest sum of piece scores wins; of equal sums, the one whose last piece starts first. A
character without a piece costs the lowest score less 10 and is written as one piece a byte.

No piece has a marker behind another character, and none holds a line feed, so a text falls
apart into chunks (markers with the word behind them; a line feed) that are segmented on their
own: the sum of the best is the best of the sum. Equal chunks are segmented once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MARKER = "▁"
#: Chunks that one worker remembers; later ones are segmented anew each time they are met.
MEMORY = 200_000
#: Longer chunks (in bytes) are segmented one by one, shorter ones many at a time.
WIDE = 48
LOW = -(1 << 60)


class Trie:
    """A double-array trie over bytes: the child of s by byte c is base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        base, check, value = [0], [-1], [-1]
        taken = bytearray(1)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        work, free = [(0, 0, len(keys), 0)], 1
        while work:
            state, lo, hi, depth = work.pop()
            if lo < hi and len(keys[lo]) == depth:
                value[state] = values[lo]
                lo += 1
            spans, k = [], lo
            while k < hi:
                c, start = keys[k][depth], k
                while k < hi and keys[k][depth] == c:
                    k += 1
                spans.append((c, start, k))
            if not spans:
                continue
            first, tries = spans[0][0], 0
            slot = taken.find(0, max(free, first + 1))
            while slot >= 0 and any(slot - first + c < len(taken) and taken[slot - first + c] for c, _, _ in spans):
                slot, tries = taken.find(0, slot + 1), tries + 1
            if slot < 0:
                slot = max(len(taken), first + 1)
            if tries > 64:  # what lies below is nearly full: leave its gaps
                free = slot
            at = slot - first
            need = at + 256 - len(taken)
            if need > 0:
                taken.extend(bytes(need))
                base.extend([0] * need)
                check.extend([-1] * need)
                value.extend([-1] * need)
            base[state] = at
            for c, start, stop in spans:
                taken[at + c] = 1
                check[at + c] = state
                work.append((at + c, start, stop, depth + 1))
        pad = 256  # a state without children has base 0: its steps must stay inside
        self.base = np.array(base + [0] * pad, np.int32)
        self.check = np.array(check + [-1] * pad, np.int32)
        self.value = np.array(value + [-1] * pad, np.int32)
        self.check[0] = -1
        self.depth = max(map(len, keys), default=0)

    def get(self, key: bytes) -> int:
        state = 0
        for c in key:
            step = int(self.base[state]) + c
            if self.check[step] != state:
                return -1
            state = step
        return int(self.value[state])


class Unigram:
    """Pieces with log scores; encode() and decode() of whole texts."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        normal = [i for i in range(len(pieces)) if i not in special]
        self.trie = Trie([pieces[i].encode() for i in normal], normal)
        self.scores = np.array(scores, np.float64)
        self.unknown = min((scores[i] for i in normal), default=0.0) - 10
        self.lead = np.array([1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4 for c in range(256)], np.int64)
        self.bytes_as = np.zeros(256, np.int32)
        for byte, i in byte_ids.items():
            self.bytes_as[byte] = i
        turned = {i: bytes([b]) for b, i in byte_ids.items()}
        self.raw = [turned.get(i, b"" if i in special else p.replace(MARKER, " ").encode()) for i, p in enumerate(pieces)]
        inside = [p for i, p in enumerate(pieces) if i not in special and (MARKER in p.lstrip(MARKER) or "\n" in p)]
        if inside:
            raise ValueError(f"pieces cross the places where texts are cut: {inside[:3]}")
        self.known: dict[str, bytes] = {}

    def one(self, chunk: bytes) -> bytes:
        """The ids of one chunk, step by step."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(chunk)
        best, start, piece = [LOW] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        i = 0
        while i < n:
            width, state, single = int(self.lead[chunk[i]]), 0, False
            for j in range(i, n):
                step = int(base[state]) + chunk[j]
                if check[step] != state:
                    break
                state = step
                if (found := int(value[state])) >= 0:
                    single |= j + 1 - i == width
                    if (sum_ := best[i] + self.scores[found]) > best[j + 1]:
                        best[j + 1], start[j + 1], piece[j + 1] = sum_, i, found
            if not single and (sum_ := best[i] + self.unknown) > best[min(i + width, n)]:
                to = min(i + width, n)
                best[to], start[to], piece[to] = sum_, i, -1
            i += width
        out, at = [], n
        while at:
            out.append([piece[at]] if piece[at] >= 0 else self.bytes_as[list(chunk[start[at] : at])].tolist())
            at = start[at]
        return np.array([x for part in reversed(out) for x in part], np.int32).tobytes()

    def many(self, chunks: np.ndarray) -> list[bytes]:
        """The ids of chunks of one length, a row of bytes each; all rows take each step together."""
        n, length = chunks.shape
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((length + 1, n), LOW, np.float64)
        start, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
        best[0] = 0
        text = np.ascontiguousarray(chunks.T)
        width = self.lead[text]
        for i in range(length):
            rows = np.flatnonzero((text[i] & 0xC0) != 0x80)
            if not len(rows):
                continue
            single = np.zeros(n, bool)
            state, here, live = np.zeros(len(rows), np.int32), best[i][rows], rows
            for j in range(i, length):
                step = base[state] + text[j][live]
                ok = check[step] == state
                if not ok.all():
                    live, step, here = live[ok], step[ok], here[ok]
                    if not len(live):
                        break
                state = step
                found = value[state]
                hit = found >= 0
                if hit.any():
                    at, got = live[hit], found[hit]
                    single[at[width[i][at] == j + 1 - i]] = True
                    total = here[hit] + self.scores[got]
                    more = total > best[j + 1][at]
                    at = at[more]
                    best[j + 1][at], start[j + 1][at], piece[j + 1][at] = total[more], i, got[more]
            lost = rows[~single[rows]]
            if len(lost):
                to = np.minimum(i + width[i][lost], length)
                total = best[i][lost] + self.unknown
                more = total > best[to, lost]
                to, lost = to[more], lost[more]
                best[to, lost], start[to, lost], piece[to, lost] = total[more], i, -1
        ids, lens = np.full((n, length), -1, np.int32), np.zeros(n, np.int64)
        rows, at = np.arange(n), np.full(n, length)
        while len(rows):  # back from the ends
            got, was = piece[at, rows], start[at, rows]
            known = got >= 0
            ids[rows[known], lens[rows[known]]] = got[known]
            lens[rows[known]] += 1
            for r, a, b in zip(rows[~known], was[~known], at[~known]):
                for byte in chunks[r, a:b][::-1]:
                    ids[r, lens[r]] = self.bytes_as[byte]
                    lens[r] += 1
            going = was > 0
            rows, at = rows[going], was[going]
        return [ids[r, :k][::-1].tobytes() for r, k in enumerate(lens.tolist())]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks that are not in memory; as many as fit are remembered."""
        made: dict[str, bytes] = {}
        by: dict[int, list[tuple[str, bytes]]] = {}
        for chunk in chunks:
            raw = chunk.replace(" ", MARKER).encode("utf-8", "replace")
            by.setdefault(len(raw), []).append((chunk, raw))
        for length, group in by.items():
            if length > WIDE:
                made |= {chunk: self.one(raw) for chunk, raw in group}
                continue
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                rows = np.frombuffer(b"".join(raw for _, raw in part), np.uint8).reshape(len(part), length)
                made |= zip((chunk for chunk, _ in part), self.many(rows))
        if len(self.known) < MEMORY:
            self.known |= made
        return made

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; an empty or null text has none."""
        cut = CHUNKS.findall
        parts = [cut(" " + x) if x else [] for x in texts]
        known = self.known
        fresh = set().union(*parts) - known.keys()
        made = self.learn(fresh) if fresh else {}
        look = known.__getitem__ if not fresh or fresh <= known.keys() else lambda c: known.get(c) or made[c]
        return [np.frombuffer(b"".join(map(look, p)), np.int32) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: markers are spaces, byte pieces are joined, the leading space goes.

        Bytes that are no UTF-8 become U+FFFD; control pieces are empty.
        """
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


CHUNKS = re.compile(r" *[^ \n]+| +|\n")


@lru_cache(maxsize=4)
def load(model_bytes: bytes) -> Unigram:
    """From the bytes of a SentencePiece model file: its pieces and scores are used as they are."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    size = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(size)]
    byte_ids = {int(pieces[i][1:-1], 16): i for i in range(size) if m.is_byte(i)}
    special = {i for i in range(size) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
    return Unigram(pieces, [m.get_score(i) for i in range(size)], byte_ids, special)


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encoded(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", model: bytes | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, ids, n_ids, n_bytes, decoded_crc32, round_trip[, decoded]) for each input row.

    ids is the whole text's best segmentation, decoded the text that these ids give back,
    decoded_crc32 its unsigned CRC-32 and round_trip whether it equals the text; a text that
    holds the marker itself or a leading space-only difference is the only kind that does not.
    n_bytes counts byte pieces. A null or empty text has no ids and decodes to the empty text
    (round_trip is true for both). Rows are neither joined nor merged, so repeated rows and
    null ids stay; other columns are ignored; an empty table gives an empty result.
    The model (half a MB, a fixed file) travels with the function.
    """
    model = default_model() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = load(model)
        fallback = np.zeros(len(unigram.pieces), bool)
        fallback[list(unigram.byte_ids.values())] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = unigram.encode(texts)
            back = [unigram.decode(x) for x in ids]
            ends = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            counts = np.concatenate([[0], np.cumsum(fallback[flat])])
            out = [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                pa.array(np.diff(ends), pa.int32()),
                pa.array(np.diff(counts[ends]), pa.int32()),
                pa.array([zlib.crc32(x.encode("utf-8", "replace")) for x in back], pa.int64()),
                pa.array([x == (y or "") for x, y in zip(back, texts)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(out + [pa.array(back, pa.string())] * with_text, names=NAMES + ["decoded"] * with_text)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, run, SCHEMA + ", decoded string" * with_text)


NAMES = ["doc_id", "ids", "n_ids", "n_bytes", "decoded_crc32", "round_trip"]
SCHEMA = "doc_id long, ids array<int>, n_ids int, n_bytes int, decoded_crc32 long, round_trip boolean"


def decoded(rows: DataFrame, *, id_column: str = "doc_id", ids_column: str = "ids", model: bytes | None = None) -> DataFrame:
    """(doc_id, text): the text of each row's ids; null or empty ids give the empty text.

    A null among the ids, or an id outside the vocabulary, adds nothing.
    """
    model = default_model() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = load(model)
        for batch in batches:
            lists = [np.array([i for i in x or () if i is not None and 0 <= i < len(unigram.raw)], np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unigram.decode(x) for x in lists], pa.string())], names=["doc_id", "text"])

    picked = rows.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return map_batches(picked, run, "doc_id long, text string")
