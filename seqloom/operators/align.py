"""Aligning reads to a positional model: the offset at which the model fits best.

A model of m positions is (kmer, pos, val) with log10 probabilities of single bases (position 0,
and those behind windows) and of dinucleotides (positions 0 ... m - 2). A read has some fifty
offsets with some ninety terms each; they are looked up by numpy for a batch of reads at once,
as exploding them would make five thousand rows of each read. The model is a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import seq as S

LOW = -1e10
#: Scores are compared at this many decimals, so that sums in another order give the same offset.
DIGITS = 6
CODE = np.full(256, 4, np.int64)
CODE[[65, 67, 71, 84]] = range(4)


class Model:
    """mono[pos, base] and di[pos, 4 * first + second], in the order A, C, G, T."""

    def __init__(self, rows: list[tuple[str, int, float]], length: int):
        self.length = length
        self.mono, self.di = np.full((length, 4), -20.0), np.full((length - 1, 16), -20.0)
        for kmer, pos, val in rows:
            code = [int(CODE[ord(c)]) for c in kmer]
            if max(code) < 4 and pos < length + 1 - len(kmer):
                if len(kmer) == 1:
                    self.mono[pos, code[0]] = val
                elif len(kmer) == 2:
                    self.di[pos, 4 * code[0] + code[1]] = val

    def terms(self, reads: np.ndarray, *, sums: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """For reads of one length: (total by read and offset, sums of the terms before each position if asked
        for, whether N is inside). One position's terms at a time: its 16 values stay at hand."""
        n, length = reads.shape
        offsets = length - self.length + 1
        codes = CODE[reads]
        pairs = np.where((codes[:, :-1] < 4) & (codes[:, 1:] < 4), 4 * codes[:, :-1] + codes[:, 1:], 0)
        before = np.zeros((self.length if sums else 1, n, offsets))
        total = before[0]
        for p in range(self.length - 1):
            total = np.add(total, self.di[p].take(pairs[:, p : p + offsets]), out=before[p + 1] if sums else total)
        unknown = np.concatenate([np.zeros((n, 1), int), np.cumsum(codes == 4, 1)], 1)
        bad = unknown[:, self.length :] > unknown[:, :offsets]
        first = self.mono[0, np.where(codes[:, :offsets] < 4, codes[:, :offsets], 0)]
        return first + total, before if sums else None, bad


def collected(model: DataFrame, length: int) -> Model:
    """At most 20 rows a position: a few kilobytes, whatever the reads; more of them are an error."""
    most = 20 * length + 20
    rows = model.where(F.length("kmer") <= 2).select("kmer", F.col("pos").cast("int"), F.col("val").cast("double")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a model of {length} positions has at most {most} rows")
    return Model([tuple(r) for r in rows], length)


def best(score: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First offset of the highest score, the score, and whether any offset counts."""
    score = np.round(score, DIGITS)
    score[bad] = -np.inf
    at = score.argmax(1)
    top = np.take_along_axis(score, at[:, None], 1)[:, 0]
    return at, top, top > LOW


#: Terms of reads, by offset and position, that are held at once: some 20 MB.
TERMS = 1 << 21


def by_length(column: pa.Array, model: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and bytes of the reads of each length that a model fits in, so many at once that
    their terms stay within TERMS."""
    texts = column.to_pylist()
    groups: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        groups.setdefault(len(t or ""), []).append(k)
    for length, rows in groups.items():
        if length < model:
            continue
        step = max(1, TERMS // ((length - model + 1) * model))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield np.array(part), np.frombuffer("".join(texts[r] for r in part).encode("ascii", "replace"), np.uint8).reshape(len(part), length)


def best_offset(reads: DataFrame, model: DataFrame, *, length: int = 94) -> DataFrame:
    """(sample, read_no, seq, offset, score): the first of the best offsets without N.

    Reads shorter than the model, or with N at every offset, are left out.
    """
    fitted = collected(model, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in by_length(batch.column(2), length):
                total, _, bad = fitted.terms(text)
                at, top, ok = best(total, bad)
                kept = batch.take(pa.array(rows[ok]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at[ok].astype(np.int32)), pa.array(top[ok])], names=["sample", "read_no", "seq", "offset", "score"])

    rows = reads.select("sample", F.col("read_no").cast("long").alias("read_no"), "seq")
    return rows.mapInArrow(run, "sample string, read_no long, seq string, offset int, score double")


def shifted(aligned: DataFrame, *, length: int = 94) -> DataFrame:
    """Aligned reads with N around them, so that the model lies at the same place in all of them."""
    return aligned.withColumn("seq", S.shift("seq", F.col("offset"), F.length("seq") - length))


def leave_window_out(reads: DataFrame, model: DataFrame, *, length: int = 94, window: int = 2) -> DataFrame:
    """(sample, kmer, pos, val): dinucleotides seen in a window whose own terms had no say in where
    the model was put.

    window 2: at each position iw = 2 ... length - 3 the four terms iw - 2 ... iw + 1 are left
    out, and the dinucleotide at iw counts. Larger windows: windows of so many positions, the last
    left aside; the terms that touch the window are left out, the base behind it is entered anew,
    and each of its dinucleotides counts. Dinucleotides with N don't count.
    """
    fitted = collected(model, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sample = np.unique(np.array(["" if x is None else x for x in batch.column(0).to_pylist()], str), return_inverse=True)
            counts = np.zeros((len(names), 16, length), np.int64)
            for rows, text in by_length(batch.column(1), length):
                total, run_sum, bad = fitted.terms(text, sums=True)
                codes = CODE[text]
                offsets = np.arange(total.shape[1])

                def mono(pos: int, codes=codes, offsets=offsets) -> np.ndarray:
                    c = codes[:, offsets + pos]
                    return np.where(c < 4, fitted.mono[pos, np.minimum(c, 3)], 0)

                if window == 2:
                    plans = ((total - (run_sum[w + 2] - run_sum[w - 2]), [w]) for w in range(2, length - 2))
                else:
                    plans = []
                    for w in range(-(-length // window) - 1):
                        lo, hi = w * window, (w + 1) * window
                        score = total - (run_sum[hi] - run_sum[max(0, lo - 1)]) + mono(hi)
                        plans.append((score - mono(0) if w == 0 else score, list(range(lo, hi))))
                for score, places in plans:
                    at, _, ok = best(score, bad)
                    for p in places:
                        a, b = codes[np.arange(len(rows)), at + p], codes[np.arange(len(rows)), at + p + 1]
                        fine = ok & (a < 4) & (b < 4)
                        counts[:, :, p] += np.bincount(sample[rows[fine]] * 16 + 4 * a[fine] + b[fine], minlength=16 * len(names)).reshape(-1, 16)
            s, pair, p = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[s].astype(object), pa.string()),
                    pa.array(["ACGT"[x // 4] + "ACGT"[x % 4] for x in pair], pa.string()),
                    pa.array(p.astype(np.int32)),
                    pa.array(counts[s, pair, p]),
                ],
                names=["sample", "kmer", "pos", "val"],
            )

    parts = reads.select("sample", "seq").mapInArrow(run, "sample string, kmer string, pos int, val long")
    return parts.groupBy("sample", "kmer", "pos").agg(F.sum("val").alias("val"))
