"""DNA curvature from sequence: helix coordinates under bending models, bends and curvature.

One sequence's coordinates are a running product of transforms; the products of all sequences of
a length in an Arrow batch advance together, and none of them meets another. Sequences of any
length come in pieces: their transforms are scanned, a product a piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sources.shared import stored

#: The published bending models (twist, roll and tilt in degrees, rise in Angstrom)
#: as Nucleic Acids Res 22(24) 5498 (1994), table 1, and Trends Biochem Sci 23(9) 341 (1998),
#: table 1, give them; the phosphate's place; the nucleosome's curvature.
DINUCLEOTIDES = "AA AC AG AT CA GG CG GA GC TA"
TRINUCLEOTIDES = """
    AAA ATA AGA ACA TAA TTA TGA TCA GAA GTA GGA GCA CAA CTA CGA CCA
    AAT ATT AGT ACT TAT TTT TGT TCT GAT GTT GGT GCT CAT CTT CGT CCT
    AAG ATG AGG ACG TAG TTG TGG TCG GAG GTG GGG GCG CAG CTG CGG CCG
    AAC ATC AGC ACC TAC TTC TGC TCC GAC GTC GGC GCC CAC CTC CGC CCC"""
BOLSHOI_TWIST = (35.62, 34.4, 27.7, 31.5, 34.5, 33.67, 29.8, 36.9, 40.0, 36.0)
CALLADINE_TWIST = (35.0, 34.0, 34.0, 34.0, 34.0, 34.0, 34.0, 34.0, 34.0, 34.0)
FLAT = (0.0,) * 10
MODELS = {
    "straight": (DINUCLEOTIDES, (360.0 / 10.5,) * 10, FLAT, FLAT, 3.38),
    "aawedge": (DINUCLEOTIDES, BOLSHOI_TWIST, (-8.40, *FLAT[1:]), (2.40, *FLAT[1:]), 3.38),
    "calladine": (DINUCLEOTIDES, CALLADINE_TWIST, (0.0, 3.3, 3.3, 3.3, 3.3, 3.3, 3.3, 3.3, 3.3, 6.6), FLAT, 3.38),
    "trifonov": (DINUCLEOTIDES, BOLSHOI_TWIST, (-6.50, -0.9, 8.4, 2.6, 1.6, 1.2, 6.7, -2.7, -5.0, 0.9), (3.20, -0.7, -0.3, 0.0, 3.1, -1.8, 0.0, -4.6, 0.0, 0.0), 3.38),
    "desantis": (DINUCLEOTIDES, (35.9, 34.6, 35.6, 35.0, 34.5, 33.0, 33.7, 35.8, 33.3, 34.6), (-5.4, -2.4, 1.0, -7.3, 6.7, 1.3, 4.6, 2.0, -3.7, 8.0), (-0.5, -2.7, -1.6, 0.0, 0.4, -0.6, 0.0, -1.7, 0.0, 0.0), 3.38),
    "reversed": (DINUCLEOTIDES, CALLADINE_TWIST, (3.3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -3.3), FLAT, 3.38),
    "nucleosome": (
        TRINUCLEOTIDES,
        (34.3,) * 64,
        (
            0.0, 2.8, 3.3, 5.2, 2.0, 2.0, 5.4, 5.4, 3.0, 3.7, 3.8, 5.4, 3.3, 2.2, 8.3, 5.4,
            0.7, 0.7, 5.8, 5.8, 2.8, 0.0, 5.2, 3.3, 5.3, 3.7, 5.4, 7.5, 6.7, 5.2, 5.4, 5.4,
            5.2, 6.7, 5.4, 5.4, 2.2, 3.3, 5.4, 8.3, 5.4, 6.5, 6.0, 7.5, 4.2, 4.2, 4.7, 4.7,
            3.7, 5.3, 7.5, 5.4, 3.7, 3.0, 6.0, 3.8, 5.4, 5.4, 10.0, 10.0, 6.5, 5.4, 7.5, 6.0,
        ),
        (0.0,) * 64,
        3.38,
    ),
    "trinucleotide": (
        TRINUCLEOTIDES,
        (36.0,) * 64,
        (
            0.05, 6.25, 4.90, 5.50, 4.65, 4.65, 7.70, 7.70, 4.05, 5.05, 5.00, 6.75, 4.75, 5.00, 7.05, 3.05,
            0.35, 0.35, 3.90, 3.90, 6.25, 0.05, 5.50, 4.90, 4.45, 2.65, 5.30, 6.90, 7.70, 4.70, 5.30, 5.05,
            4.70, 7.70, 5.05, 5.30, 5.00, 4.75, 3.05, 7.05, 6.00, 6.65, 5.85, 5.90, 6.90, 6.90, 3.85, 3.85,
            2.65, 4.45, 6.90, 5.30, 5.05, 4.05, 6.75, 5.00, 5.50, 5.50, 9.10, 9.10, 6.65, 6.00, 5.90, 5.85,
        ),
        (0.0,) * 64,
        3.4,
    ),
}
PHOSPHATE = (8.91, -5.2, 2.08)
NUCLEOSOME = 0.0234
BORDER_TWIST = 34.3
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def turn(rise: float, twist: float, roll: float, tilt: float) -> np.ndarray:
    """The step from one base pair to the next: twist about z, then roll about x and tilt about y
    (both reversed), and the rise along z."""
    w, r, t = (math.radians(x) for x in (twist, -roll, -tilt))
    cw, sw, cr, sr, ct, st = (f(x) for x in (w, r, t) for f in (math.cos, math.sin))
    out = np.eye(4)
    out[:3, :3] = [[cw * ct, cw * st * sr - sw * cr, cw * st * cr + sw * sr], [sw * ct, sw * st * sr + cw * cr, sw * st * cr - cw * sr], [-st, ct * sr, ct * cr]]
    out[2, 3] = rise
    return out


@dataclass
class Model:
    """Steps by oligo; what a model lacks comes from the other strand with the tilt's sign turned."""

    order: int
    rise: float
    steps: dict[str | None, np.ndarray]

    @classmethod
    def of(cls, oligos: str, twist: tuple, roll: tuple, tilt: tuple, rise: float) -> Model:
        names = oligos.split()
        own = dict(zip(names, zip(twist, roll, tilt)))
        steps: dict[str | None, np.ndarray] = {None: turn(rise, BORDER_TWIST, 0.0, 0.0)}
        for letters in product("ACGT", repeat=len(names[0])):
            oligo = "".join(letters)
            if oligo in own:
                w, r, t = own[oligo]
            else:
                w, r, t = own[oligo.translate(COMPLEMENT)[::-1]]
                t = -t
            steps[oligo] = turn(rise, w, r, t)
        return cls(len(names[0]), rise, steps)

    @classmethod
    def named(cls, name: str) -> Model:
        return cls.of(*MODELS[name.lower()])


def read_model(text: str) -> Model:
    """A model's text: name; rise; then oligos, twist, roll and tilt, each after a word and going on
    in indented lines."""
    rows: list[list[str]] = []
    for line in text.splitlines()[1:]:
        if line.startswith("     ") and rows:
            rows[-1] += line.split()
        elif line.strip():
            rows.append(line.split())
    rise, oligos, *angles = rows
    twist, roll, tilt = ([float(x) for x in a[1:]] for a in angles[:3])
    return Model.of(" ".join(oligos[1:]), tuple(twist), tuple(roll), tuple(tilt), float(rise[-1]))


def oligo_windows(sequence: str, size: int) -> list[str | None]:
    """len - 1 oligos between neighbouring bases; None where one would reach beyond an end."""
    before = (size - 2) // 2
    found = [sequence[i : i + size] for i in range(len(sequence) - size + 1)]
    return ([None] * before + found + [None] * (size - 2 - before))[: max(0, len(sequence) - 1)]


def helices(sequences: list[str], model: Model) -> np.ndarray:
    """(sequences, 5, n, 3) for sequences of one length n: axis, the strands' phosphates, base pair
    normals, normals smoothed over a turn."""
    count, n = len(sequences), len(sequences[0])
    oligos = list(model.steps)
    number = {oligo: k for k, oligo in enumerate(oligos)}
    steps = np.array([model.steps[oligo] for oligo in oligos])
    between = np.array([[number[o] for o in oligo_windows(s, model.order)] for s in sequences], np.int64).reshape(count, n - 1)
    # Base i is moved by all steps from its own on: products from the end, for all sequences at once.
    moves, now = np.empty((count, n, 4, 4)), np.broadcast_to(np.eye(4), (count, 4, 4))
    moves[:, n - 1] = now
    for i in range(n - 2, -1, -1):
        now = now @ steps[between[:, i]]
        moves[:, i] = now
    return parts_of(moves)


def parts_of(moves: np.ndarray) -> np.ndarray:
    """(sequences, 5, n, 3) of the bases' transforms (sequences, n, 4, 4)."""
    count, n = moves.shape[:2]
    away, angle, up = PHOSPHATE
    p = np.array([away * np.cos(np.radians(angle)), away * np.sin(np.radians(angle)), up])
    local = np.array([[0, 0, 0, 1], [*p, 1], [-p[0], p[1], -p[2], 1], [0, 0, 1, 0]], float)
    out = np.zeros((count, 5, n, 3))
    out[:, :4] = np.einsum("snij,kj->skni", moves, local)[..., :3]
    if n > 10:
        weights = np.array([0.5, *[1.0] * 9, 0.5]) / 10
        padded = np.zeros((count, n + 10, 3))
        padded[:, 5 : n + 5] = out[:, 3]
        out[:, 4] = sum(w * padded[:, k : k + n] for k, w in enumerate(weights))
        whole = out[:, 4, 5 : n - 5]
        whole /= np.linalg.norm(whole, axis=2, keepdims=True)
    return out


def coordinates(sequence: str, model: Model) -> np.ndarray:
    """(5, n, 3) of one sequence."""
    return helices([sequence], model)[0]


def frame(axis: np.ndarray) -> np.ndarray:
    """Rows x, y, z of the frame in which a curve runs from its first point along x to its last, and
    bulges towards z: z is the direction of the point farthest from the line between the ends.

    A straight or closed curve has no such direction; any that is perpendicular will do.
    """
    x, length = along(axis[0], axis[-1])
    aside = off_line(axis, axis[0], x)
    return framed(x, length, aside[np.linalg.norm(aside, axis=1).argmax()])


def along(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, float]:
    """The direction from end to end and the distance."""
    length = float(np.linalg.norm(last - first))
    return (last - first) / length if length > 0 else np.array([1.0, 0.0, 0.0]), length


def off_line(axis: np.ndarray, first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """From the line through the ends to each point."""
    return (axis - first) - np.outer((axis - first) @ x, x)


def framed(x: np.ndarray, length: float, z: np.ndarray) -> np.ndarray:
    if np.linalg.norm(z) <= 1e-9 * max(length, 1.0):
        z = np.eye(3)[np.abs(x).argmin()]
        z = z - (z @ x) * x
    z = z / np.linalg.norm(z)
    return np.array([x, np.cross(z, x), z])


def laid_out(xyz: np.ndarray) -> np.ndarray:
    """Coordinates in the frame of the helix axis, points about the middle of the box around them."""
    turned = xyz @ frame(xyz[0]).T
    points = turned[:3].reshape(-1, 3)
    turned[:3] -= (points.min(0) + points.max(0)) / 2
    return turned


def between(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Angles between paired vectors by their products; nothing where the two are one."""
    apart = np.abs(u - v).max(-1, initial=0) > 1e-7
    return np.where(apart, np.arccos(np.clip((u * v).sum(-1), -1, 1)), 0.0)


def curvature(xyz: np.ndarray, rise: float, windows: tuple[int, int, int] = (10, 2, 15)) -> np.ndarray:
    """(..., 3, n) of (..., 5, n, 3): curvature by radius, bend angle, curvature angle, in units of the
    nucleosome's. Within a window of either end they are 0.

    The circle through three points of the axis turns from chord to chord by as much as half their
    arc's centre angle: its curvature is twice the sine of that turn over the chord of both.
    """
    n = xyz.shape[-2]
    out = np.zeros((*xyz.shape[:-3], 3, n))
    units = NUCLEOSOME * np.array([1.0, 2 * windows[2] * rise, 2 * windows[2] * rise])
    for row, (half, part) in enumerate(zip(windows, (0, 3, 4))):
        if n < 2 * half:
            continue
        line = xyz[..., part, :, :]
        before, here, after = line[..., : n - 2 * half, :], line[..., half : n - half, :], line[..., 2 * half :, :]
        if row:
            value = between(before, after)
        else:
            first, second, both = here - before, after - here, np.linalg.norm(after - before, axis=-1)
            size = np.linalg.norm(first, axis=-1) * np.linalg.norm(second, axis=-1)
            sine = np.linalg.norm(np.cross(first, second), axis=-1) / np.where(size > 0, size, np.inf)
            value = 2 * sine / np.where(both > 0, both, np.inf)
        out[..., row, half : n - half] = value / units[row]
    return out


PARTS = ("axis", "p1", "p2", "normal", "smooth")


BENDS = ("curvature", "bend_angle", "curve_angle")
PLACES = tuple(f"{p}_{c}" for p in PARTS for c in "xyz")

#: Bases whose frames are held at once; a longer sequence goes alone. Of 32 times as many the texts are
#: held, so that there are enough of about one length. A sequence is filled up to the
#: longest beside it by at most a quarter.
AT_ONCE = 1 << 17
CODE = np.zeros(256, np.uint8)
CODE[list(b"ACGT")] = range(4)


def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows whose `seq` isn't empty, those of about one length together, AT_ONCE bases or one row."""

    def groups(rows: list[dict]) -> Iterator[list[dict]]:
        rows.sort(key=lambda r: len(r["seq"]))
        start = 0
        for k in range(1, len(rows) + 1):
            n = len(rows[k]["seq"]) if k < len(rows) else 0
            if not n or n > len(rows[start]["seq"]) * 5 // 4 + 4 or (k - start + 1) * n > AT_ONCE:
                yield rows[start:k]
                start = k

    held: list[dict] = []
    bases = 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["seq"]:
                held.append(row)
                bases += len(row["seq"])
                if bases > 32 * AT_ONCE:
                    yield from groups(held)
                    held, bases = [], 0
    if held:
        yield from groups(held)


def dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(..., count) of (..., 3, count)."""
    return u[..., 0, :] * v[..., 0, :] + u[..., 1, :] * v[..., 1, :] + u[..., 2, :] * v[..., 2, :]


def round_off(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go away from zero; no negative zeros."""
    if digits is None:
        return x
    y = np.abs(x) * 10.0**digits
    whole = np.floor(y)
    return np.copysign((whole + (y - whole >= 0.5)) / 10.0**digits, x) + 0.0


class Strands:
    """Helices side by side, each in the frame of its own first base: arrays (n, 3, count), n the longest's
    bases. What lies behind a shorter one's end is void; `inside` tells it."""

    def __init__(self, sequences: list[str], model: Model):
        self.rise, self.sequences = model.rise, sequences
        self.lengths = np.array([len(s) for s in sequences])
        n = self.n = int(self.lengths.max())
        self.raw = np.frombuffer("".join(s.ljust(n, "A") for s in sequences).encode(), np.uint8).reshape(-1, n)
        self.at = np.arange(n)[:, None]
        self.inside = self.at < self.lengths
        codes, size = np.ascontiguousarray(CODE[self.raw].T).astype(np.int64), model.order
        before, kinds = (size - 2) // 2, np.zeros((n - 1, len(sequences)), np.int64)
        if n >= size:
            kinds[before : before + n - size + 1] = 1 + sum(codes[j : n - size + 1 + j] * 4 ** (size - 1 - j) for j in range(size))
            kinds[self.at[:-1] - before > self.lengths - size] = 0
        table = np.ascontiguousarray(np.array(list(model.steps.values()))[:, :3, :3].transpose(1, 2, 0))
        self.turns = turns = np.empty((n, 3, 3, len(sequences)))
        turns[0] = np.eye(3)[:, :, None]
        for i in range(n - 1):
            now, step = turns[i], np.take(table, kinds[i], axis=2)
            turns[i + 1] = now[:, None, 0] * step[None, :, 0] + now[:, None, 1] * step[None, :, 1] + now[:, None, 2] * step[None, :, 2]
        self.normals = turns[:, :, 2]
        self.axis = -(self.rise * self.normals)
        self.axis[0] = 0
        np.cumsum(self.axis, axis=0, out=self.axis)

    def within(self, border: int) -> np.ndarray:
        """Bases that have `border` others on either side."""
        return (self.at >= border) & (self.at < self.lengths - border)

    def smooth(self) -> np.ndarray:
        """Normals smoothed over a turn."""
        padded = np.zeros((self.n + 10, *self.normals.shape[1:]))
        padded[5 : self.n + 5] = np.where(self.inside[:, None], self.normals, 0)
        two = padded[1:] + padded[:-1]
        four = two[1:] + two[:-1]
        out = (four[: self.n] + four[2 : self.n + 2] + four[4 : self.n + 4] + four[6 : self.n + 6] + four[8 : self.n + 8]) / 20
        out /= np.where(self.within(5), np.sqrt(dot(out, out)), 1)[:, None]
        return np.where((self.lengths > 10) & self.inside, 1.0, 0.0)[:, None] * out

    def bends(self, smooth: np.ndarray, windows: tuple[int, int, int] = (10, 2, 15)) -> list[np.ndarray]:
        """Three arrays (n, count) as curvature() gives them."""
        found = []
        for row, (half, line) in enumerate(zip(windows, (self.axis, self.normals, smooth))):
            out = np.zeros((self.n, len(self.lengths)))
            found.append(out)
            if self.n <= 2 * half:
                continue
            before, here, after = line[: self.n - 2 * half], line[half : self.n - half], line[2 * half :]
            if row:
                value = np.arccos(np.clip(dot(before, after), -1, 1)) / (NUCLEOSOME * 2 * windows[2] * self.rise)
                value[np.abs(before - after).max(1) <= 1e-7] = 0
            else:
                u, v, w = here - before, after - here, after - before
                turned = sum((u[:, a] * v[:, b] - u[:, b] * v[:, a]) ** 2 for a, b in ((1, 2), (2, 0), (0, 1)))
                size = dot(u, u) * dot(v, v) * dot(w, w)
                value = 2 * np.sqrt(turned / np.where(size > 0, size, np.inf)) / NUCLEOSOME
            out[half : self.n - half] = np.where(self.within(half)[half : self.n - half], value, 0)
        return found

    def frame(self, as_found: bool = False) -> list[np.ndarray]:
        """x, y, z as in frame(), (3, count) each; a straight axis's z is perpendicular, or with `as_found`
        the direction of what rounding has left."""
        last = self.axis[self.lengths - 1, :, np.arange(len(self.lengths))].T
        length = np.sqrt(dot(last, last))
        x = np.where(length > 0, last / np.where(length > 0, length, 1), np.eye(3)[0][:, None])
        aside = self.axis - dot(self.axis, x)[:, None] * x
        far = np.where(self.inside, dot(aside, aside), -1).argmax(0)
        z = aside[far, :, np.arange(len(far))].T
        reach = np.sqrt(dot(z, z))
        straight = np.flatnonzero(reach <= 1e-9 * np.maximum(length, 1))
        z = z / np.where(reach > 0, reach, 1)
        for k in [] if as_found else straight:
            z[:, k] = framed(x[:, k], float(length[k]), np.zeros(3))[2]
        return [x, np.array([z[a] * x[b] - z[b] * x[a] for a, b in ((1, 2), (2, 0), (0, 1))]), z]

    def extents(self, as_found: bool = False) -> list[np.ndarray]:
        """Of the axis along each direction of its frame."""
        along_each = [dot(self.axis, k) for k in self.frame(as_found)]
        return [np.where(self.inside, x, -np.inf).max(0) - np.where(self.inside, x, np.inf).min(0) for x in along_each]

    def laid_out(self, smooth: np.ndarray | None) -> list[np.ndarray]:
        """15 arrays (n, count), x, y, z of each part but a missing last one, as in laid_out()."""
        away, angle, up = PHOSPHATE
        p = away * math.cos(math.radians(angle)), away * math.sin(math.radians(angle)), up
        strands = [self.axis + self.turns[:, :, 0] * a + self.turns[:, :, 1] * b + self.turns[:, :, 2] * c for a, b, c in (p, (-p[0], p[1], -p[2]))]
        directions = self.frame()
        out = [dot(part, k) for part in (self.axis, *strands, self.normals, *([] if smooth is None else [smooth])) for k in directions]
        for c in range(3):
            low = np.min([np.where(self.inside, out[3 * j + c], np.inf).min(0) for j in range(3)], axis=0)
            high = np.max([np.where(self.inside, out[3 * j + c], -np.inf).max(0) for j in range(3)], axis=0)
            for j in range(3):
                out[3 * j + c] -= (low + high) / 2
        return out

    def flat(self, values: np.ndarray) -> np.ndarray:
        """One value a base, the sequences one after the other."""
        return values.T[self.inside.T]


def letters(raw: np.ndarray, width: int = 1) -> pa.Array:
    """Strings of `width` bytes each."""
    n = raw.size // width
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))


def each_base(rows: list[dict], one: Strands) -> pa.Array:
    """The row's id for each base."""
    return pa.array([r["id"] for r in rows], pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), one.lengths)))


def cleaned(sequences: DataFrame, id_column: str, seq_column: str) -> DataFrame:
    return sequences.select(F.col(id_column).cast("long").alias("id"), F.regexp_replace(F.upper(seq_column), "[^ACGT]", "").alias("seq"))


def of_name(model: str | Model) -> Model:
    return Model.named(model) if isinstance(model, str) else model


def curved(sequences: DataFrame, *, model: str | Model = "trifonov", id_column: str = "read_no", seq_column: str = "seq", columns: tuple[str, ...] = BENDS + PLACES, digits: int | None = None) -> DataFrame:
    """(id, pos, base, curvature, bend_angle, curve_angle, and x, y, z of each part) for each base, or some
    of `columns`; what isn't asked for isn't worked out. Values are rounded to `digits`, if given.

    Letters but A, C, G and T are dropped first; null and empty sequences have no rows. Sequences
    of about one length are worked on together, each in full.
    """
    chosen = of_name(model)
    columns = tuple(c for c in BENDS + PLACES if c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in side_by_side(batches):
            one = Strands([r["seq"] for r in rows], chosen)
            smooth = one.smooth()
            found = dict(zip(BENDS, one.bends(smooth))) if set(columns) & set(BENDS) else {}
            found |= dict(zip(PLACES, one.laid_out(smooth))) if set(columns) & set(PLACES) else {}
            pos = np.broadcast_to(one.at.astype(np.int32), one.inside.shape)
            cols = [each_base(rows, one), pa.array(one.flat(pos)), letters(one.raw[one.inside.T])]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(round_off(one.flat(found[c]), digits)) for c in columns)], names=["id", "pos", "base", *columns])

    return cleaned(sequences, id_column, seq_column).mapInArrow(run, "id long, pos int, base string" + "".join(f", {c} double" for c in columns))


def bend_sums(pieces: DataFrame, piece: int, *, model: str | Model = "trifonov", digits: int | None = None) -> DataFrame:
    """(id, bases, most, bend, angle): each sequence's bases, largest curvature, sum of bend angles and
    largest curvature angle, each base's values rounded to `digits` first.

    Sequences come in pieces (id, offset, seq) as for curved_pieces(). Bends reach over no more than HALO
    bases and don't depend on where a helix lies, so that pieces need not know of each other.
    """
    chosen = of_name(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in side_by_side(batches):
            one = Strands([r["seq"] for r in rows], chosen)
            first = np.array([HALO if r["offset"] else 0 for r in rows])
            own = (one.at >= first) & (one.at < np.minimum(one.lengths, piece + HALO))
            curvature_, bend, angle = (np.where(own, round_off(x, digits), 0) for x in one.bends(one.smooth()))
            cols = [pa.array([r["id"] for r in rows], pa.int64()), *map(pa.array, (own.sum(0, dtype=np.int64), curvature_.max(0), bend.sum(0), angle.max(0)))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "bases", "most", "bend", "angle"])

    parts = pieces.select("id", "offset", "seq").mapInArrow(run, "id long, bases long, most double, bend double, angle double")
    return parts.where("bases > 0").groupBy("id").agg(F.sum("bases").alias("bases"), F.max("most").alias("most"), F.sum("bend").alias("bend"), F.max("angle").alias("angle"))


def whole(sequences: DataFrame, *, id_column: str = "read_no", seq_column: str = "seq") -> DataFrame:
    """Short sequences as pieces: each its only one."""
    return cleaned(sequences, id_column, seq_column).select("id", F.lit(0).cast("long").alias("offset"), "seq")


def extents(sequences: DataFrame, *, model: str | Model = "trifonov", id_column: str = "read_no", seq_column: str = "seq", digits: int | None = None, as_found: bool = False) -> DataFrame:
    """(id, bases, x, y, z): each sequence's extent along the axes of its layout, from end to end, across,
    and to the farthest point. A straight axis (two bases, say) has no extent across; with `as_found` it
    gets what the formulas give for the direction that rounding has left, as plain SQL does."""
    chosen = of_name(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in side_by_side(batches):
            one = Strands([r["seq"] for r in rows], chosen)
            x, y, z = (round_off(e, digits) for e in one.extents(as_found))
            yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.int64()), *map(pa.array, (one.lengths, x, y, z))], names=["id", "bases", "x", "y", "z"])

    return cleaned(sequences, id_column, seq_column).mapInArrow(run, "id long, bases long, x double, y double, z double")


#: Bases on either side of a piece's own that its bends reach over: 15 to a window's end, 5 to smooth
#: there, and those of an oligo about a step.
HALO = 24


def cut(sequences: DataFrame, piece: int = 1 << 16, *, id_column: str = "read_no", seq_column: str = "seq") -> DataFrame:
    """(id, offset, seq): pieces of `piece` bases and the 2 * HALO behind them, of sequences that fit a row,
    without letters but A, C, G and T. A chromosome comes in pieces from its file: read_fasta."""
    clean = F.regexp_replace(F.upper(seq_column), "[^ACGT]", "")
    rows = sequences.select(F.col(id_column).cast("long").alias("id"), clean.alias("seq")).where("seq <> ''")
    starts = F.sequence(F.lit(0), F.length("seq") - 1, F.lit(piece))
    parts = F.transform(starts, lambda o: F.struct(o.cast("long").alias("offset"), F.substr("seq", o + 1, F.lit(piece + 2 * HALO)).alias("seq")))
    return rows.select("id", F.explode(parts).alias("p")).select("id", "p.offset", "p.seq")


def suffix_products(steps: np.ndarray) -> np.ndarray:
    """The products from each step to the last, the later on the left: in blocks side by side, then across."""
    n = len(steps)
    side = max(1, int(np.ceil(np.sqrt(n))))
    blocks = np.broadcast_to(np.eye(4), (side * side, 4, 4)).copy()
    blocks[:n] = steps
    blocks = blocks.reshape(side, side, 4, 4)
    now = np.broadcast_to(np.eye(4), (side, 4, 4))
    for j in range(side - 1, -1, -1):
        now = now @ blocks[:, j]
        blocks[:, j] = now
    behind, now = np.empty((side, 1, 4, 4)), np.eye(4)
    for k in range(side - 1, -1, -1):
        behind[k, 0] = now
        now = now @ blocks[k, 0]
    return (behind @ blocks).reshape(-1, 4, 4)[:n]


def inverse(move: np.ndarray) -> np.ndarray:
    """Of a rotation and a shift."""
    out = np.eye(4)
    out[:3, :3] = move[:3, :3].T
    out[:3, 3] = -move[:3, :3].T @ move[:3, 3]
    return out


class Piece:
    """A piece's own bases from `a` to `b`, and the transforms of all its bases up to its last."""

    def __init__(self, offset: int, seq: str, piece: int, model: Model):
        self.a, self.b = (HALO if offset else 0), min(len(seq), piece + HALO)
        number = {oligo: k for k, oligo in enumerate(model.steps)}
        steps = np.array(list(model.steps.values()))[[number[o] for o in oligo_windows(seq, model.order)]]
        self.moves = np.concatenate([suffix_products(steps.reshape(-1, 4, 4)), np.eye(4)[None]])
        self.end = min(self.b, len(seq) - 1)  # the base that the next piece's own begin with, or the last

    def own(self) -> np.ndarray:
        """The product of its own bases' steps."""
        return inverse(self.moves[self.end]) @ self.moves[self.a]

    def parts(self, behind: np.ndarray) -> np.ndarray:
        """(5, n, 3) in the coordinates of the whole, `behind` being the product of all later steps."""
        return parts_of((behind @ inverse(self.moves[self.end]) @ self.moves)[None])[0]


def curved_pieces(pieces: DataFrame, piece: int, *, model: str | Model = "trifonov") -> DataFrame:
    """What curved() gives, for sequences of any length that come in pieces (id, offset, seq): `piece` bases
    and 2 * HALO behind them, as cut() and a FASTA file's reader make them; the last ones are shorter.

    Transforms are scanned: each piece's product, the products of all later pieces for each (some
    numbers a piece of a sequence), then each piece by itself. A piece's own bases are those with HALO on
    either side, so that bends across borders are whole. The layout needs a sequence's ends, its
    farthest point and its box, each a sum over pieces; no task holds more than a piece. (id, offset) is
    unique; a table without rows gives none.
    """
    chosen = Model.named(model) if isinstance(model, str) else model

    def each(rows: DataFrame, columns: list[str], schema: str, function) -> DataFrame:
        """`function` of a piece and its row gives columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    one = Piece(row["offset"], row["seq"], piece, chosen)
                    if one.a < one.b:
                        yield function(one, row)

        return rows.select("id", "offset", "seq", *columns).mapInArrow(run, schema)

    def one_row(names: list[str], *values) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [v.ravel().tolist() if isinstance(v, np.ndarray) else v] for n, v in zip(names, values)})

    products = each(pieces, [], "id long, offset long, move array<double>", lambda p, r: one_row(["id", "offset", "move"], r["id"], r["offset"], p.own()))

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset", ascending=False)
        behind, now = [], np.eye(4)
        for move in frame["move"]:
            behind.append(now.ravel().tolist())
            now = now @ np.reshape(move, (4, 4))
        # The last base lies at the origin, the first where all steps together move it.
        return frame.assign(behind=behind, first=[now[:3, 3].tolist()] * len(frame))[["id", "offset", "behind", "first"]]

    scanned = products.groupBy("id").applyInPandas(scan, "id long, offset long, behind array<double>, first array<double>")
    placed = stored(pieces.join(scanned, ["id", "offset"]), name="pieces")

    def farthest(p: Piece, row: dict) -> pa.RecordBatch:
        x, _ = along(np.array(row["first"]), np.zeros(3))
        aside = off_line(p.parts(np.reshape(row["behind"], (4, 4)))[0, p.a : p.b], np.array(row["first"]), x)
        reach = np.linalg.norm(aside, axis=1)
        k = int(reach.argmax())
        return one_row(["id", "reach", "before", "z", "first"], row["id"], float(reach[k]), -(row["offset"] + p.a + k), aside[k], row["first"])

    reaches = each(placed, ["behind", "first"], "id long, reach double, before long, z array<double>, first array<double>", farthest)
    bulges = reaches.groupBy("id").agg(F.max(F.struct("reach", "before", "z", "first")).alias("m")).select("id", "m.z")
    turned = placed.join(stored(bulges, name="bulges"), "id")

    def laid(p: Piece, row: dict) -> np.ndarray:
        x, length = along(np.array(row["first"]), np.zeros(3))
        return p.parts(np.reshape(row["behind"], (4, 4))) @ framed(x, length, np.array(row["z"])).T

    def box(p: Piece, row: dict) -> pa.RecordBatch:
        points = laid(p, row)[:3, p.a : p.b].reshape(-1, 3)
        return one_row(["id", "low", "high"], row["id"], points.min(0), points.max(0))

    boxes = each(turned, ["behind", "first", "z"], "id long, low array<double>, high array<double>", box)
    middle = [((F.min(F.col("low")[c]) + F.max(F.col("high")[c])) / 2).alias(f"m{c}") for c in range(3)]
    middles = stored(boxes.groupBy("id").agg(*middle).select("id", F.array("m0", "m1", "m2").alias("middle")), name="middles")
    places = [f"{p}_{c}" for p in PARTS for c in "xyz"]

    def bases(p: Piece, row: dict) -> pa.RecordBatch:
        xyz = laid(p, row)
        xyz[:3] -= np.array(row["middle"])
        bends, xyz = curvature(xyz, chosen.rise)[:, p.a : p.b], xyz[:, p.a : p.b]
        n = p.b - p.a
        columns = [pa.array([row["id"]] * n, pa.int64()), pa.array(row["offset"] + np.arange(p.a, p.b)), pa.array(list(row["seq"][p.a : p.b])), *map(pa.array, bends), *(pa.array(np.ascontiguousarray(xyz[j, :, c])) for j in range(5) for c in range(3))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "pos", "base", "curvature", "bend_angle", "curve_angle", *places])

    return each(turned.join(middles, "id"), ["behind", "first", "z", "middle"], "id long, pos long, base string, curvature double, bend_angle double, curve_angle double, " + ", ".join(f"{c} double" for c in places), bases)


def extents_of_pieces(pieces: DataFrame, piece: int, *, model: str | Model = "trifonov") -> DataFrame:
    """What extents() gives, for sequences in pieces as for curved_pieces(): scanned as there, but from the
    first base on; then each one's farthest point and box are sums over its pieces."""
    chosen = of_name(model)
    nine = lambda k: np.reshape(k, (3, 3))

    def own(rows: list[dict]) -> tuple[Strands, np.ndarray, np.ndarray]:
        """With the first of its own bases and the one behind them, or its last."""
        one = Strands([r["seq"] for r in rows], chosen)
        return one, np.array([HALO if r["offset"] else 0 for r in rows]), np.minimum(piece + HALO, one.lengths)

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in side_by_side(batches):
            one, a, b = own(rows)
            e, k = np.minimum(b, one.lengths - 1), np.arange(len(rows))
            begin, end, shift = one.turns[np.minimum(a, e), :, :, k], one.turns[e, :, :, k], one.axis[e, :, k] - one.axis[np.minimum(a, e), :, k]
            turn_ = begin.transpose(0, 2, 1) @ end
            moved = (begin.transpose(0, 2, 1) @ shift[:, :, None])[:, :, 0]
            some = np.flatnonzero(a < b)
            names = pa.schema([("id", pa.int64()), ("offset", pa.int64()), ("turn", pa.list_(pa.float64())), ("shift", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pydict({"id": [rows[i]["id"] for i in some], "offset": [rows[i]["offset"] for i in some], "turn": turn_[some].reshape(-1, 9).tolist(), "shift": moved[some].tolist()}, names)

    moved = pieces.select("id", "offset", "seq").mapInArrow(moves, "id long, offset long, turn array<double>, shift array<double>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by id and offset; some numbers a piece of one sequence are held at once."""
        names = ["id", "offset", "turn", "shift", "last"]
        out: list[list] = []
        since, turned, at = 0, np.eye(3), np.zeros(3)

        def batch(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)

        def ended() -> None:
            for row in out[since:]:
                row[4] = at.tolist()

        for rows in batches:
            for r in rows.to_pylist():
                if out and r["id"] != out[-1][0]:
                    ended()
                    turned, at, since = np.eye(3), np.zeros(3), len(out)
                    if len(out) >= 4096:
                        yield batch(out)
                        out, since = [], 0
                out.append([r["id"], r["offset"], turned.ravel().tolist(), at.tolist(), None])
                turned, at = turned @ nine(r["turn"]), at + turned @ r["shift"]
        if out:
            ended()
            yield batch(out)

    dealt = moved.repartition("id").sortWithinPartitions("id", "offset")
    scanned = dealt.mapInArrow(scan, "id long, offset long, turn array<double>, shift array<double>, last array<double>")
    placed = stored(pieces.join(scanned, ["id", "offset"]), name="pieces")

    def located(rows: list[dict]) -> tuple[Strands, np.ndarray, np.ndarray, np.ndarray]:
        """With which bases are its own, where they lie in the whole, and its last base's place."""
        one, a, b = own(rows)
        k = np.arange(len(rows))
        turn_ = np.array([nine(r["turn"]) for r in rows]) @ one.turns[a, :, :, k].transpose(0, 2, 1)
        turn_ = turn_.transpose(1, 2, 0)
        rest = one.axis - one.axis[a, :, k].T
        at = np.stack([dot(rest, turn_[c]) for c in range(3)], axis=1) + np.array([r["shift"] for r in rows]).T
        return one, (one.at >= a) & (one.at < b), at, np.array([r["last"] for r in rows]).T

    def direction(last: np.ndarray) -> np.ndarray:
        length = np.sqrt(dot(last, last))
        return np.where(length > 0, last / np.where(length > 0, length, 1), np.eye(3)[0][:, None])

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in side_by_side(batches):
            one, mine, at, last = located(rows)
            x = direction(last)
            aside = at - dot(at, x)[:, None] * x
            reach = np.where(mine, dot(aside, aside), -1)
            far, k = reach.argmax(0), np.arange(len(rows))
            yield pa.RecordBatch.from_pydict({"id": [r["id"] for r in rows], "reach": reach[far, k], "before": [-(r["offset"] + int(f)) for r, f in zip(rows, far)], "z": aside[far, :, k].tolist()})

    reaches = placed.mapInArrow(farthest, "id long, reach double, before long, z array<double>")
    bulges = stored(reaches.groupBy("id").agg(F.max(F.struct("reach", "before", "z")).alias("m")).select("id", "m.z"), name="bulges")

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in side_by_side(batches):
            one, mine, at, last = located(rows)
            frames = np.array([framed(*along(np.zeros(3), np.array(r["last"])), np.array(r["z"])) for r in rows]).transpose(1, 2, 0)
            each = [dot(at, k) for k in frames]
            low, high = (np.array([least(np.where(mine, x, far), axis=0) for x in each]).T for far, least in ((np.inf, np.min), (-np.inf, np.max)))
            yield pa.RecordBatch.from_pydict({"id": [r["id"] for r in rows], "bases": mine.sum(0, dtype=np.int64), "low": low.tolist(), "high": high.tolist()})

    boxes = placed.join(bulges, "id").mapInArrow(box, "id long, bases long, low array<double>, high array<double>")
    extent = [(F.max(F.col("high")[c]) - F.min(F.col("low")[c])).alias("xyz"[c]) for c in range(3)]
    return boxes.groupBy("id").agg(F.sum("bases").alias("bases"), *extent)


def hybrid36(number: Column, width: int) -> Column:
    """A number in `width` columns: decimal as long as it fits, then base 36 from A0... on, as molecular
    viewers read it; an error beyond that."""
    most, base = 10**width, 10 * 36 ** (width - 1)
    digits = F.lpad(F.conv((number - most + base).cast("string"), 10, 36), width, "0")
    error = F.raise_error(F.concat(F.lit("too many atoms for a PDB file: "), number.cast("string")))
    return F.when(number < most, F.lpad(number.cast("string"), width, " ")).when(number < most + 26 * 36 ** (width - 1), digits).otherwise(error)


def pdb_lines(curved_rows: DataFrame) -> DataFrame:
    """(id, serial, line): a PDB ATOM record of each phosphate, first strand's then the other's."""
    serial = F.col("pos").cast("long") * 2

    def line(number: Column, chain: str, name: Column, at: str) -> Column:
        place = F.format_string("%8.3f%8.3f%8.3f", *[F.col(f"{at}_{c}") for c in "xyz"])
        return F.concat(F.lit("ATOM  "), hybrid36(number, 5), F.lit("  P    D"), name, F.lit(f" {chain}"), hybrid36(F.col("pos") + 1, 4), F.lit("    "), place, F.lit("  1.00  0.00           P"))

    first = curved_rows.select("id", (serial + 1).alias("serial"), line(serial + 1, "A", F.col("base"), "p1").alias("line"))
    second = curved_rows.select("id", (serial + 2).alias("serial"), line(serial + 2, "B", F.translate("base", "ACGT", "TGCA"), "p2").alias("line"))
    return first.unionByName(second)


def numbers36(numbers: np.ndarray, width: int) -> np.ndarray:
    """(count, width) bytes: hybrid36() of numbers that fit."""
    out, most = np.empty((len(numbers), width), np.uint8), 10**width
    if len(numbers) and numbers.max() >= most + 26 * 36 ** (width - 1):
        raise ValueError(f"too many atoms for a PDB file: {numbers.max()}")
    digits = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)
    for plain in (True, False):
        rows = (numbers < most) == plain
        rest = numbers[rows] if plain else numbers[rows] - most + 10 * 36 ** (width - 1)
        text = np.empty((len(rest), width), np.uint8)
        for k in range(width - 1, -1, -1):
            text[:, k] = np.where((rest > 0) | (k == width - 1), digits[rest % (10 if plain else 36)], ord(" "))
            rest = rest // (10 if plain else 36)
        out[rows] = text
    return out


#: The 4 bytes before a decimal point, of negative numbers from the middle on, and the 4 from it on.
_BEFORE = np.frombuffer("".join([f"{k:4d}" for k in range(10000)] + [f"{f'-{k}':>4.4}" for k in range(10000)]).encode(), np.uint32)
_BEHIND = np.frombuffer("".join(f".{k:03d}" for k in range(1000)).encode(), np.uint32)


def decimals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, 8) bytes: %8.3f of each; and which fit these columns, as the others' bytes mean nothing."""
    value = (np.minimum(np.abs(x), 1e6) * 1000 + 0.5).astype(np.int32)
    minus, whole = np.signbit(x), value // 1000
    fit = whole <= np.where(minus, 999, 9999)
    out = np.empty((len(x), 2), np.uint32)
    out[:, 0], out[:, 1] = _BEFORE[np.where(fit, whole, 0) + 10000 * minus], _BEHIND[value - 1000 * whole]
    return out.view(np.uint8), fit


def pdb_records(sequences: DataFrame, *, model: str | Model = "trifonov", id_column: str = "read_no", seq_column: str = "seq") -> DataFrame:
    """(id, serial, line): what pdb_lines() gives of curved() sequences, formatted by columns of bytes."""
    chosen = of_name(model)
    other = np.zeros(256, np.uint8)
    other[list(b"ACGT")] = list(b"TGCA")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in side_by_side(batches):
            one = Strands([r["seq"] for r in rows], chosen)
            places, n = one.laid_out(None), one.n
            ids = each_base(rows, one)
            pos = one.flat(np.broadcast_to(one.at, one.inside.shape))
            for strand, chain in enumerate("AB"):
                blank = np.frombuffer(f"ATOM         P    D  {chain}        {'':24}  1.00  0.00           P".encode(), np.uint8)
                of_pos = np.tile(blank, (n, 1))
                of_pos[:, 6:11], of_pos[:, 22:26] = numbers36(2 * one.at[:, 0] + 1 + strand, 5), numbers36(one.at[:, 0] + 1, 4)
                lines = of_pos[pos]
                bases = one.raw[one.inside.T]
                lines[:, 19] = other[bases] if strand else bases
                at = [one.flat(places[3 + 3 * strand + c]) for c in range(3)]
                texts, fit = zip(*map(decimals, at))
                lines[:, 30:54] = np.concatenate(texts, axis=1)
                records, wide = letters(lines, lines.shape[1]), np.flatnonzero(~np.all(fit, axis=0))
                if len(wide):  # long helices' numbers are wider than their columns
                    said = records.to_pylist()
                    for i in wide:
                        said[i] = said[i][:30] + "".join(f"{x[i]:8.3f}" for x in at) + said[i][54:]
                    records = pa.array(said)
                yield pa.RecordBatch.from_arrays([ids, pa.array(2 * pos + 1 + strand), records], names=["id", "serial", "line"])

    return cleaned(sequences, id_column, seq_column).mapInArrow(run, "id long, serial long, line string")
