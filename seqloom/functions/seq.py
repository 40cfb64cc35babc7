"""Column expressions on DNA sequences; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each IUPAC letter stands for, and the complements of the letters.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "N": "ACGT", "W": "AT", "S": "CG", "M": "AC", "K": "GT", "B": "CGT", "H": "ACT", "D": "AGT", "V": "ACG"}
IUPAC_FROM, IUPAC_TO = "ABCDGHMNRSTUVWXY", "TVGHCDKNYSAABWXR"
BASES = "ACGT"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(seq: Column | str) -> Column:
    return F.translate(col(seq), "ACGTacgt", "TGCAtgca")


def revcomp(seq: Column | str) -> Column:
    """Reverse complement of A, C, G and T in either case; other letters stay."""
    return F.reverse(complement(seq))


def revcomp_iupac(seq: Column | str) -> Column:
    """Reverse complement of all IUPAC letters in either case."""
    return F.reverse(F.translate(col(seq), IUPAC_FROM + IUPAC_FROM.lower(), IUPAC_TO + IUPAC_TO.lower()))


def iupac_expand(oligo: Column | str) -> Column:
    """All sequences a degenerate oligo stands for, as an array; null if it has another letter."""
    codes = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    letters = F.split(F.upper(col(oligo)), "")
    grown = F.aggregate(letters, F.array(F.lit("")), lambda done, c: F.flatten(F.transform(done, lambda a: F.transform(F.split(F.element_at(codes, c), ""), lambda b: F.concat(a, b)))))
    return F.when(F.length(col(oligo)) == 0, F.array().cast("array<string>")).otherwise(grown)


def kmers(seq: Column | str, k: int) -> Column:
    """The windows of length k in order, as an array; empty if the sequence is shorter."""
    s = col(seq)
    # One look ahead at each letter: a lambda over positions takes three times as long.
    windows = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.when(F.length(s) >= k, windows).otherwise(F.array().cast("array<string>"))


def overlapping(seq: Column | str, key: Column | str) -> Column:
    """0-based positions of every occurrence of key, overlapping ones included."""
    s, k = col(seq), col(key)
    ends = F.sequence(F.lit(0), F.length(s) - F.length(k))
    return F.when((F.length(s) >= F.length(k)) & (F.length(k) > 0), F.filter(ends, lambda i: F.substr(s, i + 1, F.length(k)) == k)).otherwise(F.array().cast("array<int>"))


def non_overlapping(seq: Column | str, key: str) -> Column:
    """0-based positions of the occurrences of key that a left-to-right scan consumes."""
    s = col(seq)
    quoted = "".join(c if c.isalnum() else f"\\{c}" for c in key)
    parts = F.transform(F.split(s, quoted, -1), F.length)
    state = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("at"))
    step = lambda a, n: F.struct((a.p + n + len(key)).cast("int").alias("p"), F.concat(a["at"], F.array((a.p + n).cast("int"))).alias("at"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), state, step, lambda a: a["at"])


def base_count(seq: Column | str, base: str) -> Column:
    s = col(seq)
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def pad_end(seq: Column | str, length: int) -> Column:
    """N behind shorter reads; longer ones stay whole."""
    s = col(seq)
    return F.when(F.length(s) < length, F.rpad(s, length, "N")).otherwise(s)


def shift(seq: Column | str, start: Column | str, room: Column | int) -> Column:
    """room - start N before the read and start N behind: best-matching parts line up."""
    return F.concat(F.repeat(F.lit("N"), (room if isinstance(room, Column) else F.lit(room)) - col(start)), col(seq), F.repeat(F.lit("N"), col(start)))


def well(name: Column | str) -> Column:
    """A01 to A1."""
    return F.regexp_replace(col(name), "([A-P])0(\\d)", "$1$2")


def path_parts(path: Column | str) -> tuple[Column, Column, Column]:
    """Directory, name without its last suffix, suffix with its dot."""
    p = col(path)
    return F.regexp_extract(p, "^(.*/)?[^/]*$", 1), F.regexp_extract(p, "([^/]*?)(\\.[^./]*)?$", 1), F.regexp_extract(p, "(\\.[^./]*)$", 1)


def trimmed(text: Column | str) -> Column:
    """Without blanks and tabs at both ends."""
    return F.btrim(col(text), F.lit(" \t"))


def chunks(seq: Column | str, size: int) -> Column:
    """Consecutive pieces of `size`; the last one may be shorter."""
    s = col(seq)
    starts = F.sequence(F.lit(0), F.length(s) - 1, F.lit(size))
    return F.when(F.length(s) > 0, F.transform(starts, lambda i: F.substr(s, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def overlapping_chunks(seq: Column | str, size: int, overlap: int) -> Column:
    """Structs (at, part): pieces of size + 2 overlap that start `size` apart, for as long as more
    than twice the overlap is left."""
    s = col(seq)
    starts = F.sequence(F.lit(0), F.length(s) - 2 * overlap - 1, F.lit(size))
    made = F.transform(starts, lambda i: F.struct(i.alias("at"), F.substr(s, i + 1, F.lit(size + 2 * overlap)).alias("part")))
    return F.when(F.length(s) > 2 * overlap, made).otherwise(F.array().cast("array<struct<at:int,part:string>>"))
