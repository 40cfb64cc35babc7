"""Reading gzip files with many tasks, where they have many members.

A gzip file may be any number of compressed members one behind the other, as block compressors and
concatenation make them. Tasks get ranges of bytes: each looks for the first member that begins in
its range (the signature, and then the member itself, which must decompress to its end and checksum)
and reads on from member to member until one begins beyond the range. A line belongs to the range in which
it begins; the reader finishes it from the next member. A file of one member is one task's,
as there is no place to begin in it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How a member begins, and the flags that are always 0.
SIGNATURE, RESERVED = b"\x1f\x8b\x08", 0xE0
#: Bytes that are read at once, and of text that is handed on at once.
READ, TEXT = 1 << 18, 4 << 20
#: Ranges of a file that are read first where only its first lines are asked for.
FIRST = 4
#: Bytes of a range.
RANGE = 32 << 20


def opened(path: str):
    """A file of any store that Arrow knows, at random access."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Members:
    """The members of a file from its first that begins at `begin` or behind it."""

    def __init__(self, file, begin: int, stop: int):
        self.file, self.at, self.size = file, begin, file.size()
        if begin:
            self.at = self.sought(begin, stop)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def sought(self, begin: int, stop: int) -> int:
        """Where the first member in the range begins; `stop` if none does."""
        at, held = begin, b""
        while at < stop:
            if len(held) < len(SIGNATURE) + 1:
                held = self.read(at, min(READ, stop - at) + len(SIGNATURE))
            k = held.find(SIGNATURE)
            if k < 0 or at + k >= stop:
                at += max(1, len(held) - len(SIGNATURE))
                held = b""
                continue
            at += k
            if held[k + 3 : k + 4] and not held[k + 3] & RESERVED and self.sound(at):
                return at
            at, held = at + 1, held[k + 1 :]
        return stop

    def sound(self, at: int) -> bool:
        """Whether a member that begins here decompresses to its end."""
        try:
            for _ in self.member(at):
                pass
        except (zlib.error, EOFError):
            return False
        return True

    def member(self, at: int) -> Iterator[bytes]:
        """The text of the member at a place, piece by piece; `self.end` is then where the next one begins."""
        d = zlib.decompressobj(31)
        while not d.eof:
            raw = self.read(at, READ)
            if not raw:
                raise EOFError("a gzip member is cut short")
            at += len(raw)
            text = d.decompress(raw, TEXT)
            while text or d.unconsumed_tail:
                if text:
                    yield text
                if d.eof:
                    break
                text = d.decompress(d.unconsumed_tail, TEXT) if d.unconsumed_tail else b""
        self.end = at - len(d.unused_data)

    def texts(self, stop: int) -> Iterator[tuple[bool, bytes]]:
        """(whether its member begins in the range, text) up to the end of the file."""
        at = self.at
        while at < self.size:
            if self.read(at, 2) != SIGNATURE[:2]:
                return  # padding behind the last member
            for text in self.member(at):
                yield at < stop, text
            at = self.end


def lines_of(file, begin: int, stop: int) -> Iterator[list[bytes]]:
    """The lines that begin in a range, without their ends, some at a time."""
    members = Members(file, begin, stop)
    if members.at >= min(stop, members.size):
        return
    left, skipping = b"", begin > 0
    for inside, text in members.texts(stop):
        if skipping:  # up to the first line feed it is the range's before
            k = text.find(b"\n")
            if k < 0:
                if inside:
                    continue
                return
            text, skipping = text[k + 1 :], False
            if not inside:
                return
        if not inside:
            k = text.find(b"\n")
            if k < 0:
                left += text
                continue
            yield [left + text[:k]]
            return
        *whole, left = (left + text).split(b"\n")
        if whole:
            yield whole
    if left:
        yield [left]


class Range(InputPartition):
    def __init__(self, path: str, begin: int, stop: int):
        self.path, self.begin, self.stop = path, begin, stop


class GzipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.size = int(options.get("range", RANGE))
        self.most = int(options["lines"]) if "lines" in options else None
        self.ranges = int(options["ranges"]) if "ranges" in options else None

    def partitions(self) -> list[Range]:
        return [Range(p, k, min(k + self.size, n)) for p, n in self.files for k in range(0, n, self.size)[: self.ranges]] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        done = 0
        with opened(part.path) as file:
            for lines in lines_of(file, part.begin, part.stop):
                if self.most is not None:
                    lines = lines[: self.most - done]  # no task reads on beyond what is asked of its file
                n = len(lines)
                texts = [x.decode("utf-8", "replace").removesuffix("\r") for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array([part.begin] * n, pa.int64()), pa.array(range(done, done + n), pa.int64()), pa.array(texts, pa.string())], names=["path", "block", "id", "value"])
                done += n
                if done == self.most:
                    return


class GzipLines(DataSource):
    """Lines (path, block, id, value) of gzip files: block is the range's first byte, id counts its lines."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "path string, block long, id long, value string"

    def reader(self, schema) -> DataSourceReader:
        return GzipReader(self.options)


def gzip_lines(spark: SparkSession, paths: list[str] | str, *, bytes_of_range: int = RANGE, lines: int | None = None) -> DataFrame:
    """(path, block, id, value): the lines of gzip files, range by range; with `lines` of so many first ranges
    of each file as hold its first `lines`, and at most so many of each range, so that the first lines of a
    file cost no more than some times these, however long it is. Folders and patterns are taken as Spark's
    readers take them; the list of files, not their content, comes to the driver."""
    spark.dataSource.register(GzipLines)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length").orderBy("path")
    files = [(r.path, r.length) for r in found.collect()]
    reader = spark.read.format("gzip_lines").option("files", json.dumps(files)).option("range", str(bytes_of_range))
    if lines is None:
        return reader.load()
    reader, ranges = reader.option("lines", str(lines)), FIRST
    while True:
        rows = reader.option("ranges", str(ranges)).load()
        # Files that go on beyond these ranges and have too few lines in them: four times as many ranges.
        longer = {p for p, n in files if n > ranges * bytes_of_range}
        if not longer:
            return rows
        enough = {r.path for r in rows.groupBy("path").count().where(F.col("count") >= lines).collect()}
        if longer <= enough:
            return rows
        ranges *= 4
