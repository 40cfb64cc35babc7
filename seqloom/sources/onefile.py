"""One ordered file out of many tasks.

Rows are sorted by ranges, each task writes its own part, and the parts are joined in their order
by copying bytes from store to store: no task sorts, formats or holds more than its range. Parts that
are compressed make a file of as many gzip members, which gzip_lines reads with many tasks.
"""

from __future__ import annotations

import gzip
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, *, line: Column | str = "value", order: list[Column | str], head: list[str] | None = None, compress: bool = False) -> str:
    """Write `line` of each row in that order behind the lines of `head`; the folder `path` then holds one
    file, whose name is returned. Nothing is written to `path` before all parts are there."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    value = F.col(line) if isinstance(line, str) else line
    rows.select("*", value.alias("_line")).orderBy(*order).select("_line").write.text(parts, compression="gzip" if compress else "none")
    files = place(path).getFileSystem(conf)
    if files.exists(place(path)):
        files.delete(place(parts), True)
        raise FileExistsError(path)
    found = sorted(str(s.getPath().toString()) for s in files.listStatus(place(parts)) if s.getPath().getName().startswith("part-"))
    target = f"{path.rstrip('/')}/part-00000.txt" + ".gz" * compress
    out = files.create(place(target))
    try:
        if head:
            said = "".join(f"{h}\n" for h in head).encode()
            out.write(bytearray(gzip.compress(said) if compress else said))
        for name in found:
            part = files.open(place(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()
    files.delete(place(parts), True)
    return target
