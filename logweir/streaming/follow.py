"""Follow files that grow: a streaming source of appended lines, through rotation and restarts.

A file is known by its inode and its first line, not by its name. So a file that is renamed
is read on from where it was, one that takes its name is read from its start, and so is
one that was truncated in place. The offsets that the stream commits are bytes of each file, always
behind a line's end: a line that is still being written waits, and after a restart each line
is taken once. Large ranges are cut, so that many tasks read what has been appended.

Files must lie where the driver and all executors can open them by the same path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.sources.lines import not_blank

NAME = "followed_lines"
#: Bytes that a task reads of a file.
SPLIT_BYTES = 32 << 20


def _source():
    """The source's class. It is made here so that workers get it whole, with nothing to import."""
    import glob
    import os
    import zlib
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    @dataclass
    class Part(InputPartition):
        identity: str
        path: str
        first: int
        start: int
        end: int
        last: int

    class Reader(DataSourceStreamReader):
        head = 1024
        packed = (".gz", ".bz2", ".xz", ".zst")

        def __init__(self, options):
            self.path = options["path"]
            self.split = int(options.get("splitBytes", 32 << 20))
            self.at_end = str(options.get("startingAt", "beginning")) == "end"

        def identity(self, path):
            """Inode and checksum of the first line; none before the line is whole."""
            with open(path, "rb") as file:
                line, sep, _ = file.read(self.head).partition(b"\n")
                full = sep or len(line) == self.head
                return f"{os.fstat(file.fileno()).st_ino}-{zlib.crc32(line)}" if full else None

        def files(self):
            """(identity, path) of the files and their rotated ones, in order of name."""
            names = {p for pattern in (self.path, f"{self.path}.*", f"{self.path}-*") for p in glob.glob(pattern)}
            for path in sorted(names):
                if not path.endswith(self.packed) and os.path.isfile(path):
                    try:
                        known = self.identity(path)
                    except FileNotFoundError:
                        continue
                    if known:
                        yield known, path

        def whole(self, path):
            """Bytes up to the end of the last whole line."""
            with open(path, "rb") as file:
                at = file.seek(0, os.SEEK_END)
                while at > 0:
                    step = min(at, 1 << 16)
                    file.seek(at - step)
                    found = file.read(step).rfind(b"\n")
                    if found >= 0:
                        return at - step + found + 1
                    at -= step
            return 0

        def ends(self):
            found = {}
            for known, path in self.files():
                try:
                    found[known] = [path, self.whole(path)]
                except FileNotFoundError:
                    continue
            return dict(sorted(found.items()))

        def initialOffset(self):
            return {"files": self.ends() if self.at_end else {}}

        def latestOffset(self):
            return {"files": self.ends()}

        def partitions(self, start, end):
            before, parts = start["files"], []
            for known, (path, last) in end["files"].items():
                first = before.get(known, [path, 0])[1]
                for at in range(first, last, self.split):
                    parts.append(Part(known, path, first, at, min(at + self.split, last), last))
            return parts

        def located(self, part):
            for path in (part.path, *(p for _, p in self.files())):
                try:
                    if self.identity(path) == part.identity:
                        return path
                except FileNotFoundError:
                    continue
            raise FileNotFoundError(f"{part.path} was removed before all of it was read")

        def read(self, part):
            """Lines that begin in the part: (line, file, first byte)."""
            with open(self.located(part), "rb") as file:
                at = part.start
                if at > part.first:
                    # The line that lies across the cut is the part's before.
                    file.seek(at - 1)
                    at += len(file.readline()) - 1
                else:
                    file.seek(at)
                while at < part.end:
                    line = file.readline()
                    yield line.rstrip(b"\r\n").decode("utf-8", "replace"), part.identity, at
                    at += len(line)

        def commit(self, end):
            pass

    class Followed(DataSource):
        @classmethod
        def name(cls):
            return "followed_lines"

        def schema(self):
            return "value string, file string, mid bigint"

        def streamReader(self, schema):
            return Reader(self.options)

    return Followed


def follow_lines(spark: SparkSession, path: str, starting_at: str = "beginning", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of the non-blank lines of ``path`` (a file or a pattern) and of its rotated files.

    Rotated files are those whose names begin with the path and a dot or a dash; compressed
    ones are left out. ``starting_at="end"`` takes only what is appended from now on.
    ``file`` names the file by its identity, and ``mid`` is the line's first byte, so lines
    have the order that they have in the file.
    """
    if starting_at not in ("beginning", "end"):
        raise ValueError(f"Unknown start '{starting_at}'. Available: beginning, end")
    spark.dataSource.register(_source())
    options = {"path": path, "startingAt": starting_at, "splitBytes": str(split_bytes)}
    lines = spark.readStream.format(NAME).options(**options).load()
    return not_blank(lines.select("value", "file", F.lit(0).cast("bigint").alias("block_start"), "mid"))
