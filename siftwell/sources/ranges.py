"""Files read by byte ranges on executors.

Spark lists files and their sizes without reading them; tasks open a path where it lies and
read only the ranges they need.  Paths of stores that Python can't open (only Spark's readers
can) come with their content instead, so everything downstream works alike.
"""

from __future__ import annotations

import io
import re

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_path(path: str) -> str | None:
    """The path in the file system, if it is one."""
    return "/" + re.sub(r"^(file:)?/+", "", path) if re.match(r"file:/|/", path) else None


def open_input(path: str) -> pa.NativeFile:
    """A file that can be read at any place."""
    if at := local_path(path):
        return pyarrow.fs.LocalFileSystem().open_input_file(at)
    store, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return store.open_input_file(inner)


class Ranged(io.RawIOBase):
    """A file of a path, or of bytes at hand, that is read where asked; n_read counts the bytes."""

    def __init__(self, path: str, data: bytes | None = None) -> None:
        super().__init__()
        self.file = open_input(path) if data is None else pa.BufferReader(data)
        self.local = local_path(path) if data is None else None
        self.size, self.at, self.n_read = self.file.size(), 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, to + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def read(self, n: int | None = -1) -> bytes:
        left = max(0, self.size - self.at)
        got = self.range(self.at, self.at + (left if n is None or n < 0 else min(n, left)))
        self.at += len(got)
        return got

    def readinto(self, into) -> int:
        got = self.read(len(into))
        into[: len(got)] = got
        return len(got)

    def range(self, start: int, stop: int) -> bytes:
        """The bytes from start until before stop, as far as there are any."""
        stop = min(stop, self.size)
        if start >= stop:
            return b""
        got = self.file.read_at(stop - start, start)
        self.n_read += len(got)
        return got

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


class Ahead(Ranged):
    """A file whose small ranges are served from what was read ahead; larger ones are read as they are asked."""

    def __init__(self, path: str, ahead: int = 1 << 21) -> None:
        super().__init__(path)
        self.path, self.ahead, self.base, self.held = path, ahead, 0, b""

    def range(self, start: int, stop: int) -> bytes:
        stop = min(stop, self.size)
        if stop - start >= self.ahead:
            return super().range(start, stop)
        if start < self.base or stop > self.base + len(self.held):
            self.base, self.held = start, super().range(start, start + self.ahead)
        return self.held[start - self.base : stop - self.base] if start < stop else b""


def opens(path: str) -> bool:
    """Whether Python can open a file's path."""
    try:
        open_input(path).close()
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, content) of a file or of the files of a folder; content is null where ranges of the path can be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    first = found.select("path").first()
    if first is None or opens(first.path):
        return found.select("path", "length", F.lit(None).cast("binary").alias("content"))
    return found.select("path", "length", "content")


def tasks(pieces: int, size: int, each: int = 1 << 20) -> int:
    """Tasks for so many pieces of so many bytes: one a piece, unless pieces are very small."""
    return max(1, min(pieces, max(32, size // each)))


def block_size(files: DataFrame, step: int) -> tuple[int, int]:
    """Bytes of the blocks that ranges of ``step`` bytes are dealt out in, and how many tasks take them: whole ranges, up to about 1 MB, less if all files are small."""
    total = files.agg(F.sum("length")).first()[0] or 0
    each = step * max(1, min((1 << 20) // step, total // (32 * step)))
    pieces = files.where("length > 0").agg(F.sum(F.ceil(F.col("length") / each))).first()[0] or 0
    return each, tasks(pieces, total)


def by_range(files: DataFrame, step: int) -> DataFrame:
    """A row (path, start, stop) for each ``step`` bytes of files (path, length), dealt out evenly; ranges of a block go to one task, in order.

    Blocks are shuffled, not ranges, of which there may be very many."""
    each, n = block_size(files, step)
    blocks = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(each).cast("long"))).alias("block")).repartition(n, "path", "block")
    cuts = blocks.select("path", "length", F.explode(F.sequence("block", F.least(F.col("block") + each, "length") - 1, F.lit(step).cast("long"))).alias("start"))
    return cuts.select("path", "start", F.least(F.col("start") + step, "length").alias("stop"))


def dealt(cuts: DataFrame, files: DataFrame, step: int) -> DataFrame:
    """Ranges (path, start, …) of files, dealt out as by_range does it."""
    each, n = block_size(files, step)
    return cuts.repartition(n, "path", F.floor(F.col("start") / each)).sortWithinPartitions("path", "start")
