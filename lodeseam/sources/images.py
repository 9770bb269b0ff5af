"""Images, split images and directories as pages, with range and start-place selection before any byte is read."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan

from ..operators.pages import MARGIN, PAGE, paged

SCHEMA = "source string, path string, offset bigint, depth int, pagesize int, bufsize int, buf binary"
_SPLIT = re.compile(r"^(.*?)(\d{3})(\.(?:vmdk|raw|img))?$")


def is_split(name: str) -> bool:
    """Whether a file is the first of numbered segments (.000, .001, 001.vmdk)."""
    m = _SPLIT.match(name)
    return bool(m) and m.group(2) in ("000", "001") and (m.group(1).endswith(".") or bool(m.group(3)))


def segments(first: str, names: list[str]) -> list[str]:
    """The numbered segments among `names` that follow the first without a gap."""
    m = _SPLIT.match(first)
    if not m or not is_split(first):
        return [first]
    head, number, tail = m.group(1), int(m.group(2)), m.group(3) or ""
    out, there = [], set(names)
    while (name := f"{head}{number:03d}{tail}") in there:
        out.append(name)
        number += 1
    return out or [first]


class _Piece(InputPartition):
    def __init__(self, source: str, offset: int, size: int, parts: list[tuple[str, int, int]]):
        self.source, self.offset, self.size, self.parts = source, offset, size, parts


class PagedImage(DataSource):
    """`spark.read.format("lodeseam_image")`: one partition for each group of pages of raw and split images.

    Options: path (a file, comma-separated files or a glob; seen by the executors under the same name), pagesize, margin,
    start, end (bytes of the image), pages_per_task. Filters on `offset` choose pages before they are read.
    """

    @classmethod
    def name(cls) -> str:
        return "lodeseam_image"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.page, self.margin = int(options.get("pagesize", PAGE)), int(options.get("margin", MARGIN))
        self.path, self.group = options["path"], int(options.get("pages_per_task", 4))
        self.low, self.high = int(options.get("start", 0)), int(options["end"]) if options.get("end") else None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if f.attribute == ("offset",) if hasattr(f, "attribute") else False:
                if isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan):
                    self.high = f.value if self.high is None else min(self.high, f.value)
                elif isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), f.value + 1 if self.high is None else min(self.high, f.value + 1)
            yield f  # Spark tests each row as well

    def partitions(self) -> list[_Piece]:
        import glob
        import os

        out = []
        for pattern in self.path.split(","):
            for name in sorted(glob.glob(pattern.removeprefix("file://"))):
                if _SPLIT.match(name) and not is_split(name):
                    continue  # a later segment comes with its first
                files = segments(name, [os.path.join(os.path.dirname(name), x) for x in os.listdir(os.path.dirname(name) or ".")])
                bounds, total = [], 0
                for f in files:
                    size = os.path.getsize(f)
                    bounds.append((f, total, total + size))
                    total += size
                starts = [i for i in range(0, total, self.page) if i >= self.low and (self.high is None or i < self.high)]
                for i in range(0, len(starts), self.group):
                    for at in starts[i : i + self.group]:
                        out.append(_Piece(name, at, min(self.page, total - at), bounds))
        return out

    def read(self, piece: _Piece) -> Iterator[tuple]:
        wanted, at, buf = self.page + self.margin, piece.offset, []
        for name, start, end in piece.parts:
            if start <= at < end and wanted > 0:
                with open(name, "rb") as f:
                    f.seek(at - start)
                    data = f.read(min(wanted, end - at))
                buf.append(data)
                at += len(data)
                wanted -= len(data)
        raw = b"".join(buf)
        yield (piece.source, "", piece.offset, 0, min(piece.size, len(raw)), len(raw), raw)


def read_image(spark: SparkSession, path: str, page: int = PAGE, margin: int = MARGIN, start: int = 0, end: int | None = None) -> DataFrame:
    """Pages of raw and split images that all executors see under `path`."""
    spark.dataSource.register(PagedImage)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("lodeseam_image").option("path", path).option("pagesize", page).option("margin", margin).option("start", start)
    return (reader.option("end", end) if end is not None else reader).load()


def read_files(spark: SparkSession, path: str, page: int | None = None, margin: int = 0) -> DataFrame:
    """Files of a directory, and of those below it, from any store that Spark reads; a page is a whole file by default."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("source"), "content")
    if page:
        return paged(files, "content", ["source"], page, margin)
    size = F.octet_length("content")
    return files.where(size > 0).select("source", F.lit("").alias("path"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("depth"), size.alias("pagesize"), size.alias("bufsize"), F.col("content").alias("buf"))


def from_column(df: DataFrame, column: str, source: str, page: int = PAGE, margin: int = MARGIN) -> DataFrame:
    """Pages of a table's text or binary column; `source` names the row."""
    named = df.select(F.col(source).cast("string").alias("source"), F.col(column).alias("__raw"))
    return paged(named, "__raw", ["source"], page, margin)


def open_source(spark: SparkSession, path: str, **options) -> DataFrame:
    """A directory as files; all else as an image. Directories that hold images are refused, as their files are pages."""
    import os

    local = path.removeprefix("file://")
    if "://" in path and not path.startswith("file://") or os.path.isdir(local):
        if os.path.isdir(local) and any(n.lower().endswith((".e01", ".000", ".001", ".vmdk")) for n in os.listdir(local)):
            raise ValueError(f"{path} holds disk images; name one of them")
        return read_files(spark, path, **options)
    if local.lower().endswith(".e01"):
        raise NotImplementedError("EWF images need a library that is not here")
    return read_image(spark, path, **options)


def from_buffer(spark: SparkSession, buf: bytes, source: str = "buffer") -> DataFrame:
    """One buffer as one page."""
    return spark.createDataFrame([(source, "", 0, 0, len(buf), len(buf), bytearray(buf))], SCHEMA)
