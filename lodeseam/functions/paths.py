"""Forensic paths: where a feature was found, through all decoders, as `path` and `offset`.

`1000-GZIP-300-BASE64` with offset 30 reads: at byte 30 of what BASE64 made of byte 300 of what GZIP made of byte 1000.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: stands between a file's name and the path inside it.
FILE_MARK = "\U0010001c"


@dataclass(frozen=True, order=True)
class Pos:
    """A place; orders by path, then by offset."""

    path: str = ""
    offset: int = 0

    def __str__(self) -> str:
        return f"{self.path}-{self.offset}" if self.path else str(self.offset)

    @property
    def depth(self) -> int:
        return len(re.findall(r"-[A-Z]", self.path))

    def into(self, decoder: str) -> Pos:
        return Pos(f"{self}-{decoder}", 0)

    def moved(self, by: int) -> Pos:
        if self.offset + by < 0:
            raise ValueError("a place can't lie before its buffer")
        return Pos(self.path, self.offset + by)

    def shifted(self, by: int) -> Pos:
        """The same place in an image that has `by` more bytes in front."""
        head, rest = re.match(r"(\d*)(.*)", self.path).groups()
        return Pos(f"{int(head) + by}{rest}", self.offset) if head else Pos(self.path, self.offset + by) if not self.path else self

    @property
    def image_offset(self) -> int:
        head = re.match(r"\d+", self.path)
        return int(head.group()) if head else self.offset

    @classmethod
    def parse(cls, text: str) -> Pos:
        path, _, offset = text.rpartition("-")
        return cls(path, int(offset))


def pos0(path: Column, offset: Column) -> Column:
    return F.when(path == "", offset.cast("string")).otherwise(F.concat_ws("-", path, offset.cast("string")))


def depth(path: Column) -> Column:
    return F.regexp_count(path, F.lit("-[A-Z]"))


def first_part(path: Column) -> Column:
    return F.when(path.contains("-"), F.substring_index(path, "-", 1)).otherwise(F.lit(""))


def last_part(path: Column) -> Column:
    return F.when(path.contains("-"), F.substring_index(path, "-", -1)).otherwise(F.lit(""))


def alpha_part(path: Column) -> Column:
    """The decoders' names, joined by slashes."""
    return F.array_join(F.filter(F.split(path, "-"), lambda p: p.rlike("^[A-Za-z]")), "/")


def image_offset(path: Column, offset: Column) -> Column:
    head = F.regexp_extract(path, r"^(\d+)", 1)
    return F.when(head == "", offset).otherwise(head.try_cast("long"))


def parse(text: Column) -> tuple[Column, Column]:
    """(path, offset) of a printed place."""
    path = F.regexp_extract(text, r"^(.*)-\d+$", 1)
    return path, F.regexp_extract(text, r"(\d+)$", 1).try_cast("long")
