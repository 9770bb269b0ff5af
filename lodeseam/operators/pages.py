"""Pages: overlapping slices of bytes, and the gates that keep useless ones from the scanners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of the scan.
PAGE = 16 << 20
MARGIN = 4 << 20
MIN_SIZE = 16
MIN_DISTINCT = 4
MAX_NGRAM = 10
MAX_DEPTH = 7


def paged(df: DataFrame, column: str, keep: list[str], page: int = PAGE, margin: int = MARGIN) -> DataFrame:
    """One row for each page: keep, offset, pagesize, bufsize, buf (the page and its look-ahead). Nulls have no page."""
    raw = F.col(column).cast("binary")
    total = F.octet_length(raw).cast("long")
    starts = F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / page)), lambda i: i * page))
    rows = df.select(*keep, raw.alias("__raw"), F.explode(starts).alias("offset"))
    size = F.octet_length("__raw").cast("long")
    return rows.select(
        *keep,
        F.lit("").alias("path"),
        "offset",
        F.lit(0).alias("depth"),
        F.least(F.lit(page).cast("long"), size - F.col("offset")).cast("int").alias("pagesize"),
        F.least(F.lit(page + margin).cast("long"), size - F.col("offset")).cast("int").alias("bufsize"),
        F.substring("__raw", (F.col("offset") + 1).cast("int"), F.lit(page + margin)).alias("buf"),
    )


def owned(features: DataFrame, page_offset: str = "page_offset", pagesize: str = "pagesize") -> DataFrame:
    """Features that begin in the page and not in its look-ahead, which the next page owns."""
    return features.where(F.col("offset") < F.col(page_offset) + F.col(pagesize))


def distinct_bytes(buf: Column) -> Column:
    """Number of different byte values."""
    return F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(F.hex(buf), "(..)", "$1 "), " "), lambda x: x != "")))


def ngram_size(buf: Column, most: int = MAX_NGRAM) -> Column:
    """The smallest n below `most` such that the buffer is its first n bytes over and over, at least twice; else 0."""
    size = F.octet_length(buf)
    text = F.decode(buf, "ISO-8859-1")
    cases = F.lit(0)
    for n in range(most - 1, 0, -1):
        head = F.substring(text, 1, n)
        cases = F.when((size >= 2 * n) & (F.substring(F.repeat(head, F.ceil(size / n).cast("int")), 1, 2_000_000_000) .startswith(text)), n).otherwise(cases)
    return cases


def gated(pages: DataFrame, min_size: int = MIN_SIZE, min_distinct: int = MIN_DISTINCT, max_ngram: int = MAX_NGRAM, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pages worth scanning: large enough, no repeated n-gram, several byte values, not too deep. Cheap tests come first."""
    return pages.where((F.octet_length("buf") >= min_size) & (F.col("depth") < max_depth)).where(ngram_size(F.col("buf"), max_ngram) == 0).where(distinct_bytes(F.col("buf")) >= min_distinct)


def unseen(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """Pages whose place an earlier run has not begun (seen: pos0)."""
    place = F.when(F.col("path") == "", F.col("offset").cast("string")).otherwise(F.concat_ws("-", "path", F.col("offset").cast("string")))
    return pages.withColumn("__pos0", place).join(seen.select(F.col("pos0").alias("__pos0")).distinct(), "__pos0", "left_anti").drop("__pos0")


def sampled(pages: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """A fraction of the pages, chosen by a hash of their place, so that a page is read only if it is chosen."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction lies between 0 and 1")
    return pages.where(F.pmod(F.xxhash64("path", "offset", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))
