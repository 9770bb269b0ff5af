"""Connected components of a links table, by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join, so no vertex's neighbours are ever collected, and a vertex with many
links is split by the partial aggregate and the skew join. Before each step the links that lie together, CHUNK at a time,
become stars without a shuffle. Every step is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, written

#: Links that a task holds at one time.
CHUNK = 1 << 17


def _stars(edges: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that connect the same vertices: within every CHUNK each vertex is linked to its smallest only."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in held:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = top(u), top(v)
                up[max(a, b)] = min(a, b)
        pairs = [(x, top(x)) for x in list(up)]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs if p[0] != p[1]], pa.int64()) for i in (0, 1)], names=["u", "v"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                held.append(batch.slice(start, CHUNK))
                rows += len(held[-1])
                if rows >= CHUNK:
                    yield star(held)
                    held, rows = [], 0
        if held:
            yield star(held)

    return edges.mapInArrow(run, "u long, v long")


def _unfinished(edges: DataFrame) -> bool:
    """Whether a vertex has links to several smaller ones, or to smaller and larger ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down > 0 AND up > 0").limit(1).count() > 0


def forest(links: DataFrame) -> DataFrame:
    """From links (a, b: long) to (node, root): the smallest node reachable, for every node linked to a smaller one.

    Links are read twice, so they should be a written table. Tasks hold CHUNK links each, however the links were dealt;
    links that all fit one task are settled by it.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    before = None
    while True:
        tasks = max(1, -(-edges.count() // CHUNK))
        stars = written(_stars(edges.coalesce(tasks)), "links")
        if before is not None:
            deleted(before)
        if tasks == 1 or not _unfinished(stars):
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = before = written(small.where("u <> v").distinct(), "links")
        deleted(stars)


def components(links: DataFrame) -> DataFrame:
    """forest(links) with the roots themselves: (node, root) for every node linked to another one."""
    found = forest(links)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
