"""Interval and as-of joins: which file a place belongs to, runs of blocks, islands of records."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task sorts; about 100 bytes each are held.
TASK_ROWS = 1 << 20


def as_of(places: DataFrame, runs: DataFrame, keys: list[str], at: str, start: str, end: str, buckets: int = 64, width: int | None = None) -> DataFrame:
    """places with the columns of the last run that starts at or before them and has not ended; else nulls.

    Both sides are put in one order within blocks of `width` places: a run also enters each block as that block's carried
    run, found by a running maximum over one row a block, so no key's rows meet in one task and no range is joined.
    """
    width = width or 1 << 20
    block = lambda c: F.floor(F.col(c) / width)
    extra = [c for c in runs.columns if c not in keys]
    run = F.struct(*[F.col(c).alias(c) for c in [start, *[c for c in extra if c != start]]])
    left = places.select(*keys, F.struct(*[F.col(c) for c in places.columns if c not in keys]).alias("__p"), F.col(at).alias("__at"), block(at).alias("__b"), F.lit(1).alias("__k"))
    right = runs.select(*keys, run.alias("__r"), F.col(start).alias("__at"), block(start).alias("__b"), F.lit(0).alias("__k"))
    # The last run of each block, carried to the later blocks that hold places.
    last = right.groupBy(*keys, "__b").agg(F.max("__r").alias("__last"))
    blocks = left.select(*keys, "__b").distinct().join(last, [*keys, "__b"], "full")
    order = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("__carried", F.last("__last", ignorenulls=True).over(order)).select(*keys, "__b", "__carried")
    empty = left.select(*keys, "__p", "__at", "__b", "__k", F.lit(None).cast(right.schema["__r"].dataType).alias("__r"))
    both = empty.unionByName(right.select(*keys, F.lit(None).cast(left.schema["__p"].dataType).alias("__p"), "__at", "__b", "__k", "__r"))
    within = Window.partitionBy(*keys, "__b").orderBy("__at", "__k").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__own", F.last("__r", ignorenulls=True).over(within)).where("__k = 1")
    found = seen.join(carried, [*keys, "__b"], "left").withColumn("__r", F.coalesce("__own", "__carried"))
    inside = F.col("__at") < F.col(f"__r.{end}")
    return found.select(*keys, "__p.*", *[F.when(inside, F.col(f"__r.{c}")).alias(c) for c in extra])


def overlapping(places: DataFrame, runs: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = 1 << 20) -> DataFrame:
    """All runs that hold a place: both sides meet on blocks of `width`, a run in every block that it touches."""
    right = runs.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    left = places.withColumn("__b", F.floor(F.col(at) / width))
    return left.join(right, [*keys, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def islands(df: DataFrame, keys: list[str], order: str, follows: Column) -> DataFrame:
    """df with `island`: it grows by one where a row does not follow the one before it.

    `follows` may use lag(...) columns named __previous_<order>.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn(f"__previous_{order}", F.lag(order).over(w))
    marked = marked.withColumn("__new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", f"__previous_{order}")


def parts_of(df: DataFrame) -> int:
    """Parts of about TASK_ROWS rows, at least one for each core. Of a plain Parquet table only the footers are read."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def runs(df: DataFrame, keys: list[str], steps: dict[str, int], parts: int | None = None, distinct: bool = False) -> DataFrame:
    """Runs of rows, in the order of the columns in `steps`, that each go up by their step: keys, first_<column> and
    last_<column>, n. With distinct, equal rows count as one.

    Only a run's first and last row are kept, by their neighbours in one sorted order, so no table of rows or runs is held:
    a task holds what it sorts. With parts the rows are dealt by keys into so many tasks.
    """
    rows = df.select(*keys, *steps)
    rows = rows.repartition(parts, *keys) if parts else rows
    w = Window.partitionBy(*keys).orderBy(*steps)
    every = lambda f: functools.reduce(lambda a, b: a & b, [f(c, step) for c, step in steps.items()])
    if distinct:
        again = every(lambda c, _: F.lag(c).over(w).eqNullSafe(F.col(c))) & (F.row_number().over(w) > 1)
        rows = rows.withColumn("__again", again).where("NOT __again").drop("__again")
    follows = every(lambda c, step: F.lag(c).over(w) + step == F.col(c))
    goes_on = every(lambda c, step: F.col(c) + step == F.lead(c).over(w))
    no = F.lit(False)
    ends = rows.withColumns({"__first": ~F.coalesce(follows, no), "__last": ~F.coalesce(goes_on, no)}).where("__first OR __last")
    lasts = {f"last_{c}": F.when(F.col("__last"), F.col(c)).otherwise(F.lead(c).over(w)) for c in steps}
    first, step = next(iter(steps.items()))
    n = F.coalesce(F.floor((F.col(f"last_{first}") - F.col(first)) / step).cast("long") + 1, F.lit(1).cast("long"))
    return ends.withColumns(lasts).where("__first").select(*keys, *[x for c in steps for x in (F.col(c).alias(f"first_{c}"), F.col(f"last_{c}"))], n.alias("n"))


def consecutive(df: DataFrame, keys: list[str], order: str, step: int = 1, parts: int | None = None, distinct: bool = False) -> DataFrame:
    """Runs of rows whose order column goes up by `step`: keys, first, last, n. See runs()."""
    found = runs(df, keys, {order: step}, parts, distinct)
    return found.select(*keys, F.col(f"first_{order}").alias("first"), F.col(f"last_{order}").alias("last"), "n")
