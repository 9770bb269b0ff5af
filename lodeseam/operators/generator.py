"""All matches of a pattern with their byte offsets, as a Column expression.

Spark has no such function: the text is split at the matches, and offsets are running sums of the pieces' lengths. Sums
run in blocks of BLOCK matches, so a text with many matches costs its length and not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32
SPANS = "array<struct<offset:bigint,feature:string>>"


def find_all(text: Column, regex: str, needs: str | None = None) -> Column:
    """array of struct(offset: bytes before the match, feature). Texts that do not hold `needs` are not searched."""
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    cells = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(F.octet_length(g).cast("long").alias("g"), F.octet_length(v).cast("long").alias("n"), v.alias("v")))

    def block(xs: Column, start: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(start.cast("long").alias("at"), F.array().cast(SPANS).alias("out")),
            lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("offset"), x["v"].alias("feature")))).alias("out")),
        )["out"]

    def blocks(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK))
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["g"] + x["n"]))
        both = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice(sums, 1, i), F.lit(0).cast("long"), lambda a, x: a + x).alias("at")))
        return F.flatten(F.transform(both, lambda b: block(b["p"], b["at"])))

    # One element holds the list, so that it is computed once for its several uses.
    out = F.element_at(F.transform(F.array(cells), lambda xs: F.when(F.size(xs) <= BLOCK, block(xs, F.lit(0))).otherwise(blocks(xs))), 1)
    return out if needs is None else F.when(text.contains(needs), out).otherwise(F.array().cast(SPANS))


def matches(df: DataFrame, column: str, regex: str, needs: str | None = None) -> DataFrame:
    """df with one row for each match: offset and feature."""
    return df.select("*", F.inline(find_all(F.col(column), regex, needs)))
