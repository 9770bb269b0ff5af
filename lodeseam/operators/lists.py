"""Stop and alert lists: what is known and diverted, and what is wanted and copied."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lists of up to so many rows are broadcast; larger literal lists are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Patterns that a list may hold, and those that are joined to one alternation.
PATTERNS, ALTERNATIVES = 500, 50

LIST = "feature string, before string, after string, is_regex boolean"


def parsed(lines: DataFrame) -> DataFrame:
    """LIST rows of a list file's lines (value): place, feature and context; place and feature; a pattern; or a literal."""
    line = F.regexp_replace("value", "\r$", "")
    parts = F.split(line, "\t")
    feature = F.when(F.size(parts) >= 3, parts[1]).when(F.size(parts) == 2, F.element_at(parts, 2)).otherwise(line)
    context = F.when(F.size(parts) >= 3, parts[2])
    at = F.instr(context, feature)
    before = F.when(at > 0, F.substring(context, F.lit(1), at - 1)).otherwise("")
    after = F.when(at > 0, F.substring(context, at + F.length(feature), F.length(context))).otherwise("")
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(feature.alias("feature"), before.alias("before"), after.alias("after"), ((F.size(parts) == 1) & line.rlike(r"[*\[(?]")).alias("is_regex"))


def literals(spark: SparkSession, values: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType()), T.StructField("is_regex", T.BooleanType())])
    return spark.createDataFrame([(v, "", "", any(c in v for c in "*[(?")) for v in values], schema)


def _joined(features: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Features with (semi) or without (anti) a row of the list.

    A literal matches the equal feature whose context agrees with the list's as far as both go: to the left of the feature
    compared from its left edge backwards, to the right forwards. A pattern matches anywhere, in any case.
    """
    exact = listed.where("NOT is_regex").select(F.col("feature").alias("__f"), F.col("before").alias("__b"), F.col("after").alias("__a")).distinct()
    exact = F.broadcast(exact) if exact.count() <= BROADCAST_ROWS else exact
    patterns = [r.feature for r in listed.where("is_regex").select("feature").distinct().orderBy("feature").limit(PATTERNS + 1).collect()]
    if len(patterns) > PATTERNS:
        raise ValueError(f"a list holds more than {PATTERNS} patterns")
    context = F.col("context") if "context" in features.columns else F.col("feature")
    at = F.instr(context, F.col("feature"))
    left, right = F.substring(context, F.lit(1), at - 1), F.substring(context, at + F.length("feature"), F.length(context))
    n, m = F.least(F.length(left), F.length("__b")), F.least(F.length(right), F.length("__a"))
    agrees = (F.right(left, n) == F.right(F.col("__b"), n)) & (F.left(right, m) == F.left(F.col("__a"), m))
    alternations = ["(?i)" + "|".join(f"(?:{p})" for p in patterns[i : i + ALTERNATIVES]) for i in range(0, len(patterns), ALTERNATIVES)]
    hit = functools.reduce(lambda a, b: a | b, [F.col("feature").rlike(p) for p in alternations], F.lit(False))
    row = features.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    by_pattern, plain = row.where("__hit").drop("__hit"), row.where("NOT __hit").drop("__hit")
    joined = plain.join(exact, (F.col("feature") == F.col("__f")) & agrees, how)
    return joined.unionByName(by_pattern) if how == "left_semi" and patterns else joined


def kept(features: DataFrame, stop: DataFrame) -> DataFrame:
    """Features that no row of the stop list matches."""
    return _joined(features, stop, "left_anti")


def stopped(features: DataFrame, stop: DataFrame) -> DataFrame:
    """The others, under <recorder>_stopped."""
    return _joined(features, stop, "left_semi").withColumn("recorder", F.concat("recorder", F.lit("_stopped")))


def alerts(features: DataFrame, alert: DataFrame) -> DataFrame:
    """Copies of the features that the alert list matches, under ALERTS_found."""
    return _joined(features, alert, "left_semi").withColumn("recorder", F.lit("ALERTS_found"))


def applied(features: DataFrame, stop: DataFrame | None = None, alert: DataFrame | None = None) -> DataFrame:
    """Features with those of the stop list diverted and those of the alert list copied."""
    out = features
    if stop is not None:
        out = kept(features, stop).unionByName(stopped(features, stop))
    if alert is not None:
        out = out.unionByName(alerts(features, alert))
    return out
