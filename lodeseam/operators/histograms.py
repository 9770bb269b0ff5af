"""Histograms of features: key by key counts, ordered by count and key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class Histogram:
    """How a recorder's features become keys: lower-cased, digits only, required text, then the pattern's whole match."""

    recorder: str
    suffix: str = "histogram"
    pattern: str = ""
    require: str = ""
    require_context: bool = False
    lowercase: bool = False
    numeric: bool = False


# The declared histograms.
DECLARED = (
    Histogram("email", lowercase=True),
    Histogram("email", "domain_histogram", "(@.*)", lowercase=True),
    Histogram("domain"),
    Histogram("url"),
    Histogram("url", "services", "://([^/]+)"),
    Histogram("url", "microsoft-live", "://((cid-[0-9a-f])+[a-z.].live.com/)"),
    Histogram("url", "facebook-id", "://[-_a-z0-9.]+facebook.com/.*[&?]{1}id=([0-9]+)"),
    Histogram("url", "facebook-address", "://[-_a-z0-9.]+facebook.com/([a-zA-Z0-9.]*[^/?&]$)", lowercase=True),
    Histogram("url", "searches", "search.*[?&/;fF][pq]=([^&/]+)"),
    Histogram("ether", pattern=r"([^\(]+)"),
    Histogram("ccn", numeric=True),
    Histogram("ccn_track2"),
    Histogram("telephone", numeric=True),
    Histogram("pii", "teamviewer", "CT.*CMD_.*((From|To)=[0-9]+)", numeric=True),
    Histogram("find", lowercase=True),
    Histogram("ip", require="cksum-ok", require_context=True),
    Histogram("tcp"),
    Histogram("vin"),
)


def key_of(h: Histogram, feature: Column) -> Column:
    """The key, null where the feature gives none."""
    key = X.ascii_lower(feature) if h.lowercase else feature
    key = X.digits(key) if h.numeric else key
    if h.pattern:
        key = F.when(key.rlike(h.pattern), F.regexp_extract(key, h.pattern, 0))
    return key


def histogram(features: DataFrame, h: Histogram) -> DataFrame:
    """(recorder, suffix, feature, n, n_utf16) of the recorder's features; partial counts are made before the shuffle."""
    rows = features.where(F.col("recorder") == h.recorder)
    if h.require:
        rows = rows.where(F.col("context" if h.require_context else "feature").contains(h.require))
    wide = F.col("is_utf16") if "is_utf16" in features.columns else F.lit(False)
    keyed = rows.select(key_of(h, F.col("feature")).alias("feature"), wide.alias("wide")).where("feature IS NOT NULL AND feature <> ''")
    counted = keyed.groupBy("feature").agg(F.count("*").alias("n"), F.count_if("wide").alias("n_utf16"))
    return counted.select(F.lit(h.recorder).alias("recorder"), F.lit(h.suffix).alias("suffix"), "feature", "n", "n_utf16")


def histograms(features: DataFrame, declared: tuple[Histogram, ...] = DECLARED) -> DataFrame:
    """All declared histograms in one aggregation: each feature row gives a key for every histogram of its recorder."""
    wide = F.col("is_utf16") if "is_utf16" in features.columns else F.lit(False)
    has_context = "context" in features.columns
    cells = []
    for h in declared:
        ok = F.col("recorder") == h.recorder
        if h.require:
            ok = ok & (F.col("context").contains(h.require) if h.require_context and has_context else F.col("feature").contains(h.require))
        cells.append(F.when(ok, F.struct(F.lit(h.recorder).alias("recorder"), F.lit(h.suffix).alias("suffix"), key_of(h, F.col("feature")).alias("feature"))))
    keyed = features.select(wide.alias("wide"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull() & c["feature"].isNotNull() & (c["feature"] != ""))).alias("k"))
    return keyed.groupBy("k.recorder", "k.suffix", "k.feature").agg(F.count("*").alias("n"), F.count_if("wide").alias("n_utf16"))


def ordered(h: DataFrame) -> DataFrame:
    return h.orderBy(F.desc("n"), "feature")


def top(h: DataFrame, n: int = 50) -> DataFrame:
    """The n most frequent keys of each histogram, ties by key; a group limit before the sort keeps tasks small."""
    return h.withColumn("rank", F.expr("row_number() OVER (PARTITION BY recorder, suffix ORDER BY n DESC, feature)")).where(F.col("rank") <= n)


def lines(h: DataFrame) -> DataFrame:
    """The rows as report lines: n=<count>, the key, and the count of UTF-16 finds where there are any."""
    tail = F.when(F.col("n_utf16") > 0, F.concat(F.lit("\t(utf16="), F.col("n_utf16").cast("string"), F.lit(")"))).otherwise("")
    return h.select(F.concat(F.lit("n="), F.col("n").cast("string"), F.lit("\t"), F.col("feature"), tail).alias("value"))
