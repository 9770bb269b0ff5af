"""Readers of feature and histogram files, file maps and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text


def _lines(spark: SparkSession, path: str) -> DataFrame:
    first = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(path).select(first.alias("value")).where(~F.col("value").startswith("#") & (F.col("value") != ""))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(pos0, path, offset, feature, context) of feature files: three to eleven columns, the first begins with a digit."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path).where(F.col("value").rlike(r"^[^\t]*\d\t") & F.size(parts).between(2, 11))
    own = rows.select(parts[0].alias("pos0"), text.legacy_hex_to_octal(parts[1]).alias("feature"), F.try_element_at(parts, F.lit(3)).alias("context"))
    where, offset = paths.parse(F.col("pos0"))
    return own.select("pos0", where.alias("path"), offset.alias("offset"), "feature", "context")


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(feature, n, n_utf16) of histogram files."""
    rows = _lines(spark, path).where(F.col("value").rlike(r"^n=\d+\t"))
    wide = F.coalesce(F.regexp_extract("value", r"\t\(utf16=(\d+)\)$", 1).try_cast("long"), F.lit(0).cast("long"))
    return rows.select(F.regexp_replace(F.regexp_extract("value", r"^n=\d+\t(.*)$", 1), r"\t\(utf16=\d+\)$", "").alias("feature"), F.regexp_extract("value", r"^n=(\d+)", 1).cast("long").alias("n"), wide.alias("n_utf16"))


def read_file_map(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, filename, md5, allocated) of the byte runs of an XML file map."""
    schema = "filename string, filesize long, alloc int, unalloc int, hashdigest array<struct<_VALUE:string,_type:string>>, byte_runs struct<byte_run:array<struct<_img_offset:long,_len:long>>>"
    files = spark.read.format("xml").option("rowTag", "fileobject").schema(schema).load(path)
    md5 = F.filter(F.col("hashdigest"), lambda h: F.lower(h["_type"]) == "md5")
    runs = files.select("filename", F.try_element_at(md5, F.lit(1))["_VALUE"].alias("md5"), (F.coalesce("unalloc", F.lit(0)) == 0).alias("allocated"), F.explode("byte_runs.byte_run").alias("r"))
    return runs.select(F.col("r._img_offset").alias("start"), (F.col("r._img_offset") + F.col("r._len")).alias("end"), "filename", "md5", "allocated")


def with_files(features: DataFrame, runs: DataFrame, width: int = 1 << 30) -> DataFrame:
    """Features with the file that their place in the image belongs to: allocated files first, then others."""
    from ..operators.joins import as_of

    at = features.withColumn("__at", paths.image_offset(F.col("path"), F.col("offset"))).withColumn("__one", F.lit(1))
    out = at
    for flag, prefix in ((True, "a"), (False, "u")):
        own = runs.where(F.col("allocated") == flag).select(F.lit(1).alias("__one"), F.col("start").alias(f"{prefix}_start"), F.col("end").alias(f"{prefix}_end"), F.col("filename").alias(f"{prefix}_name"), F.col("md5").alias(f"{prefix}_md5"))
        out = as_of(out, own, ["__one"], "__at", f"{prefix}_start", f"{prefix}_end", width=width)
    found = out.withColumn("filename", F.coalesce("a_name", "u_name")).withColumn("md5", F.coalesce("a_md5", "u_md5"))
    return found.select(*features.columns, "filename", "md5")
