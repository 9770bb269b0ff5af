"""The report of a run: what was set, what was gone through, how much was found; and the restart from it."""

from __future__ import annotations

from datetime import UTC, datetime
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import recorder_counts, work_units
from .scan import Options


def run_report(rows: DataFrame, options: Options, source: str) -> str:
    """An XML summary of a scan's rows: settings, totals, and one line a recorder (their number is that of the scanners)."""
    totals = rows.where("kind = 'page'").agg(F.count("*").alias("buffers"), F.max("depth").alias("depth"), F.countDistinct("buf_sha1").alias("distinct")).first()
    alerts = rows.where("kind = 'alert'").count()
    counts = recorder_counts(rows).orderBy("recorder").collect()
    settings = "".join(f"<setting name='{escape(k)}'>{escape(str(v))}</setting>" for k, v in sorted(vars(options).items()))
    found = "".join(f"<recorder><name>{escape(r.recorder)}</name><count>{r.n}</count></recorder>" for r in counts)
    return (
        f"<?xml version='1.0' encoding='UTF-8'?>\n<report><source>{escape(source)}</source><finished>{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}</finished><configuration>{settings}</configuration>"
        f"<totals><buffers>{totals.buffers}</buffers><distinct>{totals.distinct}</distinct><max_depth>{totals.depth or 0}</max_depth><alerts>{alerts}</alerts></totals><recorders>{found}</recorders></report>\n"
    )


def write_work_units(rows: DataFrame, folder: str) -> None:
    """The places gone through, appended run by run."""
    work_units(rows).where("depth = 0").write.mode("append").parquet(f"{folder}/work_units")


def remaining(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Pages that no earlier run of the folder has gone through."""
    seen = spark.read.parquet(f"{folder}/work_units").select("source", F.col("pos0").alias("__pos0")).distinct()
    place = F.when(F.col("path") == "", F.col("offset").cast("string")).otherwise(F.concat_ws("-", "path", F.col("offset").cast("string")))
    return pages.withColumn("__pos0", place).join(seen, ["source", "__pos0"], "left_anti").drop("__pos0")
