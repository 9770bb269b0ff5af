"""Sinks: report lines, carved files, packet captures, work units. Folders are ones that all executors share."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def banner(recorder: str, note: str = "") -> list[str]:
    """The head of a file of lines."""
    return [*([f"# BANNER {note}"] if note else []), "# lodeseam", f"# Feature-Recorder: {recorder}", "# Feature-File-Version: 1.1", f"# Started: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"]


def write_feature_lines(features: DataFrame, folder: str, note: str = "", mode: str = "append") -> None:
    """pos0, feature and context by tabs, a folder for each recorder; contexts that are empty are left out.

    Every file begins with its recorder's banner: a task puts it before the first line of each recorder it meets.
    """
    tail = F.when(F.coalesce(F.col("context"), F.lit("")) != "", F.concat(F.lit("\t"), F.col("context"))).otherwise("")
    line = F.concat("pos0", F.lit("\t"), "feature", tail)

    def headed(batches) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            recorders, values = [], []
            for recorder, value in zip(batch.column("recorder").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if recorder != last:
                    head = banner(recorder, note)
                    recorders += [recorder] * len(head)
                    values += head
                    last = recorder
                recorders.append(recorder)
                values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(recorders, pa.string()), pa.array(values, pa.string())], names=["recorder", "value"])

    # Sorted by recorder alone, which the writer asks for as well, so that a banner stays before its lines.
    rows = features.select("recorder", line.alias("value")).where("value IS NOT NULL").sortWithinPartitions("recorder")
    rows.mapInArrow(headed, "recorder string, value string").write.partitionBy("recorder").mode(mode).text(folder)


def write_histograms(histograms: DataFrame, folder: str) -> None:
    """Ordered lines for each histogram; one range-sorted file list a histogram."""
    ordered = histograms.repartitionByRange("recorder", "suffix", F.desc("n"), "feature").sortWithinPartitions("recorder", "suffix", F.desc("n"), "feature")
    ordered.select("recorder", "suffix", _line().alias("value")).write.partitionBy("recorder", "suffix").mode("overwrite").text(folder)


def _line():
    tail = F.when(F.col("n_utf16") > 0, F.concat(F.lit("\t(utf16="), F.col("n_utf16").cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("n="), F.col("n").cast("string"), F.lit("\t"), F.col("feature"), tail)


def write_carved(carved: DataFrame, folder: str) -> DataFrame:
    """One file for each carved object (rel_path, hash, data) under a shared folder; (rel_path, hash, size, cached).

    A file is written under another name first and then renamed, so a repeated task leaves no half file. Objects with a
    hash that an earlier place has are not written again.
    """
    first = carved.groupBy("hash").agg(F.min("rel_path").alias("__first"))
    rows = carved.join(first, "hash").withColumn("cached", F.col("rel_path") != F.col("__first")).select("rel_path", "hash", "data", "cached")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name, data, cached in zip(*[batch.column(c).to_pylist() for c in ("rel_path", "data", "cached")], strict=True):
                sizes.append(len(data))
                if not cached:
                    path = os.path.join(folder, name)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(f"{path}.{os.getpid()}.part", "wb") as f:
                        f.write(data)
                    os.replace(f"{path}.{os.getpid()}.part", path)
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), batch.column("hash"), pa.array(sizes, pa.int64()), batch.column("cached")], names=["rel_path", "hash", "size", "cached"])

    return rows.mapInArrow(run, "rel_path string, hash string, size bigint, cached boolean")


def write_packets(rows: DataFrame, folder: str, most: int = 100_000) -> DataFrame:
    """Packets that the scan carved, in the order of their places, as capture files: (file, packets).

    Packets of one kind of link and source are dealt by ranges of places into files of about `most` packets, numbered in
    their order, so no task holds all of an image's packets; each task writes as it reads.
    """
    packets = rows.where("kind = 'carved' AND recorder LIKE 'packets%'").select("recorder", "source", "path", "offset", "data")
    parts = max(1, -(-packets.count() // most))
    order = ["recorder", "source", "path", "offset"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, key, out, made, n = TaskContext.get().partitionId(), None, None, [], 0

        def close() -> None:
            if out:
                out.close()
                os.replace(made[-1] + ".part", made[-1])
                done.append((os.path.basename(made[-1]), n))

        done: list[tuple[str, int]] = []
        for batch in batches:
            for recorder, source, data in zip(*[batch.column(c).to_pylist() for c in ("recorder", "source", "data")], strict=True):
                if (recorder, source) != key:
                    close()
                    key, n = (recorder, source), 0
                    link = int(recorder.rpartition("_")[2]) if "_linktype_" in recorder else 1
                    made.append(os.path.join(folder, f"{recorder}-{''.join(c if c.isalnum() else '_' for c in source)[-80:]}-{number:05d}.pcap"))
                    out = open(made[-1] + ".part", "wb")  # noqa: SIM115
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link))
                out.write(data)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["file", "packets"])

    return packets.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "file string, packets bigint")


def work_units(rows: DataFrame) -> DataFrame:
    """(source, pos0, depth, sha1): the buffers that a scan went through, for a restart and for the report."""
    return rows.where("kind = 'page'").select("source", "pos0", "depth", F.col("buf_sha1").alias("sha1"))


def recorder_counts(rows: DataFrame) -> DataFrame:
    return rows.where("kind IN ('feature', 'carved')").groupBy("recorder").agg(F.count("*").alias("n"))
