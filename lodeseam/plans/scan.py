"""The scan: pages through gates, scanners and decoders to features, carved objects, alerts and provenance.

Every page is handled in one pass: all scanners run over it, and what decoders yield is gone through at once, depth first,
down to MAX_DEPTH, so recursion needs no shuffle and no loop over jobs. A scanner that fails gives an alert row, and the
others go on. Repeated buffers are told by their SHA-1 afterwards: with dedupe, only the rows of a buffer's first place
stay, which is the same in every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scanners as S
from ..functions import text
from ..functions.paths import Pos
from ..operators import duplicates as repeats
from ..operators import histograms, lists
from ..operators.pages import MAX_DEPTH, MAX_NGRAM
from ..scanners import Carved, Child, Found, Page
from ..sources import sinks

ROWS = (
    "kind string, recorder string, source string, path string, offset bigint, pos0 string, feature string, context string, "
    "is_utf16 boolean, depth int, buf_sha1 string, hash string, data binary"
)
_TYPES = [pa.string()] * 3 + [pa.string(), pa.int64()] + [pa.string()] * 3 + [pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.binary()]
_NAMES = [f.split()[0] for f in ROWS.split(", ")]


@dataclass(frozen=True)
class Options:
    """What a scan does; scanners' own settings are in `settings`."""

    enable: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    context: int = 16
    max_depth: int = MAX_DEPTH
    max_ngram: int = MAX_NGRAM
    carve_mode: int = 1  # 0: nothing, 1: what was encoded, 2: everything
    settings: dict = field(default_factory=dict)


def ngram(buf: bytes, most: int) -> int:
    """The smallest n below `most` such that the buffer is its first n bytes over and over; else 0."""
    for n in range(1, most):
        if len(buf) >= 2 * n and buf[n:] == buf[:-n]:
            return n
    return 0


def scanned(buf: bytes, size: int, place: Pos, options: Options, scanners: list, memory: bool = False) -> Iterator[tuple]:
    """Rows of a buffer and of all that its decoders find, without the source."""
    depth = place.depth
    digest = hashlib.sha1(buf).hexdigest()

    def row(kind, recorder, at, feature, context, wide=False, hash_=None, data=None) -> tuple:
        where = place.moved(at)
        return (kind, recorder, where.path, where.offset, str(where), feature, context, wide, depth, digest, hash_, data)

    yield row("page", "pages", 0, None, None)
    if depth >= options.max_depth:
        yield row("alert", "alerts", 0, "process_extract: MAX DEPTH REACHED", None)
        return
    if ngram(buf, options.max_ngram):
        return
    distinct = len(set(buf))
    for s in scanners:
        if len(buf) < s.min_size or distinct < s.min_distinct or s.depth0_only and depth:
            continue
        page = Page(buf, size, place.path, place.offset, depth, memory, options.settings)
        try:
            for x in s.run(page):
                if x.at >= size:
                    continue
                if isinstance(x, Found):
                    raw = x.feature if isinstance(x.feature, bytes) else None
                    feature = text.as_utf8(raw) if raw is not None else x.feature
                    length = x.length if x.length is not None else len(raw if raw is not None else x.feature.encode())
                    around = x.context if x.context is not None else text.as_utf8(buf[max(0, x.at - options.context) : x.at + length + options.context])
                    yield row("alert" if x.recorder == "alerts" else "feature", x.recorder, x.at, feature, around, x.utf16)
                elif isinstance(x, Carved):
                    if options.carve_mode == 2 or options.carve_mode == 1 and place.path:
                        sha = hashlib.sha1(x.data).hexdigest()
                        where = place.moved(x.at)
                        name = f"{x.recorder}/{int(sha[:8], 16) % 1000:03d}/{text.safe_name_py(str(where))}{x.ext}"
                        note = f"<fileobject><filename>{name}</filename><filesize>{len(x.data)}</filesize><hashdigest type='sha1'>{sha}</hashdigest></fileobject>"
                        yield row("carved", x.recorder, x.at, name, note, False, sha, x.data)
                elif isinstance(x, Child) and x.data:
                    yield from scanned(x.data, len(x.data), place.moved(x.at).into(x.tag), options, scanners, memory or x.memory)
        except Exception as e:  # one scanner's failure is no other's
            yield row("alert", "alerts", 0, f"scanner={s.name}", f"{type(e).__name__}: {e}")


def scan(pages: DataFrame, options: Options | None = None, source: str = "source") -> DataFrame:
    """ROWS of all pages (columns: source, path, offset, pagesize, buf)."""
    options = options or Options()
    chosen = S.enabled(options.enable, options.disable, options.only)
    # A small input in fewer parts than there are cores is dealt out, as scanning costs more than moving it.
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if not pages.isStreaming and pages.rdd.getNumPartitions() < cores:
        pages = pages.repartition(cores)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                name, path, offset, size, buf = (batch.column(c)[i].as_py() for c in ("source", "path", "offset", "pagesize", "buf"))
                if buf is None:
                    continue
                rows, held = [], 0
                for kind, recorder, *rest in scanned(buf, size, Pos(path or "", offset), options, chosen):
                    rows.append((kind, recorder, name, *rest))
                    held += len(rest[-1] or b"") + 200
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return pages.select(F.col(source).cast("string").alias("source"), "path", "offset", "pagesize", "buf").mapInArrow(run, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def first_places(rows: DataFrame) -> DataFrame:
    """Rows of each buffer's first place only; a decoded buffer's descendants go with it."""
    place = F.struct("source", "path", "offset")
    own = rows.where("kind = 'page'").select("buf_sha1", place.alias("__place"))
    first = own.groupBy("buf_sha1").agg(F.min("__place").alias("__first"))
    keep = first.select("buf_sha1", F.col("__first.source").alias("source"), F.col("__first.path").alias("path"))
    return rows.join(keep, ["buf_sha1", "source", "path"], "left_semi")


def duplicates(rows: DataFrame) -> DataFrame:
    """(first_pos0, dup_pos0, sha1) of buffers met more than once."""
    own = rows.where("kind = 'page'").select(F.concat_ws("|", "source", "pos0").alias("place"), "buf_sha1")
    return repeats.report(own, "buf_sha1", "place").select(F.col("first_place").alias("first_pos0"), F.col("dup_place").alias("dup_pos0"), F.col("buf_sha1").alias("sha1"))


@dataclass
class Report:
    """What a scan gives: features after the lists, histograms, carved objects, alerts, duplicates, made of its rows."""

    rows: DataFrame
    stop: DataFrame | None = None
    alert: DataFrame | None = None
    dedupe: bool = False

    def __post_init__(self) -> None:
        own = first_places(self.rows) if self.dedupe else self.rows
        found = own.where("kind IN ('feature', 'carved')").select("recorder", "source", "path", "offset", "pos0", "feature", "context", "is_utf16")
        self.features = lists.applied(found, self.stop, self.alert)
        self.histograms = histograms.histograms(self.features.where("recorder NOT LIKE '%!_stopped' ESCAPE '!'"))
        self.carved = own.where("kind = 'carved'").select("recorder", "pos0", F.col("feature").alias("rel_path"), F.octet_length("data").cast("long").alias("size"), "hash", "data")
        self.alerts = own.where("kind = 'alert'").select("source", "pos0", "feature", "context")
        self.duplicates = duplicates(self.rows)

    def write(self, folder: str, lines: bool = False) -> Report:
        """One Parquet table a part, features and histograms by recorder; with lines also as report lines.

        The pages are scanned once: the rows go to `scan`, by kind, and all parts are made of what is read back.
        """
        spark = self.rows.sparkSession
        self.rows.write.partitionBy("kind").mode("overwrite").parquet(f"{folder}/scan")
        stored = Report(spark.read.schema(ROWS).parquet(f"{folder}/scan"), self.stop, self.alert, self.dedupe)
        stored.features.write.partitionBy("recorder").mode("overwrite").parquet(f"{folder}/features")
        features = spark.read.schema(stored.features.schema).parquet(f"{folder}/features")
        histograms.histograms(features.where("recorder NOT LIKE '%!_stopped' ESCAPE '!'")).write.mode("overwrite").parquet(f"{folder}/histograms")
        stored.carved.write.mode("overwrite").parquet(f"{folder}/carved")
        stored.alerts.write.mode("overwrite").parquet(f"{folder}/alerts")
        stored.duplicates.write.mode("overwrite").parquet(f"{folder}/duplicates")
        if lines:
            sinks.write_feature_lines(features, f"{folder}/lines", mode="overwrite")
        return stored


def report(pages: DataFrame, options: Options | None = None, stop: DataFrame | None = None, alert: DataFrame | None = None, dedupe: bool = False, rows: DataFrame | None = None) -> Report:
    """The parts of a scan, each made when it is asked for; Report.write scans once for all of them.

    A part made with dedupe or lists needs the rows several times. To scan once for it, give rows=written(scan(...)).
    """
    return Report(scan(pages, options) if rows is None else rows, stop, alert, dedupe)


def path_query(buf: bytes, path: str, settings: dict | None = None) -> bytes:
    """The bytes at a forensic path: numbers move on, names decode what begins there."""
    tokens, data, at = path.split("-"), buf, 0
    for token in tokens:
        if token.isdigit():
            data, at = data[int(token) :], at + int(token)
            continue
        for s in S.REGISTRY.values():
            page = S.Page(data, len(data), "", 0, 0, False, settings or {})
            if s.name.upper() == token.split("(")[0] or token.startswith("XOR") and s.name == "xor":
                child = next((c for c in s.run(page) if isinstance(c, S.Child) and c.at == 0 and c.tag == token), None)
                if child is None:
                    raise ValueError(f"nothing to decode at {token}")
                data = child.data
                break
        else:
            raise ValueError(f"no decoder is called {token}")
    return data


__all__ = ["Options", "Report", "duplicates", "first_places", "path_query", "report", "scan", "scanned"]
