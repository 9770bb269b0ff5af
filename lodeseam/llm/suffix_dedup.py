"""Removal of repeated byte strings: every byte covered by a SIZE-byte string that also starts earlier.

Earlier means a smaller doc_id, or the same document and an earlier start; strings never reach over a document's end, may
overlap, and are judged on the input.

1. Each document falls into runs of windows by a content-defined key (window_keys): equal windows have equal keys. A task
   first joins equal runs of its own documents, so that a hot passage leaves a task once. Keys that a sample shows to
   have many different runs (a frequent line in ever new surroundings) are split by further keys at once.
2. Runs are dealt by key. Of runs with equal hashes all but the first are claimed to repeat it. Keys with one distinct run
   are done.
3. Where runs of one key differ, or a run may repeat itself, the bytes of one copy of each are fetched and dealt by key;
   runs of a key with over HOT of them are split by further keys first, so that no passage's surroundings meet in one
   task. There shard transforms are merged by interleave refinement (interleave), and the repeated intervals of SIZE
   symbols tell which windows are not the first.
4. A document's claims become stretches that repeat one stretch of one document each, and both sides' bytes are compared.
   Should a claim be wrong, all is done again with another hash, so hashes only group and bytes decide.
5. Spans go back to their documents.

Defined results: a null text counts as empty; texts under SIZE bytes lose nothing; of rows with one doc_id and different
texts the one with the smaller hash of its text comes first; rows equal in doc_id and text are one document, all with its
result; a null doc_id comes last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, deleted, texts, written
from .interleave import Shard, merge
from .window_keys import SIZE, keyed_runs

GRAM = 48
#: Text whose runs a task joins before it sends them on, and text that is hashed at one time, in bytes.
JOINED = 24 << 20
HASHED = 2 << 20
HOT = 256
#: A sample of about so many bytes finds the keys that have at least FREQUENT different runs in it; at most
#: SAMPLED / FREQUENT of them are sent to the tasks.
SAMPLED = 32 << 20
FREQUENT = 64
FURTHER = tuple(range(8))
SHARD = 64 << 10
TASK = 256 << 10
#: Claims are compared in blocks of so many bytes of the stretch that comes first, and a document's spans joined so at first.
COMPARED = 1024
JOINED_SPANS = 1 << 20
#: Spans are joined to the texts by broadcast while they hold at most so many bytes.
BROADCAST = 32 << 20

RUN = np.dtype([("key", "<u8"), ("same", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("at", "<u4"), ("n", "<u2"), ("odd", "?")])
LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): doc orders the documents, tie those that share a doc_id."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    twice = rows.groupBy("doc").count().where("count > 1").limit(1).count()
    return rows.select("doc", (F.xxhash64("text") if twice else F.lit(0)).cast("long").alias("tie"), "text")


def _pieces(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    return np.frombuffer(b"".join(found), np.uint8), ends - np.fromiter(map(len, found), np.int64, len(found)), ends


def _runs(doc: np.ndarray, tie: np.ndarray, found: list[bytes], frequent: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The runs to compare, those of frequent keys split by further keys, and the spans that repeat inside their document."""
    raw, starts, ends = _pieces(found)
    piece, first, n, key, odd, known = keyed_runs(raw, starts, ends, SIZE, GRAM)
    often = np.isin(key, frequent) & ~known if len(frequent) else known & False
    if often.any():
        held = raw.tobytes()
        joined, begins, stops = _pieces([held[a:b] for a, b in zip(first[often].tolist(), (first + n + SIZE - 1)[often].tolist(), strict=True)])
        part, at, length, finer, again, sure_ = keyed_runs(joined, begins, stops, SIZE, GRAM, seeds=FURTHER)
        more = (piece[often][part], first[often][part] + at - begins[part], length, finer, again, sure_)
        piece, first, n, key, odd, known = (np.concatenate([x[~often], y]) for x, y in zip((piece, first, n, key, odd, known), more, strict=True))
    sure = None
    if known.any():
        k = piece[known]
        at = first[known] - starts[k]
        # A negative ss: these bytes are compared already.
        sure = np.stack([doc[k], tie[k], at, at + n[known] + SIZE - 1, doc[k], tie[k], at * 0 - 1], axis=1).astype("<i8")
        piece, first, n, key, odd = (x[~known] for x in (piece, first, n, key, odd))
    out = np.zeros(len(first), RUN)
    held = memoryview(raw)
    out["same"] = [xxhash.xxh3_64_intdigest(held[a:b], seed) for a, b in zip(first.tolist(), (first + n + SIZE - 1).tolist(), strict=True)]
    out["key"], out["doc"], out["tie"], out["at"], out["n"], out["odd"] = key, doc[piece], tie[piece], first - starts[piece], n, odd
    return out, sure


def _sorted(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs by key, bytes and place; whether each begins its kind; its kind's first run; whether it stands elsewhere."""
    runs = runs[np.lexsort([runs[f] for f in ("at", "tie", "doc", "n", "same", "key")])]
    new = np.ones(len(runs), bool)
    for f in ("key", "same", "n"):
        changed = runs[f][1:] != runs[f][:-1]
        new[1:] = changed if f == "key" else new[1:] | changed
    lead = runs[np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))]
    return runs, new, lead, (runs["doc"] != lead["doc"]) | (runs["tie"] != lead["tie"]) | (runs["at"] != lead["at"])


def _claims(runs: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Rows (doc, tie, s, e, src, stie, ss): the bytes [s, e) of a document repeat those of src from ss on."""
    return np.stack([runs["doc"], runs["tie"], runs["at"], runs["at"] + runs["n"].astype(np.int64) + SIZE - 1, lead["doc"], lead["tie"], lead["at"]], axis=1).astype("<i8")


def _frequent(docs: DataFrame) -> np.ndarray:
    """Keys with many different runs in a sample of whole documents, chosen by hash, of about SAMPLED bytes.

    They only say which runs are dealt by further keys; the result is the same whatever is in the sample.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = int(1_000_000 * min(1.0, SAMPLED / max(1, total)))
    some = docs.where(F.pmod(F.xxhash64("doc", "tie", F.lit(17)), F.lit(1_000_000)) < share)
    none = np.zeros(0, np.uint64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", HASHED):
            runs, _ = _runs(batch.column("doc").to_numpy(), batch.column("tie").to_numpy(), texts(batch, "text"), none)
            pairs = np.unique(np.stack([runs["key"], runs["same"]], axis=1).view(np.int64), axis=0) if len(runs) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["key", "same"])

    kinds = some.mapInArrow(run, "key long, same long").groupBy("key").agg(F.approx_count_distinct("same").alias("kinds"))
    return np.sort(np.array([r.key for r in kinds.where(F.col("kinds") >= FREQUENT).collect()], np.int64).view(np.uint64))


def _dealt(docs: DataFrame, buckets: int, seed: int = 0) -> DataFrame:
    """Runs in packed rows (bucket, runs, repeats): runs to compare under their key's bucket, repeats already known."""
    frequent = _frequent(docs)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sure: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            runs, _, lead, later = _sorted(np.concatenate(held))
            spans = np.concatenate([_claims(runs[later], lead[later]), *sure])
            runs = runs[~later]
            bucket = (runs["key"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            runs, bucket = runs[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            parts = np.split(runs, cuts) if len(runs) else []
            names = bucket[np.concatenate([[0], cuts])].tolist() if len(runs) else []
            rows = [(b, p.tobytes(), None) for b, p in zip(names, parts, strict=True)]
            rows += [(int(p[0, 0] + p[0, 2] + i) % buckets, None, p.tobytes()) for i, p in enumerate(np.array_split(spans, 1 + len(spans) // 4096)) if len(p)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "runs", "repeats"])

        for batch in chunks(batches, "text", HASHED):
            found = texts(batch, "text")
            runs, spans = _runs(batch.column("doc").to_numpy(), batch.column("tie").to_numpy(), found, frequent, seed)
            held.append(runs)
            if spans is not None:
                sure.append(spans)
            size += sum(map(len, found))
            if size > JOINED:
                yield out()
                held, sure, size = [], [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "bucket int, runs binary, repeats binary")


FOUND = "doc long, tie long, s int, e int, src long, stie long, ss int, key long, hot boolean"


def _found(rows: np.ndarray, key: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
    """FOUND rows: claims (ss 0 or more), spans that repeat for sure (ss negative), and runs whose bytes are wanted (key)."""
    none = pa.nulls(len(rows))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    columns = [pa.array(np.ascontiguousarray(rows[:, i]).astype(t.to_pandas_dtype()), t) for i, t in enumerate(kinds)]
    columns += [none.cast(pa.int64()) if key is None else pa.array(key.view(np.int64), pa.int64()), none.cast(pa.bool_()) if hot is None else pa.array(hot, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOUND.split(", ")])


def _compared(dealt: DataFrame) -> DataFrame:
    """FOUND rows of the runs that are dealt to a task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += [np.frombuffer(x, RUN) for x in batch.column("runs").to_pylist() if x]
            known = [np.frombuffer(x, "<i8").reshape(-1, 7) for x in batch.column("repeats").to_pylist() if x]
            if known:
                yield _found(np.concatenate(known))
        if not held:
            return
        runs = np.concatenate(held)
        held.clear()
        runs, new, lead, later = _sorted(runs)
        group = np.cumsum(np.concatenate([[True], runs["key"][1:] != runs["key"][:-1]])) - 1
        kinds = np.bincount(group, weights=new)
        wanted = new & ((kinds[group] > 1) | (np.bincount(group, weights=runs["odd"])[group] > 0))
        yield _found(_claims(runs[later], lead[later]))
        yield _found(_claims(runs[wanted], lead[wanted]), runs["key"][wanted], (kinds > HOT)[group][wanted])

    return dealt.mapInArrow(run, FOUND)


def _joined(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by [s, e)."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    i = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return s[i], e[np.append(i[1:], len(s)) - 1]


def _stretches(rows: np.ndarray) -> np.ndarray:
    """Claims (s, e, src, stie, ss) of one document, those joined that meet and repeat one stretch."""
    s, e, src, stie, ss = rows.T
    rows = rows[np.lexsort([s, ss - s, stie, src])]
    s, e, src, stie, ss = rows.T
    same = (src[1:] == src[:-1]) & (stie[1:] == stie[:-1]) & ((ss - s)[1:] == (ss - s)[:-1]) & (s[1:] <= e[:-1])
    # Runs of one length at most follow one another by start, so within a stretch the last end is the largest but for ties.
    i = np.flatnonzero(np.concatenate([[True], ~same]))
    out = rows[i].copy()
    out[:, 1] = np.maximum.reduceat(e, i)
    return out


CLAIM = "struct<s:int,e:int,src:bigint,stie:bigint,ss:int>"
LISTS = f"doc long, tie long, spans binary, claims array<{CLAIM}>"


def _lists(found: DataFrame) -> DataFrame:
    """Per document the packed intervals that repeat, and its claims; long documents are joined in parts first."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("src", pa.int64()), ("stie", pa.int64()), ("ss", pa.int32())]))
        for batch in batches:
            packed, claims = [], []
            for row in batch.column("rows"):
                rows = np.stack([row.values.field(c).to_numpy().astype(np.int64) for c in ("s", "e", "src", "stie", "ss")], axis=1)
                packed.append(np.stack(_joined(rows[:, 0], rows[:, 1]), axis=1).astype("<i4").tobytes())
                rows = rows[rows[:, 4] >= 0]
                claims.append([dict(zip(("s", "e", "src", "stie", "ss"), x, strict=True)) for x in _stretches(rows).tolist()] if len(rows) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(packed, pa.binary()), pa.array(claims, kind)], names=["doc", "tie", "spans", "claims"])

    rows = found.groupBy("doc", "tie", F.shiftright("s", JOINED_SPANS.bit_length() - 1).alias("part")).agg(F.collect_list(F.struct("s", "e", "src", "stie", "ss")).alias("rows"))
    return rows.select("doc", "tie", "rows").mapInArrow(run, LISTS)


def _fetched(docs: DataFrame, lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, key, doc, tie, at, raw): the wanted runs' bytes (kind 0), blocks that claims point to (1), claimed bytes (2).

    Kinds 1 and 2 are named by the document and the place of what comes first.
    """
    claims = lists.select("doc", "tie", F.explode("claims").alias("c")).select("doc", "tie", "c.*")
    blocks = claims.select(F.col("src").alias("doc"), F.col("stie").alias("tie"), F.explode(F.sequence(F.expr(f"ss div {COMPARED}"), F.expr(f"(ss + e - s - 1) div {COMPARED}"))).alias("b")).distinct()
    none = F.lit(None)
    parts = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "e", "key", "hot")).alias("runs"))
    asked = parts.select("doc", "tie", "runs", none.cast(f"array<array<{CLAIM}>>").alias("claims"), none.cast("array<int>").alias("blocks"))
    asked = asked.unionByName(lists.where(F.size("claims") > 0).groupBy("doc", "tie").agg(F.collect_list("claims").alias("claims")), allowMissingColumns=True)
    asked = asked.unionByName(blocks.groupBy("doc", "tie").agg(F.collect_list(F.col("b").cast("int")).alias("blocks")), allowMissingColumns=True)
    asked = asked.groupBy("doc", "tie").agg(F.max("runs").alias("runs"), F.flatten(F.max("claims")).alias("claims"), F.max("blocks").alias("blocks"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc", "tie", "runs", "claims", "blocks")]
            for doc, tie, runs, claimed, wanted_blocks, text in zip(*columns, texts(batch, "text"), strict=True):
                hot = []
                for r in runs or ():
                    if r["hot"]:
                        hot.append(r)
                    else:
                        out.append((0, r["key"], doc, tie, r["s"], text[r["s"] : r["e"]]))
                if hot:
                    parts = [text[r["s"] : r["e"]] for r in hot]
                    joined, starts, ends = _pieces(parts)
                    piece, first, n, key, _, _ = keyed_runs(joined, starts, ends, SIZE, GRAM, seeds=FURTHER)
                    begins = first - starts[piece]
                    for p, b, k, name in zip(piece.tolist(), begins.tolist(), n.tolist(), key.view(np.int64).tolist(), strict=True):
                        out.append((0, name, doc, tie, hot[p]["s"] + b, parts[p][b : b + k + SIZE - 1]))
                for b in wanted_blocks or ():
                    out.append((1, None, doc, tie, b * COMPARED, text[b * COMPARED : (b + 1) * COMPARED]))
                for c in claimed or ():
                    s, ss = c["s"], c["ss"]
                    while s < c["e"]:
                        n = min(c["e"] - s, COMPARED - ss % COMPARED)
                        out.append((2, None, c["src"], c["stie"], ss, text[s : s + n]))
                        s, ss = s + n, ss + n
            found = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds, strict=True)], names=["kind", "key", "doc", "tie", "at", "raw"])

    return docs.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "runs", "claims", "blocks").mapInArrow(run, "kind byte, key long, doc long, tie long, at int, raw binary")


def _all_equal(fetched: DataFrame) -> bool:
    """Whether all claimed bytes equal those that they repeat."""
    b = F.expr(f"at div {COMPARED}").alias("b")
    first = fetched.where("kind = 1").dropDuplicates(["doc", "tie", "at"]).select("doc", "tie", b, F.col("raw").alias("block"))
    claimed = fetched.where("kind = 2").select("doc", "tie", b, F.expr(f"at % {COMPARED}").alias("o"), "raw")
    met = claimed.join(first, ["doc", "tie", "b"], "left").select(F.expr("block IS NOT NULL AND substring(block, o + 1, octet_length(raw)) = raw").alias("ok"))
    return met.where("NOT ok").limit(1).count() == 0


def repeated_windows(strings: list[bytes], doc: np.ndarray, tie: np.ndarray, at: np.ndarray, size: int = SIZE, shard: int = SHARD) -> tuple[np.ndarray, ...]:
    """Places (doc, tie, start) of the windows of the strings that are not the first of their kind."""
    cuts, held = [0], 0
    for i, s in enumerate(strings):
        if i > cuts[-1] and held + len(s) > shard:
            cuts.append(i)
            held = 0
        held += len(s)
    cuts.append(len(strings))
    shards = [Shard(strings[a:b], size) for a, b in zip(cuts, cuts[1:], strict=False)]
    which, position, block = merge(shards, size)
    base = np.cumsum([0, *[len(s.symbols) for s in shards]])
    # Only rows in intervals of two or more rows count.
    rows = np.flatnonzero(np.bincount(block)[block] > 1)
    position, block = position[rows] + base[which[rows]], block[rows]
    ends = np.concatenate([s.ends + b for s, b in zip(shards, base, strict=False)])
    string = np.searchsorted(ends, position)
    start = at[string] + position - np.where(string > 0, ends[string - 1] + 1, 0)
    order = np.lexsort([start, tie[string], doc[string], block])
    b, d, t, s = block[order], doc[string][order], tie[string][order], start[order]
    lead = np.maximum.accumulate(np.where(np.concatenate([[True], b[1:] != b[:-1]]), np.arange(len(b)), 0)) if len(b) else np.zeros(0, np.int64)
    later = (d != d[lead]) | (t != t[lead]) | (s != s[lead])
    return d[later], t[later], s[later]


def _resolved(contexts: DataFrame) -> DataFrame:
    """FOUND rows of the windows that repeat."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: (x[0], x[4], x[1], x[2], x[3]))
        first: list[tuple] = []
        again = []
        for x in held:
            if first and first[-1][0] == x[0] and first[-1][4] == x[4]:
                again.append(x)
            else:
                first.append(x)
        sure = lambda d, t, s, e: _found(np.stack([d, t, s, e, d, t, s * 0 - 1], axis=1))
        if again:
            yield sure(*[np.array([x[i] for x in again], np.int64) for i in (1, 2, 3)], np.array([x[3] + len(x[4]) for x in again], np.int64))
        d, t, s = repeated_windows([x[4] for x in first], *[np.array([x[i] for x in first], np.int64) for i in (1, 2, 3)])
        if not len(d):
            return
        order = np.lexsort([s, t, d])
        d, t, s = d[order], t[order], s[order]
        i = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (np.diff(s) > 1)]))
        yield sure(d[i], t[i], s[i], s[np.append(i[1:], len(d)) - 1] + SIZE)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "doc", "tie", "at", "raw")], strict=True):
                if size > TASK and row[0] != held[-1][0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from flush(held)

    return contexts.mapInArrow(run, FOUND)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, tie, spans): per document with repeats, the packed maximal runs [s, e) of removed bytes."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs if "tie" in docs.columns else _keyed(docs)
    seed, equal = 0, False
    while not equal:
        dealt = _dealt(keyed, max(1024, 4 * parts), seed).repartition(parts, "bucket")
        found = written(_compared(dealt), "found")
        lists = written(_lists(found.where("key IS NULL")), "claims")
        fetched = written(_fetched(keyed, lists, found.where("key IS NOT NULL")), "fetched")
        equal = _all_equal(fetched)
        seed += 1
        deleted(found)
        if not equal:
            deleted(lists, fetched)
    contexts = fetched.where("kind = 0").select("key", "doc", "tie", "at", "raw").repartition(parts, "key").sortWithinPartitions("key")
    more = _lists(_resolved(contexts).select("doc", "tie", "s", "e", "src", "stie", "ss"))
    both = lists.select("doc", "tie", "spans").unionByName(more.select("doc", "tie", "spans"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("spans").to_pylist():
                found = np.frombuffer(b"".join(row), "<i4").reshape(-1, 2)
                out.append(np.stack(_joined(found[:, 0], found[:, 1]), axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(out, pa.binary())], names=["doc", "tie", "spans"])

    merged = both.groupBy("doc", "tie").agg(F.collect_list("spans").alias("spans"))
    out = written(merged.mapInArrow(run, "doc long, tie long, spans binary"), "repeats")
    deleted(lists, fetched)
    return out


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes."""
    keyed = _keyed(docs)
    lists = repeats(keyed)
    total = lists.agg(F.sum(F.octet_length("spans"))).first()[0] or 0
    joined = keyed.join(F.broadcast(lists) if total <= BROADCAST else lists, ["doc", "tie"], "left").select("doc", "text", "spans")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids, rows = batch.column("doc").to_pylist(), []
            for text, spans in zip(texts(batch, "text"), batch.column("spans").to_pylist(), strict=True):
                cut = np.frombuffer(spans, "<i4").reshape(-1, 2).tolist() if spans else []
                parts, at = [], 0
                for s, e in cut:
                    parts.append(text[at:s])
                    at = e
                kept = b"".join([*parts, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if i == LAST else i for i in ids], pa.int64()), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]],
                names=[f.split()[0] for f in KEPT.split(", ")],
            )

    return joined.mapInArrow(run, KEPT)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(docs, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
