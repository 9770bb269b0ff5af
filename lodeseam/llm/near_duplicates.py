"""Near duplicates by SetSketch registers, banded, with links confirmed on whole shingle sets.

A document's set holds its distinct shingles of five words (A-Z lower-cased; a shorter text is one shingle; a text without
words has an empty set and no link). Two documents are linked if 100 * intersection >= PERCENT * union.

1. One pass over the texts gives every document its set's size, a 64-bit name of the set, and its sketch. Equal sets fall
   into one class, which from here on is one node however many copies it has.
2. Bands of register values are grouped. In every group each member is paired with the group's first member only, so that
   pairs grow with the members and not with their square.
3. Pairs whose similarity of largest likelihood is too low are left; of the others the texts are fetched, the pairs are
   confirmed on the whole sets, and links are joined to components.
4. Groups that still hold several components are gone through in blocks, by their sketches. Members of the component that
   has most of a group do not meet each other, so rows grow with the members. Where over BLOCK members are of others, each
   pair meets where it shares a second band. Each document gives the one of another component that is most alike, so pairs
   grow with the documents; these are confirmed and joined.
5. The groups are gone through once more. The texts of documents that still have a plausible partner in another component
   go to the groups where they have it, and all such pairs are confirmed inside the blocks, unless links found before connect
   them; only links that join components leave a block. No pair of a group goes without a comparison unless it is connected
   already.

With 36 bands of six registers, a pair at the threshold of 85 shares no band with a probability of 2e-8, and only one band
with 2e-7; under 85 the bands are 43 of five registers, which gives the same at 80. The estimate must miss by the margin,
five standard errors, to lose one. Shingles and sets are named by 64-bit hashes.

Defined results: a null or empty text is its own component with n_shingles 0; equal rows are copies, of which one row only
is kept; rows that share a doc_id but not their text are separate documents, told apart by their sets; a null doc_id never
names a component unless all of its documents lack one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, deleted, give_back, small_batches, texts, written
from .components import forest
from .setsketch import REGISTERS, ROWS, at_least, mix, sketches

WORDS = 5
PERCENT = 85
MARGIN = 0.12
#: Registers of a band under PERCENT, where six would lose more.
LOW_ROWS = 5
BLOCK = 512
#: Ids of documents to be fetched are broadcast up to this number; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of the words whose hashes a worker keeps.
KNOWN_BYTES = 1 << 20

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Shingles:
    """64-bit names of a text's distinct shingles, ascending."""

    def __init__(self, size: int = WORDS):
        self.size, self.known, self.held = size, {}, 0

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.translate(_LOWER).split() if text else []
        known = self.known
        if self.held > KNOWN_BYTES:
            known.clear()
            self.held = 0
        ids = []
        for w in words:
            x = known.get(w)
            if x is None:
                x = xxhash.xxh3_64_intdigest(w)
                if self.held <= KNOWN_BYTES:
                    known[w] = x
                    self.held += len(w)
            ids.append(x)
        ids = np.array(ids, np.uint64)
        if len(ids) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(ids.tobytes(), seed=1)], np.uint64) if len(ids) else ids
        total = np.zeros(len(ids) - self.size + 1, np.uint64)
        for j in range(self.size):
            total = mix(total * _STEPS[j % len(_STEPS)] + ids[j : len(ids) - self.size + 1 + j])
        return np.unique(total)


SIGNED = "doc_id long, n_shingles long, node long, sketch binary"


def _name(shingles: np.ndarray) -> int | None:
    """The 64-bit name of a set, None if it is empty."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())))) if len(shingles) else None


def signatures(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, node (name of its set, null if empty) and sketch."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in chunks(batches, "text", 2 << 20):
            sets = [shingles(t) for t in texts(batch, "text")]
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            made = sketches(np.concatenate([sets[i] for i in some]), sizes[some]) if len(some) else np.zeros((0, REGISTERS), np.uint8)
            nodes: list = [None] * len(sets)
            packed: list = [None] * len(sets)
            for i, row in zip(some.tolist(), made, strict=True):
                nodes[i], packed[i] = _name(sets[i]), row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "n_shingles", "node", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def _rows(percent: int) -> int:
    return ROWS if percent >= PERCENT else LOW_ROWS


def _margin(percent: int) -> float:
    p = percent / 100
    return MARGIN if percent >= PERCENT else max(MARGIN, 5 * (p * (1 - p) / REGISTERS) ** 0.5)


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    above, same = (a > b).sum(axis=-1), (a == b).sum(axis=-1)
    return above, a.shape[-1] - above - same, same


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    x = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "na", "nb", "sa", "sb")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                counts = _counts(_matrix(batch.column("sa")), _matrix(batch.column("sb")))
                ok = at_least(percent / 100 - _margin(percent), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), *counts)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, fetched: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs that are links, by their whole sets."""
    both = pairs.join(fetched.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(fetched.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in chunks(batches, "ta"):
            ok = []
            for s, t in zip(texts(batch, "ta"), texts(batch, "tb"), strict=True):
                x, y = shingles(s), shingles(t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common * 100 >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _fetched(docs: DataFrame, signed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """One text for each wanted node."""
    rows = signed.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    rows = written(rows, "wanted")
    ids = rows.select(F.col("doc_id").alias("__id")).distinct()
    if rows.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    kept = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in chunks(batches, "text"):
            nodes = [_name(shingles(t)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column("text")], names=["node", "text"])

    named = kept.mapInArrow(run, "node long, text string")
    out = written(named.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "fetched")
    deleted(rows)
    return out


def _shares(groups: DataFrame) -> DataFrame:
    """Per band: the component with most members there, their blocks, the number of other members and the blocks of these."""
    counts = groups.groupBy("band", "root").agg(F.count("*").alias("count"))
    most = counts.groupBy("band").agg(F.sum("count").alias("all"), F.max(F.struct("count", "root")).alias("most"))
    shares = most.select("band", F.col("most.root").alias("main"), F.col("most.count").alias("held"), (F.col("all") - F.col("most.count")).alias("others"))
    return shares.select("band", "main", "others", F.ceil(F.col("held") / BLOCK).cast("int").alias("mains"), F.ceil(F.col("others") / BLOCK).cast("int").alias("rests"))


def _blocks(groups: DataFrame, percent: int, columns: list[str]) -> DataFrame:
    """The members of each group (band, pos, node, root and the columns), dealt so that those of different components meet.

    Members of the component that has most in the group need not meet each other: each of their blocks meets each block of
    the others, in (i, 0) and up, and the others' blocks meet in (i, -k). So rows grow with the members while the others
    fit one block. Where they do not, they meet in the groups of those that share a second band too.
    """
    width = _rows(percent)
    bands = REGISTERS // width
    sized = groups.withColumn("group", F.col("band")).join(_shares(groups), "band")
    small = sized.where(F.col("others") <= BLOCK).withColumn("pos2", F.lit(-1))
    large = sized.where(F.col("others") > BLOCK).withColumn("pos2", F.explode(F.expr(f"filter(sequence(0, {bands - 1}), i -> i > pos)")))
    large = large.withColumn("band", F.xxhash64("band", F.expr(f"substring(sketch, pos2 * {width} + 1, {width})"), "pos2")).drop("main", "others", "mains", "rests")
    large = large.join(_shares(large), "band").where("others > 0")
    rows = small.unionByName(large).withColumn("own", F.expr("if(root = main, -1, int(pmod(xxhash64(node), rests)))"))
    alone = rows.where("mains = 1 AND rests = 1").withColumn("at", F.expr("named_struct('i', 0, 'j', 0)"))
    main = "transform(sequence(0, rests - 1), x -> named_struct('i', x, 'j', int(pmod(xxhash64(node), mains))))"
    other = "transform(sequence(0, mains - 1), x -> named_struct('i', own, 'j', x))"
    after = "transform(filter(sequence(0, rests - 1), x -> x > own), x -> named_struct('i', own, 'j', -x))"
    before = "transform(filter(sequence(0, rests - 1), x -> x < own), x -> named_struct('i', x, 'j', -own))"
    dealt = rows.where("mains > 1 OR rests > 1").withColumn("at", F.explode(F.expr(f"if(own < 0, {main}, concat({other}, {after}, {before}))")))
    keyed = alone.unionByName(dealt).select("band", "at.i", "at.j", "own", "pos", "pos2", "group", "node", *columns)
    return keyed.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _tables(batches) -> Iterator[pa.Table]:
    """The rows of one pair of blocks after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "i", "j")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            now = tuple(key[:, start])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)
        held = []
    give_back()


def _partners(t: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row by row the later rows of other components that are plausible and looked at here, and their equal registers.

    A pair is looked at in the first band that it shares, or in the first two.
    """
    width = _rows(percent)
    bands = REGISTERS // width
    root, n, own, pos, pos2 = (t.column(c).to_numpy() for c in ("root", "n", "own", "pos", "pos2"))
    s, j = _matrix(t.column("sketch").combine_chunks()), t.column("j")[0].as_py()
    for x in range(len(n) - 1):
        y = np.arange(x + 1, len(n))
        y = y[(root[y] != root[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
        if j < 0:
            y = y[own[y] != own[x]]
        elif j and own[x] >= 0:
            y = y[own[y] < 0]
        if not len(y):
            continue
        shared = (s[x] == s[y])[:, : bands * width].reshape(len(y), bands, width).all(axis=2)
        here = shared.argmax(axis=1) == pos[x]
        if pos2[x] >= 0:
            shared[:, pos[x]] = False
            here &= shared.any(axis=1) & (shared.argmax(axis=1) == pos2[x])
        y = y[here]
        counts = _counts(s[x], s[y])
        ok = at_least(percent / 100 - _margin(percent), n[x], n[y], *counts)
        if ok.any():
            yield x, y[ok], counts[2][ok]


def _best(groups: DataFrame, percent: int) -> DataFrame:
    """(group, a, alike, b): for each document a with plausible partners in other components of a group the one most alike."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for t in _tables(batches):
            node = t.column("node").to_numpy()
            alike, partner = np.full(len(node), -1, np.int64), np.zeros(len(node), np.int64)
            for x, y, same in _partners(t, percent):
                k = int(same.argmax())
                if same[k] > alike[x]:
                    alike[x], partner[x] = same[k], node[y[k]]
                more = same > alike[y]
                alike[y[more]], partner[y[more]] = same[more], node[x]
            some = alike >= 0
            group = t.column("group").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(v[some], pa.int64()) for v in (group, node, alike, partner)], names=["group", "a", "alike", "b"])

    return _blocks(groups, percent, ["root", "n", "sketch"]).mapInArrow(run, "group long, a long, alike long, b long")


def _inside(groups: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) that join different components inside each group (with text), confirmed on the whole sets in the blocks."""

    def links(t: pa.Table, shingles: Shingles) -> list[tuple[int, int]]:
        node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
        text, sets, up, out = t.column("text"), {}, {r: r for r in root.tolist()}, []

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(text[i].as_py().encode())
            return sets[i]

        for x, y, _ in _partners(t, percent):
            for z in y.tolist():
                a, b = top(int(root[x])), top(int(root[z]))
                if a != b:
                    u, v = of(x), of(z)
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    if common * 100 >= percent * (len(u) + len(v) - common):
                        up[max(a, b)] = min(a, b)
                        out.append((int(node[x]), int(node[z])))
        return out

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for t in _tables(batches):
            found = links(t, shingles)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return _blocks(groups, percent, ["root", "n", "sketch", "text"]).mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, node, root (a node that names its component) and component_id."""
    small_batches(docs.sparkSession)
    signed = written(signatures(docs, size), "signed")
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("label"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    width = _rows(percent)
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // width - 1)), lambda i: F.xxhash64(F.substring(F.col("sketch"), i * width + 1, F.lit(width)), i))
    members = classes.select("node", F.posexplode(bands).alias("pos", "band"))
    groups = members.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(groups, "band"), "shared")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs, f"{name}_pairs")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        fetched = _fetched(docs, signed, nodes, size)
        out = written(_confirmed(pairs, fetched, percent, size), name)
        deleted(pairs, fetched)
        return out

    stars = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(_plausible(stars, classes, percent), "stars")
    roots = forest(links)

    def open_groups() -> DataFrame:
        """Members of groups that hold several components."""
        placed = shared.select("band", "pos", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_bands = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band")
        return written(placed.join(open_bands, "band").join(classes.select("node", "n", "sketch"), "node"), "rest")

    def joined(more: DataFrame) -> DataFrame:
        return forest(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    for last in (False, True):
        rest = open_groups()
        best = written(_best(rest, percent), "best")
        if not best.limit(1).count():
            deleted(rest, best)
            break
        if last:
            fetched = _fetched(docs, signed, best.select(F.col("a").alias("node")).distinct(), size)
            met = rest.join(best.select(F.col("group").alias("band"), F.col("a").alias("node")), ["band", "node"], "left_semi")
            more = written(_inside(met.join(fetched, "node"), percent, size), "more")
            deleted(fetched)
        else:
            likeliest = best.groupBy("a").agg(F.max(F.struct("alike", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
            more = confirmed(likeliest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
        deleted(rest, best)
        roots = joined(more)
    named = classes.select("node", "label").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labels = named.groupBy("root").agg(F.min("label").alias("component_id"))
    by_node = written(named.join(labels, "root").select("node", "root", "component_id"), "labels")
    deleted(classes, shared)
    out = signed.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
    return out.select("doc_id", "n_shingles", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def digest(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return linked(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_nodes(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """docs with __node, the name of the text's set."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in chunks(batches, "text"):
            yield batch.append_column("__node", pa.array([_name(shingles(t)) for t in texts(batch, "text")], pa.int64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__node", LongType())]))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; of equal rows one stays.

    A doc_id that stands once tells its document. Documents that share a doc_id or have none are told by doc_id and set;
    a null doc_id comes after all others, and of several texts of one doc_id and set one stays.
    """
    found = linked(docs, percent)
    ids = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id"))
    ids = written(ids, "shared_ids")
    if not ids.limit(1).count():
        drop = written(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__drop")).distinct(), "drop")
        if drop.count() <= BROADCAST_IDS:
            drop = F.broadcast(drop)
        return docs.join(drop, docs["doc_id"] == F.col("__drop"), "left_anti")
    found = written(found, "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    first = written(found.where("node IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.node"), "first")
    shared = F.col("doc_id").eqNullSafe(F.col("__id"))
    drop = found.where("node IS NOT NULL").join(first, ["doc_id", "node"], "left_anti").select(F.col("doc_id").alias("__drop")).distinct()
    single = docs.join(ids, shared, "left_anti").join(drop, F.col("doc_id") == F.col("__drop"), "left_anti")
    rest = _with_nodes(docs.join(ids, shared, "left_semi")).withColumn("__text", F.xxhash64("text"))
    empty = rest.where("__node IS NULL").dropDuplicates(["doc_id", "__text"])
    texts_of = rest.where("__node IS NOT NULL").groupBy("doc_id", "__node").agg(F.min("__text").alias("t")).select(F.col("doc_id").alias("i"), F.col("__node").alias("n"), "t")
    chosen = first.join(texts_of, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("n"))).select("i", "n", "t")
    own = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("__node") == F.col("n")) & (F.col("__text") == F.col("t"))
    whole = rest.join(chosen, own, "left_semi").dropDuplicates(["doc_id", "__node"])
    return single.unionByName(empty.unionByName(whole).drop("__node", "__text"))
