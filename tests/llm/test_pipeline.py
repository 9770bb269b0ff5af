"""The pipeline's stages, one after the other, on the smallest tables."""

import corpus_pipeline
from lodeseam.llm import decontaminate, near_duplicates, pii, quality_classifier
from lodeseam.llm.common import table

from ..compare import connection, spark_rows, sql_rows
from .samples import frame

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    names, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, SF)
        assert kept.columns == names, name
        kept = kept.cache()
        assert 0 < kept.count() <= before.count()
    assert kept.where("n_chars <> length(text)").count() == 0
    assert decontaminate.digest(kept, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert near_duplicates.digest(kept).count() == kept.count()
    assert pii.digest(kept).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count() and last.where("NOT exact").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(r.doc_id for r in last.select("doc_id").collect())


def test_stage_one_keeps_clean_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = {r.doc_id for r in quality_classifier.keep(docs, labels).select("doc_id").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_sql(spark):
    from lodeseam.llm import queries

    con = connection(SF)
    for name, sql in queries.ORACLES.items():
        assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(con, sql), name


def test_near_copies_from_080_up_go(spark):
    """Of texts of n words with words changed far apart, 5 shingles each: similarity 0.80, 0.825 and 0.77."""
    rows, gone = [], set()
    for i in range(60):
        n, changed = [(49, [24]), (160, [20, 70, 120]), (160, [20, 60, 100, 140])][i % 3]
        own = [f"w{i}x{k}" for k in range(n)]
        rows.append((2 * i, " ".join(own), "en", "s", 0))
        for k in changed:
            own[k] = f"other{i}x{k}"
        rows.append((2 * i + 1, " ".join(own), "en", "s", 0))
        if i % 3 < 2:
            gone.add(2 * i + 1)
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in rows} - gone)


def test_stages_equal_brute_force(spark, tmp_path):
    """All stages on a small table with shared and null ids: exact sets, window by window, patterns, and the library."""
    import re

    import sentencepiece

    from lodeseam.llm.sentencepieces import default_model

    from .test_operators import PATTERNS, brute_hits, brute_pii, shingles

    def words(k, n=60, swapped=()):
        return " ".join(f"q{k}r{j}" if j in swapped else f"t{k}w{j}" for j in range(n))

    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, words("a")), (1, words("b")), (2, words("a", swapped=[30])), (3, words("c") + ", write to me@example.com"), (3, words("c") + ", write to me@example.com"),
        (None, words("d")), (None, words("e") + " at 10.1.2.3 or +49 30 123 456 78"), (9, words("d", swapped=[5])), (4, f"{words('f')}. {item}! {words('g')}"), (5, item.upper()),
        (6, ""), (7, None), (8, words("h", 3)), (10, words("a").upper()), (11, words("i", 400) + " a@b.c" * 3),
    ]
    docs = frame(spark, [(i, t, "en", "s", len(t or "")) for i, t in rows])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # Without bad labels no document is rejected.
    kept = list(rows)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
    up = {i: i for i in order}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in order:
        for b in order:
            s, t = shingles(kept[a][1]), shingles(kept[b][1])
            if a != b and (100 * len(s & t) >= 80 * len(s | t) if s and t else kept[a] == kept[b]):
                x, y = sorted((top(a), top(b)), key=order.index)
                up[y] = x
    kept = [kept[i] for i in order if top(i) == i]
    cleaned = []
    for i, t in kept:
        if t and brute_hits(t, [(1, item)])[1]:
            t = re.sub(re.sub(" ", "[^a-z0-9]+", item), "", t, flags=re.I)
            if not re.search(r"\w", t):
                continue
        for k, a, b in sorted(((x.split(":")[0], *map(int, x.split(":")[1:])) for x in brute_pii(t)), key=lambda x: -x[1]):
            t = f"{t[:a]}[{k.upper()}]{t[b:]}"
        cleaned.append((i, t))
    assert set(PATTERNS) == {"email", "ip", "card", "phone"}
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = sorted(repr((i, library.encode(t or "", add_bos=True, add_eos=True))) for i, t in cleaned)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    got = docs.collect()
    assert sorted(repr((r.doc_id, list(r.ids))) for r in got) == want and all(r.exact for r in got)


def test_workers_get_small_batches(spark):
    """Stages hold few texts in executor and worker: 12 MB came as one batch. Texts over the bound stay whole."""
    import pyarrow as pa

    from lodeseam.llm.common import BATCH_BYTES, READ_ROWS

    key, read = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {k: spark.conf.get(k) for k in (key, read)}

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)], "bytes": [batch.nbytes]})

    many = spark.range(0, 6000, 1, 1).selectExpr("repeat('x', 2000) AS text")
    long = " ".join(f"w{k}" for k in range(BATCH_BYTES // 7))
    docs = frame(spark, [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", len(long) + 4), (3, long[::-1], "en", "s", len(long))])
    assert len(long) > BATCH_BYTES
    try:
        for _, stage in corpus_pipeline.STAGES:
            if stage is corpus_pipeline.personal_data:  # no Python workers
                continue
            spark.conf.set(key, "64m")
            spark.conf.set(read, "4096")
            stage(spark, docs, SF)
            found = many.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in found) == 6000 and max(r.bytes for r in found) < 1.1 * BATCH_BYTES, stage.__name__
            assert spark.conf.get(read) == str(READ_ROWS), stage.__name__
        assert [(r.doc_id, r.text == long or r.text == long[::-1]) for r in corpus_pipeline.near_dedup(spark, docs, SF).orderBy("doc_id").collect()] == [(1, True), (3, True)]
        spark.conf.set(key, "1m")
        corpus_pipeline.encoding(spark, docs, SF)
        assert spark.conf.get(key) == "1m"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
