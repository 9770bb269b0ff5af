"""The ten operators against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam.llm import components, decontaminate, html_text, interleave, near_duplicates, pii, quality_classifier, quality_rules, sentencepieces, setsketch, suffix_dedup, toxicity, url_lists

from .samples import COLUMNS, documents, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


# 1


def brute_hits(text, items, n=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(pattern, (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(pattern, (body or "").translate(LOWER))
        size = min(n, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_decontamination(spark, bound):
    docs = documents()
    words = docs[0][1].split()
    items = [(1, " ".join(words[5:20])), (2, "WORD"), (3, None), (4, ""), (5, docs[2][1][:300]), (6, " ".join(words[8:19]).upper()), (6, " ".join(words[40:55]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(frame(spark, docs).withColumn("found", F.lit(1)), bench, bound=bound)
    want = []
    for doc in docs:
        n, hit, found = brute_hits(doc[1], items)
        want.append((doc[0], n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert same([tuple(r) for r in got.collect()], want)


def test_decontamination_removes_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two three, four! Five six; seven eight nine ten - and this."), (2, None), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert same([tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()], [(1, "Keep this.  - and this."), (2, None), (3, "clean")])
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench, action="documents").collect()) == [2, 3]
    more = docs.unionByName(spark.createDataFrame([(4, " One two three, four! Five six; seven eight nine ten!"), (5, "!?")], docs.schema))
    assert sorted(r.doc_id for r in decontaminate.decontaminate(more, bench, drop_empty=True).collect()) == [1, 2, 3, 5]
    assert decontaminate.digest(docs.where("doc_id > 9"), bench.where("item_id > 9")).count() == 0


# 2


def test_sentencepieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    rnd = random.Random(2)
    texts = [d[1] for d in documents()] + ["", " ", "a  b", "▁", "<s></s><0x0A>", "the the  the", " " * 3000, "-" * 700, "\x00a"]
    texts += ["".join(rnd.choice(list(" \n▁etaoin=日é😀")) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    tok = sentencepieces.Tokenizer()
    ids = [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert [x.tolist() for x in tok.encode(texts)] == ids
    assert [tok.decode(x) for x in ids] == [library.decode(x) for x in ids]
    for _ in range(500):
        odd = [rnd.choice([0, 1, 2, 13, 15, 200, 195, 227, 259, rnd.randint(0, 31999)]) for _ in range(rnd.randint(0, 9))]
        assert tok.decode(odd) == library.decode(odd)
    docs = documents()
    want = [(d[0], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest()) for d, x in zip(docs, ids, strict=False)]
    assert same([tuple(r) for r in sentencepieces.digest(frame(spark, docs)).collect()], want)
    back = sentencepieces.decode(sentencepieces.encode(frame(spark, docs)))
    assert same([tuple(r) for r in back.collect()], [(d[0], d[1] or "") for d in docs])


def test_queue_equals_rounds():
    tok = sentencepieces.Tokenizer()
    rnd = random.Random(4)
    for _ in range(200):
        word = "".join(rnd.choice("thaneris▁") for _ in range(rnd.randint(1, 40)))
        sym = tok.pieces.of_char[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        merged, _, place = sentencepieces.merge_rounds(tok.pieces, sym, np.zeros(len(sym), np.int64))
        assert sentencepieces._queue(tok.pieces, sym.tolist()) == list(zip(merged.tolist(), place.tolist(), strict=True))


# 3


def test_toxicity_learns_words_and_spellings(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(700):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            text.insert(rnd.randrange(len(text)), rnd.choice(["scoundrel", "zzqu" + rnd.choice(words)]))
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "...", None, None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.digest(frame(spark, docs), table))
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert {r["doc_id"]: r["score"] for r in got if r["doc_id"] >= 9000} == {9000: 0.0, 9001: 0.0, 9002: 0.0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    none = toxicity.digest(frame(spark, docs[:5]), table.where("toxic = 0"))
    assert {r.score for r in none.collect()} == {0.0}


def test_toxicity_of_awkward_tables(spark):
    docs = documents(count=30) + [(7000, "word " * 300_000, "en", "s", 0)]
    labels = spark.createDataFrame([(d[0], 1, k % 2) for k, d in enumerate(docs) if d[0] is not None], "doc_id long, quality int, toxic int")
    given = frame(spark, docs).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    assert toxicity.digest(given, labels).count() == len(docs)
    assert toxicity.digest(given.where("doc_id < -9"), labels).count() == 0
    assert {r.score for r in toxicity.digest(given, labels.where("doc_id < -9")).collect()} == {0.0}


# 4


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    docs = [*documents(), (2000, "one # two $ three\nsame line\nsame line\n\n" * 3, "en", "s", 0)]
    got = rows_of(quality_rules.digest(frame(spark, docs)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = []
    for d in docs:
        counts = brute_rules(d[1])
        want.append((d[0], *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]))
    assert same([(r["doc_id"], *[r[n] for n in names], r["base_failed"]) for r in got], want)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.keep(frame(spark, docs)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("bound", [200_000, 0])
def test_every_group_has_its_own_bands(spark, monkeypatch, bound):
    monkeypatch.setattr(quality_rules, "FEW", 2)
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", bound)
    usual, odd = ("none", 100, 0, 0, 0, 0, 70, 4.0, 0.0, 0.8), ("other", 100, 0, 0, 0, 0, 70, 1.0, 0.9, 0.8)
    rows = [(3 * i + k, f"l{i:04d}", *usual) for i in range(1100) for k in range(3)]
    rows += [(9000, "zz", *odd), (9001, "zz", *odd), (9999, "rare", *odd)]
    monkeypatch.setattr(quality_rules, "measures", lambda docs, model=None: spark.createDataFrame(rows, quality_rules.SCHEMA))
    failed = {r.doc_id for r in quality_rules.judged(None).where("band_failed").collect()}
    assert failed == {9999}


def test_bands_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "FEW", 20)
    rnd = random.Random(14)
    rows = []
    for i in range(900):
        lang, script, n = rnd.choice(["en", "de", "xx"] if i < 890 else ["rare"]), rnd.choice(["latin", "other"]), rnd.choice([10, 70, 130, 140])
        wild = rnd.random() < 0.05
        rows.append((i, lang, script, rnd.choice([100, 100, 5]), 0, 0, 0, rnd.choice([0, 0, 0, 30]), n, 4 + rnd.gauss(0, 0.1) + 3 * wild, abs(rnd.gauss(0, 0.01)), 0.8 + rnd.gauss(0, 0.01) - 0.4 * (wild and rnd.random() < 0.5)))
    monkeypatch.setattr(quality_rules, "measures", lambda docs, model=None: spark.createDataFrame(rows, quality_rules.SCHEMA))
    got = {r.doc_id: (r.base_failed, r.band_failed) for r in quality_rules.judged(None).collect()}
    own, all_ = collections.defaultdict(list), collections.defaultdict(list)
    base = {r[0]: r[3] < 10 or 100 * r[7] > 20 * r[3] for r in rows}
    for r in rows:
        if r[8] >= 64 and not base[r[0]]:
            for m, x in enumerate(r[9:]):
                step = min(65536, math.floor(x * 1024 + 0.5))
                own[r[1], r[2], r[8].bit_length(), m].append(step)
                all_[r[8].bit_length(), m].append(step)
    quartiles = lambda xs: [sorted(xs)[-(-len(xs) * q // 4) - 1] / 1024 for q in (1, 2, 3)] if len(xs) >= 20 else None
    for r in rows:
        failed = False
        for m, floor in enumerate((0.15, 0.02, 0.1)):
            q = quartiles(own[r[1], r[2], r[8].bit_length(), m]) or quartiles(all_[r[8].bit_length(), m])
            if r[8] >= 64 and q:
                off = (abs(r[9] - q[1]), r[10] - q[1], q[1] - r[11])[m]
                failed |= off > max(5 * (q[2] - q[0]), floor)
        assert got[r[0]] == (base[r[0]], failed), r


def test_repeated_words_with_a_large_vocabulary():
    words = [str(i).encode() for i in range(8000)] + [b"1", b"2", b"3", b"4", b"5"]
    assert quality_rules.repeated_words(words) == 10


# 5


def test_url_lists(spark):
    from datetime import date

    events = spark.createDataFrame(
        [("bad.example.com", "add", date(2024, 1, 10)), ("bad.example.com", "remove", date(2024, 2, 1)), ("bad.example.com", "add", date(2024, 2, 1)), ("BAD.example.com", "add", date(2024, 3, 1)),
         ("example.org/ads/", "add", date(2024, 1, 1)), ("never.com", "remove", date(2024, 1, 1)), (None, "add", date(2024, 1, 1)), ("sub.bad.example.com", "add", date(2024, 3, 1))],
        "entry string, action string, day date",
    )
    spans = {(r.entry, str(r.from_day), str(r.until_day)) for r in url_lists.intervals(events).collect()}
    assert ("bad.example.com", "2024-01-10", "2024-02-01") in spans and ("bad.example.com", "2024-03-01", "None") in spans and len(spans) == 4
    captures = [
        (1, "http://www.bad.example.com/x", date(2024, 1, 9)), (2, "http://WWW.bad.example.com/x", date(2024, 1, 10)), (3, "https://bad.example.com:8080/", date(2024, 2, 1)),
        (4, "https://u@sub.bad.example.com/?q", date(2024, 3, 2)), (5, "http://example.org/ads/x.html", date(2024, 5, 1)), (6, "http://example.org/adsx", date(2024, 5, 1)),
        (7, None, date(2024, 5, 1)), (8, "http://bad.example.com", None), (9, "not a url", date(2024, 5, 1)), (2, "http://WWW.bad.example.com/x", date(2024, 1, 10)),
    ]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched date").withColumn("entry", F.lit("clash"))
    for bound in (200_000, 0):
        url_lists.BROADCAST_ENTRIES, old = bound, url_lists.BROADCAST_ENTRIES
        got = [(r.page_id, r.n_entries, r.entry, r.blocked) for r in url_lists.matched(df, events).collect()]
        url_lists.BROADCAST_ENTRIES = old
        assert sorted(got, key=repr) == sorted(
            [(1, 0, None, False), (2, 1, "bad.example.com", True), (2, 1, "bad.example.com", True), (3, 0, None, False), (4, 2, "sub.bad.example.com", True), (5, 1, "example.org/ads/", True), *[(i, 0, None, False) for i in (6, 7, 8, 9)]], key=repr
        )


# 6


def test_interleave_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        depth = rnd.choice([2, 4, 8])
        letters = rnd.choice([b"ab", b"abc", b"a", bytes(range(245))])
        strings = [bytes(rnd.choice(letters) for _ in range(rnd.randint(depth, 40))) for _ in range(rnd.randint(1, 12))]
        doc = np.array([rnd.randint(0, 3) for _ in strings])
        at = np.arange(len(strings)) * 100
        d, _, s = suffix_dedup.repeated_windows(strings, doc, doc * 0, at, size=depth, shard=rnd.choice([1, 30, 1000]))
        places = collections.defaultdict(list)
        for i, x in enumerate(strings):
            for p in range(len(x) - depth + 1):
                places[x[p : p + depth]].append((int(doc[i]), int(at[i]) + p))
        assert sorted(zip(d.tolist(), s.tolist(), strict=True)) == sorted(y for v in places.values() for y in v if y != min(v))
    assert interleave.Shard([b"abc"], 100).order.tolist() == [3, 0, 1, 2]


def brute_removed(docs, order):
    """(n_bytes, n_removed, n_spans, kept_sha256) by document, taken in the order that `order` gives."""
    seen, out = set(), {}
    for doc in sorted(docs, key=order):
        raw = (doc[1] or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - 99):
            window = raw[p : p + 100]
            if window in seen:
                cover[p] += 1
                cover[p + 100] -= 1
            seen.add(window)
        hit = np.cumsum(cover)[:-1] > 0
        kept = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        out[doc[0], doc[1]] = (len(raw), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("frequent", "task"), [(64, 256 << 10), (1, 1), (64, 300)])
def test_suffix_dedup(spark, monkeypatch, frequent, task):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "TASK", task)
    # Rows equal in id and text are one document here; ids shared by different texts have a test of their own.
    docs = [d for i, d in enumerate(documents(count=80)) if d[0] != 2 and d not in documents(count=80)[:i]]
    docs += [(3000, "=" * 900 + "tail", None, None, 0), (3001, "-" * 50 + "=" * 300, None, None, 0), (2999, "Der " * 200, None, None, 0)]
    want = brute_removed(docs, lambda d: (d[0] is None, d[0] or 0))
    given = frame(spark, docs).withColumn("doc", F.lit(5)).withColumn("tie", F.lit("x")).withColumn("spans", F.lit("y"))
    got = sorted(map(repr, map(tuple, suffix_dedup.digest(given).collect())))
    assert got == sorted(repr((d, *x)) for (d, _), x in want.items())


def test_suffix_dedup_of_shared_and_null_ids(spark):
    rnd = random.Random(8)
    part = ["".join(rnd.choice("abcdefgh ") for _ in range(170)) for _ in range(6)]
    docs = [(1, part[0] + "x" + part[1]), (1, part[1] + "y" + part[2]), (None, part[2] + part[3]), (None, part[3] + "z" + part[0]), (0, part[4]), (0, part[4]), (7, ""), (7, None), (8, part[4][:99])]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    tie = {r.text: r.h for r in given.select("text", F.xxhash64("text").alias("h")).collect()}
    want = brute_removed(list(dict.fromkeys(docs)), lambda d: (d[0] is None, d[0] or 0, tie[d[1]]))
    got = sorted(map(repr, map(tuple, suffix_dedup.digest(given).collect())))
    assert got == sorted(repr((d[0], *want[d])) for d in docs)


@pytest.mark.parametrize("size", [60, 97])
def test_suffix_dedup_without_repeats(spark, size):
    rnd = random.Random(size)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(size))
    docs = [(i, "".join(rnd.choice(own) for _ in range(200)) + "!" + shared + "?" + "".join(rnd.choice(own) for _ in range(200))) for i, own in enumerate(("ijklm", "nopqr"))]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.digest(given).collect()) == [(0, 0, 0), (1, 0, 0)]
    assert suffix_dedup.digest(given.where("doc_id > 9")).count() == 0


def test_suffix_dedup_compares_bytes(spark, monkeypatch):
    import types

    # All runs of one length have one hash at first: the comparison sees it and the next hash is taken.
    first = types.SimpleNamespace(xxh3_64_intdigest=lambda x, seed=0: len(x) if seed == 0 else int.from_bytes(hashlib.sha1(bytes(x)).digest()[:8], "big"))
    monkeypatch.setattr(suffix_dedup, "xxhash", first)
    calls = []
    equal = suffix_dedup._all_equal
    monkeypatch.setattr(suffix_dedup, "_all_equal", lambda x: calls.append(equal(x)) or calls[-1])
    rnd = random.Random(9)
    docs = [(i, "".join(rnd.choice("abc") for _ in range(120)) + "-" * 60 + "common words in the middle of everything and more of them, until they fill a window whole" + "-" * 60 + "".join(rnd.choice("abc") for _ in range(120)), None, None, 0) for i in range(12)]
    want = brute_removed(docs, lambda d: d[0])
    got = sorted(map(repr, map(tuple, suffix_dedup.digest(frame(spark, docs)).collect())))
    assert got == sorted(repr((d, *x)) for (d, _), x in want.items())
    assert calls == [False, True]
    assert suffix_dedup.digest(frame(spark, []).where("doc_id > 1")).count() == 0


def test_suffix_dedup_with_shared_ids(spark):
    text = "a passage that is long enough to be found again when it stands in another row of the table, with some more words"
    got = suffix_dedup.digest(frame(spark, [(1, text, None, None, 0), (1, text, None, None, 0), (1, text + " more", None, None, 0)])).collect()
    assert sorted(r.n_removed for r in got) in ([0, 0, len(text)], [0, len(text), len(text)])


# 7


def luhn(d):
    values = [int(c) for c in reversed(d)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    rnd = random.Random(7)
    parts = [*"0123456789.-+ ()@ab_%é", "4845168114407329", " 1.2.3.4 ", "a@b.c", "+1 (017) 555-7713"]
    docs = documents() + [(5000 + i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))), None, None, 0) for i in range(600)] + [(9000, "a@b.c " * 300 + "1.2.3.4 ", None, None, 0)]
    got = rows_of(pii.digest(frame(spark, docs)))
    want = []
    for d in docs:
        base = brute_pii(d[1])
        want.append((d[0], *[sum(x.startswith(k + ":") for x in base) for k in PATTERNS], hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert same([(r["doc_id"], *[r[f"n_{k}"] for k in PATTERNS], r["base_sha256"]) for r in got], want)
    assert all(set(brute_pii(d[1])) <= set(r["spans"].split(",")) for d, r in zip(sorted(docs, key=repr), sorted(got, key=repr), strict=True) if d[0] == r["doc_id"])


def test_personal_data_of_awkward_texts(spark):
    key = "A" * 500 + "b7" + "c" * 40
    docs = [(1, f'token = "{key}" and more', None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (4, "call (743) 555-3824, " * 3000, None, None, 0)]
    got = {r.doc_id: r for r in pii.digest(frame(spark, docs).withColumn("spans", F.lit("x")).withColumn("kind", F.lit(1))).collect()}
    assert f"secret:9:{9 + len(key)}" in got[1].spans and got[1].n_spans >= 1
    assert got[2].n_spans == got[3].n_spans == 0 and got[4].n_spans == 3000
    assert pii.digest(frame(spark, docs).where("doc_id < 0")).count() == 0


def test_redaction(spark):
    text = 'é write to me@example.com or call tel (743) 555-3824; token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" commit 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e end'
    got = {r.doc_id: r.text for r in pii.redact(frame(spark, [(1, text, "en", "s", 0), (2, None, "en", "s", 0), (3, "nothing", "en", "s", 0)])).collect()}
    assert got[1] == 'é write to [EMAIL] or call tel [LOCAL_PHONE]; token = "[SECRET]" commit 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e end'
    assert got[2] is None and got[3] == "nothing"


# 8


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_near_duplicates(spark, monkeypatch):
    rnd = random.Random(8)
    docs = [d for d in documents(count=90) if d[0] is not None and d[0] != 2]
    base = [f"t{i}" for i in range(160)]
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(len(own))] = f"u{rnd.randint(0, 9999)}"
        docs.append((4000 + i, " ".join(own), None, None, 0))
    sets = [(d[0], shingles(d[1])) for d in docs]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 85 * len(s | t) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    want = [(i, len(s), top(i), i == top(i)) for i, s in sets]
    for block in (512, 7):
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        assert same([tuple(r) for r in near_duplicates.digest(frame(spark, docs)).collect()], want)
    kept = near_duplicates.deduplicated(frame(spark, docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want}) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert near_duplicates.digest(frame(spark, docs).where("doc_id < 0")).count() == 0


def test_near_duplicates_awkward_rows(spark):
    rows = [(None, "one two three four five six", None, None, 0), (None, None, None, None, 0), (7, None, None, None, 0), (7, "", None, None, 0), (8, "one TWO three four five six", None, None, 0)]
    got = near_duplicates.digest(frame(spark, rows)).collect()
    assert same([tuple(r) for r in got], [(None, 2, 8, False), (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True), (8, 2, 8, True)])


def test_deduplicated_tells_shared_and_null_ids_by_their_texts(spark):
    def text(k, swapped=()):
        return " ".join(f"x{k}y{j}" if j in swapped else f"t{k}w{j}" for j in range(60))

    rows = [
        (1, text("a")), (1, text("b")), (2, text("a", [30])), (3, text("c")), (3, text("c")), (4, text("d")), (1, text("d", [30])), (8, text("h")), (9, text("h").upper()),
        (None, text("e")), (None, text("e")), (5, text("f")), (None, text("f", [30])), (None, text("g")), (6, None), (6, ""), (6, ""), (None, None), (7, text("b", [30])),
    ]
    got = near_duplicates.deduplicated(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]), percent=80)
    want = [(1, text("a")), (1, text("b")), (1, text("d", [30])), (3, text("c")), (8, text("h")), (None, text("e")), (5, text("f")), (None, text("g")), (6, None), (6, ""), (None, None)]
    assert same([(r.doc_id, r.text) for r in got.collect()], want)


def test_near_duplicates_of_other_shingle_sizes(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "last"])), (3, " ".join(words[::-1]))]
    for size in (3, 7):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.linked(frame(spark, [(*r, "en", "s", 0) for r in rows]), size=size).collect()}
        assert got == {1: (81 - size, 1), 2: (81 - size, 1), 3: (81 - size, 3)}


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 1000, dtype=np.uint64), rng.integers(0, 2**63, 1000, dtype=np.uint64)
    x, y = np.unique(a), np.unique(np.concatenate([a[:900], b[:100]]))
    sx, sy, both = setsketch.sketches(np.concatenate([x, y, np.union1d(x, y)]), np.array([len(x), len(y), len(np.union1d(x, y))]))
    assert (np.maximum(sx, sy) == both).all()
    same_, above = int((sx == sy).sum()), int((sx > sy).sum())
    assert abs(setsketch.estimate(len(x), len(y), above, len(sx) - same_ - above, same_) - 900 / 1100) < 0.12
    assert (setsketch.sketches(x[:1], np.array([1])) == setsketch.sketches(x[:1], np.array([1]))).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (103, 103), (50, 60), (60, 50)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(21)} | {(i, 100) for i in (100, 101, 102)} | {(50, 50), (60, 50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 8)
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 20)]
    random.Random(3).shuffle(chain)
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(chain, "a long, b long").repartition(8)).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(20)}


# 9


def test_quality_classifier(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(500):
        good = rnd.random() < 0.7
        text = " ".join(rnd.choice(words) + ("" if good else rnd.choice(["###", "!!", "$"])) for _ in range(rnd.randint(10, 80)))
        docs.append((i, text, rnd.choice(["en", None]), rnd.choice(["big", "big", "small", None]), 0))
        labels.append((i, int(good), 0))
    docs += [(900, None, "en", "big", 0), (901, "", None, None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.digest(frame(spark, docs), table).collect()}
    held = [(i, q) for i, q, _ in labels if toxicity.held_out(i)]
    assert np.mean([got[i].kept == bool(q) for i, q in held]) > 0.95
    assert got[900].posterior == got[901].posterior == 0.0 and not got[900].kept
    assert quality_classifier.keep(frame(spark, docs), table).columns == COLUMNS.replace(" long", "").replace(" string", "").split(", ")
    assert quality_classifier.digest(frame(spark, docs), table.where("quality = 1")).where("NOT kept").count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 400 + [("bad", "p", 0.1)] * 400 + [("tiny", "p", 0.1)]
    found, prior = quality_classifier.sites(spark.createDataFrame(rows, "source string, lang string, __p double"))
    host = prior.host_score(F.col("hn"), F.col("hs"))
    score = {r.host: r.score for r in found.select("host", prior.path_score(F.col("n"), F.col("s"), host).alias("score")).collect()}
    assert score["big"] > 0.85 and score["bad"] < 0.15 and score["bad"] < score["tiny"] < prior.mean


def test_quality_posteriors_equal_brute_force(spark, monkeypatch):
    """Every document's site means, without the document itself, from the formulas of the method of moments."""
    rnd = random.Random(19)
    rows = [(i, f"text {i}", rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", None, f"s{i % 9}"]), rnd.random()) for i in range(300)]

    class Known:
        trees = (1,)

        def probability(self, found):
            return np.array([p_of[t] for t in found])

    p_of = {t.encode(): p for _, t, _, _, p in rows}
    docs = spark.createDataFrame([(i, t, lang, src, 0) for i, t, lang, src, _ in rows], COLUMNS)
    got = {r.doc_id: r for r in quality_classifier.judged(docs, Known()).collect()}
    n, s = collections.Counter(), collections.Counter()
    for _, _, lang, src, p in rows:
        for key in ((src,), (src, lang)):
            n[key] += 1
            s[key] += p
    mean = sum(p for *_, p in rows) / len(rows)

    def weight(keys, parent):
        total, q = sum(n[k] for k in keys), sum(n[k] ** 2 for k in keys)
        v = sum(n[k] * (s[k] / n[k] - parent(k)) ** 2 for k in keys)
        between = (v - (len(keys) - 1) * mean * (1 - mean)) / (total - q / total)
        return min(1e6, max(1.0, mean * (1 - mean) / between - 1 if between > 0 else 1e6))

    hosts, paths = [k for k in n if len(k) == 1], [k for k in n if len(k) == 2]
    kh = weight(hosts, lambda k: mean)
    kp = weight(paths, lambda k: (s[k[:1]] + kh * mean) / (n[k[:1]] + kh))
    logit = lambda x: np.log(x / (1 - x))
    for i, _, lang, src, p in rows:
        h, k = (src,), (src, lang)
        host = (s[h] - p + kh * mean) / (n[h] - 1 + kh)
        path = (s[k] - p + kp * host) / (n[k] - 1 + kp)
        posterior = 1 / (1 + np.exp(-(logit(min(max(p, 1e-4), 1 - 1e-4)) + logit(path) - logit(mean))))
        assert abs(got[i].host_score - host) < 1e-6 and abs(got[i].path_score - path) < 1e-6 and abs(got[i].posterior - posterior) < 1e-6


# 10


def test_html_text(spark):
    pages = [
        (1, "u", "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One &amp; two<br>three</p><aside>side words</aside><p>x</p></article><footer>&copy; foot</footer>"),
        (2, None, None), (3, "u", ""), (4, "u", "<p>a < b &lt; c"), (5, "u", "<!-- never ends"), (6, "u", "<article><p>cut &am"), (7, "u", "<article><div class='ad banner'>buy</div><p>kept words</p><div id=comments><p>I say</p></div></article>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[1] == ("Head One & two three x", 22) and got[2] == got[3] == got[5] == ("", 0)
    assert got[6] == ("cut &am", 7) and got[7] == ("kept words", 10)
    assert [b.text for b in html_text.blocks("<p>a < b &lt; c")] == ["a < b < c"]


def test_html_head_without_an_end():
    tree = html_text.fitted_tree()
    body = "<article><h1>Head line</h1><p>Kept words of the article</p></article>"
    inside = "<meta charset=x><title>T</title><style>p{}</style><noscript>no <b>sight</b></noscript>"
    for page in (f"<html><head>{inside}<body>{body}</html>", f"<head>{inside}\n{body}", f"<head>{inside}</head><body>{body}</body>", f"<head>{inside}{body}</body></html>"):
        assert html_text.main_text(page, tree) == "Head line Kept words of the article"
    assert [b.text for b in html_text.blocks("<head><title>T</title> bare text")] == ["bare text"]
    found = html_text.blocks("<article><p>a <math><mi>x</mi></math> b</p><noscript><p>c</p></noscript><canvas>d</canvas><object>e</object><svg><text>f</text></svg></article>")
    assert " ".join(b.text for b in found).split() == list("axbcde")


def test_html_names_that_conflict():
    tree = html_text.fitted_tree()
    rest = '<nav><a href="/">Home</a> <a href="/x">More</a></nav>{}<footer><p>All rights reserved</p></footer>'
    words = "These are the words of a long enough paragraph that an article has, one after the other."
    inner = f"<h1>A title</h1><p>{words}</p><p>{words}</p>"
    for opening, closing in (
        ('<article class="post comments-open">', "</article>"), ('<main class="site-main no-sidebar">', "</main>"), ('<div class="content has-sidebar">', "</div>"),
        ('<article class="related post">', "</article>"), ('<div class="entry promo">', "</div>"),
    ):
        assert html_text.main_text(rest.format(opening + inner + closing), tree) == f"A title {words} {words}", opening
    head = f"<header class=entry-header><h1>A title</h1></header><p>{words}</p><aside><p>{words}</p></aside><div class=sidebar-box><p>{words}</p></div>"
    assert html_text.main_text(rest.format(f"<header><p>Site name and motto</p></header><article>{head}</article>"), tree) == f"A title {words}"


def test_html_is_linear():
    import time

    for piece in ("<div>x", "<div class=ad>x", "<div>x</p>", "<b class=ad>x</b>"):
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            html_text.blocks(piece * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.2, piece

    began = time.time()
    for piece in ("<a \"", "<p><div ", "<", "&#", "<!--", "</", "<script>"):
        html_text.main_text(piece * 30_000, html_text.fitted_tree())
    assert time.time() - began < 60
