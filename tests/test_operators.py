"""Operators on literal tables."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lodeseam.functions import paths, text, validators
from lodeseam.functions.paths import Pos
from lodeseam.operators import analytics, features, generator, histograms, joins, lists, pages
from lodeseam.plans.scan import Options, duplicates, report, scan
from lodeseam.sources import images, reports, sinks


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_find_all_offsets(spark):
    import re

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab1é日 ") for _ in range(rnd.randint(0, 300))) for _ in range(40)] + ["", "1" * 3, "1a" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(x.offset, x.feature) for x in r.m] for r in df.select("i", generator.find_all(F.col("t"), "[0-9]+").alias("m")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(len(t[: m.start()].encode()), m.group()) for m in re.finditer("[0-9]+", t)]
    assert generator.matches(df.limit(0), "t", "a").count() == 0
    assert [r.m for r in spark.createDataFrame([(None,)], "t string").select(generator.find_all(F.col("t"), "a").alias("m")).collect()] == [None]


def test_paths(spark):
    p = Pos("1000-GZIP-300-BASE64", 30)
    assert str(p) == "1000-GZIP-300-BASE64-30" and Pos.parse(str(p)) == p and p.depth == 2 and p.image_offset == 1000
    assert p.shifted(65) == Pos("1065-GZIP-300-BASE64", 30) and Pos("", 7).into("ZIP") == Pos("7-ZIP", 0)
    with pytest.raises(ValueError):
        Pos("", 1).moved(-2)
    df = spark.createDataFrame([("1000-GZIP-300-BASE64", 30), ("", 7)], "p string, n long")
    got = df.select(paths.pos0(F.col("p"), F.col("n")), paths.depth(F.col("p")), paths.alpha_part(F.col("p")), paths.image_offset(F.col("p"), F.col("n")), paths.first_part(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(str(p), 2, "GZIP/BASE64", 1000, "1000"), ("7", 0, "", 7, "")]


def test_escapes():
    assert text.octal_escaped(b"a\x01\\\xff\xc3\xa9") == "a\\001\\134\\377é"
    assert text.octal_unescaped("a\\001\\134\\377é") == b"a\x01\\\xff\xc3\xa9"
    assert text.as_utf8("héllo".encode("utf-16-le")) == "héllo" and text.looks_utf16(b"plain") is None
    assert text.scaled_int("16k") == 16384 and text.scaled_int("2T") == 2 << 40
    with pytest.raises(ValueError):
        text.scaled_int("x")
    assert text.fat_iso((31 << 9) | (3 << 5) | 4, (5 << 11) | (6 << 5) | 7) == "2011-03-04T05:06:14" and text.fat_iso(0, 0) is None


def test_validators_agree(spark):
    rnd = random.Random(2)
    numbers = ["371449635398431", "4485116811440732", "4845168114407329"] + ["".join(rnd.choice("0123456789") for _ in range(rnd.randint(12, 20))) for _ in range(300)]
    numbers += ["4" + "".join(rnd.choice("0123456789") for _ in range(15)) for _ in range(600)]
    got = {r.d: r.ok for r in spark.createDataFrame([(n,) for n in numbers], "d string").select("d", validators.card_digits_ok(F.col("d")).alias("ok")).collect()}
    assert got == {n: validators.valid_card(n) for n in numbers} and sum(got.values()) > 20
    assert validators.valid_ssn("123-45-6789") and not validators.valid_ssn("666-45-6789")


def test_histograms(spark):
    rows = [("ccn", x, None, False) for x in ("100", "200", "300", "200", "300", "foo 300 bar")] + [("ccn", "300", None, True), ("find", "ABCdefg", None, False), ("ip", "1.2.3.4", "cksum-ok", False), ("ip", "1.2.3.5", "cksum-bad", False)]
    df = spark.createDataFrame(rows, "recorder string, feature string, context string, is_utf16 boolean")
    h = histograms.histogram(df, histograms.Histogram("ccn", numeric=True))
    assert [(r.feature, r.n, r.n_utf16) for r in histograms.ordered(h).collect()] == [("300", 4, 1), ("200", 2, 0), ("100", 1, 0)]
    assert [r.value for r in histograms.lines(histograms.ordered(h)).collect()][0] == "n=4\t300\t(utf16=1)"
    every = {(r.recorder, r.feature): r.n for r in histograms.histograms(df).collect()}
    assert every[("find", "abcdefg")] == 1 and ("ip", "1.2.3.5") not in every and every[("ip", "1.2.3.4")] == 1
    pattern = histograms.histogram(df, histograms.Histogram("find", pattern="^(.....)", lowercase=True))
    assert [r.feature for r in pattern.collect()] == ["abcde"]
    assert histograms.top(h, 1).count() == 1


def test_lists(spark):
    rows = [("email", "a@x.com", "to a@x.com now"), ("email", "a@x.com", "by a@x.com now"), ("email", "b@y.com", "b@y.com"), ("email", "Spam@z.com", "Spam@z.com")]
    df = spark.createDataFrame(rows, "recorder string, feature string, context string")
    listed = lists.parsed(spark.createDataFrame([("12\ta@x.com\tto a@x.com now",), ("# note",), ("",), ("spam.*@z",), ("5\tb@y.com",)], "value string"))
    assert tuples(listed) == [("a@x.com", "to ", " now", False), ("b@y.com", "", "", False), ("spam.*@z", "", "", True)]
    assert tuples(lists.kept(df, listed)) == [("email", "a@x.com", "by a@x.com now")]
    assert {r.recorder for r in lists.stopped(df, listed).collect()} == {"email_stopped"} and lists.stopped(df, listed).count() == 3
    assert lists.applied(df, None, lists.literals(spark, ["b@y.com"])).where("recorder = 'ALERTS_found'").count() == 1


def test_as_of_across_blocks(spark):
    rnd = random.Random(3)
    runs = [(k, s, s + rnd.randint(1, 400), i) for i, (k, s) in enumerate({(rnd.randint(0, 2), rnd.randint(0, 5000)) for _ in range(60)})]
    places = [(rnd.randint(0, 3), rnd.randint(0, 6000), i) for i in range(300)]
    want = []
    for k, at, i in places:
        last = max((r for r in runs if r[0] == k and r[1] <= at), key=lambda r: r[1], default=None)
        want.append((k, at, i, last[3] if last and at < last[2] else None))
    p, r = spark.createDataFrame(places, "k int, at long, i int"), spark.createDataFrame(runs, "k int, start long, stop long, run int")
    for width in (7, 500, 1 << 20):
        got = joins.as_of(p, r, ["k"], "at", "start", "stop", width=width).select("k", "at", "i", "run")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    over = joins.overlapping(p, r, ["k"], "at", "start", "stop", width=100).select("i", "run")
    assert tuples(over) == sorted((i, x[3]) for k, at, i in places for x in runs if x[0] == k and x[1] <= at < x[2])


def test_runs_of_blocks(spark):
    blocks = spark.createDataFrame([(1, 0, 0), (1, 8, 1), (1, 16, 2), (1, 40, 3), (1, 3, 9), (2, 8, 1)], "source int, disk_block long, file_block long")
    got = analytics.block_runs(blocks)
    assert tuples(got) == [(1, 0, 16, 0, 3), (1, 3, 3, 9, 1), (1, 40, 40, 3, 1), (2, 8, 8, 1, 1)]
    assert tuples(analytics.merged_runs(got.where("first_block <> 3"), 24)) == [(1, 0, 40, 4), (2, 8, 8, 1)]
    assert tuples(joins.consecutive(blocks.select("source", "file_block"), ["source"], "file_block")) == [(1, 0, 3, 4), (1, 9, 9, 1), (2, 1, 1, 1)]


def test_differences(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 1)], "feature string, n long")
    b = spark.createDataFrame([("y", 1), ("z", 5)], "feature string, n long")
    assert [tuple(r) for r in analytics.ordered_diff(analytics.histogram_diff(a, b)).collect()] == [("z", 0, 5, 5), ("x", 1, 0, -1), ("y", 3, 1, -2)]
    assert tuples(analytics.only_in(a, b, "feature")) == [("x",)] and tuples(analytics.in_both(a, b, "feature")) == [("y",)]


def test_pages_and_gates(spark):
    df = spark.createDataFrame([(1, bytearray(range(250))), (2, None), (3, bytearray()), (4, bytearray(b"ab" * 60)), (5, bytearray(b"\0" * 90))], "id int, raw binary")
    cut = pages.paged(df, "raw", ["id"], 100, 30)
    assert tuples(cut.select("id", "offset", "pagesize", "bufsize"))[:3] == [(1, 0, 100, 130), (1, 100, 100, 130), (1, 200, 50, 50)]
    assert {r.id for r in pages.gated(cut).collect()} == {1}
    got = {r.id: r.n for r in df.where("octet_length(raw) > 0").select("id", pages.ngram_size(F.col("raw")).alias("n")).collect()}
    assert got == {1: 0, 4: 2, 5: 1}
    assert pages.unseen(cut, spark.createDataFrame([("100",)], "pos0 string")).where("offset = 100").count() == 0
    assert 0 < pages.sampled(spark.range(1000).select(F.lit("").alias("path"), F.col("id").alias("offset")), 0.2).count() < 400


def test_every_address_is_found_across_pages(spark, tmp_path):
    body = b"".join(b"user%d@company.com " % i for i in range(20_000))
    half = len(body) // 2
    (tmp_path / "disk.000").write_bytes(body[:half])
    (tmp_path / "disk.001").write_bytes(body[half:])
    (tmp_path / "disk.003").write_bytes(b"not part of it")
    assert images.segments("disk.000", ["disk.000", "disk.001", "disk.003"]) == ["disk.000", "disk.001"]
    read = images.read_image(spark, str(tmp_path / "disk.000"), page=4096, margin=512)
    rows = scan(read, Options(only=("email",))).where("recorder = 'email'")
    # A page that begins inside an address gives its rest as well; every whole one is found once.
    whole = rows.where(F.col("feature").rlike("^user[0-9]+@company[.]com$"))
    assert whole.count() == whole.select("feature").distinct().count() == 20_000
    assert images.read_image(spark, str(tmp_path / "disk.000"), page=4096, start=8192, end=12288).count() == 1


def test_report(spark, tmp_path):
    packed = gzip.compress(b"hello@world.com and known@good.com are in here", mtime=0)
    rows = [("one", bytearray(b"front " + packed)), ("two", bytearray(b"other front " + packed)), ("three", bytearray(b"plain known@good.com text"))]
    read = images.from_column(spark.createDataFrame(rows, "name string, raw binary"), "raw", "name")
    found = scan(read, Options(only=("gzip", "email"))).cache()
    assert tuples(duplicates(found)) == [("one|6-GZIP-0", "two|12-GZIP-0", r.sha1) for r in duplicates(found).collect()]
    stop = lists.literals(spark, ["known@good.com"])
    whole = report(read, stop=stop, rows=found)
    assert whole.features.where("recorder = 'email'").count() == 2 and whole.features.where("recorder = 'email_stopped'").count() == 3
    once = report(read, rows=found, dedupe=True)
    assert tuples(once.features.where("recorder = 'email'").select("source", "feature")) == [("one", "hello@world.com"), ("one", "known@good.com"), ("three", "known@good.com")]
    whole.write(str(tmp_path / "report"), lines=True)
    sinks.write_feature_lines(whole.features, str(tmp_path / "lines"))
    back = reports.read_features(spark, str(tmp_path / "lines/recorder=email"))
    assert tuples(back.select("pos0", "feature"))[0] == ("12-GZIP-0", "hello@world.com")
    sinks.write_histograms(whole.histograms, str(tmp_path / "hist"))
    assert ("hello@world.com", 2, 0) in tuples(reports.read_histogram(spark, str(tmp_path / "hist/recorder=email/suffix=histogram")))
    assert sinks.work_units(found).count() == 5


def test_carved_files(spark, tmp_path):
    card = b"BEGIN:VCARD\r\nFN:John\r\nEND:VCARD\r\n"
    read = images.from_column(spark.createDataFrame([("a", bytearray(b"some text " + card)), ("b", bytearray(b"more and more text " + card))], "name string, raw binary"), "raw", "name")
    rows = report(read, Options(only=("vcard",), carve_mode=2)).carved
    written = sinks.write_carved(rows, str(tmp_path)).collect()
    assert sorted(r.cached for r in written) == [False, True] and {r.size for r in written} == {len(card)}
    assert len(list(tmp_path.rglob("*.vcf"))) == 1


def test_files_and_file_map(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/a.txt").write_bytes(b"some@where.com is written here")
    (tmp_path / "in/empty").write_bytes(b"")
    assert images.open_source(spark, str(tmp_path / "in")).count() == 1
    (tmp_path / "map.xml").write_text(
        "<files><fileobject><filename>a.txt</filename><hashdigest type='md5'>aa</hashdigest><byte_runs><byte_run img_offset='100' len='50'/></byte_runs></fileobject>"
        "<fileobject><filename>gone</filename><unalloc>1</unalloc><hashdigest type='md5'>bb</hashdigest><byte_runs><byte_run img_offset='90' len='100'/></byte_runs></fileobject></files>"
    )
    runs = reports.read_file_map(spark, str(tmp_path / "map.xml"))
    feats = spark.createDataFrame([("", 120, "x"), ("95-GZIP", 3, "y"), ("", 500, "z")], "path string, offset long, feature string")
    got = {r.feature: (r.filename, r.md5) for r in reports.with_files(feats, runs).collect()}
    assert got == {"x": ("a.txt", "aa"), "y": ("gone", "bb"), "z": (None, None)}


def test_streams(spark, tmp_path):
    from lodeseam.streaming import scan as streams

    folder = tmp_path / "in"
    spark.createDataFrame([(1, "a@example.com and abc@example.com in text"), (2, "abc@example.com again, here")], "id long, text string").repartition(2).write.parquet(str(folder))
    rows = streams.scanned_stream(streams.page_stream(spark, str(folder), "id long, text string", "text", "id", 1), Options(only=("email",)))
    query = streams.histogram_stream(rows).writeStream.outputMode("complete").format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert tuples(spark.table("found").where("recorder = 'email'").select("feature", "n")) == [("abc@example.com", 2)]
    seen = []
    streams.each_batch(streams.unique_stream(rows.where("recorder = 'email'"), "feature"), lambda df, i: seen.extend(r.feature for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert seen == ["abc@example.com"]


def test_report_scans_once(spark, tmp_path):
    from lodeseam.operators import lists
    from lodeseam.plans.scan import Options, report
    from lodeseam.sources.images import from_column

    count = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, "write to abc@example.com or def@example.com"), (2, "and ghi@example.com")], "k long, t string")

    def counted(batches):
        for batch in batches:
            count.add(len(batch))
            yield batch

    pages = from_column(df.mapInArrow(counted, df.schema), "t", "k")
    stop, alert = lists.literals(spark, ["abc@example.com", "^gh[i]"]), lists.literals(spark, ["def@example.com"])
    stored = report(pages, Options(only=("email",)), stop, alert, dedupe=True).write(str(tmp_path), lines=True)
    assert count.value == 2
    assert sorted((r.recorder, r.feature) for r in stored.features.where("feature LIKE '%@%'").collect()) == [
        ("ALERTS_found", "def@example.com"), ("email", "def@example.com"), ("email_stopped", "abc@example.com"), ("email_stopped", "ghi@example.com")]
    assert count.value == 2
    lines = [r.value for r in spark.read.text(f"{tmp_path}/lines/recorder=email").collect()]
    assert lines[0] == "# lodeseam" and lines[1] == "# Feature-Recorder: email" and lines[-1].startswith("28\tdef@example.com\t")
    assert {r.feature for r in spark.read.parquet(f"{tmp_path}/histograms").where("recorder = 'email' AND suffix = 'histogram'").collect()} == {"def@example.com"}


def test_lists_keep_null_features(spark):
    from lodeseam.operators import lists

    df = spark.createDataFrame([("a", None, None), ("b", "abc", "x abc y"), ("c", "zzz", None)], "recorder string, feature string, context string")
    stop = lists.literals(spark, ["a[b]c", *[f"q{i}[x]" for i in range(120)]])
    assert sorted(r.recorder for r in lists.applied(df, stop).collect()) == ["a", "b_stopped", "c"]


def test_both_paths_find_the_same(spark):
    """The native extractors and the byte scanners over one corpus."""
    from lodeseam.plans.scan import Options, scan
    from lodeseam.sources.images import from_column

    log = '10.0.0.7 - - "GET /x HTTP/1.1" 200'
    texts = [
        "x" * 40 + "pokesText" + "." * 3000 + "pokesText" + "." * 1500 + "hovercard/page" + "." * 9000 + "pokesText and more " * 20,
        "pokesText at the first byte, then later pokesText" + "." * 200, "." * 100 + "mobileFriends", "", None,
        f"{log}\nno address GET / x\n/10.0.0.7 PUT /1.2.3.4 y\n{log.replace('GET', 'PATCH')}\n" + "z" * 1100 + f"{log}\n{log} no end",
        "Date: Mon, 02 Jan 2012 10:11:12 +0100 then Subject: hello\nHost: a.b.c Message-ID: <x@y>\nCookie: z",
        "fax: 0 (12) 345-678 tel: 030 1234567 call (215) 555-1212 or 215-555-1213. +49 30 12 34 56 78",
        "[ 100.5 200 3712 345678 ] box [123 456 7890] 4485 1684 1144 0732 4485 1684 1144 0732 1234 5678 9012 3456 7890",
        "ssn: 123-45-6789 dob: 2001-02-03 DOB 3 May 1980 dob: June 4, 1999 fedex 1234 5678 9 sin 123 456 789 SIN: 123-456-789",
        "a@example.com b.c@mail.example.org http://www.example.com/?q=1&quot; 10.1.2.3 00:1a:2b:3c:4d:5e 4532015112830366 fbid=4532015112830366",
    ]
    rows = [*enumerate(texts), *[(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]]
    df = spark.createDataFrame(rows, "k long, t string")
    names = ["email", "url", "domain", "ether", "ccn", "telephone", "ccn_track2", "pii", "sin", "rfc822", "httplogs", "facebook"]
    native = {(r.k, r.recorder, r.offset, r.feature) for r in features.extract(df, "t", names, ["k"]).collect()}
    scanned = scan(from_column(df, "t", "k"), Options(only=("email", "accts", "httplogs", "facebook"))).where("kind = 'feature' AND NOT is_utf16")
    found = {(int(r.source), r.recorder, r.offset, r.feature) for r in scanned.collect() if r.recorder in names}
    escaped = {x for x in native | found if "\\" in x[3] or "\r" in x[3] or "\n" in x[3]}
    bitcoin = {x for x in found if x[1] == "pii" and x[3][0] in "13" and x[3].isalnum()}
    assert native - escaped == found - escaped - bitcoin
    marks = sorted((x[0], x[2], len(x[3])) for x in native if x[1] == "facebook")
    assert marks == [(0, 0, 4096), (0, 2510, 4096), (0, 11524, 2418), (2, 0, 103)]
    # An address counts from its second digit on where a slash stands before the first.
    assert sum(x[1] == "httplogs" for x in native) == 2 and {"telephone", "ccn", "pii", "sin", "rfc822", "ether"} <= {x[1] for x in native}


def test_run_report_and_restart(spark, tmp_path):
    from lodeseam.plans.run_report import remaining, run_report, write_work_units

    body = spark.createDataFrame([("a", bytearray(b"first@example.com text " * 20)), ("b", bytearray(b"second@example.com text " * 20))], "name string, raw binary")
    read = images.from_column(body, "raw", "name", 128, 32)
    half = read.where("offset < 256")
    rows = scan(half, Options(only=("email",)))
    write_work_units(rows, str(tmp_path))
    rest = remaining(spark, read, str(tmp_path))
    assert rest.count() == read.count() - half.count() and rest.where("offset < 256").count() == 0
    xml = run_report(rows, Options(only=("email",)), "a & b")
    assert "<source>a &amp; b</source>" in xml and "<name>email</name>" in xml and "<buffers>4</buffers>" in xml


@pytest.mark.parametrize("block", [256, 3])
def test_correlation_counts_features_on_many_drives(spark, monkeypatch, block):
    monkeypatch.setattr(analytics, "DRIVES_BLOCK", block)
    rnd = random.Random(3)
    on = {f"f{i:02d}": sorted(rnd.sample([f"d{k:02d}" for k in range(14)], rnd.randint(1, 14))) for i in range(60)}
    on |= {"everywhere": [f"d{k:02d}" for k in range(14)], "far": ["x", "y"], "alone": ["z"]}
    counts = spark.createDataFrame([(d, f, 1) for f, ds in on.items() for d in ds], "drive string, feature string, count long")
    want = {}
    for f, ds in on.items():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                want.setdefault((a, b), []).append((len(ds), f))
    got = {(r.a, r.b): (r.weight, r.shared) for r in analytics.drive_pairs(counts).collect()}
    assert got.keys() == want.keys()
    assert all(got[p][1] == len(w) and abs(got[p][0] - sum(1 / n for n, _ in w)) < 1e-9 for p, w in want.items())
    top = {(r.a, r.b, r["rank"]): (r.drives, r.feature) for r in analytics.factors(counts).collect()}
    assert top == {(*p, i + 1): x for p, w in want.items() for i, x in enumerate(sorted(w)[:5])}
    mine = sorted((len(ds), f) for f, ds in on.items() if "d01" in ds)
    mine = [x for x in mine if x[0] <= 10] + [x for x in mine if x[0] > 10][:1]
    tied = {}
    for n, f in mine:
        for d in on[f]:
            if d != "d01":
                tied[d] = tied.get(d, 0) + 1 / n
    found = {r.other: r.weight for r in analytics.drive_matches(counts, "d01").collect()}
    assert found.keys() == tied.keys() and all(abs(found[d] - w) < 1e-9 for d, w in tied.items())
