"""A report's counts are made of one scan."""

from lodeseam import queries
from lodeseam.operators import lists
from lodeseam.plans.scan import Options, first_places, report, scan
from lodeseam.sources.images import from_column


def test_counts_of_one_scan(spark, tmp_path):
    texts = ["mail one.person@mail1.example.com, call (215) 555-1212 now", "write two.person@mail2.example.com, call (215) 555-1213"]
    docs = spark.createDataFrame([(i, texts[i % 2] if i < 6 else None) for i in range(8)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counted = queries.QUERIES["scan_report_counts"](spark, str(tmp_path))
    # The documents were scanned before: nothing in the plan of the counts scans them again.
    assert "MapInArrow" not in counted._jdf.queryExecution().optimizedPlan().toString()
    rows = scan(from_column(docs, "text", "doc_id"), Options(only=("email", "accts")))
    again = report(None, stop=lists.literals(spark, ["mail1[.]example"]), dedupe=True, rows=rows).features.groupBy("recorder").count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, again.collect())) == [("domain", 1), ("domain_stopped", 1), ("email", 1), ("email_stopped", 1), ("telephone", 2)]


def test_first_places_scan_twice_at_most(spark):
    docs = spark.createDataFrame([(i, f"call (215) 555-121{i % 3} now or never") for i in range(9)], "doc_id long, text string")
    first = first_places(scan(from_column(docs, "text", "doc_id"), Options(only=("accts",))))
    assert first._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert sorted((r.source, r.feature) for r in first.where("kind = 'feature'").collect()) == [(str(i), f"(215) 555-121{i}") for i in range(3)]
