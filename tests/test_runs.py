"""Runs of rows: what a task holds, and equality with the plain definition."""

import random

from lodeseam import queries
from lodeseam.operators import analytics, joins

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(rows, step):
    out = []
    for key, k in sorted(set(rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        if out and out[-1][0] == key and k is not None and out[-1][2] is not None and out[-1][2] + step == k:
            out[-1] = (key, out[-1][1], k, out[-1][3] + 1)
        else:
            out.append((key, k, k, 1))
    return sorted(out, key=repr)


def test_consecutive_equals_brute_force(spark):
    pick = random.Random(3)
    rows = [(pick.randrange(4), pick.randrange(60) - 20) for _ in range(150)] + [(1, None), (1, None), (9, None), (7, 5)]
    df = spark.createDataFrame(rows, "key int, k long")
    for step in (1, 3):
        got = joins.consecutive(df, ["key"], "k", step, parts=3, distinct=True)
        assert got.columns == ["key", "first", "last", "n"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, step)
    # Without distinct equal rows are apart: each begins a run.
    assert sorted(map(tuple, joins.consecutive(spark.createDataFrame([(1, 4), (1, 5), (1, 5), (1, 6)], "key int, k long"), ["key"], "k").collect())) == [(1, 4, 5, 2), (1, 5, 6, 2)]


def test_block_runs_with_equal_and_crossing_rows(spark):
    rows = [(1, 0, 0), (1, 8, 1), (1, 8, 1), (1, 16, 2), (1, 4, 7), (1, 12, 8), (1, 16, 5), (1, 24, 6), (2, 24, 3), (2, None, 1), (2, None, 1)]
    df = spark.createDataFrame(rows, "source int, disk_block long, file_block long")
    got = sorted(map(tuple, analytics.block_runs(df, parts=3, distinct=True).collect()), key=repr)
    assert got == sorted([(1, 0, 16, 0, 3), (1, 4, 12, 7, 2), (1, 16, 24, 5, 2), (2, 24, 24, 3, 1), (2, None, None, 1, 1)], key=repr)


def test_tasks_hold_what_they_sort(spark, monkeypatch):
    for name in ("gaps_islands_runs", "hash_block_runs"):
        assert "HashAggregate" not in plan(queries.QUERIES[name](spark, SF))
        monkeypatch.setattr(joins, "TASK_ROWS", 500)
        rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
        assert rows > 4 * 500 and queries.QUERIES[name](spark, SF).rdd.getNumPartitions() == -(-rows // 500)
        monkeypatch.undo()
