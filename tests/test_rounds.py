"""Scans over segments and what is built on them, against plain loops: as-of joins, matching in rounds, quotas, large tops."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import analytics as an
from colloquy.operators.matching import match_nearest
from colloquy.operators.scan import running


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("backward", [False, True])
def test_running_by_segments_equals_a_window(spark, before, backward):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.randint(0, 99), i, rng.choice([None, rng.randint(0, 9)])) for i in range(300)]
    frame = spark.createDataFrame(data, "k string, t long, id long, v long")
    values = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "l": ("last", F.struct("v"))}
    found = running(frame, ["k"], ["t", "id"], F.floor(F.col("t") / 7), values, before, backward)
    assert rows(found) == rows(running(frame, ["k"], ["t", "id"], None, values, before, backward))


@pytest.mark.parametrize("keyed, width", [(True, None), (True, 5), (False, 5), (False, None)])
def test_as_of(spark, keyed, width):
    rng = random.Random(4)
    asked = [(rng.choice(["x", "y", None]), rng.choice([None, *range(40)]), i, "old") for i in range(200)]
    schedule = [(rng.choice(["x", "y", None]), rng.choice([None, *range(-3, 30)]), rng.choice([None, "u", "v", "w"])) for _ in range(40)]
    expected = []
    for k, t, i, _ in asked:
        known = [(since, v is not None, v) for key, since, v in schedule if since is not None and t is not None and since <= t and (key == k or not keyed)]
        expected.append((k, t, i, max(known, default=(0, 0, None), key=lambda e: (e[0], e[1], e[2] or ""))[2]))
    a = spark.createDataFrame(asked, "k string, t long, id long, v string")
    b = spark.createDataFrame(schedule, "k string, since long, v string")
    assert rows(an.as_of(a, b, "t", "since", "v", ["k"] if keyed else [], width)) == sorted(expected, key=repr)
    assert rows(an.as_of(a.limit(0), b, "t", "since", "v")) == [] and an.as_of(a, b.limit(0), "t", "since", "v").where("v is not null").count() == 0


def test_as_of_takes_a_schedule_of_any_length(spark):
    schedule = spark.range(100_000).selectExpr("id * 10 AS since", "id AS v")
    found = an.as_of(spark.range(0, 1_000_000, 777).withColumnRenamed("id", "t"), schedule, "t", "since", "v", width=50_000)
    assert found.where("v <> t div 10").count() == 0 and found.count() == len(range(0, 1_000_000, 777))


@pytest.mark.parametrize("width", [None, 4])
def test_match_nearest_against_the_sequential_rule(spark, width):
    rng = random.Random(5)
    left = [(r, f"l{rng.randint(0, 12):02d}", rng.randint(0, 30)) for r in "pq" for _ in range(14)]
    right = [(r, f"r{rng.randint(0, 12):02d}", rng.randint(0, 30)) for r in "pq" for _ in range(11)] + [("only", "r", 1), ("p", None, 3), ("p", "r99", None)]
    expected = []
    for rec in "pq":
        pairs = sorted((abs(a - b), l, r) for k, l, a in left if k == rec for j, r, b in right if j == rec and r is not None and b is not None)
        used = set()
        for d, l, r in pairs:
            if l not in used and r not in used:
                used |= {l, r}
                expected.append((rec, l, r, float(d)))
    a, b = spark.createDataFrame(left, "rec string, l string, t long"), spark.createDataFrame(right, "rec string, r string, t long")
    assert rows(match_nearest(a, b, "rec", "l", "r", "t", width)) == sorted(expected, key=repr)
    assert rows(match_nearest(a.limit(0), b, "rec", "l", "r", "t")) == []


@pytest.mark.parametrize("few", [10_000, 3])
def test_quota_select_against_the_sequential_rule(spark, monkeypatch, few):
    monkeypatch.setattr(an, "FEW", few)
    rng = random.Random(6)
    data = [(rng.choice("abcd"), rng.choice([f"g{i}" for i in range(9)] + [None]), rng.choice([None, *range(8)]), i) for i in range(160)]
    cells, quota = [("a", 7), ("c", 5), ("b", 30), ("zz", 3)], {"a": 2, "b": 3, "c": 1, "zz": 1}
    used, expected = {}, []
    for cell, target in cells:
        left = target
        for c, g, s, k in sorted((r for r in data if r[0] == cell), key=lambda r: (r[2] is None, -(r[2] or 0), r[3])):
            if left and used.get(g, 0) < quota[cell]:
                used[g], left = used.get(g, 0) + 1, left - 1
                expected.append((c, g, s, k))
    frame = spark.createDataFrame(data, "cell string, rec string, score long, key long")
    assert rows(an.quota_select(frame, cells, quota)) == sorted(expected, key=repr)
    assert rows(an.quota_select(frame.limit(0), cells, 2)) == []


def test_best_rows_of_a_large_target(spark):
    frame = spark.range(60_000).selectExpr("id AS key", "CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 7919) % 1000 END AS score")
    expected = frame.orderBy(F.col("score").desc_nulls_last(), "key").limit(20_000)
    assert an.best_rows(frame, 20_000, "score", "key").exceptAll(expected).count() == 0 and an.best_rows(frame, 20_000, "score", "key").count() == 20_000
