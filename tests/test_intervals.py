"""Boundary rules of the interval algebra, by hand and against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import intervals as iv
from colloquy.operators.scan import running


def spans(spark, rows, schema="rec string, speaker string, start long, end long"):
    return spark.createDataFrame(rows, schema)


def got(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*(columns or ("start", "end"))).collect()), key=repr)


def test_three_merge_rules(spark):
    rows = [("r", "a", a, b) for a, b in [(0, 20), (10, 30), (30, 40), (44, 50), (90, 100)]]
    turns = spans(spark, rows)
    assert got(iv.merge(turns, ["rec"])) == [(0, 30), (30, 40), (44, 50), (90, 100)]
    assert got(iv.merge(turns, ["rec"], touching=True)) == [(0, 40), (44, 50), (90, 100)]
    assert got(iv.merge(turns, ["rec"], gap=5)) == [(0, 50), (90, 100)]


def test_overlaps_of_touching_turns_and_handover(spark):
    assert got(iv.overlaps(spans(spark, [("r", "A", 0, 5), ("r", "A", 5, 8), ("r", "B", 3, 9)]))) == [(3, 8)]
    assert got(iv.overlaps(spans(spark, [("r", "A", 0, 5), ("r", "B", 5, 8)]))) == []


def test_gaps_and_subtract(spark):
    speech = spans(spark, [("r", "a", 20, 40), ("r", "a", 45, 90)])
    totals = spark.createDataFrame([("r", 120), ("silent", 30)], "rec string, total long")
    assert got(iv.gaps(speech, totals, ["rec"], 10), "rec", "start", "end") == [("r", 0, 20), ("r", 90, 120), ("silent", 0, 30)]
    whole = spark.createDataFrame([("r", 0, 100)], "rec string, start long, end long")
    assert got(iv.subtract(whole, spans(spark, [("r", "a", 20, 30), ("r", "a", 50, 60)]), ["rec"])) == [(0, 20), (30, 50), (60, 100)]


def covered(rows):
    return {t for a, b in rows for t in range(a, b)}


def test_algebra_against_point_sets(spark):
    rng = random.Random(0)
    rows, cuts = [], []
    for rec in range(30):
        for i in range(rng.randint(1, 9)):
            a = rng.randint(0, 60)
            rows.append((f"r{rec}", f"s{rng.randint(0, 2)}", a, a + rng.randint(1, 15)))
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 60)
            cuts.append((f"r{rec}", "x", a, a + rng.randint(1, 15)))
    turns, b = spans(spark, rows), spans(spark, cuts)
    merged = iv.merge(turns, ["rec"], touching=True)
    for width in (None, 7):
        left = iv.subtract(merged, b, ["rec"], width=width).collect()
        for rec in {r[0] for r in rows}:
            mine = covered([r[2:] for r in rows if r[0] == rec]) - covered([c[2:] for c in cuts if c[0] == rec])
            assert covered([(r.start, r.end) for r in left if r.rec == rec]) == mine
    both = iv.overlaps(turns).collect()
    for rec in {r[0] for r in rows}:
        per = [covered([r[2:] for r in rows if r[0] == rec and r[1] == f"s{s}"]) for s in range(3)]
        assert covered([(r.start, r.end) for r in both if r.rec == rec]) == {t for t in range(80) if sum(t in p for p in per) >= 2}


def test_suppress_keeps_the_best_of_near_windows(spark):
    rows = spark.createDataFrame([("r", 0, 10, 4), ("r", 2, 12, 5), ("r", 20, 30, 1)], "rec string, start long, end long, overlap long")
    assert got(iv.suppress(rows, ["rec"], "overlap", 0.3)) == [(2, 12), (20, 30)]
    assert spark.range(1).select(iv.hull_iou(*map(F.lit, (0, 10, 5, 15)))).first()[0] == 5 / 15


def test_pad_spills_to_the_other_side(spark):
    a, b = iv.pad(F.lit(2), F.lit(4), F.lit(100), F.lit(10))
    assert tuple(spark.range(1).select(a, b).first()) == (0, 10)
    a, b = iv.pad(F.lit(95), F.lit(99), F.lit(100), F.lit(10))
    assert tuple(spark.range(1).select(a, b).first()) == (90, 100)


def test_lint_and_runs(spark):
    rows = [("r", "a", i * 10, i * 10 + 8, "ja") for i in range(6)] + [("r", "b", 5, 5, " ")]
    turns = spark.createDataFrame(rows, "rec string, speaker string, start long, end long, text string")
    assert sorted(r.finding for r in iv.lint(turns, ["rec"], longest=7).collect()) == ["empty", "not_positive"] + ["too_long"] * 6
    assert got(iv.repeated_runs(turns.where("speaker = 'a'"), ["rec"], least=5, gap=4)) == [(40, 48)]


def random_turns(rng, recs, n, longest, span):
    rows = []
    for rec in range(recs):
        for _ in range(rng.randint(1, n)):
            a = rng.randint(0, span)
            rows.append((None if rec == 0 else f"r{rec}", rng.choice(["a", "b", None]), a, a + rng.randint(1, longest)))
    return rows + rows[:5]


@pytest.mark.parametrize("width", [7, 1000])
def test_stretches_change_nothing(spark, width):
    rng = random.Random(width)
    turns = spans(spark, random_turns(rng, 12, 60, 40, 400)).persist()
    totals = turns.groupBy("rec").agg((F.max("end") + 9).alias("total"))
    for rule, keys in (({}, ["rec"]), ({"touching": True}, ["rec", "speaker"]), ({"gap": 6}, ["rec"]), ({}, ["rec", "speaker"])):
        assert got(iv.merge(turns, keys, width=width, **rule), *keys, "start", "end") == got(iv.merge(turns, keys, **rule), *keys, "start", "end")
    both = iv.overlaps(turns)
    assert got(iv.overlaps(turns, width=width), "rec", "start", "end") == got(both, "rec", "start", "end")
    speech = iv.merge(turns, ["rec"], touching=True)
    assert got(iv.gaps(speech, totals, ["rec"], 2, width), "rec", "start", "end") == got(iv.gaps(speech, totals, ["rec"], 2), "rec", "start", "end")
    cuts = spans(spark, random_turns(rng, 9, 20, 15, 400))
    plain = Counter()
    for rec, speaker, a, b in turns.collect():
        free = sorted(covered([(a, b)]) - covered([(c, d) for r, _, c, d in cuts.collect() if r == rec])) + [10**9]
        begun = None
        for t, after in zip(free, free[1:]):
            begun = t if begun is None else begun
            if after != t + 1:
                if t + 1 - begun > 2:
                    plain[rec, speaker, begun, t + 1] += 1
                begun = None
    for w in (None, width):
        assert Counter(tuple(r) for r in iv.subtract(turns, cuts, ["rec"], least=2, width=w).collect()) == plain


@pytest.mark.parametrize("width", [None, 13])
def test_measure_against_plain_sums(spark, width):
    rng = random.Random(6)
    turns = spans(spark, [r for r in random_turns(rng, 8, 30, 25, 150) if r[0] and r[1]]).persist()
    totals = turns.groupBy("rec").agg(F.max("end").alias("total"))
    windows = iv.sliding(totals, 30, 11).drop("total")
    rows, overlaps = turns.collect(), iv.overlaps(turns).collect()
    for r in iv.measure(windows, turns, ["rec"], width=width).collect():
        def cut(spans):
            return [min(x.end, r.end) - max(x.start, r.start) for x in spans if x.rec == r.rec and x.start < r.end and x.end > r.start]

        shared = cut(overlaps)
        assert (r.overlap, r.events, r.longest) == (sum(shared), len(shared), max(shared, default=0))
        assert r.speech == len(covered([(x.start, x.end) for x in rows if x.rec == r.rec]) & set(range(r.start, r.end)))
        assert (r.by_speaker or {}) == {s: sum(c) for s in ("a", "b") if (c := cut([x for x in rows if x.speaker == s]))}
    best = {}
    for r in windows.collect():
        shared = sum(max(min(x.end, r.end) - max(x.start, r.start), 0) for x in overlaps if x.rec == r.rec)
        best[r.rec] = max(best.get(r.rec, (0, 0)), (shared, -r.start))
    assert {r.rec: (r.shared, -r.start) for r in iv.best_window(totals, iv.overlaps(turns), ["rec"], 30, 11, width).collect()} == {k: v for k, v in best.items() if v[0]}


@pytest.mark.parametrize("width", [None, 9])
def test_suppress_against_the_greedy_rule(spark, width):
    rng = random.Random(2)
    rows = []
    for rec in range(6):
        for _ in range(60):
            a = rng.randint(0, 120)
            rows.append((f"r{rec}", a, a + rng.randint(5, 30), rng.randint(0, 6)))
    rows += rows[:9]
    expected = []
    for rec in range(6):
        kept = []
        for _, a, b, score in sorted((r for r in rows if r[0] == f"r{rec}"), key=lambda r: (-r[3], r[1], r[2])):
            if all(max(min(b, d) - max(a, c), 0) <= 0.3 * (max(b, d) - min(a, c)) for c, d, _ in kept):
                kept.append((a, b, score))
        expected += [(f"r{rec}", *k) for k in kept]
    frame = spark.createDataFrame(rows, "rec string, start long, end long, overlap long")
    assert got(iv.suppress(frame, ["rec"], "overlap", 0.3, width), "rec", "start", "end", "overlap") == sorted(expected, key=repr)
    assert iv.suppress(frame.limit(0), ["rec"], "overlap", 0.3).count() == 0


def test_one_long_recording_is_many_tasks(spark):
    turns = spark.range(200_000).selectExpr("'r' AS rec", "concat('s', id % 3) AS speaker", "id * 2000 AS start", "id * 2000 + 1000 + id % 1700 AS end")
    merged = iv.merge(turns, ["rec"], touching=True, width=600_000)
    assert merged.count() == iv.merge(turns, ["rec"], touching=True).count()
    flagged = running(turns, ["rec"], ["start", "end"], F.floor(F.col("start") / 600_000), {"reached": ("max", F.col("end"))}, before=True)
    tasks = [r.n for r in flagged.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 1 and max(tasks) < 100_000


@pytest.mark.parametrize("width", [1, 9])
def test_runs_by_stretches_equal_those_of_a_whole_key(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["p", None]), i, i + rng.randint(0, 2), rng.choice(["x", "x", "x", None, "y"])) for i in rng.sample(range(200), 120)]
    frame = spark.createDataFrame(rows, "rec string, start long, end long, text string").persist()
    for keys in (["rec"], []):
        whole, cut = (iv.run_lengths(frame, keys, "start", "text", w) for w in (None, width))
        assert got(cut, *keys, "text", "first", "last", "n") == got(whole, *keys, "text", "first", "last", "n")
    for least in (1, 3):
        whole, cut = (iv.repeated_runs(frame, ["rec"], least=least, gap=3, width=w) for w in (None, width))
        assert got(cut, "rec", "start", "end", "text") == got(whole, "rec", "start", "end", "text")
    # one text throughout: a run over all stretches
    same = spark.range(90).selectExpr("'r' AS rec", "id AS start", "id + 1 AS end", "'t' AS text")
    assert got(iv.repeated_runs(same, ["rec"], least=80, width=width)) == [(79, 80)]
    assert got(iv.run_lengths(same, ["rec"], "start", "text", width), "first", "last", "n") == [(0, 89, 90)]


def test_windows_are_joined_without_a_table_in_the_driver(spark):
    """However small what is joined seems, windows, silences and overlaps are not broadcast."""
    turns = spark.sql("SELECT * FROM VALUES ('a', 'x', 0L, 9L), ('a', 'y', 5L, 14L) AS t(rec, speaker, start, end)")
    windows = turns.select("rec", "start", "end")
    assert "Broadcast" not in iv.snap(windows, windows, ["rec"], "start", 4, -1)._jdf.queryExecution().executedPlan().toString()
    # the speakers of a recording are few, and may be broadcast
    measured = iv.measure(windows, turns, ["rec"], width=10)._jdf.queryExecution().executedPlan().toString()
    assert measured.count("SortMergeJoin") == 3
