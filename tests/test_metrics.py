"""Speech metrics on cases worked out by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import normalised_tokens
from colloquy.operators import metrics as me


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert me.edit_distance(a, b) == plain_distance(a, b)


def test_assign():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        cost = rng.integers(0, 20, (n, n)).astype(float)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))
        found = me.assign(cost)
        assert sorted(found) == list(range(n)) and sum(cost[i, j] for i, j in enumerate(found)) == best


@pytest.mark.parametrize(
    "ref, hyp, miss, false_alarm, confusion, der",
    [
        ([("A", 0, 10)], [("A", 0, 5)], 5, 0, 0, 0.5),
        ([("A", 0, 5)], [("A", 0, 10)], 0, 5, 0, 1.0),
        ([("A", 0, 10)], [("X", 0, 5), ("Y", 5, 10)], 0, 0, 5, 0.5),
        ([("A", 0, 10), ("B", 5, 10)], [("X", 0, 10), ("Y", 5, 10)], 0, 0, 0, 0.0),
    ],
)
def test_diarization_error(spark, ref, hyp, miss, false_alarm, confusion, der):
    schema = "speaker string, start long, end long, rec string"
    frames = [spark.createDataFrame([(*r, "r") for r in rows], schema) for rows in (ref, hyp)]
    found = me.diarization_error(*frames).first()
    assert (found.miss, found.false_alarm, found.confusion, found.der) == (miss, false_alarm, confusion, der)


def cp(spark, ref, hyp):
    def frame(d):
        return spark.createDataFrame([("r", k, v) for k, v in d.items()], "rec string, speaker string, text string").select("rec", "speaker", normalised_tokens(F.col("text")).alias("tokens"))

    return tuple(me.assigned_errors(frame(ref), frame(hyp), ["rec"]).first())[1:]


def test_word_errors(spark):
    ref = {"A": "ala ma kota", "B": "kot ma alę"}
    assert cp(spark, ref, ref) == (0, 6)
    assert cp(spark, ref, {"A": ref["B"], "B": ref["A"]}) == (0, 6)
    assert cp(spark, ref, {"A": "ala ma psa", "B": ref["B"]}) == (1, 6)
    assert cp(spark, ref, {"A": ref["A"]}) == (3, 6)
    assert cp(spark, {"A": "Ala, ma kota!!! [śmiech]"}, {"A": "ala ma kota"}) == (0, 3)
    assert cp(spark, {"A": "yyy"}, {"A": "mhm"}) == (0, 0)


def test_interleaving_and_streams():
    speakers = [[["jeden"], ["dwa"]], [["trzy"]]]
    assert me.best_interleaving(speakers, ["jeden", "dwa", "trzy"]) == (0, ["jeden", "dwa", "trzy"])
    assert me.edit_distance(["jeden", "trzy", "dwa"], ["jeden", "dwa", "trzy"]) > 0
    utterances = [["jeden"], ["dwa"], ["trzy"]]
    assert me.best_streams(utterances, [["jeden", "trzy"], ["dwa"]]) == 0
    rng = random.Random(1)
    for _ in range(30):
        own = [[[rng.choice("ab") for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 2))] for _ in range(2)]
        stream = [rng.choice("ab") for _ in range(rng.randint(0, 5))]
        orders = set(itertools.permutations([0] * len(own[0]) + [1] * len(own[1])))
        best = min(plain_distance([t for s, i in zip(o, [o[:k].count(o[k]) for k in range(len(o))]) for t in own[s][i]], stream) for o in orders)
        errors, merged = me.best_interleaving(own, stream)
        assert errors == best == plain_distance(merged, stream)


def plain_streams(utterances, streams):
    if not utterances:
        return sum(map(len, streams))
    rest, u = utterances[:-1], utterances[-1]
    return min(plain_streams(rest, [*streams[:k], s[:at], *streams[k + 1 :]]) + plain_distance(u, s[at:]) for k, s in enumerate(streams) for at in range(len(s) + 1))


def test_streams_and_merges_of_whole_utterances():
    rng = random.Random(2)
    for n in range(120):
        said = [(rng.choice("AB"), [rng.choice("abc") for _ in range(rng.randint(0, 4))]) for _ in range(rng.randint(0, 4))]
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 4))] for _ in range(2)]
        if n % 2:
            streams = [[t for s, u in said if s == k for t in u if rng.random() < 0.8] for k in "BA"]
        best = plain_streams([u for _, u in said], streams)
        assert me.best_streams([u for _, u in said], streams) == me.stream_errors(said, streams) == best
        own = [[u for s, u in said if s == k] for k in "AB"]
        assert me.merged_errors(said, streams[0]) == me.best_interleaving(own, streams[0])[0]


def test_sessions_are_scored_whole(spark, tmp_path):
    from colloquy.plans.metric_queries import met_05_06_short_sessions

    words = "ala ma kota i psa oraz dwie małe rybki w dużym akwarium".split()
    rows = [(1, n, ("user", "assistant")[n % 2], " ".join(words[n:] + words[:n])) for n in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    dropped = sum((i + 1 + 1 + n + 1) % 7 == 0 for n in range(5) for i in range(len(words)))
    found = met_05_06_short_sessions(spark, str(tmp_path)).first()
    assert (found.length, found.merged, found.streams) == (5 * len(words), dropped, dropped)


def test_timed_errors(spark):
    a = [("x", 0.0, 1.0), ("y", 1.0, 2.0)]
    assert me.timed_distance(a, a, 0.0) == 0 and me.timed_distance(a, [("x", 50.0, 51.0), ("y", 51.0, 52.0)], 5.0) == 4
    rows = spark.createDataFrame([("r", "A", 0, 2, ["x", "y"])], "rec string, speaker string, start long, end long, tokens array<string>")
    timed = rows.select("rec", "speaker", me.spread_in_time(F.col("tokens"), F.col("start"), F.col("end")).alias("tokens"))
    assert tuple(me.assigned_errors(timed, timed, ["rec"], errors_of=me.timed_errors(5.0)).first()) == ("r", 0, 2)


def test_characters_under_the_merge(spark):
    ref = spark.createDataFrame([("r", "A", 1, ["kot"]), ("r", "B", 2, ["pies"])], "rec string, speaker string, order long, tokens array<string>")
    hyp = spark.createDataFrame([("r", 1, ["pies", "kos"])], "rec string, stream int, tokens array<string>")
    assert tuple(me.interleaved_errors(ref, hyp, ["rec"], characters_too=True).first()) == ("r", 1, 8)


def full_timed_distance(a, b, collar):
    row = list(range(len(b) + 1))
    for i, (x, s, e) in enumerate(a, 1):
        new = [i]
        for j, (y, t, f) in enumerate(b, 1):
            pair = row[j - 1] + (x != y) if s < f + collar and t < e + collar else 10**9
            new.append(min(row[j] + 1, new[-1] + 1, pair))
        row = new
    return row[-1]


def test_timed_distance_in_bands():
    rng = random.Random(7)
    for n in range(400):
        def side():
            times = [rng.randint(0, 40) for _ in range(rng.randint(0, 9))]
            return [(rng.choice("abc"), float(t), t + rng.choice([0.0, 1.0, 5.0])) for t in (sorted(times) if n % 3 else times)]

        a, b = side(), side()
        for collar in (0.0, 3.0, 100.0):
            assert me.timed_distance(a, b, collar) == full_timed_distance(a, b, collar)


def test_ten_minutes_of_words_far_apart_in_time_are_scored_in_bands():
    rng = random.Random(8)
    a = [(rng.choice("abcdefgh"), i * 400.0, i * 400.0 + 380) for i in range(6000)]
    b = [(t if rng.random() < 0.8 else "x", s + rng.uniform(-900, 900), e) for t, s, e in a if rng.random() < 0.9]
    errors = me.timed_distance(a, b, 5000.0)
    assert 600 < errors < 2500
    late = [(t, s + 10**7, e + 10**7) for t, s, e in b]
    assert me.timed_distance(a, late, 5000.0) == len(a) + len(b)


def dense_streams(utterances, streams):
    """All places in all streams, whole."""
    cost = sum(np.ix_(*[np.arange(len(s) + 1) for s in streams]))

    def relaxed(c, axis):
        step = np.arange(c.shape[axis]).reshape([-1 if k == axis else 1 for k in range(c.ndim)])
        return np.minimum.accumulate(c - step, axis=axis) + step

    for u in utterances:
        found = []
        for axis, stream in enumerate(streams):
            now = np.moveaxis(cost, axis, -1)
            for token in u:
                differs = np.array([t != token for t in stream], int)
                skipped = now + 1
                skipped[..., 1:] = np.minimum(skipped[..., 1:], now[..., :-1] + differs)
                now = relaxed(skipped, now.ndim - 1)
            found.append(np.moveaxis(now, -1, axis))
        cost = np.minimum.reduce(found)
    return int(cost.flat[-1])


def test_streams_of_a_session_with_contending_words():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    for n, streams in ((12, 2), (9, 3), (8, 1)):
        said = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 9))] for _ in range(n)]
        heard = [[] for _ in range(streams)]
        for u in said:
            to = rng.randrange(streams)
            for t in u:
                if (luck := rng.random()) > 0.1:
                    heard[to].append(t if luck > 0.25 else rng.choice(vocabulary))
                if rng.random() < 0.1:
                    heard[to].append(rng.choice(vocabulary))
        assert me.best_streams(said, heard) == dense_streams(said, heard)


def test_ten_minutes_in_three_contending_streams():
    """Fifteen hundred words: whole, the places of three streams would be 10^8 cells a token."""
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(400)]
    said = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 16))] for _ in range(150)]
    heard = [[], [], []]
    for u in said:
        to = rng.randrange(3)
        heard[to] += [t if rng.random() > 0.03 else rng.choice(vocabulary) for t in u if rng.random() > 0.03]
    errors = me.best_streams(said, heard)
    assert 20 < errors < 150
    own = [said[0::2], said[1::2]]
    merged_errors, merged = me.best_interleaving(own, [t for u in said for t in u if rng.random() > 0.05])
    assert 30 < merged_errors < 150 and len(merged) == sum(map(len, said))


@pytest.mark.parametrize("collar, skip", [(0, False), (4, True)])
def test_diarization_error_by_stretches(spark, collar, skip):
    rng = random.Random(11)
    schema = "rec string, speaker string, start long, end long"
    sides = []
    for names in ("AB", "xyz"):
        rows = [(f"r{rng.randint(0, 3)}", rng.choice(names), a, a + rng.randint(1, 40)) for a in (rng.randint(0, 300) for _ in range(80))]
        sides.append(spark.createDataFrame(rows, schema))
    totals = sides[0].groupBy("rec").agg(F.max("end").alias("total"))
    found = [sorted(tuple(r) for r in me.diarization_error(*sides, totals=totals, collar=collar, skip_overlap=skip, width=w).collect()) for w in (None, 90)]
    assert len(found[0]) == 4 and all(a[:1] == b[:1] and a[1:] == pytest.approx(b[1:]) for f in found[1:] for a, b in zip(found[0], f))


def test_words_late_by_days_pair_with_no_earlier_utterance(spark, tmp_path):
    """The third utterance is shorter than the collar and the fourth says the last word of the second one again."""
    import duckdb

    from colloquy.plans import all_queries, all_sql

    said = [("user", "one two three"), ("assistant", "four five the"), ("user", "six"), ("assistant", "seven the eight")]
    spark.createDataFrame([(2, turn, role, text) for turn, (role, text) in enumerate(said)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("met_03_time_constrained_errors", "met_14_layer_3", "met_15_layer_3_summary"):
        result = duck.execute(all_sql()[name])
        columns = [c[0] for c in result.description]
        assert sorted(map(tuple, all_queries()[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(result.fetchall())


def test_errors_of_long_texts_that_only_lose_or_gain():
    """Half a million characters against what is left of them: no column of all the others is worked out for each."""
    import time

    long = "abcdefghij" * 50_000
    short = long[3:].replace("f", "")
    began = time.process_time()
    assert me.edit_distance(long, short) == me.edit_distance(short, long) == len(long) - len(short)
    assert time.process_time() - began < 10
    assert me.edit_distance("abc", "") == 3 and me.edit_distance("", "abc") == 3 and me.edit_distance("abcd", "axd") == 2


def test_only_one_row_of_tokens_at_a_time_is_in_python():
    """Whole batches of token lists as Python objects outgrow the memory of a worker."""
    from pyspark.sql.types import LongType
    from pyspark.util import PythonEvalType

    assert all(f.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF and f.returnType == LongType() for f in (me.token_errors, me.timed_errors(5.0)))


def contending_session(turns, words):
    """Turns of two speakers, every seventh word replaced by an earlier one of the turn; two streams by turns, and one in which neighbours are turned."""
    rng = random.Random(15)
    said, heard = [], []
    for n in range(turns):
        tokens = [f"w{rng.randint(0, 300)}" for _ in range(words)]
        said.append(("AB"[n % 2], tokens))
        heard.append([tokens[i - 3] if (i + n) % 7 == 0 and i >= 3 else t for i, t in enumerate(tokens)])
    streams = [[t for h in heard[k::2] for t in h] for k in (0, 1)]
    one = [t for n in range(0, turns, 2) for h in (heard[n + 1], heard[n]) for t in h]
    return said, streams, one, sum(me.edit_distance(u, h) for (_, u), h in zip(said, heard))


def test_hours_of_contending_words_are_searched_near_the_answer():
    """The words have equals elsewhere, so only where each utterance as a whole may lie says what the rest costs."""
    import resource
    import time

    said, streams, one, most = contending_session(200, 60)
    own = [[u for s, u in said if s == k] for k in "AB"]
    began, memory = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = me.stream_errors(said, streams), me.merged_errors(said, one), me.best_interleaving(own, one)[0]
    assert found[1] == found[2] and most - 20 <= min(found) and max(found) <= most
    assert time.process_time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - memory < 500 << 10


def test_what_utterances_cost_at_least_is_never_more_than_they_cost():
    rng = random.Random(16)
    for _ in range(300):
        u, s = ([rng.randint(0, 4) for _ in range(rng.randint(0, n))] for n in (6, 12))
        least = min(plain_distance(u, s[i:j]) for i in range(len(s) + 1) for j in range(i, len(s) + 1))
        assert me._apart(np.array(u, np.int64), np.array(s, np.int64)) == least


def test_speakers_of_many_sessions_are_assigned_in_one_call(spark):
    rng = random.Random(17)
    rows = [(n, side, f"{side}{k}", [rng.choice("abc") for _ in range(rng.randint(0, 5))]) for n in range(60) for side in "rh" for k in range(rng.randint(1, 4))]
    table = spark.createDataFrame(rows, "rec long, side string, speaker string, tokens array<string>")
    found = me.assigned_errors(*(table.where(F.col("side") == side).drop("side") for side in "rh"), ["rec"])
    # before, each session was a pandas call of its own
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        sides = [[t for n, s, _, t in rows if n == r.rec and s == side] for side in "rh"]
        most = max(map(len, sides))
        ref, hyp = (side + [[]] * (most - len(side)) for side in sides)
        least = min(sum(plain_distance(ref[i], hyp[j]) for i, j in enumerate(p)) for p in itertools.permutations(range(most)))
        assert (r.errors, r.length) == (least, sum(map(len, ref)))
