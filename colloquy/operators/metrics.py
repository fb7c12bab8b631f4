"""Speech metrics: diarization error, and word and character errors under the best assignment of speakers.

The work between sessions, and within one between pairs of speakers, is Spark's: joins make the pairs, an Arrow function compares two token
lists, and only a session's small cost matrix meets in one group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import permutations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .intervals import STRETCH, meeting, merge, overlaps, per_stretch, subtract


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Substitutions, insertions and deletions between two token lists, by Myers' bit-parallel column steps (1999) on integers as long as ``a``.

    No pairing costs less than the difference in length, and one costs just that where the shorter list lies within the longer one in order.
    """
    n = len(a)
    short, long = sorted((a, b), key=len)
    rest = iter(long)
    if all(t in rest for t in short):
        return len(long) - len(short)
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    every, last, distance = (1 << n) - 1, 1 << n - 1, n
    rises, falls = every, 0  # where a column goes up or down by one
    for token in b:
        equal = places.get(token, 0)
        free = (((equal & rises) + rises) ^ rises) | equal
        right, left = falls | (~(free | rises) & every), rises & free
        distance += 1 if right & last else -1 if left & last else 0
        right, left = (right << 1 | 1) & every, left << 1 & every
        equal |= falls
        rises, falls = left | (~(equal | right) & every), right & equal
    return distance


@F.pandas_udf(LongType())
def text_errors(a: pd.Series, b: pd.Series) -> pd.Series:
    """Character errors between two texts."""
    return pd.Series([edit_distance(x or "", y or "") for x, y in zip(a, b)])


@F.arrow_udf(LongType())
def token_errors(a: pa.Array, b: pa.Array) -> pa.Array:
    """Errors between two token lists; only the lists of one row at a time are Python objects."""
    return pa.array([edit_distance(x.as_py() or [], y.as_py() or []) for x, y in zip(a, b)], pa.int64())


def assign(cost: np.ndarray) -> tuple[int, ...]:
    """For each row of a square matrix the column that makes the sum least: all orders up to 6, else by augmenting paths."""
    n = len(cost)
    if n <= 6:
        return min(permutations(range(n)), key=lambda p: (sum(cost[i, j] for i, j in enumerate(p)), p))
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, back = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = slack < least[free]
            least[free[better]], back[free[better]] = slack[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[back[j0]], back[j0]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return tuple(out.tolist())


def scored_time(reference: DataFrame, totals: DataFrame, keys: Sequence[str], speaker: str = "speaker", collar=0, skip_overlap: bool = False, width=None) -> DataFrame:
    """(keys, start, end) of the time that is scored: [0, total] less half a ``collar`` on either side of every reference boundary and, with
    ``skip_overlap``, less the time in which two or more reference speakers talk."""
    span = totals.select(*keys, F.lit(0).cast(totals.schema["total"].dataType).alias("start"), F.col("total").alias("end"))
    out = []
    if collar:
        edges = merge(reference, [*keys, speaker], touching=True, width=width).select(*keys, F.explode(F.array("start", "end")).alias("t"))
        out.append(edges.select(*keys, (F.col("t") - collar / 2).alias("start"), (F.col("t") + collar / 2).alias("end")))
    if skip_overlap:
        out.append(overlaps(reference, keys, speaker, width=width))
    for less in out:
        span = subtract(span, less, keys, width=width)
    return span


def within(turns: DataFrame, scored: DataFrame, keys: Sequence[str], width=None) -> DataFrame:
    """``turns`` cut to the ``scored`` time."""
    columns = [F.col("lo").alias(c) if c == "start" else F.col("hi").alias(c) if c == "end" else F.col(c) for c in turns.columns]
    return meeting(turns, scored.select(*keys, "start", "end"), keys, width).select(*columns)


def diarization_error(
    reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str] = ("rec",), speaker: str = "speaker", totals: DataFrame | None = None, collar=0, skip_overlap: bool = False, width=None
) -> DataFrame:
    """(keys, miss, false_alarm, confusion, total, der) per recording.

    A speaker's own turns are merged first.  Hypothesis speakers are mapped one to one onto reference speakers so that most time agrees; what
    both sides hold at once but not under that mapping is confusion.  ``total`` sums speech per reference speaker.  With ``totals`` (keys, total)
    only :func:`scored_time` counts, for the mapping as well; ``collar`` and ``skip_overlap`` need it.  With ``width`` a recording is cut at stretches
    of that width, each of which is swept for itself; all that is counted adds up.
    """
    if totals is not None:
        scored = scored_time(reference, totals, keys, speaker, collar, skip_overlap, width)
        reference, hypothesis = (within(t, scored, keys, width) for t in (reference, hypothesis))
    elif collar or skip_overlap:
        raise ValueError("a collar and the skipping of overlaps need the recordings' totals")
    keys = list(keys)
    ref, hyp = (per_stretch(side, [*keys, speaker], width) for side in (reference, hypothesis))
    places = [*keys, STRETCH]

    def steps(turns: DataFrame, side: str) -> DataFrame:
        ends = turns.select(*places, F.col("start").alias("t"), F.lit(1).alias("d")).union(turns.select(*places, F.col("end").alias("t"), F.lit(-1).alias("d")))
        return ends.select(*places, "t", *[(F.col("d") if s == side else F.lit(0)).alias(s) for s in ("r", "h")])

    points = steps(ref, "r").union(steps(hyp, "h")).groupBy(*places, "t").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    along = Window.partitionBy(*places).orderBy("t")
    level = points.select(*keys, F.sum("r").over(along).alias("r"), F.sum("h").over(along).alias("h"), (F.lead("t").over(along) - F.col("t")).alias("w"))
    sums = level.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("r") - F.col("h"), F.lit(0)) * F.col("w")).alias("miss"),
        F.sum(F.greatest(F.col("h") - F.col("r"), F.lit(0)) * F.col("w")).alias("false_alarm"),
        F.sum(F.least("r", "h") * F.col("w")).alias("both"),
        F.sum(F.col("r") * F.col("w")).alias("total"),
    )
    shared = meeting(ref, hyp.withColumnRenamed(speaker, "other"), places).groupBy(*keys, speaker, "other").agg(F.sum(F.col("hi") - F.col("lo")).alias("w"))

    def agreed(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index=speaker, columns="other", values="w").fillna(0).to_numpy(float)
        n = max(table.shape)
        cost = np.zeros((n, n))
        cost[: table.shape[0], : table.shape[1]] = -table
        best = -sum(cost[i, j] for i, j in enumerate(assign(cost)))
        return pd.DataFrame([[*rows[keys].iloc[0], best]], columns=[*keys, "agreed"])

    types = ", ".join(f"`{k}` {reference.schema[k].dataType.simpleString()}" for k in keys)
    mapped = shared.groupBy(*keys).applyInPandas(agreed, f"{types}, agreed double")
    out = sums.join(mapped, keys, "left").withColumn("confusion", F.col("both") - F.coalesce("agreed", F.lit(0.0)))
    rate = (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.greatest(F.col("total").cast("double"), F.lit(1e-9))
    return out.select(*keys, "miss", "false_alarm", "confusion", "total", rate.alias("der"))


def speaker_tokens(utterances: DataFrame, tokens: Column, keys: Sequence[str], speaker: str, order: str) -> DataFrame:
    """(keys, speaker, tokens): each speaker's tokens in ``order``."""
    parts = utterances.withColumn("tokens__", tokens).groupBy(*keys, speaker).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col("tokens__").alias("t")))).alias("parts"))
    return parts.select(*keys, speaker, F.flatten(F.transform("parts", lambda p: p["t"])).alias("tokens"))


@F.arrow_udf(ArrayType(StructType([StructField("speaker", StringType()), StructField("other", StringType()), StructField("errors", LongType()), StructField("length", LongType())])))
def _best_assignment(sessions: pa.Array) -> pa.Array:
    """Who is given to whom in each session, whose rows are those of :func:`assignment`; only one session at a time is Python objects."""

    def best(rows: list[dict]) -> list[dict]:
        refs = {x["r"]: x["n_r"] for x in rows if x["h"] is None and x["r"] is not None}
        hyps = {x["h"]: x["n_h"] for x in rows if x["r"] is None and x["h"] is not None}
        names = list(refs), list(hyps)
        n = max(map(len, names))
        cost = np.zeros((n, n))
        cost[: len(refs), :] = np.array(list(refs.values())).reshape(-1, 1)
        cost[len(refs) :, : len(hyps)] = list(hyps.values())
        at_r, at_h = ({k: i for i, k in enumerate(side)} for side in names)
        for x in rows:
            if x["r"] is not None and x["h"] is not None:
                cost[at_r[x["r"]], at_h[x["h"]]] = x["cost"]
        own, others, sizes = ([*side, *[fill] * (n - len(side))] for side, fill in ((names[0], None), (names[1], None), (list(refs.values()), 0)))
        return [{"speaker": own[i], "other": others[j], "errors": int(cost[i, j]), "length": sizes[i]} for i, j in enumerate(assign(cost))]

    of = pa.struct([("speaker", pa.string()), ("other", pa.string()), ("errors", pa.int64()), ("length", pa.int64())])
    return pa.array([best(x.as_py()) for x in sessions], pa.list_(of))


def assignment(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str], speaker: str = "speaker", errors_of=token_errors) -> DataFrame:
    """(keys, speaker, other, errors, length): which hypothesis speaker each reference speaker is given, one to one, for the fewest token errors.

    A reference speaker without a partner (other is null) is all deleted, a hypothesis speaker without one (speaker is null) all inserted.  The
    tables are (keys, speaker, tokens); ``errors_of`` compares two lists; see :func:`timed_errors`.
    """
    keys = list(keys)
    ref = reference.select(*keys, F.col(speaker).alias("r"), F.col("tokens").alias("a"))
    hyp = hypothesis.select(*keys, F.col(speaker).alias("h"), F.col("tokens").alias("b"))
    pairs = ref.join(hyp, keys).select(*keys, "r", "h", errors_of("a", "b").alias("cost"), F.size("a").alias("n_r"), F.size("b").alias("n_h"))
    alone = ref.select(*keys, "r", F.lit(None).cast("string").alias("h"), F.lit(0).cast("long").alias("cost"), F.size("a").alias("n_r"), F.lit(0).alias("n_h"))
    extra = hyp.select(*keys, F.lit(None).cast("string").alias("r"), "h", F.lit(0).cast("long").alias("cost"), F.lit(0).alias("n_r"), F.size("b").alias("n_h"))

    found = pairs.unionByName(alone).unionByName(extra).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("r", "h", "cost", "n_r", "n_h"))).alias("rows__"))
    return found.select(*keys, F.inline(_best_assignment("rows__")))


def assigned_errors(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str], speaker: str = "speaker", errors_of=token_errors) -> DataFrame:
    """(keys, errors, length): token errors under the best one-to-one assignment of speakers; see :func:`assignment`."""
    return assignment(reference, hypothesis, keys, speaker, errors_of).groupBy(*keys).agg(F.sum("errors").alias("errors"), F.sum("length").alias("length"))


def characters_between(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, errors, length): character errors between token lists a and b, joined by spaces, added up over the rows of a key."""
    a, b = (F.coalesce(F.array_join(c, " "), F.lit("")) for c in ("a", "b"))
    scored = texts.select(*keys, text_errors(a, b).alias("errors"), F.length(a).alias("length"))
    return scored.groupBy(*keys).agg(F.sum("errors").alias("errors"), F.sum("length").cast("long").alias("length"))


def assigned_characters(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str], speaker: str = "speaker") -> DataFrame:
    """(keys, errors, length): character errors under the assignment of speakers that has the fewest word errors."""
    keys = list(keys)
    pairs = assignment(reference, hypothesis, keys, speaker).select(*keys, "speaker", "other")
    ref = reference.select(*keys, F.col(speaker).alias("speaker"), F.col("tokens").alias("a"))
    hyp = hypothesis.select(*keys, F.col(speaker).alias("other"), F.col("tokens").alias("b"))
    return characters_between(pairs.join(ref, [*keys, "speaker"], "left").join(hyp, [*keys, "other"], "left"), keys)


def single_stream_errors(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, errors, length): one list of tokens each side, (keys, tokens); an absent hypothesis is empty."""
    joined = reference.select(*keys, F.col("tokens").alias("a")).join(hypothesis.select(*keys, F.col("tokens").alias("b")), list(keys), "left")
    return joined.select(*keys, token_errors("a", "b").alias("errors"), F.size("a").cast("long").alias("length"))


def timed_distance(a: list[tuple], b: list[tuple], collar: float) -> int:
    """Edit distance of (token, start, end) lists in which tokens pair up only where they are less than ``collar`` apart in time.

    All tokens cost one each, but a pair saves one, of equals two.  What can be saved grows only where a token may pair, so each token of ``a`` visits
    the band of tokens of ``b`` that lie within the collar (or between such); before a band nothing changes any more, after it nothing has yet.
    """
    if not a or not b:
        return len(a) + len(b)
    codes: dict = {}
    known = [np.array([codes.setdefault(t[0], len(codes)) for t in side]) for side in (a, b)]
    (from_a, to_a), (from_b, to_b) = ([np.array([t[k] for t in side], float) for k in (1, 2)] for side in (a, b))
    # bands hold all tokens that may pair, whatever the order of times, and neither end of them ever goes back
    low = np.searchsorted(np.maximum.accumulate(to_b), from_a - collar, "right")
    high = np.searchsorted(np.minimum.accumulate(from_b[::-1])[::-1], to_a + collar, "left")
    low, high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
    saved, reached = np.zeros(len(b) + 1, np.int64), 0
    for i, (x, y) in enumerate(zip(low.tolist(), high.tolist())):
        if x >= y:
            continue
        if y > reached:
            saved[reached + 1 : y + 1] = saved[reached]
            reached = y
        may = (from_a[i] < to_b[x:y] + collar) & (from_b[x:y] < to_a[i] + collar)
        pair = saved[x:y] + np.where(may, 1 + (known[1][x:y] == known[0][i]), 0)
        np.maximum.accumulate(np.maximum(saved[x + 1 : y + 1], pair), out=saved[x + 1 : y + 1])
    return len(a) + len(b) - int(saved[reached])


def spread_in_time(tokens: Column, start: Column, end: Column) -> Column:
    """(token, start, end) of each token, the utterance's time shared out evenly."""
    share = (end - start) / F.size(tokens)
    return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (start + i * share).cast("double").alias("start"), (start + (i + 1) * share).cast("double").alias("end")))


def timed_errors(collar: float):
    """Like :data:`token_errors` for arrays from :func:`spread_in_time`."""

    @F.arrow_udf(LongType())
    def errors(a: pa.Array, b: pa.Array) -> pa.Array:
        def rows(x):
            return [(t["token"], t["start"], t["end"]) for t in x.as_py() or []]

        return pa.array([timed_distance(rows(x), rows(y), collar) for x, y in zip(a, b)], pa.int64())

    return errors


def _least_errors(a: Sequence, b: Sequence) -> int:
    """What any pairing of ``a`` with ``b`` costs at least, in whatever order: tokens without an equal on the other side."""
    return max(len(a), len(b)) - (Counter(a) & Counter(b)).total()


#: Kinds of tokens that are counted; where there are more tokens than kinds some share one, which only lowers an estimate.
KINDS = 256


def _apart(utterance: np.ndarray, stream: np.ndarray) -> int:
    """What ``utterance`` costs at least against any stretch of ``stream``, the rest of which is free: the steps of :func:`edit_distance`, where a
    column (the stream) may be begun and left anywhere."""
    every = (1 << len(stream)) - 1
    rises = falls = 0
    for token in utterance:
        equal = int.from_bytes(np.packbits(stream == token, bitorder="little").tobytes(), "little")
        free = (((equal & rises) + rises) ^ rises) | equal
        right, left = falls | (~(free | rises) & every), rises & free
        right, left = (right << 1 | 1) & every, left << 1 & every
        equal |= falls
        rises, falls = left | (~(equal | right) & every), right & equal
    up, down = (np.unpackbits(np.frombuffer(x.to_bytes(len(stream) // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int64) for x in (rises, falls))
    return len(utterance) + int(np.cumsum(up - down).min(initial=0))


def _ahead(utterances: list[np.ndarray], stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each utterance on, and after the last: what they cost at least wherever each of them lies, their tokens, and how many of each kind."""
    rows = [(_apart(u, stream), len(u), np.bincount(u % KINDS, minlength=KINDS)) for u in reversed(utterances)]
    return tuple(np.cumsum(np.array([nothing, *found]), axis=0)[::-1] for nothing, found in zip((0, 0, np.zeros(KINDS, int)), zip(*rows) if rows else ((),) * 3))


def _kinds_ahead(stream: np.ndarray) -> np.ndarray:
    """How many tokens of each kind come from each place of a stream on; those below 0 are of none."""
    out = np.zeros((len(stream) + 1, KINDS), np.int32)
    known = np.flatnonzero(stream >= 0)
    out[known, stream[known] % KINDS] = 1
    return np.cumsum(out[::-1], axis=0, dtype=np.int32)[::-1]


def _deepened(least: int, search) -> int:
    """The answer of ``search(most)``, which finds the least errors if they are at most ``most`` (else something larger): the bound grows from ``least``
    by steps that double, so the last search does most of the work."""
    slack = 1
    while (found := search(least + slack)) > least + slack:
        slack *= 2
    return found


_FAR = 1 << 40


def _advanced(rows: np.ndarray, token: int, stream: np.ndarray) -> np.ndarray:
    """Costs at each place of a stream, a line a state, after one more reference token; ``stream`` holds the tokens between the places."""
    new = rows + 1
    np.minimum(new[:, 1:], rows[:, :-1] + (stream != token), out=new[:, 1:])
    step = np.arange(new.shape[1])
    return np.minimum.accumulate(new - step, axis=1) + step


def best_streams(utterances: list[Sequence], streams: list[Sequence]) -> int:
    """Least errors when each reference utterance goes, in order, to the stream that suits it best.

    A state is a place in every stream after some utterances.  Only states are kept whose errors, and what the utterances still to come cost at least,
    each by itself wherever it may lie and by the tokens of all without an equal, stay within a bound; it grows until it holds the answer.  So the work
    follows from how far the answer is from that estimate and not from the product of the lengths of the streams.
    """
    codes: dict = {}
    spoken = [np.array([codes.setdefault(t, len(codes)) for t in u], np.int64) for u in utterances]
    coded = [np.array([codes.get(t, -1) for t in s], np.int64) for s in streams]
    within = [_kinds_ahead(s) for s in coded]
    ends = np.array([len(s) for s in streams])
    apart, length, kinds = _ahead(spoken, np.concatenate(coded))

    def estimate(done: int, places: np.ndarray) -> np.ndarray:
        """What the rest costs at least."""
        out = np.empty(len(places), np.int64)
        for at in range(0, len(places), 4096):
            here = places[at : at + 4096]
            rest = sum(w[here[:, k]] for k, w in enumerate(within))
            out[at : at + 4096] = np.maximum(length[done], (ends - here).sum(1)) - np.minimum(rest, kinds[done]).sum(1)
        return np.maximum(out, apart[done])

    def search(most: int) -> int:
        places, cost = np.zeros((1, len(streams)), np.int64), np.zeros(1, np.int64)
        for done, tokens in enumerate(spoken, 1):
            found = []
            for k in range(len(streams)):
                # states that differ in this stream's place only share a line of costs
                others = np.delete(places, k, axis=1)
                lines, line = np.unique(others, axis=0, return_inverse=True) if others.shape[1] else (others[:1], np.zeros(len(others), int))
                line, start = line.ravel(), int(places[:, k].min())
                stop = min(int(places[:, k].max()) + len(tokens) + most - int(cost.min() + apart[done]), len(streams[k]))
                rows = np.full((len(lines), stop - start + 1), _FAR)
                np.minimum.at(rows, (line, places[:, k] - start), cost)
                step = np.arange(rows.shape[1])
                rows = np.minimum.accumulate(rows - step, axis=1) + step
                for token in tokens:
                    rows = _advanced(rows, token, coded[k][start:stop])
                    if rows.min() + apart[done] > most:
                        break
                left = length[done] - (ends.sum() - lines.sum(1)[:, None] - start - step)
                at, place = np.nonzero(rows + np.maximum(np.abs(left), apart[done]) <= most)
                found.append((np.insert(lines[at], k, place + start, axis=1), rows[at, place]))
            places, cost = (np.concatenate(x) for x in zip(*found))
            if not len(places):
                return _FAR
            places, state = np.unique(places, axis=0, return_inverse=True)
            least = np.full(len(places), _FAR)
            np.minimum.at(least, state.ravel(), cost)
            kept = least + estimate(done, places) <= most
            places, cost = places[kept], least[kept]
            if not len(places):
                return _FAR
        return int((cost + (ends - places).sum(1)).min())

    return _deepened(int(estimate(0, np.zeros((1, len(streams)), np.int64))[0]), search)


def stream_errors(utterances: list[tuple], streams: list[Sequence]) -> int:
    """:func:`best_streams` of (speaker, tokens) utterances.

    Where giving each speaker a stream already costs no more than what any choice costs at least, that is the answer.
    """
    speakers = sorted({s for s, _ in utterances}, key=str)
    least = _least_errors([t for _, u in utterances for t in u], [t for s in streams for t in s])
    if len(streams) ** len(speakers) <= 64:
        for chosen in product(range(len(streams)), repeat=len(speakers)):
            of = dict(zip(speakers, chosen))
            parts = [([t for s, u in utterances if of[s] == k for t in u], stream) for k, stream in enumerate(streams)]
            # the distance is worked out only where its own lower bound leaves room
            if sum(_least_errors(a, b) for a, b in parts) == least and sum(edit_distance(a, b) for a, b in parts) == least:
                return least
    return best_streams([u for _, u in utterances], streams)


def best_interleaving(speakers: list[list[Sequence]], stream: Sequence) -> tuple[int, list]:
    """Least errors of any merge of the speakers' utterances that keeps each speaker's own order, against one stream, and that merge.

    As in :func:`best_streams` a state, here how many utterances of each speaker are done and a place in the stream, is kept only while its errors
    and the least cost of the rest stay within a growing bound; only such places have their way back in memory.
    """
    codes: dict = {}
    spoken = [[np.array([codes.setdefault(t, len(codes)) for t in u], np.int64) for u in own] for own in speakers]
    coded = np.array([codes.get(t, -1) for t in stream], np.int64)
    rest_of_stream, places = _kinds_ahead(coded), np.arange(len(stream) + 1)
    ahead = [_ahead(own, coded) for own in spoken]

    def to_come(at: tuple[int, ...]) -> list:
        """What the utterances after ``at`` cost at least by themselves, their tokens, and how many of each kind."""
        return [sum(own[k][i] for own, i in zip(ahead, at)) for k in range(3)]

    best: list = []
    first = (0,) * len(speakers)

    def search(most: int) -> int:
        best.clear()
        # a node: the first place that is kept and costs from there on; for its way back the speaker and the place before of each place
        level = {first: (0, places[: most - int(to_come(first)[0]) + 1])}
        froms: dict[tuple[int, ...], tuple[int, np.ndarray]] = {}
        for _ in range(sum(map(len, speakers))):
            found: dict[tuple[int, ...], list] = {}
            for at, (start, row) in level.items():
                for s, own in enumerate(spoken):
                    if at[s] == len(own):
                        continue
                    then = (*at[:s], at[s] + 1, *at[s + 1 :])
                    apart, length, kinds = to_come(then)
                    stop = min(start + len(row) - 1 + len(own[at[s]]) + most - int(row.min() + apart), len(stream))
                    now = np.concatenate([row, row[-1] + np.arange(1, stop - start - len(row) + 2)])
                    origin = np.minimum(np.arange(len(now)), len(row) - 1)
                    for token in own[at[s]]:
                        now, origin = _advance(now, origin, (coded[start:stop] != token).astype(int))
                        if now.min() + apart > most:
                            break
                    spare = np.maximum(length, len(stream) - places[start : stop + 1]) - np.minimum(rest_of_stream[start : stop + 1], kinds).sum(1)
                    kept = np.flatnonzero(now + np.maximum(spare, apart) <= most)
                    if len(kept):
                        span = slice(kept[0], kept[-1] + 1)
                        found.setdefault(then, []).append((start + int(kept[0]), now[span], s, origin[span] + start))
            level = {}
            for key, ways in found.items():
                start, stop = min(w[0] for w in ways), max(w[0] + len(w[1]) for w in ways)
                row, back = np.full(stop - start, _FAR), np.zeros((2, stop - start), np.int64)
                for begin, now, s, origin in ways:
                    span = slice(begin - start, begin - start + len(now))
                    better = now < row[span]
                    row[span] = np.where(better, now, row[span])
                    back[:, span] = np.where(better, np.stack([np.full(len(now), s), origin]), back[:, span])
                level[key], froms[key] = (start, row), (start, back)
        last = tuple(map(len, speakers))
        if last not in level or level[last][0] + len(level[last][1]) <= len(stream):
            return _FAR
        at, place, order = last, len(stream), []
        while any(at):
            start, back = froms[at]
            s, place = back[:, place - start].tolist()
            at = (*at[:s], at[s] - 1, *at[s + 1 :])
            order.append((s, at[s]))
        best.extend(t for s, i in reversed(order) for t in speakers[s][i])
        return int(level[last][1][len(stream) - level[last][0]])

    apart, length, kinds = to_come(first)
    errors = _deepened(max(int(apart), max(int(length), len(stream)) - int(np.minimum(rest_of_stream[0], kinds).sum())), search)
    return errors, list(best)


def _advance(row: np.ndarray, origin: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more reference token: the new costs, and for each place the stream place at which the utterance began on the best way there."""
    skip, take = row + 1, np.concatenate([[_FAR], row[:-1] + differs])
    new = np.minimum(skip, take)
    came = np.where(take <= skip, np.concatenate([[0], origin[:-1]]), origin)
    # insertions: the least cost so far, and in the low digits where it was; of equals the last
    place, base = np.arange(len(new)), len(new)
    low = np.minimum.accumulate((new - place) * base - place)
    at = -low % base
    return (low + at) // base + place, came[at]


def merged_errors(utterances: list[tuple], stream: Sequence) -> int:
    """The errors of :func:`best_interleaving` of (speaker, tokens) utterances in time order.

    Where that order already costs no more than what any merge costs at least, that is the answer.
    """
    whole = [t for _, u in utterances for t in u]
    least = _least_errors(whole, stream)
    if edit_distance(whole, stream) == least:
        return least
    return best_interleaving([[u for s, u in utterances if s == name] for name in sorted({s for s, _ in utterances}, key=str)], stream)[0]


def interleaved_errors(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str], multi_stream: bool = False, characters_too: bool = False) -> DataFrame:
    """(keys, errors, length): (keys, speaker, order, tokens) utterances against (keys, stream, tokens).

    One stream: the best merge of the speakers that keeps each one's order.  With ``multi_stream`` utterances stay in time order and each goes to
    its best stream; with ``characters_too`` the errors and length are those of characters under the best merge of words.  Each session is one
    group, whose work grows with how far its errors are from what its words cost at least.
    """
    keys = list(keys)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("order", kind="stable")
        key = (left if len(left) else right)[keys].iloc[0]
        streams = [list(t) for t in right.sort_values("stream")["tokens"]] or [[]]
        if multi_stream:
            errors = stream_errors([(s, list(t)) for s, t in zip(left["speaker"], left["tokens"])], streams)
        elif not characters_too:
            errors = merged_errors([(s, list(t)) for s, t in zip(left["speaker"], left["tokens"])], streams[0])
        else:
            merged = [t for ts in left["tokens"] for t in ts]
            if edit_distance(merged, streams[0]) > _least_errors(merged, streams[0]):
                _, merged = best_interleaving([[list(t) for t in g["tokens"]] for _, g in left.groupby("speaker", sort=True)], streams[0])
            a, b = " ".join(merged), " ".join(streams[0])
            return pd.DataFrame([[*key, edit_distance(a, b), len(a)]], columns=[*keys, "errors", "length"])
        return pd.DataFrame([[*key, errors, sum(map(len, left["tokens"]))]], columns=[*keys, "errors", "length"])

    types = ", ".join(f"`{k}` {reference.schema[k].dataType.simpleString()}" for k in keys)
    return reference.groupBy(*keys).cogroup(hypothesis.groupBy(*keys)).applyInPandas(score, f"{types}, errors long, length long")


def characters(text: Column) -> Column:
    """The characters of ``text`` as tokens."""
    return F.filter(F.split(text, ""), lambda c: c != "")
