"""Candidate fragments of recordings and their selection by cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import quota_select
from .intervals import STRETCH, gaps, merge, overlaps, suppress
from .scan import settled

#: What a row of a stretch is: the recording's total (as its end), the middle of a silence, or a span.
_TOTAL, _MIDDLE, _OVERLAP, _SPEECH, _TURN = range(5)


@dataclass(frozen=True)
class FragmentRule:
    """What makes a fragment, times in milliseconds.  Fixed values: the defaults."""

    target: int = 90_000
    shortest: int = 30_000
    longest: int = 150_000
    stride: int = 5_000
    silence: int = 500
    radius: int = 5_000
    overlap: int = 3_000
    balance: float = 0.15
    density: float = 0.40
    iou: float = 0.30
    #: What one task scans of a recording.
    stretch: int = 600_000


def _windows(total: float, stretch: int, middles: np.ndarray, rule: FragmentRule) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the windows that begin in a stretch before they are moved, both ends moved outward to ``middles`` (sorted) within the radius and
    cut to the recording, of a length that the rule allows; equal ones once, in the stretch of the first.  Neither starts nor ends ever fall."""
    first, last = np.floor(stretch * rule.stretch / rule.stride), np.ceil((stretch + 1) * rule.stretch / rule.stride)
    at = np.arange(max(first - 1, 0), min(last, np.floor((total - rule.target) / rule.stride)) + 1) * rule.stride
    own = np.flatnonzero(np.floor(at / rule.stretch) == stretch)
    if not len(own):
        return at[:0], at[:0]
    at = at[max(own[0] - 1, 0) : own[-1] + 1]
    middles = np.concatenate([[-np.inf], middles, [np.inf]])
    start, end = at, at + rule.target
    before, after = middles[np.searchsorted(middles, start, "right") - 1], middles[np.searchsorted(middles, end, "left")]
    start = np.maximum(np.where(start - before <= rule.radius, before, start), 0.0)
    end = np.minimum(np.where(after - end <= rule.radius, after, end), total)
    # as neither falls, equal windows follow each other: looking back at one window before the stretch is enough
    kept = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)]) & (end - start >= rule.shortest) & (end - start <= rule.longest)
    kept[: min(own[0], 1)] = False
    return start[kept], end[kept]


def _covered(starts: np.ndarray, ends: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much of each window spans cover, those that overlap twice, and how many meet it."""
    starts, ends = np.sort(starts), np.sort(ends)
    begun, over = (np.concatenate([[0.0], np.cumsum(x)]) for x in (starts, ends))

    def until(t: np.ndarray) -> np.ndarray:
        i, j = np.searchsorted(starts, t), np.searchsorted(ends, t)
        return (i - j) * t - (begun[i] - over[j])

    return until(end) - until(start), np.searchsorted(starts, end) - np.searchsorted(ends, start, "right")


def _longest(starts: np.ndarray, ends: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The longest part of each window that one of the spans, which lie apart, covers; 0 where none does."""
    order, n = np.argsort(starts), len(starts)
    # one more at the end stands for none
    lengths = np.append((ends - starts)[order], 0.0)
    starts, ends = np.append(starts[order], np.inf), np.append(ends[order], np.inf)
    first, after = np.searchsorted(ends[:n], start, "right"), np.searchsorted(starts[:n], end)
    last = np.maximum(after - 1, 0)
    # those between the first and the last are whole
    lo = np.minimum(first + 1, n)
    hi = np.maximum(last, lo)
    whole = np.where(lo < hi, np.maximum.reduceat(lengths, np.stack([lo, hi], axis=1).ravel())[::2], 0.0) if len(start) else start
    cut = [np.minimum(ends[i], end) - np.maximum(starts[i], start) for i in (first, last)]
    return np.where(after > first, np.maximum(whole, np.maximum(*cut)), 0.0)


def _suppressed(start: np.ndarray, end: np.ndarray, score: np.ndarray, unsettled: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are certainly suppressed, and which are certainly kept, by :func:`intervals.suppress`.

    ``unsettled`` ones may meet windows that are not given; what depends on them is neither.  Neither starts nor ends fall.
    """
    gone, waits = np.zeros(len(start), bool), unsettled.copy()
    first, after = np.searchsorted(end, start, "right"), np.searchsorted(start, end)
    order = np.lexsort((end, start, -score))
    place = np.argsort(order)
    for i in order:
        if gone[i]:
            continue
        near = slice(first[i], after[i])
        shared = np.minimum(end[near], end[i]) - np.maximum(start[near], start[i])
        hull = np.maximum(end[near], end[i]) - np.minimum(start[near], start[i])
        behind = (shared > most * hull) & (place[near] > place[i])
        if waits[i]:
            waits[near] |= behind
        else:
            gone[near] |= behind
    return gone, ~gone & ~waits


def _of_stretch(keys: Sequence[str], rule: FragmentRule, most: float | None) -> Callable[[tuple, pa.Table], pa.Table]:
    """The function that finds the windows of one stretch of a recording among the rows that reach it."""

    def found(key: tuple, rows: pa.Table) -> pa.Table:
        kind, lo, hi = (rows[c].to_numpy() for c in ("kind__", "start", "end"))
        who = rows["who__"].combine_chunks().dictionary_encode()
        ended, stretch = hi[kind == _TOTAL], key[-1].as_py()
        start, end = _windows(ended[0], stretch, np.sort(lo[kind == _MIDDLE]), rule) if len(ended) else (lo[:0], lo[:0])
        spans = {k: (lo[kind == k], hi[kind == k]) for k in (_OVERLAP, _SPEECH)}
        (overlap, events), (speech, _) = (_covered(*spans[k], start, end) for k in (_OVERLAP, _SPEECH))
        # what the speakers say, in their order
        code = who.indices.to_numpy(zero_copy_only=False)
        spoken, names = [], pc.array_sort_indices(who.dictionary).to_numpy()
        for name in names:
            said = (kind == _TURN) & (code == name)
            time, n = _covered(lo[said], hi[said], start, end)
            spoken.append(np.where(n > 0, time, np.nan))
        spoken = np.array(spoken).reshape(len(names), len(start))
        there = ~np.isnan(spoken)
        together = np.zeros(len(start))
        for time in spoken:
            together = together + np.where(np.isnan(time), 0.0, time)
        least = np.where(there, spoken, np.inf).min(axis=0, initial=np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            balance, density = least / together, speech / (end - start)
        kept = np.flatnonzero(there.any(axis=0) & (overlap >= rule.overlap) & (balance >= rule.balance) & (density >= rule.density))
        sure = np.zeros(len(kept), bool)
        if most is not None:
            # windows of the stretches before and after may reach as far as this
            reach = rule.target + rule.radius if stretch else -np.inf
            beside = (start[kept] < stretch * rule.stretch + reach) | (end[kept] > (stretch + 1) * rule.stretch - rule.radius)
            gone, sure = _suppressed(start[kept], end[kept], overlap[kept], beside, most)
            kept, sure = kept[~gone], sure[~gone]
        there, spoken = there[:, kept].T, spoken[:, kept].T
        offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        speakers = who.dictionary.take(pa.array(np.tile(names, len(kept))[there.ravel()]))
        columns = {k: rows[k].take(pa.array(np.zeros(len(kept), int))) for k in keys}
        columns |= {"start": start[kept], "end": end[kept], "overlap": overlap[kept], "events": events[kept]}
        columns |= {"longest": _longest(*spans[_OVERLAP], start[kept], end[kept]), "speech": speech[kept]}
        columns |= {"by_speaker": pa.MapArray.from_arrays(pa.array(offsets), speakers, pa.array(spoken[there]))}
        return pa.table(columns | {"balance": balance[kept], "density": density[kept], "sure__": sure})

    return found


def _found(turns: DataFrame, totals: DataFrame, keys: Sequence[str], speaker: str, rule: FragmentRule, most: float | None) -> DataFrame:
    """:func:`fragment_windows`; with ``most`` without those that others of their stretch certainly suppress, and with ``sure__`` for those that stay.

    A window is made, moved and measured where its stretch of the recording is, from the rows that may reach it: what is shuffled are turns, silences
    and spans, and of the windows only those that the rule keeps are ever rows.
    """
    keys = list(keys)
    # both are read several times
    both, speech = settled(overlaps(turns, keys, speaker, width=rule.stretch)), settled(merge(turns, keys, touching=True, width=rule.stretch))
    middle = ((F.col("start") + F.col("end")) / 2).alias("start")
    silent = gaps(speech, totals, keys, rule.silence, rule.stretch).select(*keys, middle, middle.alias("end"))
    nobody = F.lit(None).cast(turns.schema[speaker].dataType)

    def of(kind: int, spans: DataFrame, who: Column = nobody) -> DataFrame:
        return spans.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("start", "end")], who.alias("who__"), F.lit(kind).alias("kind__"))

    parts = of(_MIDDLE, silent)
    for kind, spans, who in ((_OVERLAP, both, nobody), (_SPEECH, speech, nobody), (_TURN, turns, F.col(speaker))):
        parts = parts.unionByName(of(kind, spans.where("end > start"), who))
    # a stretch of room at either side for windows that are moved, and for the one before the first
    reach = rule.radius + rule.stride
    first = F.greatest(F.floor((F.col("start") - rule.target - reach) / rule.stretch), F.lit(0))
    parts = parts.withColumn(STRETCH, F.explode(F.sequence(first, F.greatest(F.floor((F.col("end") + reach) / rule.stretch), first))))
    ended = totals.where(F.col("total") >= rule.target).join(both.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit(0).alias("start"), F.col("total").alias("end"))
    final = F.floor(F.floor((F.col("end") - rule.target) / rule.stride) * rule.stride / rule.stretch)
    parts = parts.unionByName(of(_TOTAL, ended).withColumn(STRETCH, F.explode(F.sequence(F.lit(0).cast("long"), final))))
    types = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys)
    times = "overlap double, events long, longest double, speech double"
    speakers = f"by_speaker map<{parts.schema['who__'].dataType.simpleString()}, double>"
    schema = f"{types}, start double, end double, {times}, {speakers}, balance double, density double, sure__ boolean"
    # the rows of a stretch are few, but not its windows: partitions are not put together by size
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, *keys, STRETCH).groupBy(*keys, STRETCH).applyInArrow(_of_stretch(keys, rule, most), schema)


def fragment_windows(turns: DataFrame, totals: DataFrame, keys: Sequence[str], speaker: str = "speaker", rule: FragmentRule = FragmentRule()) -> DataFrame:
    """Windows every stride, both ends moved outward to the middles of silences, cut to the recording, equal ones once, with what
    :func:`intervals.measure` says of them, the speakers' balance and the speech density, that reach what the rule asks for.

    Recordings without an overlap have none.  Turns of no speaker count as speech and overlap only.
    """
    return _found(turns, totals, keys, speaker, rule, None).drop("sure__")


def find_fragments(turns: DataFrame, totals: DataFrame, keys: Sequence[str], speaker: str = "speaker", rule: FragmentRule = FragmentRule()) -> DataFrame:
    """Fragments of each recording: :func:`fragment_windows`, of which the ones with most overlap suppress those that share too much with them.

    What windows of other stretches can have no part in is settled within a stretch; the rest, near the ends of stretches, in rounds.
    """
    found = settled(_found(turns, totals, keys, speaker, rule, rule.iou))
    sure, rest = (found.where(F.col("sure__") == s).drop("sure__") for s in (True, False))
    return sure.unionByName(suppress(rest, list(keys), "overlap", rule.iou, rule.target))


def overlap_bin(overlap: Column, light: float, heavy: float) -> Column:
    return F.when(overlap < light, "light").when(overlap < heavy, "moderate").otherwise("heavy")


def candidates(fragments: DataFrame, noise: DataFrame, edges: tuple[float, float], substantive: float, key: str = "rec") -> DataFrame:
    """Fragments with their recording's noise (``unknown`` where none is known), overlap bin, score and whether one overlap is long enough."""
    known = fragments.join(noise.dropDuplicates([key]), key, "left").withColumn("noise", F.coalesce("noise", F.lit("unknown")))
    out = known.withColumn("overlap_bin", overlap_bin(F.col("overlap"), *edges)).withColumn("score", F.col("overlap") * F.col("balance"))
    return out.withColumn("duration", F.col("end") - F.col("start")).withColumn("is_substantive", F.col("longest") >= substantive)


def select_fragments(found: DataFrame, targets: Sequence[tuple[str, str, int, int]], quota_by_noise: dict[str, int], key: str = "rec") -> DataFrame:
    """Two passes per (overlap bin, noise) cell in declared order: the substantive target, then the backchannel target.

    A recording gives at most its noise's quota (1 where none is named) over all cells and passes together.  ``pool`` names the pass, ``frag_id``
    numbers a recording's fragments in the order of bin, noise and start.
    """
    pool = F.when(F.col("is_substantive"), "substantive").otherwise("backchannel")
    celled = found.withColumn("pool", pool).withColumn("cell", F.concat_ws("/", "overlap_bin", "noise", "pool"))
    celled = celled.withColumn("key", F.struct(F.col(key), F.col("start")))
    cells, quota = [], {}
    for bin_, noise, *wanted in targets:
        for name, n in zip(("substantive", "backchannel"), wanted):
            cells.append((f"{bin_}/{noise}/{name}", n))
            quota[cells[-1][0]] = quota_by_noise.get(noise, 1)
    chosen = quota_select(celled, cells, quota, group=key)
    number = F.row_number().over(Window.partitionBy(key).orderBy("overlap_bin", "noise", "start")) - 1
    return chosen.withColumn("frag_id", F.format_string("%s__seg%02d", F.col(key).cast("string"), number)).drop("cell", "key")
