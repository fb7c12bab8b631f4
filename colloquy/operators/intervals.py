"""Interval algebra over (keys..., start, end) rows: merging, subtracting, sweeping, clipping, padding and windowing.

Intervals are half-open with end > start.  Every operator keys its windows and joins by ``keys`` (a recording, or a recording and a speaker);
those with a ``width`` cut keys into stretches of that width, so that one very long recording spreads over all executors as well.  Times may be integers (milliseconds) or doubles (seconds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import settled

#: A pair of intervals meets in this bucket of time only, so a bucketed join needs no distinct.
_BUCKET = "bucket__"


#: For a side of a join that grows with windows: whatever a shuffle says of its compressed size, no driver builds a table of it to broadcast.
_SPREAD = "merge"

#: The number of the stretch of a key that a piece lies in.
STRETCH = "stretch__"


def _clipped(spans: DataFrame, width) -> DataFrame:
    """``spans`` cut at the ends of stretches of ``width``, with the number of the stretch and whether a piece goes on from the stretch before
    (``resumed__``); without a width all are in stretch 0."""
    if width is None:
        return spans.withColumn(STRETCH, F.lit(0).cast("long")).withColumn("resumed__", F.lit(False))
    first = F.floor(F.col("start") / width)
    cut = spans.withColumn(STRETCH, F.explode(F.sequence(first, F.greatest(F.ceil(F.col("end") / width) - 1, first))))
    lo, hi = F.col(STRETCH) * width, (F.col(STRETCH) + 1) * width
    types = {c: spans.schema[c].dataType for c in ("start", "end")}
    return cut.withColumn("resumed__", F.col("start") < lo).withColumns({"start": F.greatest("start", lo).cast(types["start"]), "end": F.least("end", hi).cast(types["end"])})


def _islands(pieces: DataFrame, keys: Sequence[str], touching: bool, gap=None) -> DataFrame:
    """(keys, stretch__, start, end, resumed__) of the pieces of each stretch, merged."""
    order = Window.partitionBy(*keys, STRETCH).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = pieces.withColumn("opens__", F.when(reached.isNull() | _apart(F.col("start"), reached, touching, gap), 1).otherwise(0))
    rows = rows.withColumn("n__", F.sum("opens__").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, STRETCH, "n__").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("resumed__").alias("resumed__"))


def _apart(start: Column, reached: Column, touching: bool, gap) -> Column:
    return start - reached >= gap if gap is not None else start > reached if touching else start >= reached


def _joined(islands: DataFrame, keys: Sequence[str], touching: bool, gap=None) -> DataFrame:
    """(keys, start, end): the islands of stretches, joined where they go on in the next one.

    Only the first and the last island of a stretch can; these alone are looked at along a whole key, two a stretch at most.
    """
    within = Window.partitionBy(*keys, STRETCH)
    marked = islands.withColumn("edge__", (F.col("n__") == F.min("n__").over(within)) | (F.col("n__") == F.max("n__").over(within)))
    order = Window.partitionBy(*keys).orderBy(STRETCH, "n__")
    before, stretch = F.lag("end").over(order), F.lag(STRETCH).over(order)
    opens = before.isNull() | (stretch == F.col(STRETCH)) | (_apart(F.col("start"), before, touching, gap) & ~F.col("resumed__"))
    edges = marked.where("edge__").withColumn("opens__", opens.cast("int"))
    edges = edges.withColumn("island__", F.sum("opens__").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.groupBy(*keys, "island__").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return marked.where("not edge__").select(*keys, "start", "end").unionByName(edges.select(*keys, "start", "end"))


def per_stretch(turns: DataFrame, keys: Sequence[str], width) -> DataFrame:
    """(keys, STRETCH, start, end): ``turns`` cut at stretches of ``width`` and merged, touching ones too, within each; for what adds up over stretches."""
    return _islands(_clipped(turns.select(*keys, "start", "end"), width), keys, True).select(*keys, STRETCH, "start", "end")


def merge(turns: DataFrame, keys: Sequence[str], touching: bool = False, gap=None, width=None) -> DataFrame:
    """Maximal spans of ``turns`` per ``keys``: (keys, start, end).

    With ``gap`` spans merge where the next start is less than ``gap`` after the end; otherwise where it lies before the end, or, with
    ``touching``, at it.  A span opens where the start is beyond the largest end so far.  With ``width`` turns are cut at stretches of that width, each
    stretch is merged for itself and what goes on across their ends is joined again, so that a long key is many tasks.
    """
    islands = _islands(_clipped(turns.select(*keys, "start", "end"), width), keys, touching, gap)
    return islands.select(*keys, "start", "end") if width is None else _joined(islands, keys, touching, gap)


def meeting(a: DataFrame, b: DataFrame, keys: Sequence[str], width=None) -> DataFrame:
    """Pairs of an interval of ``a`` and one of ``b`` (b_start, b_end, other columns of b) that share time, with the shared part (lo, hi).

    With ``width`` both sides are filed under the stretches of that width they touch, which keeps a long recording from being one join key.
    """
    right = b.withColumnRenamed("start", "b_start").withColumnRenamed("end", "b_end")
    on = list(keys)
    if width is not None:
        a = a.withColumn(_BUCKET, F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
        right = right.withColumn(_BUCKET, F.explode(F.sequence(F.floor(F.col("b_start") / width), F.floor(F.col("b_end") / width))))
        on.append(_BUCKET)
    met = a.join(right if width is None else right.hint(_SPREAD), on).where("start < b_end and b_start < end")
    met = met.withColumn("lo", F.greatest("start", "b_start")).withColumn("hi", F.least("end", "b_end"))
    return met.where(F.col(_BUCKET) == F.floor(F.col("lo") / width)).drop(_BUCKET) if width is not None else met


def between(spans: DataFrame, keys: Sequence[str], width=None) -> DataFrame:
    """(keys, start, end) of the time between each of the merged ``spans`` and the next; with ``width`` by stretches, see :func:`merge`."""
    begun = spans.select(*keys, "start", "end").withColumn(STRETCH, F.lit(0).cast("long") if width is None else F.floor(F.col("start") / width))
    inside = Window.partitionBy(*keys, STRETCH).orderBy("start", "end")
    found = begun.select(*keys, F.lag("end").over(inside).alias("from__"), F.col("start").alias("to__"))
    if width is not None:
        along = Window.partitionBy(*keys).orderBy(STRETCH)
        stretches = begun.groupBy(*keys, STRETCH).agg(F.min("start").alias("to__"), F.max("end").alias("end"))
        found = found.unionByName(stretches.select(*keys, F.lag("end").over(along).alias("from__"), "to__"))
    return found.where("from__ < to__").select(*keys, F.col("from__").alias("start"), F.col("to__").alias("end"))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str], least=0, width=None) -> DataFrame:
    """What of each interval of ``a`` no interval of ``b`` covers, in pieces longer than ``least``: (columns of a with start and end cut).

    The pieces of ``a`` are not merged with each other; repeated rows stay repeated.  Null keys meet null keys, and nulls in other columns are
    values like others.  The pieces are what ``a`` shares with the time between the merged ``b``, so one join gives them, by stretches of ``width`` if
    that is given; an interval with very many cuts is not one task.
    """
    columns = a.columns
    # the time a spans is bounded by an empty cut at either end, so that there is free time where b has nothing
    bounds = a.groupBy(*keys).agg(F.min("start").alias("lo"), F.max("end").alias("hi")).select(*keys, F.explode(F.array("lo", "hi")).alias("start")).withColumn("end", F.col("start"))
    free = between(merge(b.select(*keys, "start", "end").unionByName(bounds), keys, touching=True, width=width), keys, width)
    free = free.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("start").alias("from__"), F.col("end").alias("to__"))
    on = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    if width is not None:
        a = a.withColumn("a_bucket__", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
        free = free.withColumn("b_bucket__", F.explode(F.sequence(F.floor(F.col("from__") / width), F.floor(F.col("to__") / width))))
        # a piece counts in the one stretch in which it begins
        on += [F.col("a_bucket__") == F.col("b_bucket__"), F.col("a_bucket__") == F.floor(F.greatest("start", "from__") / width)]
    met = a.join(free, [*on, F.col("start") < F.col("to__"), F.col("from__") < F.col("end")])
    cut = {"start": F.greatest("start", "from__"), "end": F.least("end", "to__")}
    return met.select(*[cut[c].alias(c) if c in cut else F.col(c) for c in columns]).where(F.col("end") - F.col("start") > least)


def overlaps(turns: DataFrame, keys: Sequence[str] = ("rec",), speaker: str = "speaker", least: int = 2, width=None) -> DataFrame:
    """Maximal spans in which ``least`` or more distinct speakers talk: (keys, start, end).  ``width``: see :func:`merge`."""
    # cut at stretches, a speaker's spans need not be joined again: at an end of a stretch one ends and one begins
    per_speaker = _islands(_clipped(turns.select(*keys, speaker, "start", "end"), width), [*keys, speaker], True)
    ends = F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))
    steps = per_speaker.select(*keys, STRETCH, F.explode(ends).alias("step")).groupBy(*keys, STRETCH, F.col("step.t").alias("t")).agg(F.sum("step.d").alias("d"))
    order = Window.partitionBy(*keys, STRETCH).orderBy("t")
    level = steps.withColumn("n", F.sum("d").over(order)).withColumn("until", F.lead("t").over(order))
    runs = level.withColumn("n__", F.sum(F.when(F.col("n") < least, 1).otherwise(0)).over(order)).where(F.col("n") >= least)
    islands = runs.groupBy(*keys, STRETCH, "n__").agg(F.min("t").alias("start"), F.max("until").alias("end")).withColumn("resumed__", F.lit(False))
    return islands.select(*keys, "start", "end") if width is None else _joined(islands, keys, True)


def gaps(speech: DataFrame, totals: DataFrame, keys: Sequence[str], least, width=None) -> DataFrame:
    """Silences of ``least`` or more between merged ``speech`` spans, before the first and up to ``total`` after the last.  ``width``: see :func:`merge`."""
    ends = speech.groupBy(*keys).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    head = ends.select(*keys, F.lit(0).cast(speech.schema["start"].dataType).alias("start"), F.col("first").alias("end"))
    tail = totals.join(ends, list(keys), "left").select(*keys, F.coalesce("last", F.lit(0)).alias("start"), F.col("total").alias("end"))
    return between(speech, keys, width).union(head).union(tail).where(F.col("end") - F.col("start") >= least)


def sliding(totals: DataFrame, target, stride) -> DataFrame:
    """Windows of ``target`` every ``stride`` from 0 while they end by ``total``: (columns of totals, start, end)."""
    count = F.floor((F.col("total") - target) / stride).cast("long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), count))
    return totals.where(F.col("total") >= target).withColumn("k__", at).withColumn("start", F.col("k__") * stride).withColumn("end", F.col("k__") * stride + target).drop("k__")


def covered(windows: DataFrame, spans: DataFrame, keys: Sequence[str], by: Sequence[str] = (), width=None) -> DataFrame:
    """How much of each distinct window (keys, start, end) the ``spans`` cover, for each value of their columns ``by``, and how many of them meet it:
    (keys, by, start, end, shared, n), for n > 0.  Spans that overlap count twice.

    Covered time up to t is a running sum over the starts and ends of spans up to t, so a window asks twice for its place in that order and never
    meets the spans themselves; the work is linear in windows and spans.  With ``width`` both are cut at stretches of that width and added up.
    """
    own, every = [*keys, "start", "end"], [*keys, *by]
    ends = F.array(*[F.struct(F.col(c).alias("t__"), F.lit(rank).alias("rank__"), F.lit(sign).alias("sign__")) for c, rank, sign in (("end", 0, -1), ("start", 2, 1))])
    marks = _clipped(spans.select(*every, "start", "end").where("end > start"), width).select(*every, STRETCH, (F.col("resumed__")).cast("int").alias("resumed__"), F.explode(ends).alias("e")).select(*every, STRETCH, "resumed__", "e.*")
    asked = windows.select(*own).distinct().where("end > start").withColumns({"from__": F.col("start"), "to__": F.col("end")})
    asked = _clipped(asked, width)
    asked = asked.join(spans.select(*every).distinct(), list(keys)) if by else asked
    sides = F.array(F.struct(F.col("start").alias("t__"), F.lit(-1).alias("side__")), F.struct(F.col("end").alias("t__"), F.lit(1).alias("side__")))
    asked = asked.select(*every, STRETCH, "from__", "to__", F.col("resumed__").alias("later__"), F.explode(sides).alias("s")).select(*every, STRETCH, "from__", "to__", "later__", "s.*").withColumn("rank__", F.lit(1))
    # at one time ends come first, then windows, then starts: what only touches a window does not meet it
    so_far = Window.partitionBy(*every, STRETCH).orderBy("t__", "rank__").rowsBetween(Window.unboundedPreceding, 0)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(so_far), F.lit(0))

    starts = F.col("sign__") > 0
    seen = marks.unionByName(asked, allowMissingColumns=True).select(
        *every, "from__", "to__", "side__",
        (total(F.col("sign__")) * F.col("t__") - total(F.col("sign__") * F.col("t__"))).alias("time__"),
        # a span that goes on from the stretch before has met the window there if that goes on as well
        F.when(F.col("side__") > 0, total(starts.cast("long")) - F.when(F.col("later__"), total((starts & (F.col("resumed__") == 1)).cast("long"))).otherwise(0)).otherwise(-total((~starts).cast("long"))).alias("met__"),
    ).where("side__ is not null")
    found = seen.groupBy(*every, F.col("from__").alias("start"), F.col("to__").alias("end")).agg(F.sum(F.col("side__") * F.col("time__")).alias("shared"), F.sum("met__").alias("n"))
    return found.where("n > 0")


def measure(windows: DataFrame, turns: DataFrame, keys: Sequence[str], speaker: str = "speaker", width=None) -> DataFrame:
    """Per window (keys, start, end): overlap, overlap events, longest event, speech, and the speaking time of each speaker as a map.

    A speaker's overlapping turns count twice in the map; overlap and speech are of merged time.  All but the longest event, for which windows meet
    the overlaps, is :func:`covered` time.  ``width``: see :func:`merge`.
    """
    own, nobody = [*keys, "start", "end"], F.lit(None).cast(turns.schema[speaker].dataType).alias("who__")
    both = overlaps(turns, keys, speaker, width=width)
    parts = both.select(*own, nobody, F.lit("overlap").alias("kind__"))
    parts = parts.unionByName(merge(turns, keys, touching=True, width=width).select(*own, nobody, F.lit("speech").alias("kind__")))
    parts = parts.unionByName(turns.select(*own, F.col(speaker).alias("who__"), F.lit("turn").alias("kind__")))
    shared = covered(windows, parts, keys, ["kind__", "who__"], width)

    def of(kind: str, value: str) -> Column:
        return F.max(F.when(F.col("kind__") == kind, F.col(value)))

    spoken = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind__") == "turn", F.struct(F.col("who__").alias(speaker), F.col("shared").alias("w"))))))
    found = shared.groupBy(*own).agg(of("overlap", "shared").alias("overlap"), of("overlap", "n").alias("events"), of("speech", "shared").alias("speech"), spoken.alias("by_speaker"))
    longest = meeting(windows.select(*own).distinct(), both, keys, width).groupBy(*own).agg(F.max(F.col("hi") - F.col("lo")).alias("longest"))
    found = found.join(longest.hint(_SPREAD), own, "left").select(*own, "overlap", "events", "longest", "speech", "by_speaker")
    return windows.join(found.hint(_SPREAD), own, "left").fillna(0, ["overlap", "events", "longest", "speech"])


def snap(points: DataFrame, silences: DataFrame, keys: Sequence[str], at: str, radius, outward: int) -> DataFrame:
    """``points`` with ``at`` moved to the nearest silence midpoint within ``radius`` on its outer side (-1: earlier, +1: later); first wins a tie.

    Points and midpoints meet in the stretch of ``radius`` that holds the midpoint, which is the point's own or the next one outward.
    """
    mids = silences.select(*keys, ((F.col("start") + F.col("end")) / 2).alias("mid__")).withColumn(_BUCKET, F.floor(F.col("mid__") / radius))
    own = F.floor(F.col(at) / radius)
    asked = points.select(*keys, at).distinct().withColumn(_BUCKET, F.explode(F.array(own, own + outward)))
    away = (F.col("mid__") - F.col(at)) * outward
    near = asked.join(mids.hint(_SPREAD), [*keys, _BUCKET]).where((away >= 0) & (away <= radius))
    best = near.groupBy(*keys, at).agg(F.min_by("mid__", F.struct(away.alias("d"), F.col("mid__"))).alias("mid__"))
    return points.join(best.hint(_SPREAD), [*keys, at], "left").withColumn(at, F.coalesce("mid__", F.col(at).cast("double"))).drop("mid__")


def hull_iou(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Shared time over the hull of both intervals; 0 where they are apart."""
    shared = F.greatest(F.least(end, other_end) - F.greatest(start, other_start), F.lit(0))
    hull = F.greatest(end, other_end) - F.least(start, other_start)
    return F.when(hull > 0, shared / hull).otherwise(F.lit(0.0))


def suppress(candidates: DataFrame, keys: Sequence[str], score: str, most: float, width=None) -> DataFrame:
    """Greedy non-maximum suppression: by ``score`` downwards (then start, then end), keep what has a hull IoU of ``most`` or less with all kept so far.

    In rounds instead of in turn: what comes before all its undecided neighbours is kept, for nothing else can stop it, and its neighbours go; what has
    no undecided neighbour left is kept as well.  Neighbours are found once, by stretches of ``width`` if that is given.  Of rows equal in score, start and end one is kept; null scores come last.
    """
    order = Window.partitionBy(*keys, "start", "end").orderBy(F.col(score).desc_nulls_last())
    # of equal windows the best one stands for all, as it suppresses the others (unless nothing is suppressed)
    rows = candidates.withColumn("nth__", F.row_number().over(order)).where(F.col("nth__") == 1).drop("nth__") if most < 1 else candidates
    rows = settled(rows.withColumn("id__", F.monotonically_increasing_id()))
    first = F.struct(F.col(score).isNull().alias("a"), (-F.col(score)).alias("b"), F.col("start").alias("c"), F.col("end").alias("d"), F.col("id__").alias("e"))
    windows = rows.select(*keys, "start", "end", "id__", first.alias("place__"))
    met = meeting(windows, windows.select(*keys, "start", "end", F.col("id__").alias("other__"), F.col("place__").alias("other_place__")), keys, width)
    hull = F.greatest("end", "b_end") - F.least("start", "b_start")
    near = met.where("place__ < other_place__").where(F.col("hi") - F.col("lo") > most * hull)
    ahead = settled(near.select(F.col("id__").alias("u"), F.col("other__").alias("v")))  # u comes before v and, if it is kept, suppresses it
    gone = None
    while ahead.limit(1).count():
        kept = settled(ahead.select("u").distinct().join(ahead.select(F.col("v").alias("u")).hint(_SPREAD), "u", "left_anti")).hint(_SPREAD)
        fallen = settled(ahead.join(kept, "u", "left_semi").select("v").distinct())
        gone = fallen if gone is None else gone.union(fallen)
        ahead = settled(ahead.join(kept, "u", "left_anti").join(fallen.select(F.col("v").alias("u")).hint(_SPREAD), "u", "left_anti").join(fallen.hint(_SPREAD), "v", "left_anti"))
    return (rows if gone is None else rows.join(gone.hint(_SPREAD), F.col("id__") == F.col("v"), "left_anti")).drop("id__")


def solo(turns: DataFrame, blocked: DataFrame, keys: Sequence[str] = ("rec",), speaker: str = "speaker", least=0, width=None) -> DataFrame:
    """Per speaker the merged turns less ``blocked`` time (keys, start, end).  ``width``: see :func:`merge`."""
    return subtract(merge(turns, [*keys, speaker], width=width), blocked, list(keys), least, width)


def select_regions(regions: DataFrame, keys: Sequence[str], shortest, gap) -> DataFrame:
    """Regions of ``shortest`` or longer, then merged across gaps below ``gap``.  The filter comes first and must not be moved past the merge."""
    return merge(regions.where(F.col("end") - F.col("start") >= shortest), keys, gap=gap)


def pad(start: Column, end: Column, total: Column, want: Column) -> tuple[Column, Column]:
    """An interval widened to ``want`` by equal shares; what an edge of [0, total] leaves unused goes to the other side."""
    extra = F.greatest(want - (end - start), F.lit(0))
    left = extra / 2
    from_left = F.least(left, start)
    from_right = F.least(extra - left, total - end)
    spill_right = F.least(left - from_left, total - end - from_right)
    spill_left = F.least(extra - left - from_right, start - from_left)
    return start - from_left - spill_left, end + from_right + spill_right


def window_for(start: Column, end: Column, total: Column, mode: str, amount) -> tuple[Column, Column]:
    """The window around a region: ``none``, ``fixed_pad`` (amount on both sides, clamped) or ``expand_to_chunk`` (up to amount, see pad)."""
    if mode == "none":
        return start, end
    if mode == "fixed_pad":
        return F.greatest(start - amount, F.lit(0)), F.least(end + amount, total)
    if mode == "expand_to_chunk":
        return pad(start, end, total, F.lit(amount))
    raise ValueError(f"unknown window mode {mode}")


def clamp_emits(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Starts moved to the previous region's end where they cross it, but not beyond the own end."""
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy("start", "end"))
    return regions.withColumn("start", F.when(F.col("start") < before, F.least(before, F.col("end"))).otherwise(F.col("start")))


def number_then_drop(regions: DataFrame, keys: Sequence[str], shortest) -> DataFrame:
    """Regions numbered from 0 in order before the short ones are dropped, so numbers keep their gaps."""
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) - 1
    return regions.withColumn("idx", index.cast("long")).where(F.col("end") - F.col("start") >= shortest)


def shortened_map(pieces: DataFrame, keys: Sequence[str], gap) -> DataFrame:
    """Where each piece lands when a speaker's pieces are laid end to end with ``gap`` between them: (.., concat_start, concat_end)."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    length = F.col("end") - F.col("start")
    before = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.row_number().over(order) - 1) * gap
    return pieces.withColumn("concat_start", before).withColumn("concat_end", F.col("concat_start") + length)


def full_length_map(pieces: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces at their own time, cut to [0, total], those wholly outside left out."""
    placed = pieces.join(totals, list(keys))
    placed = placed.withColumn("concat_start", F.greatest("start", F.lit(0))).withColumn("concat_end", F.least("end", "total"))
    return placed.where("concat_end > concat_start").drop("total")


def event_list(solos: DataFrame, regions: DataFrame) -> DataFrame:
    """Solo pieces and overlap regions as one list with their kind, empty ones left out."""
    both = solos.withColumn("kind", F.lit("solo")).unionByName(regions.withColumn("kind", F.lit("overlap")))
    return both.where("end > start")


def fill_regions(regions: DataFrame, speakers: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each region for every speaker of its recording, cut at the recording's end."""
    filled = regions.join(totals, list(keys)).withColumn("end", F.least("end", "total")).drop("total").where("end > start")
    return filled.join(speakers, list(keys))


def best_window(totals: DataFrame, spans: DataFrame, keys: Sequence[str], length, stride, width=None) -> DataFrame:
    """Per key the window of ``length`` that shares most time with ``spans``; the first of equals.  ``width``: see :func:`merge`."""
    shared = covered(sliding(totals, length, stride), spans, keys, width=width)
    return shared.groupBy(*keys).agg(F.max(F.struct("shared", (-F.col("start")).alias("back"))).alias("best")).select(*keys, (-F.col("best.back")).alias("start"), F.col("best.shared").alias("shared"))


def run_lengths(rows: DataFrame, keys: Sequence[str], order: str, value: str, width=None) -> DataFrame:
    """Maximal runs of equal ``value`` along ``order``: (keys, value, first, last, n).

    With ``width`` each stretch of ``order`` is cut into runs for itself, and the first and the last of a stretch are joined to those beside it.
    """
    placed = rows.select(*keys, F.col(order).alias("at__"), F.col(value).alias("value__")).withColumn(STRETCH, F.lit(0).cast("long") if width is None else F.floor(F.col("at__") / width))
    inside = Window.partitionBy(*keys, STRETCH).orderBy("at__")
    changed = F.when(F.col("value__").eqNullSafe(F.lag("value__").over(inside)) & (F.row_number().over(inside) > 1), 0).otherwise(1)
    runs = placed.withColumn("changed__", changed).withColumn("run__", F.sum("changed__").over(inside))
    aggregates = F.first("value__").alias("value__"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    runs = runs.withColumns({"first": F.col("at__"), "last": F.col("at__"), "n": F.lit(1).cast("long")}).groupBy(*keys, STRETCH, "run__").agg(*aggregates)
    columns = [*keys, F.col("value__").alias(value), "first", "last", "n"]
    if width is None:
        return runs.select(*columns)
    within, along = Window.partitionBy(*keys, STRETCH), Window.partitionBy(*keys).orderBy(STRETCH, "run__")
    marked = runs.withColumn("edge__", (F.col("run__") == 1) | (F.col("run__") == F.max("run__").over(within)))
    goes_on = F.col("value__").eqNullSafe(F.lag("value__").over(along)) & (F.lag(STRETCH).over(along) < F.col(STRETCH))
    edges = marked.where("edge__").withColumn("opens__", F.when(goes_on, 0).otherwise(1)).withColumn("run__", F.sum("opens__").over(along))
    edges = edges.groupBy(*keys, "run__").agg(*aggregates)
    return marked.where("not edge__").select(*columns).unionByName(edges.select(*columns))


def lint(turns: DataFrame, keys: Sequence[str], speaker: str = "speaker", text: str = "text", longest=30_000, tolerated=50) -> DataFrame:
    """One row per finding: empty text, end not after start, too long, or begun before the same speaker's last turn ended."""
    order = Window.partitionBy(*keys, speaker).orderBy("start", "end")
    before = F.col("before__")
    findings = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty"),
            F.when(F.col("end") <= F.col("start"), "not_positive"),
            F.when(F.col("end") - F.col("start") > longest, "too_long"),
            F.when(before - F.col("start") > tolerated, "same_speaker_overlap"),
        )
    )
    return turns.withColumn("before__", F.lag("end").over(order)).withColumn("finding", F.explode(findings)).drop("before__")


def repeated_runs(turns: DataFrame, keys: Sequence[str], text: str = "text", least: int = 5, gap=500, width=None) -> DataFrame:
    """The row at which a run of equal texts with pauses below ``gap`` reaches ``least``; once per run.

    With ``width`` rows are counted within each stretch of time; what the run that a stretch begins with has counted before comes from a scan over
    stretches.
    """
    placed = turns.withColumn(STRETCH, F.lit(0).cast("long") if width is None else F.floor(F.col("start") / width))
    inside = Window.partitionBy(*keys, STRETCH).orderBy("start", "end")
    goes_on = (F.col(text) == F.lag(text).over(inside)) & (F.col("start") - F.lag("end").over(inside) < gap)
    runs = placed.withColumn("run__", F.sum(F.when(goes_on, 0).otherwise(1)).over(inside))
    runs = runs.withColumn("nth__", F.row_number().over(Window.partitionBy(*keys, STRETCH, "run__").orderBy("start", "end")))
    if width is None:
        return runs.where(F.col("nth__") == least).drop("nth__", "run__", STRETCH)
    # of each stretch the first and the last row, and how many rows its last run has
    place = F.struct("start", "end", "run__", "nth__")
    ends = runs.groupBy(*keys, STRETCH).agg(F.min_by(F.struct(text, "start"), place).alias("first"), F.max_by(F.struct(text, "end", "run__", "nth__"), place).alias("last"))
    along = Window.partitionBy(*keys).orderBy(STRETCH)
    before = F.lag("last").over(along)
    links = ends.withColumn("on__", F.coalesce((F.col(f"first.{text}") == before[text]) & (F.col("first.start") - before["end"] < gap), F.lit(False)))
    # a run goes through a stretch that is nothing else; where it does not, counting begins anew
    links = links.withColumn("block__", F.sum(F.when(F.col("on__") & (F.col("last.run__") == 1), 0).otherwise(1)).over(along))
    counted = F.sum("last.nth__").over(Window.partitionBy(*keys, "block__").orderBy(STRETCH))
    links = links.withColumn("counted__", counted).withColumn("carried__", F.when(F.col("on__"), F.lag("counted__").over(along)).otherwise(0))
    carried = links.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col(STRETCH).alias("of__"), "carried__").where("carried__ > 0")
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    nth = F.col("nth__") + F.when(F.col("run__") == 1, F.coalesce("carried__", F.lit(0))).otherwise(0)
    found = runs.join(carried, [*same, F.col(STRETCH) == F.col("of__")], "left").where(nth == least)
    return found.select(*turns.columns)


def first_containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, order: str, width=None) -> DataFrame:
    """Each point with the first span, by ``order``, that holds it, both ends included; points in none are left out.

    With ``width`` spans are filed under the stretches of that width they touch.
    """
    own, on = points.columns, list(keys)
    if width is not None:
        points = points.withColumn(_BUCKET, F.floor(F.col(at) / width))
        spans = spans.withColumn(_BUCKET, F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
        on.append(_BUCKET)
    met = points.join(spans, on).where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end")))
    return met.groupBy(*own).agg(F.min(F.struct(order, "start", "end")).alias("s")).select(*own, "s.*")
