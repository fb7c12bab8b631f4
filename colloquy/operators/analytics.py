"""Experiment analytics: averages over recordings and runs, histories, rankings and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running, settled

NAN = float("nan")


def micro_rate(errors: Column, length: Column) -> Column:
    """100 x all errors / all words of a group; NaN where there is no word."""
    total = F.sum(length)
    return F.when(total > 0, 100.0 * F.sum(errors) / total).otherwise(F.lit(NAN))


def session_rate(errors: Column, length: Column) -> Column:
    """One session's rate; 0 / 0 is 0."""
    return F.when(length > 0, errors / length).otherwise(F.lit(0.0))


def micro_averages(scores: DataFrame, by: Sequence[str], metrics: Sequence[str], errors: str = "errors", length: str = "length", metric: str = "metric") -> DataFrame:
    """One row per ``by`` with a micro-averaged rate per metric; a metric counts only the recordings that have it."""
    rates = scores.groupBy(*by).pivot(metric, list(metrics)).agg(micro_rate(F.col(errors), F.col(length)))
    return rates


def macro_with_total(values: DataFrame, key: str, columns: Sequence[str], total: str = "AVERAGE") -> DataFrame:
    """Per key the mean of each column, and a row of the means of those, which takes each column over the keys that have it."""
    per_key = values.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
    return per_key.unionByName(per_key.agg(*[F.avg(c).alias(c) for c in columns]).withColumn(key, F.lit(total)))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def mean_skipping_nan(value: Column) -> Column:
    return F.avg(F.when(~F.isnan(value), value))


def upper_middle(value: Column) -> Column:
    """The upper of the middle order statistics of a group; unlike a median it is always one of the values."""
    sorted_ = F.sort_array(F.collect_list(value))
    return F.when(F.size(sorted_) > 0, F.element_at(sorted_, (F.floor(F.size(sorted_) / 2) + 1).cast("int")))


def deltas(history: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The change since the row before; null on a key's first row."""
    return history.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def patience(history: DataFrame, keys: Sequence[str], order: str, value: str, limit: int) -> DataFrame:
    """Running best so far, whether a row improves on it, rows since the last improvement, and whether patience is used up."""
    along = Window.partitionBy(*keys).orderBy(order)
    before = F.max(value).over(along.rowsBetween(Window.unboundedPreceding, -1))
    seen = history.withColumn("best_before", before).withColumn("improved", before.isNull() | (F.col(value) > before))
    rounds = seen.withColumn("round__", F.sum(F.col("improved").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.row_number().over(Window.partitionBy(*keys, "round__").orderBy(order)) - 1
    return rounds.withColumn("since", since.cast("long")).withColumn("stop", F.col("since") >= limit).drop("round__")


def bad_streak(history: DataFrame, keys: Sequence[str], order: str, bad: Column) -> DataFrame:
    """How many bad rows in a row end at each row; a good row resets it."""
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = history.withColumn("bad__", bad.cast("long")).withColumn("run__", F.sum(1 - F.col("bad__")).over(along))
    return marked.withColumn("streak", F.sum("bad__").over(Window.partitionBy(*keys, "run__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("bad__", "run__")


def sticky(history: DataFrame, keys: Sequence[str], order: str, starts: Column) -> DataFrame:
    """On from the first row at which ``starts`` holds."""
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("on", F.coalesce(F.bool_or(starts).over(along), F.lit(False)))


def as_of(rows: DataFrame, schedule: DataFrame, at: str, since: str, value: str, keys: Sequence[str] = (), width=None, salts: int = 16) -> DataFrame:
    """``rows`` with the ``value`` of the last ``schedule`` entry of the same ``keys`` at or before each row's ``at``; null before the first.

    Both tables are put into one order of time and the last value is carried along, by stretches of ``width`` of a key if that is given.  Of entries
    at one time the one with the largest value counts; an entry may have a null value.  Without ``keys`` the schedule is repeated for ``salts``
    shares of the rows, so that they do not end up in one task.  Rows without a time get null; null keys meet null keys.
    """
    by = list(keys) or ["salt__"]
    known = schedule.where(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("at__")).agg(F.max(value).alias("value__"))
    known = known.withColumn("seen__", F.struct("value__")).drop("value__").withColumn("rank__", F.lit(0))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row__")
    asked = rows.select(*keys, row, F.col(at).alias("at__"), F.lit(1).alias("rank__"))
    if not keys:
        known = known.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        asked = asked.withColumn("salt__", F.pmod(F.xxhash64("row__"), F.lit(salts)).cast("int"))
    segment = None if width is None else F.floor(F.col("at__") / width)
    found = running(known.unionByName(asked, allowMissingColumns=True), by, ["at__", "rank__"], segment, {"last__": ("last", F.col("seen__"))}).where("rank__ = 1")
    kept = [F.col(f"row__.`{c}`").alias(c) for c in rows.columns if c != value]
    return found.select(*kept, F.when(F.col("at__").isNotNull(), F.col("last__.value__")).alias(value))


#: Rows of a list made by hand.
SHORT_LIST = 1000


def _short(rows: DataFrame) -> list:
    found = rows.limit(SHORT_LIST + 1).collect()
    if len(found) > SHORT_LIST:
        raise ValueError(f"more than {SHORT_LIST} rows: this is no list made by hand")
    return found


#: Rows up to which a cell's best are kept in memory while they are looked for.
FEW = 10_000


def best_rows(rows: DataFrame, target: int, score: str, key: str) -> DataFrame:
    """The ``target`` rows of the highest ``score``, ties by the smaller ``key``; null scores come last.

    A large target is counted off along the order in stretches of the score between 65 of its quantiles, not in one task.
    """
    if target <= FEW:
        return rows.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(target)
    edges = rows.agg(F.percentile_approx(score, [i / 64 for i in range(65)], 10_000)).first()[0] or []
    segment = F.when(F.col(score).isNull(), len(edges) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col(score)))) if edges else F.lit(0)
    ordered = rows.withColumn("missing__", F.col(score).isNull()).withColumn("down__", -F.col(score))
    ranked = running(ordered, [], ["missing__", "down__", key], segment, {"nth__": ("sum", F.lit(1))})
    return ranked.where(F.col("nth__") <= target).drop("missing__", "down__", "nth__")


def quota_select(candidates: DataFrame, cells: Sequence[tuple[str, int]], quota: int | dict[str, int], cell: str = "cell", group: str = "rec", score: str = "score", key: str = "key") -> DataFrame:
    """Cells in declared order each take their best rows while their ``group`` has less than ``quota`` over all cells together.

    One pass a cell, of which there are as many as are declared by hand: a group offers its best rows up to what earlier cells have left of its quota,
    and the cell takes the best ``target`` of all that is offered, which is what taking them in turn comes to.  Ties go to the smaller ``key``.
    Rows stay where they are: the driver sees none.  Rows of no group count as one group.
    """
    quotas = quota if isinstance(quota, dict) else dict.fromkeys((name for name, _ in cells), quota)
    rows = settled(candidates)
    own = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(key))
    chosen = rows.limit(0)
    for name, target in cells:
        offered = rows.where(F.col(cell) == name).withColumn("nth__", F.row_number().over(own)).where(F.col("nth__") <= quotas[name])
        used = chosen.groupBy(F.col(group).alias("group__")).agg(F.count("*").alias("used__"))
        offered = offered.join(used, F.col(group).eqNullSafe(F.col("group__")), "left").where(F.col("nth__") + F.coalesce("used__", F.lit(0)) <= quotas[name])
        chosen = chosen.unionByName(settled(best_rows(offered.select(rows.columns), target, score, key)))
    return chosen


def projected_days(seconds: Column, samples: Column, target: int, epochs: int) -> Column:
    """Days that ``epochs`` epochs of ``target`` samples take, in proportion to the seconds of an epoch of ``samples``."""
    return seconds / samples * target * epochs / 86400


def audit(candidates: DataFrame, chosen: DataFrame, cell: str = "cell", group: str = "rec") -> DataFrame:
    """Per cell how many rows there were, how many were taken, and from how many groups."""
    had = candidates.groupBy(cell).agg(F.count("*").alias("available"))
    got = chosen.groupBy(cell).agg(F.count("*").alias("got"), F.count_distinct(group).alias("used"))
    return had.join(got, cell, "left").fillna(0, ["got", "used"])


def distance_to_chosen(runs: DataFrame, chosen: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``runs`` with the least Euclidean distance of their z-scores (by mean and deviation of all runs) to those of the ``chosen`` few.

    The chosen runs are a short list made by hand or by a limit and become a constant; more than ``SHORT_LIST`` are refused.
    """
    stats = runs.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()

    def scored(frame: DataFrame, name: str) -> DataFrame:
        z = [((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)) for c in columns]
        return frame.withColumn(name, F.array(*z))

    picks = [r["z"] for r in _short(scored(chosen, "z").select("z"))]
    apart = F.array_min(F.transform(F.array(*[F.array(*map(F.lit, p)) for p in picks]), lambda p: F.sqrt(F.aggregate(F.zip_with(p, F.col("z__"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))))
    return scored(runs, "z__").withColumn("distance", apart).drop("z__")
