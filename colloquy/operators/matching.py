"""Greedy one-to-one matching of points in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running, settled


def _nearest(points: DataFrame, others: DataFrame, key: str, width) -> DataFrame:
    """(key, name, other, distance): for each name the nearest of ``others``, by distance and then name.

    Of others at one time only the one with the smallest name counts; a point looks at the last before it and the first after it.
    """
    stand = others.groupBy(key, "t__").agg(F.min("name__").alias("name__")).select(key, "t__", F.struct(F.col("t__").alias("t"), F.col("name__").alias("name")).alias("seen__"), F.lit(0).alias("rank__"))
    both = stand.unionByName(points.select(key, "t__", "name__", F.lit(1).alias("rank__")), allowMissingColumns=True)
    segment = None if width is None else F.floor(F.col("t__") / width)
    both = running(both, [key], ["t__", "rank__"], segment, {"before__": ("last", F.col("seen__"))})
    # backwards the order of ranks turns as well: others at the very time are among those before
    both = running(both, [key], ["t__", "rank__"], segment, {"after__": ("last", F.col("seen__"))}, backward=True).where("rank__ = 1")
    found = both.select(key, "name__", F.explode(F.array_compact(F.array("before__", "after__"))).alias("o"), "t__")
    best = F.min(F.struct(F.abs(F.col("t__") - F.col("o.t")).cast("double").alias("distance"), F.col("o.name").alias("other")))
    return found.groupBy(key, "name__").agg(best.alias("best")).select(key, F.col("name__").alias("name"), "best.other", "best.distance")


def match_nearest(left: DataFrame, right: DataFrame, key: str, name_left: str, name_right: str, at: str, width=None) -> DataFrame:
    """(key, left, right, distance): nearest pairs first, each name once; ties by the left name, then the right one.

    In rounds: two names that are each other's nearest would be taken before any other pair of theirs, so all such pairs are taken at once and
    their rows go.  A round looks for neighbours in time only and never lists the pairs of a recording; with ``width`` a recording is cut into
    stretches of that width.  Rows without a time or a name match nothing.
    """
    rest_left, rest_right = (
        settled(side.select(key, F.col(name).alias("name__"), F.col(at).alias("t__")).where("name__ is not null and t__ is not null")) for side, name in ((left, name_left), (right, name_right))
    )
    taken = None
    while True:
        ours = _nearest(rest_left, rest_right, key, width).select(key, F.col("name").alias("l"), F.col("other").alias("r"), "distance")
        theirs = _nearest(rest_right, rest_left, key, width).select(key, F.col("other").alias("l"), F.col("name").alias("r"))
        mutual = settled(ours.join(theirs, [key, "l", "r"]).select(key, "l", "r", "distance"))
        taken = mutual if taken is None else taken.union(mutual)
        if not mutual.limit(1).count():
            return taken.select(key, F.col("l").alias(name_left), F.col("r").alias(name_right), "distance")
        rest_left = settled(rest_left.join(mutual.select(key, F.col("l").alias("name__")), [key, "name__"], "left_anti"))
        rest_right = settled(rest_right.join(mutual.select(key, F.col("r").alias("name__")), [key, "name__"], "left_anti"))


def two_by_two(first_a: Column, second_b: Column, first_b: Column, second_a: Column) -> Column:
    """Which of two pairings has the larger sum: ``straight`` (also at a tie), ``swapped``, or ``fixed`` where a sum is null or not finite, which decides
    nothing."""
    straight, swapped = first_a + second_b, first_b + second_a
    known = F.coalesce((F.abs(straight) < float("inf")) & (F.abs(swapped) < float("inf")), F.lit(False))
    return F.when(~known, "fixed").when(straight >= swapped, "straight").otherwise("swapped")
