"""Running aggregates along an order, cut into segments so that no key is one task.

A window over a key puts all of its rows in one task.  Here rows are cut into segments that follow each other in the order (a stretch of time, a range
of numbers); each segment gets one row more, the aggregate of all segments before it, and a window over (key, segment) does the rest.  What is
scanned over a whole key is a row per segment.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEGMENT, _HEAD = "segment__", "head__"
_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column | None, values: dict[str, tuple[str, Column]], before: bool = False, backward: bool = False, keep: str | None = None) -> DataFrame:
    """``rows`` with, for each name of ``values`` (aggregate, expression), that aggregate over the rows of the same ``keys`` up to each row.

    ``order`` are columns; ``segment`` follows from them and never falls along them; without one a key is one task.  ``keep`` names the column in which
    the segment stays, for windows that go on within it.  ``before`` leaves the row itself out, ``backward`` takes the rows
    after instead of those up to it.  Aggregates are sum, max, min, and last (the last value that is not null).  Rows equal in ``order`` go one
    after another in any order, as in a window over rows; null keys are a key like others.  sum of no row is null.
    """
    along = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    frame = (Window.unboundedPreceding, -1 if before else 0)
    if segment is None:
        whole = Window.partitionBy(*keys).orderBy(*along).rowsBetween(*frame)
        found = rows.withColumns({name: _AGGREGATES[kind](value).over(whole) for name, (kind, value) in values.items()})
        return found.withColumn(keep, F.lit(0)) if keep else found
    cut = rows.withColumn(_SEGMENT, segment).withColumns({f"{name}__in": value for name, (_, value) in values.items()})
    by = [*keys, _SEGMENT]
    totals = cut.groupBy(*by).agg(*[_last(f"{name}__in", order, backward) if kind == "last" else _AGGREGATES[kind](f"{name}__in").alias(f"{name}__in") for name, (kind, _) in values.items()])
    over = Window.partitionBy(*keys).orderBy(F.col(_SEGMENT).desc() if backward else F.col(_SEGMENT).asc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*by, *[_AGGREGATES[kind](f"{name}__in").over(over).alias(f"{name}__in") for name, (kind, _) in values.items()]).withColumn(_HEAD, F.lit(0))
    both = cut.withColumn(_HEAD, F.lit(1)).unionByName(heads, allowMissingColumns=True)
    within = Window.partitionBy(*by).orderBy(_HEAD, *along).rowsBetween(*frame)
    found = both.withColumns({name: _AGGREGATES[kind](f"{name}__in").over(within) for name, (kind, _) in values.items()})
    found = found.where(F.col(_HEAD) == 1).drop(_HEAD, *[f"{name}__in" for name in values])
    return found.withColumnRenamed(_SEGMENT, keep) if keep else found.drop(_SEGMENT)


def _last(column: str, order: Sequence[str], backward: bool) -> Column:
    at = F.struct(*order)
    return (F.min_by if backward else F.max_by)(column, F.when(F.col(column).isNotNull(), at)).alias(column)


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` written to the checkpoint folder and read from there: what follows does not work it out again, and a lost executor costs no more.

    The folder is the session's ``spark.checkpoint.dir``; only where none is set and the session runs on one machine a temporary one takes its place.
    """
    context = frame.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rounds-"))
    return frame.checkpoint()
