"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A source's target in words is met by complete epochs of its documents first; the fraction of an epoch that remains goes to the documents with
the smallest keys ``-ln(u) / quality`` (u uniform, a hash of the document), taken until their prefix sum of words reaches it.

No source is sorted in one task.  The keys of a source fall into cells; the words of each cell are summed with map-side aggregation and
prefix-summed, and the one cell in which the budget ends is divided into cells again until it is small.  What is put in order is that cell's
(key, id, size), without texts.  The document at which the budget ends then settles every other one where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, recounted, saved, whole

SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)
MOST = 2.0
CELLS = 4096
#: Rows of a cell that are put in order by one task.
SMALL = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column, words: Column) -> Column:
    """A weight from 0.1 to 1 that falls with the distance of the mean word length from 5.5 letters and is halved below five words."""
    mean = (F.length(text) - words + 1) / words
    graded = F.greatest(F.lit(0.1), 1 - F.abs(mean - 5.5) / 8)
    return F.when(words == 0, 0.1).when(words < 5, graded / 2).otherwise(graded)


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of ``key``."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of each source in ``sizes`` (source, size).

    Sources in code-point order, null last, get the ``weights`` in turn and share ``share`` times all words in proportion; a target stops at
    ``most`` times its source's words and the excess is shared again.  The fixed point is target = min(cap, weight * level): with sources by
    cap / weight, the level is what the uncapped tail gets once the capped head is paid.  One row per source is all that is ordered.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    named = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = named.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything).getField("level")
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return levelled.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, quality: Column | None, seed: int, id_column: str) -> DataFrame:
    """``docs`` with size__ and key__.  The words are counted once: what a generator makes is not computed again by those who use it."""
    counted = docs.withColumn("size__", F.explode(F.array(word_count(F.col("text")))))
    weight = quality if quality is not None else text_quality(F.col("text"), F.col("size__"))
    weight = F.greatest(F.coalesce(weight, F.lit(0.001)), F.lit(0.001))
    return counted.withColumn("key__", -F.log(uniform(F.lit(seed), F.col(id_column))) / weight)


def _plan(slim: DataFrame, id_column: str, share: float, weights: tuple[float, ...], most: float, small: int) -> DataFrame:
    """A row per source: its size and target, its epochs, and the (key, id, size) at which its budget ends with the words that rows there get.

    ``slim`` has source, id, size__, key__.  Of a source whose budget ends with no row the end is null.
    """
    source = F.col("source")
    totals = slim.groupBy("source").agg(F.sum("size__").alias("size"))
    targets = source_targets(totals, share, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = targets.withColumn("epochs", epochs).withColumn("part", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    budgets = saved(budgets)
    # low to high are the keys among which a source's budget ends, before the words of those with smaller keys
    bounds = budgets.select(F.col("source").alias("s"), "part", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("before"))
    rows = slim
    while True:
        within = rows.join(bounds, source.eqNullSafe(F.col("s"))).where(F.col("key__").between(F.col("low"), F.col("high")))
        first = F.col("high") == float("inf")
        place = F.when(first, 1 - F.exp(-F.col("key__"))).otherwise((F.col("key__") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
        cell = F.least(F.floor(F.coalesce(place, F.lit(0.0)) * CELLS), F.lit(CELLS - 1)).cast("int")
        cells = within.groupBy("s", "part", cell.alias("cell"), F.col("before").alias("base")).agg(
            F.sum("size__").alias("words"), F.count("*").alias("n"), F.min("key__").alias("low"), F.max("key__").alias("high")
        )
        upto = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        ends = cells.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
        ends = ends.where((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("words")))
        bounds = saved(ends.select("s", "part", "low", "high", "before", "n"))
        if not bounds.where((F.col("n") > small) & (F.col("low") < F.col("high"))).limit(1).count():
            break
        bounds = bounds.drop("n")
    last = slim.join(bounds.drop("n"), source.eqNullSafe(F.col("s"))).where(F.col("key__").between(F.col("low"), F.col("high")))
    same = last.groupBy("s", "part", "before", F.struct("key__", id_column, "size__").alias("end")).agg(F.count("*").alias("n"), F.sum("size__").alias("words"))
    order = Window.partitionBy("s").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("part") - F.col("before") - F.coalesce(F.sum("words").over(order), F.lit(0))
    cut = same.withColumn("rest", rest).where((F.col("rest") >= 0) & (F.col("rest") < F.col("words")))
    cut = cut.select(F.col("s").alias("e"), "end", F.floor(F.col("rest") / F.col("n")).alias("each"))
    known = budgets.join(cut, source.eqNullSafe(F.col("e")), "left")
    return saved(known.select(source.alias("s"), F.col("source_size").alias("source_size__"), F.col("target").alias("target__"), "epochs", "end", "each"))


def _taken(rows: DataFrame, plan: DataFrame, id_column: str) -> DataFrame:
    """``rows`` with source_size__, target__ and taken__ by what the plan says of their source; a row a source, so Spark may send it to all."""
    here = F.struct("key__", id_column, "size__")
    part = F.when(F.col("end").isNull() | (here > F.col("end")), 0).when(here == F.col("end"), F.col("each")).otherwise(F.col("size__"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("taken__", (F.col("epochs") * F.col("size__") + part).cast("long")).drop("s", "epochs", "end", "each")


def mixed(
    docs: DataFrame, quality: Column | None = None, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 42, id_column: str = "doc_id", small: int = SMALL
) -> DataFrame:
    """(id, source, size__, source_size__, target__, taken__) of every row of ``docs``: the words the mix takes of each row, repeats counted.

    Sizes are words of the whole text (null: 0); empty documents are taken 0 times.  The document in which a source's budget ends is taken in
    part, so a source's taken words differ from its target by less than one.  Where rows of one id and size are repeated at that end, they share
    what is left evenly, and the difference is less than their number.  ``quality`` is a weight above 0 (null or less: 0.001); without one it is
    judged from the text.  The same rows give the same result.  Null ids and sources are values like others.  An empty table gives an empty one.
    """
    extra = [] if quality is None else [quality.alias("quality__")]
    rows = docs.select(id_column, "source", "text", *extra)
    slim = saved(_sized(rows, F.col("quality__") if extra else None, seed, id_column).select(id_column, "source", "size__", "key__"))
    return _taken(slim, _plan(slim, id_column, share, weights, most, small), id_column).drop("key__")


def mixture(docs: DataFrame, quality: Column | None = None, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 42, id_column: str = "doc_id", small: int = SMALL) -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken whole, and the one cut at a source's budget once more up to the cut.

    The columns are those of ``docs``; the text of a cut document is its first words, space-joined, and ``n_chars``, where there is such a column,
    counts it.  Nulls, repeats and ties are as in :func:`mixed`; texts without a word are left out; an empty table gives an empty one.
    """
    extra = [] if quality is None else [quality.alias("quality__")]
    rows = docs.select(id_column, "source", "text", whole(docs), *extra)
    sized = _sized(rows, F.col("quality__") if extra else None, seed, id_column)
    slim = saved(sized.select(id_column, "source", "size__", "key__"))
    taken = _taken(sized.drop("text"), _plan(slim, id_column, share, weights, most, small), id_column).where("taken__ > 0")
    copies = F.concat(
        F.when(F.col("taken__") >= F.col("size__"), F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("taken__") / F.col("size__")).cast("int"))).otherwise(F.array().cast("array<long>")),
        F.when(F.col("taken__") % F.col("size__") > 0, F.array(F.col("taken__") % F.col("size__"))).otherwise(F.array().cast("array<long>")),
    )
    rows = taken.withColumn("cut__", F.explode(copies))
    first = F.array_join(F.slice(F.regexp_extract_all("row__.text", F.lit(WORD), F.lit(0)), 1, F.col("cut__").cast("int")), " ")
    cut = F.when(F.col("cut__") > 0, first).otherwise(F.col("row__.text"))
    return recounted(rows.select(F.col("row__").withField("text", cut).alias("row__")).select("row__.*"))
