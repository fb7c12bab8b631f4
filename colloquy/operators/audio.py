"""Operators on signals that span rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import apply_model


def overlap_add(chunks: DataFrame, keys: Sequence[str], width: int, floor: float = 1e-8) -> DataFrame:
    """(keys, t, y): chunks (keys, offset, x) of ``width`` samples under symmetric Hann weights (0 at both ends), summed where they overlap and divided by their weight.

    One row per sample, so that no signal is ever one row; the sums are pre-aggregated where the chunks are.
    """
    samples = chunks.select(*keys, "offset", F.posexplode("x").alias("i", "v"))
    weight = 0.5 - 0.5 * F.cos(2 * 3.141592653589793 * F.col("i") / max(width - 1, 1))
    rows = samples.select(*keys, (F.col("offset") + F.col("i")).alias("t"), (F.col("v") * weight).alias("vw"), weight.alias("w"))
    return rows.groupBy(*keys, "t").agg((F.sum("vw") / F.greatest(F.sum("w"), F.lit(floor))).alias("y"))


def in_chunks(signals: DataFrame, keys: Sequence[str], width: int, samples: str = "x") -> DataFrame:
    """(keys, offset, x): each signal in pieces of ``width`` samples, each beginning half a width after the one before; the last may be shorter."""
    hop = width // 2
    count = F.ceil(F.greatest(F.size(samples) - width, F.lit(0)) / hop)
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), count), lambda k: F.struct((k * hop).alias("offset"), F.slice(samples, (k * hop + 1).cast("int"), width).alias("x")))
    return signals.where(F.size(samples) > 0).select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*")


def process_in_chunks(signals: DataFrame, keys: Sequence[str], width: int, load: Callable, signature: str, samples: str = "x") -> DataFrame:
    """(keys, t, y): signals put through a model chunk by chunk and overlap-added; see :func:`models.apply_model`.

    The model gives back at least as many samples as a chunk has; a signal of one chunk is its output as it is.
    """
    done = apply_model(in_chunks(signals, keys, width, samples), "x", load, signature, "out", "array<double>")
    cut = done.select(*keys, "offset", F.slice("out", F.lit(1), F.size("x")).alias("x"))
    lone = F.max("offset").over(Window.partitionBy(*keys)) == 0
    tagged = cut.withColumn("lone__", lone)
    short = tagged.where("lone__").select(*keys, F.posexplode("x").alias("t", "y")).withColumn("t", F.col("t").cast("long"))
    return short.unionByName(overlap_add(tagged.where("not lone__").drop("lone__"), keys, width))
