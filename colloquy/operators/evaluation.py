"""Scores of recordings by layer, their summaries, and tables of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import micro_rate
from .metrics import assigned_errors, characters_between, diarization_error, single_stream_errors, speaker_tokens, timed_errors

#: The modes, from all stages to none, and the variants of a corpus.
MODES = ("full", "no_sep", "no_enh", "minimal")
VARIANTS = ("SER", "SR", "ER", "R", "SE", "S", "E", "C")


def reference_turns(recordings: DataFrame, annotated: DataFrame, prepared: DataFrame, key: str = "rec") -> DataFrame:
    """(key, source, speaker, start, end): a recording's annotated turns if it ``has_annotation``, even if that is empty, else its prepared ones."""
    columns = [key, "source", "speaker", "start", "end"]
    first = recordings.where("has_annotation").select(key).join(annotated, key).withColumn("source", F.lit("eaf")).select(columns)
    other = recordings.where("not has_annotation").select(key).join(prepared, key).withColumn("source", F.lit("rttm")).select(columns)
    return first.unionByName(other)


def total_durations(reference: DataFrame, stated: DataFrame, key: str = "rec") -> DataFrame:
    """(key, total): the duration that is stated, else the end of the last reference turn."""
    last = reference.groupBy(key).agg(F.max("end").alias("last"))
    return last.join(stated.where("total is not null").select(key, "total"), key, "left").select(key, F.coalesce("total", "last").alias("total"))


def layer1(reference: DataFrame, hypothesis: DataFrame, stated: DataFrame, key: str = "rec", collar=0, width=None) -> DataFrame:
    """(key, source, miss, false_alarm, confusion, total, der) of recordings with reference turns and a hypothesis; others are left out.  With ``width``
    recordings are scored by stretches, see :func:`metrics.diarization_error`."""
    both = reference.join(hypothesis.select(key).distinct(), key, "left_semi")
    scores = diarization_error(both.drop("source"), hypothesis, [key], totals=total_durations(both, stated, key), collar=collar, width=width)
    return both.select(key, "source").distinct().join(scores, key)


def summary1(recordings: DataFrame, scores: DataFrame, key: str = "rec") -> DataFrame:
    """One row per recording, in percent of the reference speech; a recording without scores keeps a row of nulls."""
    share = F.greatest(F.col("total").cast("double"), F.lit(1e-9))
    percent = {"der_pct": F.col("der"), "miss_pct": F.col("miss") / share, "fa_pct": F.col("false_alarm") / share, "conf_pct": F.col("confusion") / share}
    return recordings.select(key).join(scores.select(key, *[(100 * v).alias(n) for n, v in percent.items()], F.col("total").alias("total_ref")), key, "left")


def with_both_speakers(utterances: DataFrame, key: str = "rec", speakers: Sequence[str] = ("A", "B")) -> DataFrame:
    """The utterances of recordings in which each of ``speakers`` says something."""
    there = utterances.groupBy(key).agg(F.collect_set("speaker").alias("s")).where(F.size(F.array_intersect("s", F.array(*map(F.lit, speakers)))) == len(speakers))
    return utterances.join(there.select(key), key, "left_semi")


def first_mixture(mixtures: DataFrame, key: str = "rec", modes: Sequence[str] = MODES) -> DataFrame:
    """The rows of the first mode, in the order of ``modes``, that has a mixture of the recording."""
    order = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    first = F.min(order).over(Window.partitionBy(key))
    return mixtures.where(order > 0).withColumn("first__", first).where(order == F.col("first__")).drop("first__")


def layer3(reference: DataFrame, hypotheses: DataFrame, mixtures: DataFrame, key: str = "rec", collar: float = 5000.0, speakers: Sequence[str] = ("A", "B")) -> DataFrame:
    """(key, mode, metric, errors, length) of recordings in which both reference speakers talk.

    ``hypotheses`` has (key, mode, speaker, order, tokens, timed) and ``mixtures`` (key, mode, order, tokens); the reference has no mode.  ``timed``
    comes from :func:`metrics.spread_in_time`.  Each mode that has any speaker gets ``cpwer`` and ``tcpwer``; one whose speaker is missing is
    charged for it.  ``mixture`` gets ``orc_wer``: the reference in the order of time.
    """
    spoken = with_both_speakers(reference, key, speakers)
    modes = hypotheses.select(key, "mode").distinct().join(spoken.select(key).distinct(), key, "left_semi")
    on = [key, "mode"]

    def streams(rows: DataFrame, tokens: str, by: list[str]) -> DataFrame:
        return speaker_tokens(rows, F.col(tokens), by, "speaker", "order")

    out = None
    for metric, tokens, errors in (("cpwer", "tokens", None), ("tcpwer", "timed", timed_errors(collar))):
        ref = modes.join(streams(spoken, tokens, [key]), key)
        hyp = streams(hypotheses, tokens, on).join(modes, on, "left_semi")
        scored = (assigned_errors(ref, hyp, on, errors_of=errors) if errors else assigned_errors(ref, hyp, on)).withColumn("metric", F.lit(metric))
        out = scored if out is None else out.unionByName(scored)
    one = first_mixture(mixtures, key).withColumn("speaker", F.lit("all"))
    mixed = single_stream_errors(streams(spoken.withColumn("speaker", F.lit("all")), "tokens", [key]).join(one.select(key).distinct(), key, "left_semi"), streams(one, "tokens", [key]), [key])
    return out.unionByName(mixed.select(key, F.lit("mixture").alias("mode"), "errors", "length", F.lit("orc_wer").alias("metric")))


def summary3(scores: DataFrame, key: str = "rec", modes: Sequence[str] = MODES) -> DataFrame:
    """One row per scored recording, in percent: cpWER of each mode, tcpWER of the full one, the mixture; null where there is none."""
    rate = 100.0 * F.col("errors") / F.greatest("length", F.lit(1))
    names = [*[f"{m}_cpwer" for m in modes], f"{modes[0]}_tcpwer", "mixture_orc_wer"]
    return scores.withColumn("name", F.concat_ws("_", "mode", "metric")).groupBy(key).pivot("name", names).agg(F.first(rate))


def wide_row(scores: DataFrame, keys: Sequence[str], values: Sequence[str], variant: str = "variant", variants: Sequence[str] = VARIANTS) -> DataFrame:
    """One row per ``keys``: the mean of each value over the variants that were run, and a text column per value and variant, '' where it was not."""
    cells = [F.coalesce(F.max(F.when(F.col(variant) == v, F.col(c).cast("string"))), F.lit("")).alias(f"{c}_{v}") for v in variants for c in values]
    return scores.groupBy(*keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in values], *cells)


def attribution_gap(assigned: Column, mixed: Column) -> Column:
    """What the attribution of words to speakers costs: the rate under the best assignment less the rate without any."""
    return assigned - mixed


def time_ordered_characters(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, errors, length): character errors of one stream against all utterances in the order of time; (keys, order, tokens) both."""
    ref, hyp = (speaker_tokens(t.withColumn("speaker", F.lit("all")), F.col("tokens"), list(keys), "speaker", "order") for t in (reference, hypothesis))
    joined = ref.select(*keys, F.col("tokens").alias("a")).join(hyp.select(*keys, F.col("tokens").alias("b")), list(keys), "left")
    return characters_between(joined, keys)


def config_table(scores: DataFrame, mixtures: DataFrame, config: str = "config", metrics: Sequence[str] = ("cp", "orc", "cer"), floor: str = "mixture (floor)") -> DataFrame:
    """Micro-averaged rates of each config, best first, and under them a row of the mixture over all fragments.

    Both tables have (metric, errors, length); ``mixtures`` has no config.  Ranks begin at 1, the floor has none.
    """

    def rate(m: str) -> Column:
        return micro_rate(F.when(F.col("metric") == m, F.col("errors")), F.when(F.col("metric") == m, F.col("length"))).alias(m)

    rows = scores.groupBy(config).agg(*map(rate, metrics))
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(metrics[0]), F.col(config))))  # a row a config
    return ranked.unionByName(mixtures.agg(*map(rate, metrics)).withColumn(config, F.lit(floor)).withColumn("rank", F.lit(None).cast("int")))


def anchor_decision(straight: Column, swapped: Column, samples: Column, has_anchors: Column, least: int) -> Column:
    """How two separated streams go to the first two speakers: a struct of ``pairing`` and ``swap``.

    Too short a stream, a missing anchor or a similarity that is not finite leaves them as they are, each with its reason; a tie is straight.
    """

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    pairing = (
        F.when(samples < least, "arbitrary (too short)")
        .when(~has_anchors, "arbitrary (weak anchor)")
        .when(~(finite(straight) & finite(swapped)), "arbitrary (non-finite cosine)")
        .when(straight >= swapped, "straight")
        .otherwise("swapped")
    )
    return F.struct(pairing.alias("pairing"), (pairing == "swapped").alias("swap"))


def with_text(results: DataFrame, language: str) -> DataFrame:
    """``results`` (.., text, segments, language) with a missing text joined from the segments' trimmed texts and a missing language filled in."""
    joined = F.trim(F.array_join(F.transform("segments", lambda s: F.trim(F.coalesce(s["text"], F.lit("")))), " "))
    return results.withColumn("text", F.coalesce("text", joined, F.lit(""))).withColumn("language", F.coalesce("language", F.lit(language)))
