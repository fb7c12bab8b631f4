"""Annotation formats as text.  Times are milliseconds."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, collapse


def seconds(ms: Column, form: str = "%.3f") -> Column:
    return F.format_string(form, ms / 1000.0)


def rttm(turns: DataFrame) -> DataFrame:
    """(rec, line_no, value): SPEAKER lines of (rec, speaker, start, end) in time order; turns of no length are left out."""
    n = F.row_number().over(Window.partitionBy("rec").orderBy("start", "end", "speaker"))
    length = F.col("end") - F.col("start")
    value = F.concat_ws(" ", F.lit("SPEAKER"), "rec", F.lit("1"), seconds(F.col("start")), seconds(length), F.lit("<NA> <NA>"), "speaker", F.lit("<NA> <NA>"))
    return turns.where(length > 0).select("rec", n.cast("long").alias("line_no"), value.alias("value"))


def timed_line(start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("["), seconds(start, "%6.2f"), F.lit(" → "), seconds(end, "%6.2f"), F.lit("]  "), collapse(text))


def transcript(utterances: DataFrame) -> DataFrame:
    """(rec, line_no, value): one timed line an utterance (rec, utt_no, start, end, text)."""
    return utterances.select("rec", F.col("utt_no").alias("line_no"), timed_line(F.col("start"), F.col("end"), F.col("text")).alias("value"))


def srt(utterances: DataFrame) -> DataFrame:
    """(rec, cue, value): subtitle cues.  Empty utterances make no cue but are counted."""
    head = F.concat(F.col("utt_no").cast("string"), F.lit("\n"), clock(F.col("start")), F.lit(" --> "), clock(F.col("end")), F.lit("\n["), "speaker", F.lit("] "), F.trim("text"))
    return utterances.where(F.trim("text") != "").select("rec", F.col("utt_no").alias("cue"), head.alias("value"))


def time_slots(utterances: DataFrame) -> DataFrame:
    """(rec, t, slot): the distinct boundaries of a recording, numbered from 1; an utterance is at least 1 ms wide."""
    ends = utterances.select("rec", F.col("start").alias("t")).union(utterances.select("rec", F.greatest("end", F.col("start") + 1))).distinct()
    return ends.withColumn("slot", F.dense_rank().over(Window.partitionBy("rec").orderBy("t")).cast("long"))


def eaf(utterances: DataFrame) -> DataFrame:
    """(rec, value): one ELAN document per recording, a tier per speaker.  Boundaries are numbered by joins; only the XML is put together in Python."""
    slots = time_slots(utterances)
    placed = utterances.withColumn("until", F.greatest("end", F.col("start") + 1)).select("rec", "speaker", "utt_no", "start", "until", "text")
    placed = placed.join(slots.select("rec", F.col("t").alias("start"), F.col("slot").alias("a")), ["rec", "start"]).join(slots.select("rec", F.col("t").alias("until"), F.col("slot").alias("b")), ["rec", "until"])
    per = placed.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("speaker", "utt_no", "a", "b", "start", "until", "text"))).alias("rows"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rec, rows in zip(batch["rec"], batch["rows"]):
                root = ET.Element("ANNOTATION_DOCUMENT")
                order = ET.SubElement(root, "TIME_ORDER")
                for slot, t in sorted({(r["a"], r["start"]) for r in rows} | {(r["b"], r["until"]) for r in rows}):
                    ET.SubElement(order, "TIME_SLOT", TIME_SLOT_ID=f"ts{slot}", TIME_VALUE=str(t))
                tiers: dict[str, ET.Element] = {}
                for n, r in enumerate(rows, 1):
                    tier = tiers.get(r["speaker"])
                    if tier is None:
                        tier = tiers[r["speaker"]] = ET.SubElement(root, "TIER", TIER_ID=f"Speaker_{r['speaker']}")
                    note = ET.SubElement(ET.SubElement(tier, "ANNOTATION"), "ALIGNABLE_ANNOTATION", ANNOTATION_ID=f"a{n}", TIME_SLOT_REF1=f"ts{r['a']}", TIME_SLOT_REF2=f"ts{r['b']}")
                    ET.SubElement(note, "ANNOTATION_VALUE").text = r["text"]
                out.append((str(rec), ET.tostring(root, encoding="unicode")))
            yield pd.DataFrame(out, columns=["rec", "value"])

    return per.mapInPandas(build, "rec string, value string")


def diarization_json(turns: DataFrame) -> DataFrame:
    """(rec, value): one JSON document per recording with its turns in seconds and its length."""
    turn = F.struct((F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"), "speaker")
    per = turns.groupBy("rec").agg(F.sort_array(F.collect_list(turn)).alias("turns"), (F.max("end") / 1000.0).alias("total_duration_s"))
    return per.select("rec", F.to_json(F.struct("turns", "total_duration_s")).alias("value"))


def joined(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, value): the lines of a key in order as one text."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["l"]), "\n").alias("value"))


def write_lines(lines: DataFrame, path: str, key: str = "rec") -> None:
    """One folder of text per ``key``, lines in order."""
    lines.repartition(key).sortWithinPartitions(key, "line_no").select(key, "value").write.partitionBy(key).mode("overwrite").text(path)


def snippet(columns: list[str]) -> Column:
    """The columns as ``name: value`` lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns])


def payload(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, value): a JSON document per key with its rows in order, for a page that shows them."""
    others = [c for c in rows.columns if c not in (key, order)]
    nested = F.sort_array(F.collect_list(F.struct(order, *others))).alias("rows")
    return rows.groupBy(key).agg(nested).select(key, F.to_json(F.struct(key, "rows")).alias("value"))
