"""Parsers of annotation formats.  Each takes (file, line_no, value) lines or (file, document) rows; times become whole milliseconds."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The line formats.
_ARROW = r"\s*(?:→|->|—)\s*"
_HMS = r"^\s*\[\s*(\d+):(\d+):(\d+\.\d+)" + _ARROW + r"(\d+):(\d+):(\d+\.\d+)\s*\]\s*(.*)$"
_SECONDS = r"^\s*\[\s*(\d+(?:\.\d+)?)" + _ARROW + r"(\d+(?:\.\d+)?)\s*\]\s*(.*)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, each read whole so that lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return files.select("file", F.posexplode("lines").alias("line_no", "value"))


def read_documents(spark: SparkSession, path: str, name: str = "json") -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias(name))


def _ms(seconds: Column) -> Column:
    return F.bround(seconds.try_cast("double") * 1000, 0).cast("long")


def rttm(lines: DataFrame) -> DataFrame:
    """(file, rec, speaker, start, end) of SPEAKER lines with eight fields or more."""
    f = F.split(F.trim("value"), r"\s+")
    kept = lines.withColumn("f", f).where((F.col("f")[0] == "SPEAKER") & (F.size("f") >= 8))
    start, length = _ms(F.col("f")[3]), _ms(F.col("f")[4])
    return kept.select("file", F.col("f")[1].alias("rec"), F.col("f")[7].alias("speaker"), start.alias("start"), (start + length).alias("end"))


def timed_text(lines: DataFrame) -> DataFrame:
    """(file, line_no, start, end, text) of timed lines, hours first or plain seconds; lines without text are dropped."""
    v = F.col("value")

    def hms(at: int) -> Column:
        part = [F.regexp_extract(v, _HMS, at + i) for i in range(3)]
        return part[0].try_cast("long") * 3_600_000 + part[1].try_cast("long") * 60_000 + _ms(part[2])

    is_hms = v.rlike(_HMS)
    start = F.when(is_hms, hms(1)).otherwise(_ms(F.regexp_extract(v, _SECONDS, 1)))
    end = F.when(is_hms, hms(4)).otherwise(_ms(F.regexp_extract(v, _SECONDS, 2)))
    text = F.trim(F.when(is_hms, F.regexp_extract(v, _HMS, 7)).otherwise(F.regexp_extract(v, _SECONDS, 3)))
    return lines.where(is_hms | v.rlike(_SECONDS)).select(*[c for c in lines.columns if c != "value"], start.alias("start"), end.alias("end"), text.alias("text")).where("text <> ''")


def malformed(lines: DataFrame) -> DataFrame:
    """Lines that open a bracket but are no timed line."""
    return lines.where(F.trim("value").startswith("[") & ~F.col("value").rlike(_HMS) & ~F.col("value").rlike(_SECONDS))


def sectioned_text(lines: DataFrame) -> DataFrame:
    """(file, line_no, speaker, start, end, text): timed lines under ``=== Speaker X ===`` headers, which hold until the next."""
    head = F.regexp_extract("value", r"^===\s*Speaker\s+(\S+).*===\s*$", 1)
    carried = F.last(F.when(head != "", head), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no"))
    return timed_text(lines.withColumn("speaker", carried)).where("speaker is not null")


_EAF = "file string, speaker string, start long, end long, text string"


def eaf(documents: DataFrame) -> DataFrame:
    """(file, speaker, start, end, text) of ELAN documents (file, xml): both time slots known, text not empty, ``Speaker_`` taken off."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, xml in zip(batch["file"], batch["xml"]):
                root = ET.fromstring(xml)
                slots = {s.get("TIME_SLOT_ID"): s.get("TIME_VALUE") for s in root.iter("TIME_SLOT")}
                for tier in root.iter("TIER"):
                    for note in tier.iter("ALIGNABLE_ANNOTATION"):
                        a, b = (slots.get(note.get(f"TIME_SLOT_REF{i}")) for i in (1, 2))
                        text = note.findtext("ANNOTATION_VALUE") or ""
                        if a is not None and b is not None and text.strip():
                            rows.append((str(file), tier.get("TIER_ID", "").removeprefix("Speaker_"), int(a), int(b), text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EAF.split(", ")])

    return documents.select(F.col("file").cast("string").alias("file"), "xml").mapInPandas(parse, _EAF)


_TURN = "array<struct<start:double,end:double,speaker:string>>"


def diarization_json(documents: DataFrame) -> DataFrame:
    """(file, total, speaker, start, end) of (file, json), with turns under ``turns`` or ``segments``.

    A missing or zero ``total_duration_s`` becomes the end of the turn that starts last, or 0.
    """
    parsed = documents.select("file", F.from_json("json", f"turns {_TURN}, segments {_TURN}, total_duration_s double").alias("j"))
    turns = parsed.select("file", F.coalesce("j.turns", "j.segments").alias("turns"), "j.total_duration_s")
    last = F.element_at(F.array_sort("turns"), -1)["end"]
    total = F.coalesce(F.nullif("total_duration_s", F.lit(0.0)), F.when(F.size("turns") > 0, last), F.lit(0.0))
    rows = turns.select("file", total.alias("total"), F.explode("turns").alias("t"))
    return rows.select("file", F.bround(F.col("total") * 1000, 0).cast("long").alias("total"), "t.speaker", F.bround(F.col("t.start") * 1000, 0).cast("long").alias("start"), F.bround(F.col("t.end") * 1000, 0).cast("long").alias("end"))


def done_lines(lines: DataFrame) -> DataFrame:
    """Status lines that say done, not remove, and begin with a fragment id."""
    v = F.col("value")
    return lines.where(v.contains("done") & ~v.contains("remove") & F.split(v, r"\s+")[0].contains("__seg"))


def checkpoint_paths(paths: DataFrame) -> DataFrame:
    """(path, model, task, run) from the levels of ``.../model/task/run/file``."""
    p = F.split("path", "/")
    return paths.where(F.size(p) >= 4).select("path", F.element_at(p, -4).alias("model"), F.element_at(p, -3).alias("task"), F.element_at(p, -2).alias("run"))


def transcripts(lines: DataFrame) -> DataFrame:
    """(rec, mode, speaker, line_no, start, end, text) of ``(rec, mode, file, line_no, value)`` lines of ``transcript_A.txt`` and ``transcript_B.txt``.

    Whichever of the two there is is read; a mode with neither has no rows.
    """
    speaker = F.regexp_extract("file", r"^transcript_([AB])\.txt$", 1)
    return timed_text(lines.withColumn("speaker", speaker).where("speaker <> ''")).drop("file")


def mixtures(lines: DataFrame) -> DataFrame:
    """(rec, mode, line_no, start, end, text) of the lines of ``transcript_mixture.txt``."""
    return timed_text(lines.where("file = 'transcript_mixture.txt'")).drop("file")


def run_of(metadata: DataFrame, diarization: DataFrame, routing: DataFrame) -> DataFrame:
    """(file, label, start, end, backends, n_overlaps) of one row a turn, from a run's three documents (file, json); any but the first may be missing.

    Speakers get the labels that the metadata gives them, or keep their names.
    """
    part = "struct<enabled:boolean,backend:string,model_name:string>"
    form = f"spk_to_label map<string,string>, config struct<enhancement:{part},separation:{part},post_separation_processing:{part},transcription:{part}>"
    meta = metadata.select("file", F.from_json("json", form).alias("m"))

    def backend(stage: str) -> Column:
        return F.coalesce(F.col(f"m.config.{stage}.backend"), F.lit("?"))

    def on(stage: str, yes: Column | str) -> Column:
        return F.when(F.coalesce(F.col(f"m.config.{stage}.enabled"), F.lit(False)), yes).otherwise("off")

    asr = F.trim(F.concat_ws(" ", backend("transcription"), F.coalesce("m.config.transcription.model_name", F.lit(""))))
    parts = {"enh": on("enhancement", backend("enhancement")), "sep": on("separation", F.lit("on")), "bwe": backend("post_separation_processing"), "asr": asr}
    meta = meta.select("file", F.col("m.spk_to_label").alias("names"), F.concat_ws(" · ", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()]).alias("backends"))
    regions = routing.select("file", F.size(F.from_json("json", "overlap_regions array<struct<start:double,end:double>>")["overlap_regions"]).alias("n_overlaps"))
    turns = diarization_json(diarization).select("file", "speaker", "start", "end")
    joined = meta.join(turns, "file", "left").join(regions, "file", "left")
    return joined.select("file", F.coalesce(F.col("names")[F.col("speaker")], F.col("speaker")).alias("label"), "start", "end", "backends", F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"))
