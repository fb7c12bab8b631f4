"""Tabular sources with fixed schemas; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the files, and the variants with and without reverberation.
INDOOR, OUTDOOR = ("SER", "SR", "ER", "R", "C"), ("SE", "S", "E", "C")
CORPUS = "mixFile string, speaker1File string, speaker2File string, sceneFile string, eventFile string, reverbForSpeaker1 string, reverbForSpeaker2 string, reverbForEvent string"
MEETING = "start_s double, end_s double, speaker string, utterance_id string, text string"
RUNS = "Name string, State string, best_val_sisdr double, lr double, weight_decay double, grad_clip_norm double, lr_factor double, lr_patience double, epoch long, early_stopped boolean, train_si_sdr double, train_lr double, Runtime double"


_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str) -> Callable:
    """Register a function that reads a table, by name."""

    def add(read: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _SOURCES:
            raise ValueError(f"{name} is registered already")
        _SOURCES[name] = read
        return read

    return add


def source(name: str) -> Callable[..., DataFrame]:
    if name not in _SOURCES:
        raise KeyError(f"no source {name}; there are {sorted(_SOURCES)}")
    return _SOURCES[name]


@register_source("corpus")
def corpus_manifest(spark: SparkSession, folder: str, root: str, subset: str) -> DataFrame:
    return spark.read.schema(CORPUS).csv(f"{folder}/corpus_{root}_{subset}_final.csv", header=True)


def indoor_filter(manifest: DataFrame, variants: list[str], indoor=INDOOR, outdoor=OUTDOOR) -> DataFrame:
    """Rows with reverberation if any of ``variants`` is of ``indoor`` and none of ``outdoor``, rows without in the opposite case, else all."""
    with_it, without = any(v in indoor for v in variants), any(v in outdoor for v in variants)
    if with_it != without:
        return manifest.where(f"reverbForSpeaker1 is {'not ' if with_it else ''}null")
    return manifest


def semicolon_paths(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed, non-blank ``path`` column of a semicolon-separated file."""
    rows = spark.read.option("sep", ";").option("header", True).csv(path)
    return rows.select(F.trim("path").alias("path")).where("path <> ''")


@register_source("meeting")
def meeting_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEETING).csv(path, sep="\t", header=True)


@register_source("segments")
def segment_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated turns of speakers A and B; lines that begin with # are left out."""
    return spark.read.schema("start_s double, end_s double, speaker string, utterance_id string, text string").csv(path, sep="\t", comment="#").where(F.col("speaker").isin("A", "B"))


def run_exports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Finished runs of several exports, each tagged with its name in ``paths``."""
    out = None
    for tag, path in paths.items():
        rows = spark.read.schema(RUNS).csv(path, header=True).where("State = 'finished'").withColumn("sweep_type", F.lit(tag))
        out = rows if out is None else out.unionByName(rows)
    return out


def utterance_parquet(spark: SparkSession, path: str) -> DataFrame:
    """(speaker, text, path): the audio bytes beside the nested path are never read."""
    rows = spark.read.parquet(path).select("speaker", "text", F.col("audio.path").alias("path"))
    return rows.where("speaker is not null and path is not null")


def metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comma-separated table with a header, by its schema."""
    return spark.read.schema(schema).csv(path, header=True)


def joined_by_name(sides: dict[str, DataFrame], name: str) -> DataFrame:
    """The sides joined by ``name``; a name that a side lacks raises when the rows are read."""
    out = None
    for side, rows in sides.items():
        tagged = rows.withColumn(f"{side}__", F.lit(True))
        out = tagged if out is None else out.join(tagged, name, "full")
    missing = [F.when(F.col(f"{side}__").isNull(), F.lit(side)) for side in sides]
    absent = F.concat_ws(", ", *missing)
    checked = F.when(absent == "", F.col(name)).otherwise(F.raise_error(F.concat(F.lit("no "), absent, F.lit(" for "), F.col(name).cast("string"))).cast(out.schema[name].dataType))
    return out.withColumn(name, checked).drop(*[f"{side}__" for side in sides])


# The forms of names.
_AUDIO, _SPEAKER, _SESSION, _CHANNEL = r"^(.+)-([0-9]+)\.wav$", r"^(.+)-([AB])$", r"session([0-9]+)", r"^(.+)_([LR])\.txt$"


def _parts(value: Column, form: str, names: tuple[str, str], second: str) -> Column:
    found = [F.regexp_extract(value, form, i) for i in (1, 2)]
    return F.when(value.rlike(form), F.struct(found[0].alias(names[0]), found[1].cast(second).alias(names[1]))).otherwise(F.lit(None))


def audio_path(value: Column) -> Column:
    """``conv-idx.wav`` as (conv, idx), null where it is none."""
    return _parts(value, _AUDIO, ("conv", "idx"), "long")


def speaker_id(value: Column) -> Column:
    """``conv-A`` as (conv, label), null where it is none."""
    return _parts(value, _SPEAKER, ("conv", "label"), "string")


def session_of(value: Column) -> Column:
    """The ``sessionN`` in a name, else the name."""
    found = F.regexp_extract(value, _SESSION, 1)
    return F.when(found != "", F.concat(F.lit("session"), found)).otherwise(value)


def channel_file(value: Column) -> Column:
    """``id_L.txt`` as (id, channel), null where it is none."""
    return _parts(value, _CHANNEL, ("id", "channel"), "string")


def renamed_prefix(value: Column, old: str, new: str) -> Column:
    """``value`` with the first ``old`` replaced."""
    at = F.instr(value, old)
    return F.when(at > 0, F.concat(F.substr(value, F.lit(1), at - 1), F.lit(new), F.substr(value, at + len(old)))).otherwise(value)
