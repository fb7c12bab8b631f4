"""Discovery of evaluation trees: ``root/dataset/id`` with optional files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recordings(spark: SparkSession, root: str, dataset: str | None = None) -> DataFrame:
    """(dataset, id, audio, annotation, rttm, references, modes) of each recording that has audio.

    Spark lists the files; their content is not read.  Audio is ``<id>.wav`` or else ``mixture.wav``; ``modes`` are the ``pipeline*`` folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{dataset}" if dataset else root).select("path")
    depth = len(root.rstrip("/").split("/"))
    p = F.split(F.regexp_replace("path", "^file:/+", "/"), "/")
    rel = files.select("path", F.element_at(p, depth + 1).alias("dataset"), F.element_at(p, depth + 2).alias("id"), F.slice(p, depth + 3, 99).alias("rest"))
    name = F.array_join("rest", "/")

    def file(test):
        return F.first(F.when(test, F.col("path")), ignorenulls=True)

    found = rel.groupBy("dataset", "id").agg(
        F.coalesce(file(name == F.concat("id", F.lit(".wav"))), file(name == "mixture.wav")).alias("audio"),
        file(name == "annotation.eaf").alias("annotation"),
        file(name == "reference/diarization.rttm").alias("rttm"),
        F.map_from_entries(F.sort_array(F.collect_set(F.when(name.rlike(r"^reference/speaker_[A-Z]\.txt$"), F.struct(F.regexp_extract(name, r"speaker_([A-Z])", 1).alias("speaker"), F.col("path").alias("path")))))).alias("references"),
        F.sort_array(F.collect_set(F.when(F.col("rest")[0].startswith("pipeline") & (F.size("rest") > 1), F.col("rest")[0]))).alias("modes"),
    )
    return found.where("audio is not null")


def inventory(catalog: DataFrame) -> DataFrame:
    """What each recording has."""
    return catalog.select("dataset", "id", F.col("annotation").isNotNull().alias("has_eaf"), F.col("rttm").isNotNull().alias("has_rttm"), (F.size("references") > 0).alias("has_text"), F.size("modes").alias("n_modes"))


def preferred_reference(eaf: DataFrame, text: DataFrame, keys: list[str]) -> DataFrame:
    """Utterances of ``eaf``; those of ``text`` only for recordings without any of them."""
    return eaf.unionByName(text.join(eaf.select(*keys).distinct(), keys, "left_anti"))
