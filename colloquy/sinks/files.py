"""Writers that can be run again: what is there already is not written twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import settled


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose ``keys`` the Parquet table at ``path`` lacks; how many there were.

    What is new is settled before the table is touched, and a call after one that failed looks again at what is there, so no row comes in twice.
    """
    spark = rows.sparkSession
    try:
        fresh = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = rows
    fresh = settled(fresh)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def write_stages(stages: dict[str, DataFrame | None], root: str, key: str = "rec") -> list[str]:
    """Each populated stage as a Parquet table by recording under ``root``; stages that did not run leave nothing."""
    done = []
    for name, frame in stages.items():
        if frame is not None:
            frame.write.mode("overwrite").partitionBy(key).parquet(f"{root}/{name}")
            done.append(name)
    return done


def manifest(selection: DataFrame, metadata: DataFrame, key: str = "rec") -> DataFrame:
    """The selection with each recording's metadata; a recording without any keeps its rows."""
    return selection.join(metadata.dropDuplicates([key]), key, "left")


def redacted(config: DataFrame, column: str, fields: list[str], mark: str = "***") -> DataFrame:
    """``config`` with the named fields of a struct replaced where they are set."""
    value = F.col(column)
    for f in fields:
        value = value.withField(f, F.when(F.col(f"{column}.{f}").isNotNull(), F.lit(mark)))
    return config.withColumn(column, value)


def holds_secret(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows of generated text that show an access token, which must not be published."""
    return text.where(F.col(column).rlike("hf_[A-Za-z0-9]{20,}"))


def clips(chosen: DataFrame, audio: DataFrame, key: str, rate: int, samples: str = "x") -> DataFrame:
    """``chosen`` (key, start, end in seconds, ..) with the ``clip`` of its recording's ``samples``; a recording without audio gives none."""
    low, high = ((F.col(c) * rate).cast("int") for c in ("start", "end"))
    cut = F.slice(samples, low + 1, F.greatest(high - low, F.lit(0)))
    return chosen.join(audio.select(key, samples), key).withColumn("clip", cut).drop(samples)


def not_written(rows: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` are not among those ``written`` already."""
    return rows.join(written.select(*keys).distinct(), keys, "left_anti")


def write_table(rows: DataFrame, path: str, columns: list[str], optional: tuple[str, ...] = (), order: list | None = None) -> None:
    """One CSV with a header: ``columns``, and those ``optional`` ones that the rows have; ranked by ``order``, for a table that fits one file."""
    kept = rows.select(*columns, *[c for c in optional if c in rows.columns])
    kept = kept.orderBy(*order).coalesce(1) if order else kept.coalesce(1)
    kept.write.mode("overwrite").csv(path, header=True)
