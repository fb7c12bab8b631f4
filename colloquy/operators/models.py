"""Models as operators: anything that maps arrays to values, loaded once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

_LOADED: dict[str, Any] = {}
_SOURCES: dict[str, Callable] = {}


def register(name: str) -> Callable:
    """Register a loader: a function without arguments that returns a function from a series to a series."""

    def add(loader: Callable) -> Callable:
        if name in _SOURCES:
            raise ValueError(f"{name} is registered already")
        _SOURCES[name] = loader
        return loader

    return add


def loader(name: str) -> Callable:
    if name not in _SOURCES:
        raise KeyError(f"no model {name}; there are {sorted(_SOURCES)}")
    return _SOURCES[name]


def apply_model(rows: DataFrame, column: str, load: Callable[[], Callable[[pd.Series], pd.Series]], signature: str, into: str, kind: str) -> DataFrame:
    """``rows`` with ``into`` computed from ``column`` by a model that each worker loads once per ``signature``.

    A model that gives way to another is told by its ``unload``, if it has one.
    """
    schema = StructType([*rows.schema.fields]).add(into, _parse_datatype_string(kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _LOADED.get(signature)
        if model is None:
            for old in _LOADED.values():  # one model at a time stays in memory
                getattr(old, "unload", lambda: None)()
            _LOADED.clear()
            model = _LOADED[signature] = load()
        for batch in batches:
            yield batch.assign(**{into: model(batch[column])})

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class Stage:
    """A named step from rows to rows.  Stages that are not enabled are passed over."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    enabled: bool = True


def run_stages(rows: DataFrame, stages: Sequence[Stage], spill: str | None = None, resume: bool = False) -> DataFrame:
    """``rows`` put through the stages.  With ``spill`` each stage's rows are written as Parquet under that folder and read again, which ends their
    lineage; with ``resume`` a stage that was written to its end before is read and not run."""
    spark = rows.sparkSession
    for stage in stages:
        if not stage.enabled:
            continue
        path = f"{spill}/{stage.name}"
        if not (spill and resume and _written(spark, path)):
            rows = stage.run(rows)
            if spill:
                rows.write.mode("overwrite").parquet(path)
        if spill:
            rows = spark.read.parquet(path)
    return rows


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has come to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)
