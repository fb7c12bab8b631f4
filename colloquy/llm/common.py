"""Helpers shared by the operators: storage for intermediate tables, text conventions and sorted-group kernels."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, _UPPER, _UPPER.lower())


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no column added beside it can clash with them; ``select("row__.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__")


def recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where there is such a column, of the text as it is now; a null text keeps what it had."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can read.

    It is the session's ``spark.checkpoint.dir``; only where none is set and the session runs on one machine a temporary folder takes its place.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(named)
    return named


def saved(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: its lineage ends there and a lost executor costs no recomputation."""
    path = f"{shared_dir(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by :func:`saved` that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_saved_at", None)
        if path:
            jvm = frame.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def texts(batch: pa.RecordBatch, name: str = "text", step: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in short runs, so that few of them exist as Python strings at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    for at in range(0, batch.num_rows, step):
        yield at, column.slice(at, step).to_pylist()


def release() -> None:
    """Give memory that a worker has freed back to the system; workers live on between tasks, beside others on the same executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(frame: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``frame.mapInArrow`` whose workers release what a task has used when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            release()

    return frame.mapInArrow(run, schema)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 100_000) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by the integer ``key`` so that no group is cut in two."""
    held: list[pa.RecordBatch] = []
    count, wanted = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < wanted:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count, wanted = table.num_rows - cut, rows
        else:
            wanted = 2 * count
    if held:
        yield pa.Table.from_batches(held)


def pairs(keys: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs with equal keys (``keys`` sorted), at most about ``most`` of them at a time."""
    n = len(keys)
    if n < 2:
        return
    ends = np.searchsorted(keys, keys, "right")
    after = ends - np.arange(n) - 1
    total = np.cumsum(after)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        here = after[at:to]
        left = np.repeat(np.arange(at, to), here)
        if len(left):
            first = np.cumsum(here) - here
            yield left, left + 1 + np.arange(len(left)) - np.repeat(first, here)
        at = to


def labels(n: int, left: np.ndarray, right: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """For positions 0..n-1 the smallest position each is connected to, given edges; ``start`` holds labels found before."""
    out = np.arange(n) if start is None else start.copy()
    if not len(left):
        return out
    while True:
        low = np.minimum(out[left], out[right])
        before = out.copy()
        np.minimum.at(out, before[left], low)
        np.minimum.at(out, before[right], low)
        while not np.array_equal(out, jumped := out[out]):
            out = jumped
        if np.array_equal(out, before):
            return out
