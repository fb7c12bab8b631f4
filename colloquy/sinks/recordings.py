"""Files of recordings, written with a commit: nothing is in place before all of it is, and a second run changes only what has changed."""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import lines

SCHEMA = "folder string, file string, content binary"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    """The folder of a task attempt whose files are ready to be put in place."""

    folder: str


class FilesWriter(DataSourceWriter):
    """Each row is a file.  A task writes what differs from what is there into a folder of its own; the commit moves these files to their places, one
    rename each, and removes the folders of all attempts.  A task that dies leaves nothing in place, nor does a write that is aborted."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        fs, root = _filesystem(self.path)
        own = posixpath.join(root, self.job, str(TaskContext.get().taskAttemptId()))
        for row in iterator:
            place = posixpath.normpath(posixpath.join(row["folder"], row["file"]))
            if place.startswith(("..", "/", "_writing-")):
                raise ValueError(f"{place} is not a place under the folder that is written")
            content = bytes(row["content"])
            if _same(fs, posixpath.join(root, place), content):
                continue
            target = posixpath.join(own, place)
            fs.create_dir(posixpath.dirname(target), recursive=True)
            with fs.open_output_stream(target) as out:
                out.write(content)
        return _Written(own)

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        for message in messages:
            if message is None:
                continue
            for found in fs.get_file_info(pafs.FileSelector(message.folder, recursive=True, allow_not_found=True)):
                if found.is_file:
                    target = posixpath.join(root, posixpath.relpath(found.path, message.folder))
                    fs.create_dir(posixpath.dirname(target), recursive=True)
                    fs.move(found.path, target)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = _filesystem(self.path)
        folder = posixpath.join(root, self.job)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


def _same(fs: pafs.FileSystem, path: str, content: bytes) -> bool:
    there = fs.get_file_info(path)
    if not there.is_file or there.size != len(content):
        return False
    with fs.open_input_stream(path) as f:
        return f.read() == content


class RecordingFiles(DataSource):
    """``format("recording_files")`` for rows of ``SCHEMA``; the option path names the folder."""

    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Write rows (folder, file, content) as files under ``path``; files that are there with the same content are not touched, others stay."""
    files.sparkSession.dataSource.register(RecordingFiles)
    content = F.col("content").cast("binary")
    files.select("folder", "file", content.alias("content")).write.format("recording_files").mode("append").option("path", path).save()


def wav(chunks: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """(keys, content): WAV files of 16 bit from the pieces (keys, offset, x) of each signal; gaps between pieces are silent.

    A file is one row by nature, so its pieces meet in one task; they travel as bytes.
    """

    def bytes_of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: (np.clip(np.asarray(v, float), -1, 1 - 2**-15) * (1 << 15)).round().astype("<i2").tobytes())

    packed = chunks.select(*keys, "offset", F.pandas_udf(bytes_of, "binary")("x").alias("raw"))
    pieces = packed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("offset", "raw"))).alias("pieces"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for parts in batch["pieces"]:
                data = io.BytesIO()
                for p in parts:
                    data.seek(2 * p["offset"])
                    data.write(p["raw"])
                body = data.getvalue()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body))
                out.append(head + body)
            yield batch[keys].assign(content=out)

    types = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)
    return pieces.mapInPandas(build, f"{types}, content binary")


def pipeline_files(
    recordings: DataFrame, turns: DataFrame | None = None, regions: DataFrame | None = None, utterances: DataFrame | None = None, mixture: DataFrame | None = None,
    streams: DataFrame | None = None, rate: int = 16_000, subfolder: str = "pipeline",
) -> DataFrame:
    """Rows of ``SCHEMA``, the layout of a recording's outputs; what did not run is left out.

    ``recordings`` (rec, and what else metadata.json shall say; secrets are redacted before, see :func:`files.redacted`); ``turns`` and ``regions``
    (rec, speaker, start, end in ms); ``utterances`` (rec, label, utt_no, start, end, text) and ``mixture``, the same without a label;
    ``streams`` (rec, label, offset, x).  diarization.json, routing.json, stream_<label>.wav, transcript_<label>.txt and .json, the same of the mixture,
    annotation.eaf and metadata.json.
    """
    folder = F.concat_ws("/", F.col("rec").cast("string"), F.lit(subfolder))

    def files(rows: DataFrame, name) -> DataFrame:
        return rows.select(folder.alias("folder"), (F.lit(name) if isinstance(name, str) else name).alias("file"), F.col("value").cast("binary").alias("content"))

    def of_speaker(stem: str, ending: str):
        return F.concat(F.lit(f"{stem}_"), "label", F.lit(ending))

    out = [files(recordings.select("rec", F.to_json(F.struct(*recordings.columns)).alias("value")), "metadata.json")]
    if turns is not None:
        out.append(files(lines.diarization_json(turns), "diarization.json"))
    if regions is not None:
        region = F.struct((F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"))
        out.append(files(regions.groupBy("rec").agg(F.to_json(F.struct(F.sort_array(F.collect_list(region)).alias("overlap_regions"))).alias("value")), "routing.json"))
    for spoken, text_name, json_name in ((utterances, of_speaker("transcript", ".txt"), of_speaker("transcript", ".json")), (mixture, "transcript_mixture.txt", "transcript_mixture.json")):
        if spoken is None:
            continue
        keys = [c for c in ("rec", "label") if c in spoken.columns]
        line = spoken.withColumn("line", lines.timed_line(F.col("start"), F.col("end"), F.col("text")))
        parts = F.sort_array(F.collect_list(F.struct("utt_no", "line", (F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"), "text")))
        whole = line.groupBy(*keys).agg(parts.alias("parts"))
        out.append(files(whole.withColumn("value", F.concat(F.array_join(F.transform("parts", lambda p: p["line"]), "\n"), F.lit("\n"))), text_name))
        said = F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text")))
        out.append(files(whole.withColumn("value", F.to_json(F.struct(said.alias("segments")))), json_name))
    if utterances is not None:
        out.append(files(lines.eaf(utterances.withColumnRenamed("label", "speaker")).withColumn("rec", F.col("rec")), "annotation.eaf"))
    if streams is not None:
        out.append(files(wav(streams, ["rec", "label"], rate).withColumnRenamed("content", "value"), of_speaker("stream", ".wav")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
