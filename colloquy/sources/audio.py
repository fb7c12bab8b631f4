"""WAV files as rows of samples.  A long recording is many rows of at most ``chunk_s`` seconds, read by byte ranges, so that neither a row nor a task
ever holds a whole recording."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sr int, chunk_no int, samples array<float>"
#: Bytes of files that one task reads.
SPLIT = 64 << 20


@dataclass(frozen=True)
class Format:
    """What the header of a WAV file says: where its frames are and what they are made of."""

    rate: int
    channels: int
    width: int
    floats: bool
    begin: int
    frames: int


def header(f, size: int) -> Format:
    """The format of an open file of ``size`` bytes: RIFF or RF64, PCM of 8, 16, 24 or 32 bit or floats of 32 or 64 bit, the extensible form included."""
    f.seek(0)
    top = f.read(12)
    if top[:4] not in (b"RIFF", b"RF64") or top[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, long_size = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            long_size = struct.unpack("<Q", f.read(16)[8:])[0]
        elif name == b"fmt ":
            body = f.read(min(n, 40))
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            code = struct.unpack("<H", body[24:26])[0] if code == 0xFFFE and len(body) >= 26 else code
            form = code, channels, rate, bits
        elif name == b"data":
            if form is None:
                break
            code, channels, rate, bits = form
            if (code, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
                raise ValueError(f"format {code} of {bits} bit is not known")
            # a length that was never filled in, or is beyond the file, means its rest
            n = long_size if long_size is not None and n == 0xFFFFFFFF else n
            n = size - at - 8 if n in (0, 0xFFFFFFFF) else min(n, size - at - 8)
            return Format(rate, channels, bits // 8, code == 3, at + 8, n // (channels * bits // 8))
        at += 8 + n + n % 2
    raise ValueError("a WAV file without data")


def samples(raw: bytes, form: Format) -> np.ndarray:
    """Mono samples in [-1, 1) of whole frames; channels are averaged."""
    if form.floats:
        x = np.frombuffer(raw, f"<f{form.width}").astype(np.float64)
    elif form.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif form.width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel().astype(np.float64) / (1 << 31)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[form.width]).astype(np.float64) / (1 << 8 * form.width - 1)
    return x.reshape(-1, form.channels).mean(1)


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples) of a whole file."""
    f = io.BytesIO(raw)
    form = header(f, len(raw))
    f.seek(form.begin)
    return form.rate, samples(f.read(form.frames * form.channels * form.width), form)


def resampled(read: Callable[[int, int], np.ndarray], frames: int, rate: int, to: int, first: int, count: int, crossings: int = 32) -> np.ndarray:
    """``count`` samples at rate ``to`` from number ``first`` on, of a signal of ``frames`` samples of which ``read(a, b)`` gives any stretch.

    Windowed-sinc interpolation, low-passed at the lower of the two Nyquist rates.  A sample depends on its number only and not on where a
    stretch begins, so stretches fit together.
    """
    band = min(1.0, to / rate)
    reach = int(np.ceil(crossings / band))
    out = np.empty(count)
    for at in range(0, count, 16_384):
        t = np.arange(first + at, first + min(at + 16_384, count)) * rate / to
        taps = (np.floor(t).astype(np.int64) - reach + 1)[:, None] + np.arange(2 * reach)
        low, high = max(int(taps[0, 0]), 0), min(int(taps[-1, -1]) + 1, frames)
        near = np.concatenate([read(low, high) if high > low else np.zeros(0), [0.0]])  # the last stands for all beyond the signal
        away = t[:, None] - taps
        weight = band * np.sinc(band * away) * np.cos(np.pi / 2 * np.clip(away / reach, -1, 1)) ** 2
        out[at : at + len(t)] = (near[np.where((taps >= 0) & (taps < frames), taps - low, len(near) - 1)] * weight).sum(1)
    return out


def resample(x: np.ndarray, rate: int, to: int, crossings: int = 32) -> np.ndarray:
    """A whole signal at another rate; see :func:`resampled`."""
    n = round(len(x) * to / rate)
    return x[:n] if not len(x) or rate == to else resampled(lambda a, b: x[a:b], len(x), rate, to, 0, n, crossings)


@dataclass
class _Ranges(InputPartition):
    """(path, size, first byte, end byte) of what a task reads; a chunk belongs to the range in which it begins."""

    ranges: list


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rate = options["path"], int(options.get("rate") or 0)
        self.on_mismatch, self.chunk_s = options.get("on_mismatch", "resample"), float(options.get("chunk_s", 30.0))
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[_Ranges]:
        """Files by name and size only: large ones in ranges, small ones several to a task."""
        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".wav"))
        out, held, total = [], [], 0
        for name, size in files:
            for a in range(0, max(size, 1), self.split):
                held.append((name, size, a, min(a + self.split, size)))
                total += held[-1][3] - a
                if total >= self.split:
                    out.append(_Ranges(held))
                    held, total = [], 0
        return [*out, _Ranges(held)] if held else out

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()
        names = ["path", "sr", "chunk_no", "samples"]
        for name, size, a, b in partition.ranges:
            with fs.open_input_file(name) as f:
                form = header(f, size)
                wide = form.channels * form.width
                if self.rate and form.rate != self.rate and self.on_mismatch == "fail":
                    raise ValueError(f"{name} has {form.rate} samples a second, not {self.rate}")
                to = self.rate or form.rate

                def stretch(low: int, high: int) -> np.ndarray:
                    f.seek(form.begin + low * wide)
                    return samples(f.read((high - low) * wide), form)

                total = form.frames if to == form.rate else round(form.frames * to / form.rate)
                step = max(1, int(self.chunk_s * to))
                for n in range(max(-(-total // step), 1)):
                    first = n * step
                    at = form.begin + int(first * form.rate / to) * wide if n else 0
                    if a <= at < max(b, 1):
                        count = min(step, total - first)
                        x = stretch(first, first + count) if to == form.rate else resampled(stretch, form.frames, form.rate, to, first, count)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([to], pa.int32()), pa.array([n], pa.int32()), pa.array([x.astype(np.float32)], pa.list_(pa.float32()))], names)


class WavFiles(DataSource):
    """``format("wav")`` with the options path, rate, on_mismatch, chunk_s and split; see :func:`read_wav`."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


def read_wav(spark: SparkSession, path: str, rate: int | None = None, on_mismatch: str = "resample", chunk_s: float = 30.0, resampler: Callable | None = None, split: int = SPLIT) -> DataFrame:
    """Rows of ``SCHEMA`` for every WAV file under ``path``.  At another rate than ``rate`` a file is resampled or, with ``fail``, refused.

    Files are read by ranges of ``split`` bytes; a range gives the chunks that begin in it and reads beside them only what the filter needs.
    Another ``resampler``, a function of (samples, rate, to), gets whole files, each in one task.
    """
    if on_mismatch not in ("resample", "fail"):
        raise ValueError(f"on_mismatch is resample or fail, not {on_mismatch}")
    if resampler is None:
        spark.dataSource.register(WavFiles)
        return spark.read.format("wav").options(path=path, rate=str(rate or 0), on_mismatch=on_mismatch, chunk_s=str(chunk_s), split=str(split)).load()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                found, x = decode(raw)
                if rate and found != rate:
                    if on_mismatch == "fail":
                        raise ValueError(f"{name} has {found} samples a second, not {rate}")
                    found, x = rate, resampler(x, found, rate)
                step = max(1, int(chunk_s * found))
                parts = [x[i : i + step].astype(np.float32) for i in range(0, max(len(x), 1), step)]
                yield pd.DataFrame({"path": name, "sr": found, "chunk_no": range(len(parts)), "samples": [p.tolist() for p in parts]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, SCHEMA)


def parallel_files(spark: SparkSession, root: str, folders: list[str], limit: int | None = None) -> DataFrame:
    """(name, one path column per folder) of files that all ``folders`` of ``root`` have; a missing side is an error.

    Only names are listed, no content is read.  With ``limit`` only the first names in order are taken.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{root}/{f}" for f in folders]).select("path")
    p = F.split("path", "/")
    named = files.select(F.element_at(p, -1).alias("name"), F.element_at(p, -2).alias("folder"), "path")
    wide = named.groupBy("name").pivot("folder", folders).agg(F.first("path"))
    whole = F.forall(F.array(*[F.col(f).isNotNull() for f in folders]), lambda x: x)
    wide = wide if limit is None else wide.orderBy("name").limit(limit)
    return wide.withColumn("name", F.when(whole, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("a folder lacks "), "name"))))
