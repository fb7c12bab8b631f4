"""Short-time Fourier transforms of signals that are cut into rows, and back.

Neither a signal nor its spectrum is ever one row or one task: frames are worked out in blocks, to which rows give the samples (or frames) that the
block touches, so what two blocks share at their edges is sent to both.  Many small blocks are worked out in one go.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block of the transform, and samples of a block of its inverse.
FRAMES, SAMPLES = 1024, 1 << 16

#: Samples of a row at most, and samples of all frames that are transformed in one go.
ROW, AT_ONCE = 1024, 1 << 20


def window(size: int, width: int | None = None) -> np.ndarray:
    """A periodic Hann window of ``width`` samples (by default all) in the middle of ``size``."""
    width = size if width is None else width
    out = np.zeros(size)
    left = (size - width) // 2
    out[left : left + width] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    return out


def _reflected(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places before the first and beyond the last sample, mirrored there without repeating it."""
    turn = np.maximum(2 * (length - 1), 1)
    at = np.abs(at) % turn
    return np.where(at >= length, turn - at, at)


def _types(frame: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys)


def _by_blocks(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``rows`` block after block, those of each in ``order``; ``first__`` says where one begins."""
    along = Window.partitionBy(*keys, "block__").orderBy(order)
    return rows.withColumn("first__", F.row_number().over(along) == 1)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks, of ``most`` rows or one block at a time, and where each begins."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
        if held is None or not held.num_rows:
            continue
        begins = np.flatnonzero(held["first__"].to_numpy())
        if batch is None:
            begins = np.append(begins, held.num_rows)
        at = 0
        while at < len(begins) - 1:
            to = max(int(np.searchsorted(begins, begins[at] + most, "right")) - 1, at + 1)
            yield held.slice(begins[at], begins[to] - begins[at]).combine_chunks(), begins[at:to] - begins[at]
            at = to
        held = held.slice(begins[-1])


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)


def _in_turn(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` places of each block its number, and the place within it."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - (np.cumsum(counts) - counts)[of]


def _output(table: pa.Table, keys: Sequence[str], rows: np.ndarray, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    first = table.select(keys).take(pa.array(rows)).combine_chunks()
    yield from pa.table({k: first[k] for k in keys} | columns).to_batches()


def stft(pieces: DataFrame, keys: Sequence[str], size: int, hop: int, width: int | None = None, frames: int = FRAMES) -> DataFrame:
    """(keys, frame, re, im): the ``size / 2 + 1`` lowest coefficients of frames every ``hop`` samples, centred on them, under a Hann window.

    ``pieces`` (keys, offset, x) are the samples of each signal in rows of any size, without gaps or overlaps.  A signal of n samples has
    1 + n // hop frames; beyond its ends it is mirrored.  Null samples are 0; a signal without a sample has no frame.
    """
    keys, half = list(keys), size // 2
    shape = window(size, width)
    full = pieces.where(F.size("x") > 0)
    lengths = full.groupBy(*keys).agg(F.max(F.col("offset") + F.size("x")).alias("length__"))
    # the blocks that need a sample at t: those with a frame whose reach, with one sample to mirror at, covers it
    end = F.col("offset") + F.size("x")
    first = F.greatest(F.ceil((F.col("offset") - half - 1) / hop), F.lit(0))
    last = F.floor((end + half) / hop)
    touched = full.join(lengths, keys).withColumn("block__", F.explode(F.sequence(F.floor(first / frames), F.floor(F.least(last, F.floor(F.col("length__") / hop)) / frames))))
    lo = F.greatest(F.col("block__") * frames * hop - half - 1, F.col("offset"))
    hi = F.least((F.col("block__") * frames + frames - 1) * hop + half + 1, end)
    cut = touched.withColumn("x", F.slice("x", (lo - F.col("offset") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))).withColumn("offset", lo).where(F.size("x") > 0)

    # a batch of rows is no more than so many samples
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / ROW).cast("int")), lambda k: F.struct((F.col("offset") + k * ROW).alias("offset"), F.slice("x", k * ROW + 1, F.lit(ROW)).alias("x")))
    dealt = cut.select(*keys, "block__", "length__", F.explode(rows).alias("row__")).select(*keys, "block__", "length__", "row__.*")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _blocks(batches, AT_ONCE // ROW):
            length, block, start = (table[c].to_numpy()[begins] for c in ("length__", "block__", "offset"))
            sizes = table["x"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            x = np.nan_to_num(_flat(table, "x"))
            begun = (np.cumsum(sizes) - sizes)[begins] - start
            of, place = _in_turn(np.maximum(np.minimum((block + 1) * frames, length // hop + 1) - block * frames, 0))
            for at in range(0, len(of), max(AT_ONCE // size, 1)):
                here = slice(at, at + max(AT_ONCE // size, 1))
                numbers, own = (block * frames)[of[here]] + place[here], of[here, None]
                places = _reflected(numbers[:, None] * hop - half + np.arange(size), length[own]) + begun[own]
                found = np.fft.rfft(x[places] * shape, axis=1)
                ends = np.arange(1, len(found) + 1) * found.shape[1]
                yield from _output(table, keys, begins[of[here]], {"frame": pa.array(numbers), "re": _lists(found.real.ravel(), ends), "im": _lists(found.imag.ravel(), ends)})

    schema = f"{_types(pieces, keys)}, frame long, re array<double>, im array<double>"
    return _by_blocks(dealt, keys, "offset").mapInArrow(transform, schema)


def istft(spectrum: DataFrame, keys: Sequence[str], size: int, hop: int, lengths: DataFrame | None = None, width: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """(keys, offset, x): the signal whose :func:`stft` is ``spectrum`` (keys, frame, re, im), in rows of ``samples`` samples.

    Frames are added up under the window and divided by the sum of its squares.  ``lengths`` (keys, length) says how long each signal is; by
    default it ends at the centre of the last frame.  Where frames or weight are missing the signal is 0.
    """
    keys, half = list(keys), size // 2
    shape = window(size, width)
    if lengths is None:
        lengths = spectrum.groupBy(*keys).agg((F.max("frame") * hop).alias("length"))
    known = spectrum.join(lengths.select(*keys, F.col("length").alias("length__")), keys).where("length__ > 0")
    lo, hi = F.greatest(F.col("frame") * hop - half, F.lit(0)), F.least(F.col("frame") * hop + half, F.col("length__"))
    dealt = known.where(hi > lo).withColumn("block__", F.explode(F.sequence(F.floor(lo / samples), F.floor((hi - 1) / samples))))

    def synthesise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _blocks(batches, max(AT_ONCE // size, 1)):
            length, block = (table[c].to_numpy()[begins] for c in ("length__", "block__"))
            start = block * samples
            n = np.minimum(samples, length - start)
            of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
            re, im = (_flat(table, c).reshape(len(of), -1) for c in ("re", "im"))
            parts = np.fft.irfft(re + 1j * im, size, axis=1) * shape
            # a margin of one frame on either side of each block
            wide = n + 2 * size
            at = (np.cumsum(wide) - wide - start)[of] + table["frame"].to_numpy() * hop - half + size
            at = (at[:, None] + np.arange(size)).ravel()
            total, weight = (np.bincount(at, v.ravel(), wide.sum()) for v in (parts, np.broadcast_to(shape * shape, parts.shape)))
            own, place = _in_turn(wide)
            inside = (place >= size) & (place < size + n[own])
            total, weight = total[inside], weight[inside]
            y = np.where(weight > 1e-11, total / np.maximum(weight, 1e-11), 0.0)
            yield from _output(table, keys, begins, {"offset": pa.array(start), "x": _lists(y, np.cumsum(n))})

    schema = f"{_types(spectrum, keys)}, offset long, x array<double>"
    return _by_blocks(dealt.select(*keys, "block__", "length__", "frame", "re", "im"), keys, "frame").mapInArrow(synthesise, schema)


def to_polar(re: Column, im: Column, power: float = 1.0) -> tuple[Column, Column]:
    """Magnitudes, raised to ``power``, and phases of coefficients."""
    return F.zip_with(re, im, lambda a, b: F.pow(F.hypot(a, b), F.lit(power))), F.zip_with(re, im, lambda a, b: F.atan2(b, a))


def from_polar(magnitude: Column, phase: Column, power: float = 1.0) -> tuple[Column, Column]:
    """The coefficients of which :func:`to_polar` with the same ``power`` gives these magnitudes and phases."""
    return F.zip_with(magnitude, phase, lambda m, p: F.pow(m, F.lit(1 / power)) * F.cos(p)), F.zip_with(magnitude, phase, lambda m, p: F.pow(m, F.lit(1 / power)) * F.sin(p))
