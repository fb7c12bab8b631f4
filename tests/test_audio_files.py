"""WAV files by byte ranges, and files of recordings that are written with a commit."""

import io
import os
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.sinks import recordings as out
from colloquy.sources import audio, tables, tree


def wav_bytes(x, rate=8000, channels=1, code=1, bits=16, extensible=False, rf64=False, length=None, before=b""):
    x = np.asarray(x, float)
    if code == 3:
        body = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (x * 128 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        body = (x * (1 << 23)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = (x * (1 << bits - 1)).astype(f"<i{bits // 8}").tobytes()
    block = channels * bits // 8
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * block, block, bits)
    form += struct.pack("<HHI16s", 22, bits, 0, struct.pack("<H", code) + b"\0" * 14) if extensible else b""
    size = len(body) if length is None else length
    extra = b"ds64" + struct.pack("<IQQQI", 28, 0, len(body), 0, 0) if rf64 else b""
    chunks = extra + before + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", 0xFFFFFFFF if rf64 else size) + body
    return (b"RF64" if rf64 else b"RIFF") + struct.pack("<I", 4 + len(chunks) & 0xFFFFFFFF) + b"WAVE" + chunks


@pytest.mark.parametrize("code, bits, close", [(1, 8, 1 / 100), (1, 16, 1e-4), (1, 24, 1e-6), (1, 32, 1e-9), (3, 32, 1e-6), (3, 64, 1e-12)])
@pytest.mark.parametrize("more", [{}, {"extensible": True}, {"rf64": True}, {"length": 0}, {"before": b"LIST" + struct.pack("<I", 3) + b"abc\0"}])
def test_formats(code, bits, close, more):
    x = np.random.default_rng(bits).uniform(-0.9, 0.9, (50, 2))
    rate, found = audio.decode(wav_bytes(x, 8000, 2, code, bits, **more))
    assert rate == 8000
    np.testing.assert_allclose(found, x.mean(1), atol=close)


@pytest.mark.parametrize("raw", [b"", b"RIFF", b"RIFFxxxxWAVE", wav_bytes([0.0], code=7), wav_bytes([0.0]).replace(b"data", b"dada")])
def test_what_is_no_wav_file(raw):
    with pytest.raises(ValueError):
        audio.decode(raw)


@pytest.mark.parametrize("rate", [None, 16000, 5512])
def test_ranges_give_the_samples_of_the_whole(spark, tmp_path, rate):
    rng = np.random.default_rng(2)
    signals = {"a": rng.uniform(-0.5, 0.5, 5000), "b": rng.uniform(-0.5, 0.5, 7), "deep/c": rng.uniform(-0.5, 0.5, 12_345), "none": np.zeros(0)}
    for name, x in signals.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.wav").write_bytes(wav_bytes(x, 8000, bits=24))
    frame = audio.read_wav(spark, str(tmp_path), rate, chunk_s=0.05, split=3000)
    assert frame.rdd.getNumPartitions() > 10
    found = {}
    for r in frame.orderBy("path", "chunk_no").collect():
        name = os.path.relpath(r.path, tmp_path)[:-4]
        assert r.chunk_no == len(found.setdefault(name, [])) and r.sr == (rate or 8000) and len(r.samples) <= 0.05 * (rate or 8000)
        found[name].append(r.samples)
    for name, x in signals.items():
        expected = audio.resample(x, 8000, rate or 8000)
        np.testing.assert_allclose(np.concatenate(found[name]), expected, atol=1e-5)
    whole = audio.read_wav(spark, str(tmp_path), rate, chunk_s=0.05, split=1 << 30).orderBy("path", "chunk_no").collect()
    assert [s for r in whole for s in r.samples] == [s for n in sorted(found, key=lambda n: str(tmp_path / f"{n}.wav")) for c in found[n] for s in c]
    other = audio.read_wav(spark, str(tmp_path), 4000, resampler=lambda x, a, b: x[:: a // b]).where(F.col("path").endswith("/a.wav")).first()
    assert len(other.samples) == 2500


def test_a_task_reads_little_more_than_a_chunk_at_a_time(tmp_path, monkeypatch):
    """A file of 3 GB, most of it never written: the header says how long it is, a range in its middle is read."""
    raw = wav_bytes(np.zeros(0), 48_000, 2, bits=16, rf64=True)
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(raw.replace(struct.pack("<IQQQI", 28, 0, 0, 0, 0), struct.pack("<IQQQI", 28, 0, 3 << 30, 0, 0)))
        f.truncate(len(raw) + (3 << 30))
    largest = []
    real = audio.samples
    monkeypatch.setattr(audio, "samples", lambda raw, form: largest.append(len(raw)) or real(raw, form))
    reader = audio.WavReader({"path": str(tmp_path), "rate": "16000", "chunk_s": "10", "split": str(16 << 20)})
    parts = reader.partitions()
    assert len(parts) == 193
    rows = list(reader.read(parts[80]))
    assert len(rows) >= 8 and all(isinstance(r, pa.RecordBatch) and len(r.column(3)[0]) == 160_000 for r in rows)
    assert max(largest) < 1 << 20


def tree_of(root):
    return {os.path.relpath(os.path.join(d, f), root): (os.stat(os.path.join(d, f)).st_mtime_ns, open(os.path.join(d, f), "rb").read()) for d, _, fs in os.walk(root) for f in fs}


def test_a_killed_task_leaves_nothing_and_a_rerun_rewrites_nothing(spark, tmp_path):
    root = tmp_path / "out"
    rows = spark.range(0, 40, 1, 8).selectExpr("concat('r', id) AS folder", "'a.txt' AS file", "concat('text ', id) AS content")
    out.write_files(rows.where("folder < 'r2'"), str(root))
    before = tree_of(root)
    assert len(before) == 12

    def dies(batches):
        for batch in batches:
            yield batch
            if (batch["folder"] == "r37").any():
                raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        out.write_files(rows.mapInPandas(dies, rows.schema), str(root))
    assert tree_of(root) == before and not [d for d in os.listdir(root) if d.startswith("_")]
    out.write_files(rows, str(root))
    after = tree_of(root)
    assert len(after) == 40 and {k: v for k, v in after.items() if k in before} == before
    out.write_files(rows, str(root))
    assert tree_of(root) == after
    out.write_files(rows.withColumn("content", F.when(F.col("folder") == "r5", "new").otherwise(F.col("content"))), str(root))
    assert {k for k, v in tree_of(root).items() if v != after[k]} == {"r5/a.txt"} and tree_of(root)["r5/a.txt"][1] == b"new"
    with pytest.raises(Exception, match="not a place"):
        out.write_files(rows.limit(1).withColumn("file", F.lit("../../x")), str(root))
    assert tree_of(tmp_path).keys() == {f"out/{k}" for k in after}


def test_the_layout_of_a_recording(spark, tmp_path):
    turns = spark.createDataFrame([("r1", "A", 0, 900), ("r1", "B", 500, 2000), ("r2", "A", 0, 100)], "rec string, speaker string, start long, end long")
    said = spark.createDataFrame([("r1", "A", 1, 0, 900, "ala"), ("r1", "B", 2, 500, 2000, "kot"), ("r1", "A", 3, 2100, 2500, "ma")], "rec string, label string, utt_no long, start long, end long, text string")
    streams = spark.createDataFrame([("r1", "A", 0, [0.5, -0.5]), ("r1", "A", 4, [0.25])], "rec string, label string, offset long, x array<double>")
    recs = spark.createDataFrame([("r1", 16000, "***"), ("r2", 16000, None)], "rec string, sample_rate int, token string")
    files = out.pipeline_files(recs, turns, turns.where("speaker = 'B'"), said, said.drop("label"), streams, rate=8000)
    out.write_files(files, str(tmp_path))
    found = tree_of(tmp_path)
    own = {"diarization.json", "routing.json", "stream_A.wav", "annotation.eaf", "metadata.json"} | {f"transcript_{x}.{e}" for x in ("A", "B", "mixture") for e in ("txt", "json")}
    assert set(found) == {f"r1/pipeline/{n}" for n in own} | {"r2/pipeline/metadata.json", "r2/pipeline/diarization.json"}
    assert found["r1/pipeline/transcript_A.txt"][1].decode() == "[  0.00 →   0.90]  ala\n[  2.10 →   2.50]  ma\n"
    with wave.open(io.BytesIO(found["r1/pipeline/stream_A.wav"][1])) as f:
        assert f.getframerate() == 8000 and np.frombuffer(f.readframes(9), "<i2").tolist() == [16384, -16384, 0, 0, 8192]
    assert b"***" in found["r1/pipeline/metadata.json"][1]


def test_preferred_reference_and_run_exports(spark, tmp_path):
    eaf = spark.createDataFrame([("a", "x"), ("a", "y")], "rec string, text string")
    text = spark.createDataFrame([("a", "no"), ("b", "z"), (None, "n")], "rec string, text string")
    assert sorted(map(tuple, tree.preferred_reference(eaf, text, ["rec"]).collect()), key=repr) == sorted([("a", "x"), ("a", "y"), ("b", "z"), (None, "n")], key=repr)
    names = tables.RUNS.split(",") if isinstance(tables.RUNS, str) else tables.RUNS.fieldNames()
    names = [n.strip().split()[0].strip("`") for n in names]
    for tag, state in (("one", "finished"), ("two", "crashed")):
        values = [state if n == "State" else "1" for n in names]
        (tmp_path / f"{tag}.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    found = tables.run_exports(spark, {t: str(tmp_path / f"{t}.csv") for t in ("one", "two")}).collect()
    assert [(r.sweep_type, r.State) for r in found] == [("one", "finished")]
