"""Files in and out, models, configuration and streaming."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators.matching import match_nearest
from colloquy.operators.models import apply_model, loader, register
from colloquy.plans import config
from colloquy.sinks import files as out
from colloquy.sinks import lines
from colloquy.sources import annotations, audio, tables, tree
from colloquy.streaming.sessions import sessions


def write_wav(path, x, rate=8000, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())


def test_wav(spark, tmp_path):
    write_wav(tmp_path / "a.wav", np.column_stack([np.full(100, 0.5), np.full(100, 0.1)]).ravel(), channels=2)
    rows = audio.read_wav(spark, str(tmp_path), chunk_s=0.005).orderBy("chunk_no").collect()
    assert [len(r.samples) for r in rows] == [40, 40, 20] and rows[0].samples[0] == pytest.approx(0.3, abs=1e-3)
    assert len(audio.read_wav(spark, str(tmp_path), rate=16000).first().samples) == 200
    with pytest.raises(Exception, match="8000 samples a second"):
        audio.read_wav(spark, str(tmp_path), rate=16000, on_mismatch="fail").collect()


def test_parallel_files(spark, tmp_path):
    for folder in ("mix", "s1"):
        write_wav(tmp_path / folder / "x.wav", [0.0])
    assert audio.parallel_files(spark, str(tmp_path), ["mix", "s1"]).first().name == "x.wav"
    write_wav(tmp_path / "mix" / "y.wav", [0.0])
    with pytest.raises(Exception, match="lacks y.wav"):
        audio.parallel_files(spark, str(tmp_path), ["mix", "s1"]).collect()


def test_tree(spark, tmp_path):
    base = tmp_path / "root"
    write_wav(base / "d1" / "r1" / "r1.wav", [0.0])
    write_wav(base / "d1" / "r2" / "mixture.wav", [0.0])
    for name in ("annotation.eaf", "reference/speaker_A.txt", "pipeline_x/turns.json"):
        (base / "d1" / "r1" / name).parent.mkdir(exist_ok=True)
        (base / "d1" / "r1" / name).write_text("x")
    (base / "d1" / "empty").mkdir()
    found = {r.id: r for r in tree.recordings(spark, str(base)).collect()}
    assert set(found) == {"r1", "r2"} and found["r1"].modes == ["pipeline_x"] and list(found["r1"].references) == ["A"] and found["r2"].annotation is None
    assert {r.id: r.has_eaf for r in tree.inventory(tree.recordings(spark, str(base), "d1")).collect()} == {"r1": True, "r2": False}


def test_tables(spark, tmp_path):
    (tmp_path / "corpus_a_test_final.csv").write_text("mixFile,speaker1File,speaker2File,sceneFile,eventFile,reverbForSpeaker1,reverbForSpeaker2,reverbForEvent\nm,a,b,c,d,r,r,r\nn,a,b,c,d,,,\n")
    manifest = tables.corpus_manifest(spark, str(tmp_path), "a", "test")
    assert [tables.indoor_filter(manifest, v).count() for v in (["SER"], ["SE"], ["C"], ["SER", "SE"])] == [1, 1, 2, 2]
    (tmp_path / "list.csv").write_text("path;x\n a/b ;1\n ;2\n")
    assert [r.path for r in tables.semicolon_paths(spark, str(tmp_path / "list.csv")).collect()] == ["a/b"]
    (tmp_path / "t.tsv").write_text("# note\n0.5\t1.5\tA\tu1\thello\n1\t2\tC\tu2\tno\n")
    assert [r.text for r in tables.segment_transcript(spark, str(tmp_path / "t.tsv")).collect()] == ["hello"]
    spark.createDataFrame([("A", "t", ("p", b"x")), (None, "t", ("p", b"x"))], "speaker string, text string, audio struct<path:string,bytes:binary>").write.parquet(str(tmp_path / "u"))
    rows = tables.utterance_parquet(spark, str(tmp_path / "u"))
    assert rows.count() == 1 and "bytes" not in rows._jdf.queryExecution().executedPlan().toString()


def test_write_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "rec string, v long")
    path = str(tmp_path / "t")
    assert [out.append_new(rows, path, ["rec"]), out.append_new(rows, path, ["rec"])] == [2, 0]
    assert out.write_stages({"turns": rows, "not_run": None}, str(tmp_path / "run")) == ["turns"]
    assert spark.read.parquet(str(tmp_path / "run/turns")).count() == 2
    lines.write_lines(lines.rttm(spark.createDataFrame([("r", "A", 0, 1500)], "rec string, speaker string, start long, end long")), str(tmp_path / "rttm"))
    back = annotations.rttm(annotations.read_lines(spark, str(tmp_path / "rttm/*/*.txt"))).first()
    assert (back.speaker, back.end) == ("A", 1500)


def test_redaction(spark):
    rows = spark.createDataFrame([(("secret", 1),), ((None, 2),)], "config struct<token:string,n:int>")
    assert [tuple(r.config) for r in out.redacted(rows, "config", ["token"]).collect()] == [("***", 1), (None, 2)]
    assert out.holds_secret(spark.createDataFrame([("x hf_" + "a" * 20,), ("hf_short",)], "value string")).count() == 1


def test_models(spark):
    @register("double")
    def load():
        return lambda xs: xs.map(lambda x: sum(x) * 2)

    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id int, x array<double>")
    assert apply_model(rows, "x", loader("double"), "double-1", "y", "double").first().y == 6.0
    with pytest.raises(KeyError):
        loader("none")


def test_config():
    c = config.load(config.Config, {"routing": {"merge_gap_ms": 100}})
    assert c.routing.merge_gap_ms == 100 and c.fragments.stride_ms == 5000
    assert config.override(c, "fragments.min_balance", 0.5).fragments.min_balance == 0.5
    for bad in ({"routing": {"x": 1}}, {"x": 1}):
        with pytest.raises(KeyError):
            config.load(config.Config, bad)
    with pytest.raises(ValueError):
        config.load(config.Config, {"window_mode": "x"})
    with pytest.raises(KeyError):
        config.override(c, "routing.x", 1)


def test_match_nearest(spark):
    a = spark.createDataFrame([("r", "c1", 1.0), ("r", "c2", 5.0)], "rec string, channel string, t double")
    b = spark.createDataFrame([("r", "A", 4.5), ("r", "B", 5.5)], "rec string, speaker string, t double")
    assert {(r.channel, r.speaker) for r in match_nearest(a, b, "rec", "channel", "speaker", "t").collect()} == {("c2", "A"), ("c1", "B")}


def test_stream_of_sessions(spark, tmp_path):
    rows = [(u, f"2024-01-01 00:00:{s:02d}") for u in (1, 2) for s in (0, 3, 6, 30)] + [(9, "2024-01-01 01:00:00")]
    frame = spark.createDataFrame(rows, "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), ["user_id"], "ts", "10 seconds", "1 minute")
    query = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.user_id, r.n) for r in spark.table("found").collect()) == [(1, 1), (1, 3), (2, 1), (2, 3)]


def test_resampling_keeps_what_the_lower_rate_holds_and_nothing_else():
    from colloquy.sources.audio import resample

    t = np.arange(4800) / 48_000
    for rate, to in ((48_000, 16_000), (48_000, 44_100), (16_000, 48_000)):
        time, wanted = np.arange(rate // 5) / rate, np.arange(to // 5) / to
        low = resample(np.sin(2 * np.pi * 440 * time), rate, to)
        assert len(low) == to // 5 and np.abs(low - np.sin(2 * np.pi * 440 * wanted))[400:-400].max() < 1e-3
    high = resample(np.sin(2 * np.pi * 11_000 * t), 48_000, 16_000)  # above what 16,000 samples a second can hold
    assert np.abs(high[200:-200]).max() < 1e-2
    assert len(resample(np.zeros(0), 8000, 16_000)) == 0


def test_sources_by_name():
    from colloquy.sources import tables

    assert tables.source("corpus") is tables.corpus_manifest
    with pytest.raises(KeyError):
        tables.source("none")
    with pytest.raises(ValueError):
        tables.register_source("corpus")(lambda: None)


def test_stages_spill_and_resume(spark, tmp_path):
    from colloquy.operators.models import Stage, run_stages

    ran = []

    def step(name, by):
        return lambda rows: ran.append(name) or rows.selectExpr(f"id + {by} AS id")

    stages = [Stage("one", step("one", 1)), Stage("off", step("off", 100), enabled=False), Stage("two", step("two", 10))]
    assert [r.id for r in run_stages(spark.range(2), stages).orderBy("id").collect()] == [11, 12] and ran == ["one", "two"]
    assert [r.id for r in run_stages(spark.range(2), stages, str(tmp_path)).orderBy("id").collect()] == [11, 12]
    (tmp_path / "two" / "_SUCCESS").unlink()  # as if it had died
    assert [r.id for r in run_stages(spark.range(2), stages, str(tmp_path), resume=True).orderBy("id").collect()] == [11, 12]
    assert ran == ["one", "two"] * 2 + ["two"] and not (tmp_path / "off").exists()
