"""Text and array functions, sources and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import arrays as ar
from colloquy.functions import text as tx
from colloquy.sources import annotations as src


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_normalise(spark):
    assert one(spark, tx.normalise(F.lit("Okej, <b>YYY</b> tak-nie [śmiech] mhm żółw!"))) == "ok tak nie żółw"


def test_clock(spark):
    assert one(spark, tx.clock(F.lit(1234567))) == "00:20:34,567"
    assert one(spark, tx.clock_to_ms(F.lit("00:20:34.5"))) == 1234500
    assert one(spark, tx.clock_to_ms(F.lit("20:34"))) is None


def test_short_count(spark):
    assert [one(spark, tx.short_count(F.lit(n))) for n in (999, 4560, 1_234_999)] == ["999", "4.56K", "1.23M"]


def test_rttm_keeps_speaker_rows(spark):
    lines = spark.createDataFrame([("f", 0, "SPEAKER r 1 0.500 1.000 <NA> <NA> A <NA> <NA>"), ("f", 1, "SPKR-INFO r 1"), ("f", 2, "SPEAKER r 1")], "file string, line_no long, value string")
    assert [tuple(r) for r in src.rttm(lines).select("speaker", "start", "end").collect()] == [("A", 500, 1500)]


def test_timed_text_grammars(spark):
    values = ["[00:01:01.20 → 00:01:03.45] hello", "[0:1:2.5 → 0:1:4.0] short fields", "[4.00 -> 5.50]  a b", "[6.00 → 7.00]   ", "# note", "[broken"]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, line_no long, value string")
    assert [tuple(r) for r in src.timed_text(lines).select("start", "end", "text").collect()] == [(61200, 63450, "hello"), (62500, 64000, "short fields"), (4000, 5500, "a b")]
    assert [r.value for r in src.malformed(lines).collect()] == ["[broken"]


def test_diarization_total_falls_back(spark):
    docs = spark.createDataFrame([("f", '{"segments":[{"start":2.0,"end":3.0,"speaker":"B"},{"start":0.5,"end":9.0,"speaker":"A"}]}')], "file string, json string")
    assert {(r.total, r.speaker, r.start) for r in src.diarization_json(docs).collect()} == {(3000, "A", 500), (3000, "B", 2000)}


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER r 1 0.0 1.0 <NA> <NA> A <NA> <NA>\n")
    assert src.rttm(src.read_lines(spark, str(tmp_path))).first().end == 1000


def test_hysteresis_and_dilation(spark):
    p = arr(0.1, 0.4, 0.9, 0.4, 0.1, 0.4, 0.1)
    assert one(spark, ar.hysteresis(p, 0.8, 0.3)) == [0, 1, 1, 1, 0, 0, 0]
    mask = F.array(*[F.lit(v) for v in (0, 0, 1, 0, 0, 0)])
    assert one(spark, ar.dilate(mask, 1, 2)) == [0, 1, 1, 1, 1, 0]
    assert one(spark, ar.spread(F.array(F.lit(1), F.lit(0)), 2, F.lit(5))) == [1, 1, 0, 0, 1]
    assert one(spark, ar.spread(F.array(F.lit(0)), 512, F.lit(3))) == [1, 1, 1]


def test_si_sdr_and_fade(spark):
    rng = np.random.default_rng(0)
    t, e = rng.standard_normal(50), rng.standard_normal(50)
    a = e @ t / (t @ t)
    expected = 10 * np.log10(((a * t) ** 2).sum() / ((e - a * t) ** 2).sum())
    assert one(spark, ar.si_sdr(arr(*e), arr(*t))) == pytest.approx(expected, abs=1e-5)
    faded = one(spark, ar.fade(arr(*[1] * 8), F.lit(100), F.lit(2)))
    assert faded[0] == 0 and faded[3] < 1 and faded[-1] == 0 and faded[4] == 1


@pytest.mark.parametrize("task, variant, expected", [("ES", "SER", 1.0 - 0.2 - 0.02), ("SB", "C", 1.0 - 0.3 - 0.4 - 0.01 - 0.02 - 0.04)])
def test_components(spark, task, variant, expected):
    parts = {k: arr(v) for k, v in {"speaker2": 0.2, "scene": 0.3, "event": 0.4, "speaker1_reverb": 0.01, "speaker2_reverb": 0.02, "event_reverb": 0.04}.items()}
    assert one(spark, ar.without_components(arr(1.0), variant, task, parts))[0] == pytest.approx(expected)


def test_outdoor_components(spark):
    none = F.lit(None).cast("array<double>")
    parts = {"speaker2": arr(0.25), "scene": arr(0.2), "event": arr(0.3), "speaker1_reverb": none, "speaker2_reverb": none, "event_reverb": none}
    assert one(spark, ar.without_components(arr(0.9), "C", "SB", parts))[0] == pytest.approx(0.4)


def test_numbers(spark):
    from colloquy.functions.numbers_pl import in_words, spell_numbers

    cases = {"0": "zero", "007": "siedem", "12": "dwanaście", "21": "dwadzieścia jeden", "100": "sto", "1000": "tysiąc", "2022": "dwa tysiące dwadzieścia dwa", "5112": "pięć tysięcy sto dwanaście", "1000001": "milion jeden", "22000000": "dwadzieścia dwa miliony"}
    found = spark.createDataFrame([(k,) for k in cases], "n string").select("n", in_words(F.col("n")).alias("w")).collect()
    assert {r.n: r.w for r in found} == cases
    assert one(spark, tx.normalise(F.lit("mam 2 koty, 007 i 1a"))) == "mam dwa koty siedem i 1a"
    assert one(spark, spell_numbers(F.array(F.lit("rok"), F.lit("12"), F.lit("a1")))) == ["rok", "dwanaście", "a1"]


def test_masks_of_long_signals_against_plain_loops(spark):
    import random

    from colloquy.functions import arrays as ar

    rng = random.Random(1)
    rows = []
    for n in (0, 1, 255, 256, 257, 3000):
        rows.append((n, [rng.choice([0.0, 0.3, 0.3, 0.3, 0.9]) if rng.random() < 0.99 else 0.0 for _ in range(n)]))
    frame = spark.createDataFrame([*rows, (-1, None)], "n long, p array<double>")
    found = {r.n: r for r in frame.select("n", ar.hysteresis(F.col("p"), 0.5, 0.2).alias("h"), ar.dilate(ar.hysteresis(F.col("p"), 0.5, 0.4), 3, 7).alias("d")).collect()}
    for n, p in rows:
        on = [0] * n
        for i in range(n):
            if p[i] > 0.5:
                for step in (-1, 1):
                    j = i
                    while 0 <= j < n and p[j] > 0.2 and (j == i or not on[j] or p[j] <= 0.5):
                        on[j] = 1
                        j += step
        assert found[n].h == on
        strong = [int(v > 0.5) for v in p]
        assert found[n].d == [int(any(strong[max(i - 7, 0) : i + 4])) for i in range(n)]
    assert found[-1].h is None


def test_a_long_signal_is_scanned_in_linear_time(spark):
    import time

    from colloquy.functions import arrays as ar

    frame = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(299_999)), lambda i: F.when(i % 1000 < 600, 0.4).when(i % 1000 < 610, 0.9).otherwise(0.0)).alias("p"))
    began = time.perf_counter()
    assert frame.select(F.aggregate(ar.dilate(ar.hysteresis(F.col("p"), 0.5, 0.2), 5, 5), F.lit(0), lambda a, v: a + v).alias("n")).first().n == 300 * 620 - 5
    assert time.perf_counter() - began < 60


def test_numbers_of_any_length(spark):
    from colloquy.functions.numbers_pl import in_words

    cases = {
        "1000000000000000": "biliard", "2000000000000000": "dwa biliardy", "5000000000000001": "pięć biliardów jeden", "1" + "0" * 18: "trylion", "22" + "0" * 21: "dwadzieścia dwa tryliardy",
        "1" + "0" * 24: "kwadrylion", "3" + "0" * 27: "trzy kwadryliardy", "7" + "0" * 30: "siedem kwintylionów", "0" * 50 + "12": "dwanaście", "9" * 34: "9" * 34, "000": "zero", "12": "dwanaście",
        "999999999999999999": "dziewięćset dziewięćdziesiąt dziewięć biliardów dziewięćset dziewięćdziesiąt dziewięć bilionów dziewięćset dziewięćdziesiąt dziewięć miliardów dziewięćset dziewięćdziesiąt dziewięć milionów dziewięćset dziewięćdziesiąt dziewięć tysięcy dziewięćset dziewięćdziesiąt dziewięć",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.w for r in frame.select("t", in_words(F.col("t")).alias("w")).collect()} == cases
