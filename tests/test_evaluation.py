"""Layered scores, fragments and small functions against plain loops."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.functions import arrays as ar
from colloquy.operators import analytics as an
from colloquy.operators import evaluation as ev
from colloquy.operators import fragments as fr
from colloquy.operators import intervals as iv
from colloquy.operators import metrics as me
from colloquy.operators.scan import settled
from colloquy.sinks import files as fs
from colloquy.sources import annotations as src
from colloquy.sources import tables

TURNS = "rec string, speaker string, start long, end long"


def turns_of(rng, recordings=4, n=40, speakers="AB", span=4000, longest=400):
    rows = [(f"R{r}", rng.choice(speakers), a, a + rng.randint(1, longest)) for r in range(recordings) for a in [rng.randint(0, span) for _ in range(n)]]
    return rows


def test_subtract_keeps_nulls_and_repeats(spark):
    a = spark.createDataFrame([("R", None, 20, 30), ("R", "A", 20, 30), ("R", "A", 20, 30), ("R", "B", 50, 60), ("R", "B", 50, 60), (None, "C", 0, 10), ("R", "D", 23, 23 + 1)], TURNS)
    b = spark.createDataFrame([("R", 22, 23), ("R", 28, 40), (None, 4, 5), ("R", 23, 24)], "rec string, start long, end long")
    left = [("A", 20, 22), ("A", 20, 22), ("A", 24, 28), ("A", 24, 28), ("B", 50, 60), ("B", 50, 60), ("C", 0, 4), ("C", 5, 10), (None, 20, 22), (None, 24, 28)]
    for width in (None, 3, 1000):
        found = iv.subtract(a, b, ["rec"], width=width)
        assert sorted(((r.speaker, r.start, r.end) for r in found.collect()), key=repr) == sorted(left, key=repr)
    assert iv.subtract(a.limit(0), b, ["rec"]).count() == 0 and iv.subtract(a, b.limit(0), ["rec"]).count() == 7


def test_subtract_tick_by_tick(spark):
    rng = random.Random(3)
    rows, less = turns_of(rng), turns_of(rng, n=15)
    found = iv.subtract(spark.createDataFrame(rows, TURNS), spark.createDataFrame(less, TURNS), ["rec"], width=500).collect()
    expected = 0
    for r, _, a, b in rows:
        gone = {t for q, _, c, d in less if q == r for t in range(max(a, c), min(b, d))}
        expected += b - a - len(gone)
    assert sum(r.end - r.start for r in found) == expected and all(r.end > r.start for r in found)


@pytest.mark.parametrize("variants, kept", [(["SER", "C"], 2), (["SE", "C"], 2), (["SER"], 1), (["S"], 1), (["C"], 2), (["SER", "SE"], 2), ([], 2)])
def test_indoor_filter(spark, variants, kept):
    rows = spark.createDataFrame([("a", "r"), ("b", None)], "mixFile string, reverbForSpeaker1 string")
    assert tables.indoor_filter(rows, variants).count() == kept


@pytest.mark.parametrize("collar, skip", [(0, False), (40, False), (0, True), (60, True)])
def test_diarization_error_tick_by_tick(spark, collar, skip):
    rng = random.Random(collar + skip)
    ref, hyp = turns_of(rng, 2, 25, span=1500, longest=200), turns_of(rng, 2, 25, "XY", span=1500, longest=200)
    stated = spark.createDataFrame([("R0", 1600), ("R1", 1000)], "rec string, total long")
    found = {r.rec: r for r in me.diarization_error(spark.createDataFrame(ref, TURNS), spark.createDataFrame(hyp, TURNS), totals=stated, collar=collar, skip_overlap=skip).collect()}
    for rec, total in (("R0", 1600), ("R1", 1000)):
        def ticks(rows, s):
            out = np.zeros(2000, bool)
            for r, who, a, b in rows:
                if r == rec and who == s:
                    out[a:b] = True
            return out

        r, h = (np.stack([ticks(rows, s) for s in names]) for rows, names in ((ref, "AB"), (hyp, "XY")))
        scored = np.arange(2000) < total
        edges = [t for s in r for t in np.flatnonzero(np.diff(np.r_[False, s, False].astype(int)))]
        for t in edges:
            scored[max(0, t - collar // 2) : t + collar // 2] = False
        if skip:
            scored &= r.sum(0) < 2
        r, h = r[:, scored], h[:, scored]
        agreed = max((r[0] & h[i]).sum() + (r[1] & h[1 - i]).sum() for i in (0, 1))
        both = np.minimum(r.sum(0), h.sum(0)).sum()
        assert (found[rec].miss, found[rec].false_alarm) == (np.maximum(r.sum(0) - h.sum(0), 0).sum(), np.maximum(h.sum(0) - r.sum(0), 0).sum())
        assert (found[rec].confusion, found[rec].total) == (both - agreed, r.sum())


def plain_fragments(rows, total, rule):
    def spans(test):
        on = np.array([test(level) for level in levels])
        edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(int)))
        return list(zip(edge[::2], edge[1::2]))

    per = {s: np.zeros(total + 500, bool) for s in {s for s, _, _ in rows}}
    for s, a, b in rows:
        per[s][a:b] = True
    levels = sum(x.astype(int) for x in per.values())
    overlaps, speech = spans(lambda n: n >= 2), spans(lambda n: n >= 1)
    if not overlaps:
        return []
    ends = [0, *[e for _, e in speech]]
    gaps = [(a, b) for a, b in zip(ends, [*[s for s, _ in speech], total]) if b - a >= rule.silence]
    mids = [(a + b) / 2 for a, b in gaps]
    found = []
    for t in range(0, total - rule.target + 1, rule.stride):
        a, b = t, t + rule.target
        before, after = [m for m in mids if 0 <= a - m <= rule.radius], [m for m in mids if 0 <= m - b <= rule.radius]
        a, b = max(max(before, default=a), 0), min(min(after, default=b), total)
        if not rule.shortest <= b - a <= rule.longest:
            continue
        cut = [min(b, d) - max(a, c) for c, d in overlaps if min(b, d) > max(a, c)]
        by = {}
        for s, c, d in rows:
            if min(b, d) > max(a, c):
                by[s] = by.get(s, 0) + min(b, d) - max(a, c)
        union = sum(max(0, min(b, d) - max(a, c)) for c, d in speech)
        if by and sum(cut) >= rule.overlap and min(by.values()) / sum(by.values()) >= rule.balance and union / (b - a) >= rule.density:
            found.append((a, b, sum(cut), len(cut), max(cut, default=0)))
    kept = []
    for f in sorted(set(found), key=lambda f: (-f[2], f[0], f[1])):
        if all(max(min(f[1], k[1]) - max(f[0], k[0]), 0) <= rule.iou * (max(f[1], k[1]) - min(f[0], k[0])) for k in kept):
            kept.append(f)
    return sorted(kept)


def test_find_fragments(spark):
    rng = random.Random(8)
    rows = turns_of(rng, 3, 30) + [("R9", "A", 100, 3900)]
    rule = fr.FragmentRule(target=900, shortest=600, longest=1500, stride=150, silence=40, radius=200, overlap=100, balance=0.1, density=0.2)
    ends = {r: max(b for q, _, _, b in rows if q == r) + 100 for r in {r for r, *_ in rows}}
    found = fr.find_fragments(spark.createDataFrame(rows, TURNS), spark.createDataFrame(list(ends.items()), "rec string, total long"), ["rec"], rule=rule).collect()
    expected = [(r, *f) for r in sorted(ends) for f in plain_fragments([x[1:] for x in rows if x[0] == r], ends[r], rule)]
    assert len(expected) > 3
    assert sorted((r.rec, r.start, r.end, r.overlap, r.events, r.longest) for r in found) == sorted(expected)


@pytest.mark.parametrize("stretch", [700, 5000])
def test_fragments_by_stretches(spark, monkeypatch, stretch):
    """Recordings of several stretches have the same fragments, and of the windows only what the rule keeps is written."""
    written = []
    monkeypatch.setattr(fr, "settled", lambda frame: written.append(settled(frame)) or written[-1])
    rng = random.Random(stretch)
    rows = turns_of(rng, 2, 70, span=12_000)
    rule = fr.FragmentRule(target=900, shortest=600, longest=1500, stride=20, silence=30, radius=150, overlap=250, balance=0.2, density=0.3, stretch=stretch)
    ends = {r: max(b for q, _, _, b in rows if q == r) + 100 for r in {r for r, *_ in rows}}
    turns, totals = spark.createDataFrame(rows, TURNS), spark.createDataFrame(list(ends.items()), "rec string, total long")

    def sets(found):
        return sorted((r.rec, r.start, r.end, r.overlap, r.events, r.longest) for r in found.collect())

    def plain(rule):
        return [(r, *f) for r in sorted(ends) for f in plain_fragments([x[1:] for x in rows if x[0] == r], ends[r], rule)]

    found = sets(fr.find_fragments(turns, totals, ["rec"], rule=rule))
    assert found == plain(rule) and len(found) > 3
    assert max(ends.values()) > 2 * stretch and sum(f.count() for f in written) < sum((e - 900) // 20 for e in ends.values()) / 2
    # nothing shares more than all of its time
    assert sets(fr.fragment_windows(turns, totals, ["rec"], rule=rule)) == plain(replace(rule, iou=1.0))


def test_stretches_are_dealt_to_all_tasks(spark):
    """However few the rows of stretches are, they aren't put together in one task, as their windows are many."""
    turns = spark.createDataFrame(turns_of(random.Random(6), 20, 30), TURNS)
    rule = fr.FragmentRule(target=900, shortest=600, longest=1500, stride=150, silence=40, radius=200, overlap=100, balance=0.1, density=0.2)
    found = fr.fragment_windows(turns, turns.groupBy("rec").agg((F.max("end") + 100).alias("total")), ["rec"], rule=rule)
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() == 4


def test_candidates_do_not_shuffle_windows(spark):
    """What is written to disk grows with turns and fragments, however many windows there are."""
    status, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()

    def shuffled():
        stages = status.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    turns = spark.createDataFrame(turns_of(random.Random(4), 2, 70, span=12_000), TURNS)
    rule = fr.FragmentRule(target=900, shortest=600, longest=1500, stride=3, silence=30, radius=150, overlap=400, balance=0.3, density=0.3)
    totals, noise = turns.groupBy("rec").agg((F.max("end") + 100).alias("total")), spark.createDataFrame([("R0", "low"), ("R0", "low")], "rec string, noise string")
    before = shuffled()
    found = fr.candidates(fr.find_fragments(turns, totals, ["rec"], rule=rule), noise, (400, 800), 300).collect()
    assert {r.noise for r in found} == {"low", "unknown"}
    assert shuffled() - before < sum((r.total - 900) // 3 for r in totals.collect())


def test_select_fragments_in_two_passes(spark):
    rng = random.Random(5)
    rows = [(f"R{rng.randint(0, 25)}", float(i), rng.choice(["light", "heavy"]), rng.choice(["low", "unknown"]), rng.random() < 0.6, rng.randint(0, 50) / 7) for i in range(300)]
    targets, quota = [("heavy", "low", 7, 3), ("light", "low", 9, 2), ("heavy", "unknown", 5, 5), ("light", "unknown", 40, 0)], {"low": 2}
    found = fr.select_fragments(spark.createDataFrame(rows, "rec string, start double, overlap_bin string, noise string, is_substantive boolean, score double"), targets, quota).collect()
    used, expected = {}, []
    for bin_, noise, *wanted in targets:
        for pool, n in zip((True, False), wanted):
            for r in sorted((r for r in rows if r[2:5] == (bin_, noise, pool)), key=lambda r: (-r[5], r[0], r[1])):
                if n and used.get(r[0], 0) < quota.get(noise, 1):
                    used[r[0]], n = used.get(r[0], 0) + 1, n - 1
                    expected.append((*r[:2], "substantive" if pool else "backchannel"))
    assert sorted((r.rec, r.start, r.pool) for r in found) == sorted(expected)
    for rec in {r.rec for r in found}:
        own = sorted((r.overlap_bin, r.noise, r.start, r.frag_id) for r in found if r.rec == rec)
        assert [o[3] for o in own] == [f"{rec}__seg{i:02d}" for i in range(len(own))]


def test_first_mixture_and_missing_speaker(spark):
    token = "array<string>"
    ref = spark.createDataFrame([("r", "A", 1, ["a", "b"], None), ("r", "B", 2, ["c"], None), ("q", "A", 1, ["x"], None)], f"rec string, speaker string, order long, tokens {token}, timed array<struct<token:string,start:double,end:double>>")
    timed = ref.withColumn("timed", me.spread_in_time(F.col("tokens"), F.lit(0), F.lit(10)))
    hyp = timed.where("speaker = 'A'").withColumn("mode", F.lit("no_enh"))
    mixed = spark.createDataFrame([("r", "minimal", 1, ["z"]), ("r", "no_sep", 1, ["a", "b", "c"])], f"rec string, mode string, order long, tokens {token}")
    found = {(r.mode, r.metric): (r.rec, r.errors, r.length) for r in ev.layer3(timed, hyp, mixed).collect()}
    assert found == {("no_enh", "cpwer"): ("r", 1, 3), ("no_enh", "tcpwer"): ("r", 1, 3), ("mixture", "orc_wer"): ("r", 0, 3)}
    summary = ev.summary3(ev.layer3(timed, hyp, mixed)).first()
    assert summary.full_cpwer is None and summary.no_enh_cpwer == pytest.approx(100 / 3) and summary.mixture_orc_wer == 0


def test_energy_mask(spark):
    rng = np.random.default_rng(4)
    for n, frame, close, open_ in ((50, 4, 6, 3), (33, 3, 5, 4), (7, 5, 9, 2), (1, 2, 2, 2)):
        x = rng.standard_normal(n) * (rng.random(n) < 0.5)
        full = np.convolve(x**2, np.ones(frame) / frame, mode="same") if n >= frame else np.array([sum(x[max(i - frame // 2, 0) : i + (frame - 1) // 2 + 1] ** 2) / frame for i in range(n)])
        env = np.sqrt(np.maximum(full, 0))
        m = env > max(0.5 * env.max(), 1e-4)

        def around(m, low, high, outside):
            padded = np.r_[np.full(low, outside), m, np.full(high, outside)]
            return np.stack([padded[k : k + len(m)] for k in range(low + high + 1)])

        def dilate(m, w):
            return around(m, w - w // 2 - 1, w // 2, False).any(0)

        def erode(m, w):
            return around(m, w // 2, w - w // 2 - 1, False).all(0)

        expected = dilate(erode(erode(dilate(m, close), close), open_), open_)
        found = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(ar.energy_mask(F.col("x"), frame, close, open_, relative=0.5)).first()[0]
        assert found == expected.tolist(), n


def test_names_and_missing_sides(spark):
    rows = spark.createDataFrame([("EDACC-C35_P1-53.wav", "EDACC-C06-A", "overlap_0_session1_x", "id_a_L.txt"), ("x.wav", "A", "none", "a.txt")], "a string, s string, m string, c string")
    found = rows.select(tables.audio_path(F.col("a")), tables.speaker_id(F.col("s")), tables.session_of(F.col("m")), tables.channel_file(F.col("c")), tables.renamed_prefix(F.col("a"), "EDACC-", "EAEC-")).collect()
    assert [tuple(map(lambda v: tuple(v) if isinstance(v, tuple) else v, r)) for r in found] == [(("EDACC-C35_P1", 53), ("EDACC-C06", "A"), "session1", ("id_a", "L"), "EAEC-C35_P1-53.wav"), (None, None, "none", None, "x.wav")]
    sides = {"mix": spark.createDataFrame([("a", 1), ("b", 2)], "name string, mix long"), "source": spark.createDataFrame([("a", 3)], "name string, source long")}
    with pytest.raises(PySparkException, match="no source for b"):
        tables.joined_by_name(sides, "name").collect()


def test_transcripts_of_whichever_speaker(spark):
    lines = [("r", "full", "transcript_A.txt", 0, "[0.00 → 1.00] a"), ("r", "full", "transcript_mixture.txt", 0, "[0.00 → 1.00] m"), ("q", "full", "notes.txt", 0, "[0.00 → 1.00] x")]
    frame = spark.createDataFrame(lines, "rec string, mode string, file string, line_no long, value string")
    assert [(r.rec, r.speaker, r.text) for r in src.transcripts(frame).collect()] == [("r", "A", "a")]
    assert [(r.rec, r.text) for r in src.mixtures(frame).collect()] == [("r", "m")]


def test_clips_and_tables(spark, tmp_path):
    audio = spark.createDataFrame([("r", [float(i) for i in range(10)])], "rec string, x array<double>")
    chosen = spark.createDataFrame([("r", 0.5, 1.5, "f0"), ("r", 4.0, 9.0, "f1"), ("q", 0.0, 1.0, "f2")], "rec string, start double, end double, frag_id string")
    left = fs.not_written(chosen, spark.createDataFrame([("f1",)], "frag_id string"), ["frag_id"])
    assert {r.frag_id: r.clip for r in fs.clips(left, audio, "rec", 2).collect()} == {"f0": [1.0, 2.0]}
    fs.write_table(chosen, str(tmp_path / "t"), ["frag_id", "rec"], ("start", "pesq"), [F.desc("start")])
    back = tables.metadata(spark, str(tmp_path / "t"), "frag_id string, rec string, start double")
    assert [tuple(r) for r in back.collect()] == [("f1", "r", 4.0), ("f0", "r", 0.5), ("f2", "q", 0.0)]


def test_signals_through_a_model_in_chunks(spark):
    from colloquy.operators.audio import in_chunks, process_in_chunks

    rng = np.random.default_rng(2)
    data = {f"s{n}": rng.standard_normal(n).tolist() for n in (3, 8, 9, 30)}
    signals = spark.createDataFrame(list(data.items()), "sig string, x array<double>")
    assert {(r.sig, r.offset, len(r.x)) for r in in_chunks(signals, ["sig"], 8).collect()} == {("s3", 0, 3), ("s8", 0, 8), ("s9", 0, 8), ("s9", 4, 5), *(("s30", k, min(8, 30 - k)) for k in range(0, 25, 4))}
    found = {}
    for r in process_in_chunks(signals, ["sig"], 8, lambda: lambda xs: xs.map(lambda x: [2 * v for v in x] + [9.0]), "twice").collect():
        found.setdefault(r.sig, {})[r.t] = r.y
    for name, x in data.items():
        y = found[name]
        assert sorted(y) == list(range(len(x)))
        # the first sample of several chunks has no weight
        assert [y[t] for t in range(len(x) > 8, len(x))] == pytest.approx([2 * v for v in x[len(x) > 8 :]])


@pytest.mark.parametrize("n, size, hop, width", [(1, 8, 2, None), (3, 8, 2, None), (7, 8, 3, 6), (50, 16, 4, None), (333, 16, 5, 12), (200, 32, 16, None)])
def test_stft_against_numpy_and_back(spark, n, size, hop, width):
    from colloquy.operators import spectrum as sp

    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    whole = {}
    place, cuts = 0, []
    while place < n:
        cuts.append((place, x[place : place + int(rng.integers(1, 40))].tolist()))
        place += len(cuts[-1][1])
    frame = spark.createDataFrame([("s", o, v) for o, v in cuts] + [("empty", 0, [])], "sig string, offset long, x array<double>")
    padded = x[sp._reflected(np.arange(-(size // 2), n + size // 2), n)]
    shape = sp.window(size, width)
    for r in sp.stft(frame, ["sig"], size, hop, width, frames=3).collect():
        whole[r.frame] = np.array(r.re) + 1j * np.array(r.im)
    assert sorted(whole) == list(range(1 + n // hop))
    for k, found in whole.items():
        np.testing.assert_allclose(found, np.fft.rfft(padded[k * hop : k * hop + size] * shape), atol=1e-9)
    if hop * 2 < (width or size):
        lengths = spark.createDataFrame([("s", n)], "sig string, length long")
        magnitude, phase = sp.to_polar(F.col("re"), F.col("im"), 0.3)
        polar = sp.stft(frame, ["sig"], size, hop, width).select("sig", "frame", magnitude.alias("m"), phase.alias("p"))
        re, im = sp.from_polar(F.col("m"), F.col("p"), 0.3)
        pieces = sp.istft(polar.select("sig", "frame", re.alias("re"), im.alias("im")), ["sig"], size, hop, lengths, width, samples=17).orderBy("offset").collect()
        np.testing.assert_allclose(np.concatenate([p.x for p in pieces]), x, atol=1e-6)


def test_overlap_add_weighs_with_numpy_hanning(spark):
    from colloquy.operators.audio import in_chunks, overlap_add

    x = np.random.default_rng(1).normal(size=27)
    frame = spark.createDataFrame([("s", x.tolist())], "sig string, x array<double>")
    chunks = in_chunks(frame, ["sig"], 8).withColumn("x", F.transform("x", lambda v: v * F.col("offset")))
    total, weight = np.zeros(27), np.zeros(27)
    for r in chunks.collect():
        w = np.hanning(8)[: len(r.x)]
        total[r.offset : r.offset + len(r.x)] += w * np.array(r.x)
        weight[r.offset : r.offset + len(r.x)] += w
    found = [r.y for r in overlap_add(chunks, ["sig"], 8).orderBy("t").collect()]
    np.testing.assert_allclose(found, total / np.maximum(weight, 1e-8), atol=1e-12)


def test_many_small_blocks_are_transformed_in_one_go(spark):
    from colloquy.operators import spectrum as sp

    rng = np.random.default_rng(9)
    rows = [(n, 0, rng.normal(size=5 + n % 9).tolist()) for n in range(200)]
    pieces = [(s, o + k, x[k : k + 4]) for s, o, x in rows for k in range(0, len(x), 4)]
    whole = {s: x for s, _, x in rows}
    spectrum = sp.stft(spark.createDataFrame(pieces, "sig long, offset long, x array<double>"), ["sig"], 4, 2, frames=2).persist()
    assert spectrum.count() == sum(1 + len(x) // 2 for x in whole.values())
    back = {}
    for r in sp.istft(spectrum, ["sig"], 4, 2, spark.createDataFrame([(s, len(x)) for s, x in whole.items()], "sig long, length long"), samples=3).orderBy("offset").collect():
        back.setdefault(r.sig, []).extend(r.x)
    spectrum.unpersist()
    assert back.keys() == whole.keys() and all(np.allclose(back[s], x) for s, x in whole.items())
    # before, each block was a call of its own
    applied = spectrum._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in applied and "FlatMapGroupsInArrow" not in applied


def test_layer_1_by_stretches(spark):
    schema = "rec string, speaker string, start long, end long"
    ref = spark.createDataFrame([("r", "A", 0, 70), ("r", "B", 50, 90), ("q", "A", 5, 25)], schema).withColumn("source", F.lit("eaf"))
    hyp = spark.createDataFrame([("r", "x", 10, 95), ("r", "y", 60, 80), ("q", "x", 0, 40)], schema)
    stated = spark.createDataFrame([("r", 85), ("q", None)], "rec string, total long")
    whole, cut = (sorted(map(tuple, ev.layer1(ref, hyp, stated, width=w).collect())) for w in (None, 16))
    assert whole == cut and len(cut) == 2
