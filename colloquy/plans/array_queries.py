"""Queries of signal arrays; embeddings are the signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as ar
from .registry import Registry
from .views import SIGNALS, signals

_REGISTRY = Registry()
QUERIES, ORACLE_SQL, query = _REGISTRY.queries, _REGISTRY.oracle, _REGISTRY.query

_PAIRS = "pairs AS (SELECT a.sig, a.x, b.x AS y FROM signals a JOIN signals b ON b.sig = a.sig + 1 WHERE a.sig % 2 = 0)"
_SUM = "list_sum(list_transform({0}, lambda v: v * v))"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


def _pairs(spark, sf_dir):
    s = signals(spark, sf_dir)
    return s.where("sig % 2 = 0").join(s.select((F.col("sig") - 1).alias("sig"), F.col("x").alias("y")), "sig")


def _r(c, name, digits=9):
    return F.round(c, digits).alias(name)


@query(f"SELECT sig, round(sqrt({_SUM.format('x')} / len(x)), 9) AS rms FROM signals", SIGNALS)
def arr_01_rms(spark, sf_dir):
    return signals(spark, sf_dir).select("sig", _r(ar.rms(F.col("x")), "rms"))


@query(f"SELECT sig, round(x[1] * t / r, 9) AS first, round(x[-1] * t / r, 9) AS last FROM (SELECT sig, x, r, median(r) OVER (PARTITION BY sig % 7) AS t FROM (SELECT sig, x, sqrt({_SUM.format('x')} / len(x)) AS r FROM signals))", SIGNALS)
def arr_02_03_to_median_rms(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("r", ar.rms(F.col("x")))
    s = s.withColumn("t", F.median("r").over(Window.partitionBy(F.col("sig") % 7)))
    y = ar.to_rms(F.col("x"), F.col("t"))
    return s.select("sig", _r(F.element_at(y, 1), "first"), _r(F.element_at(y, -1), "last"))


@query("SELECT sig, round(list_sum(list_transform(range(0, len(x)), lambda i: abs(x[i + 1]) * CASE WHEN i < 8 THEN 0.5 - 0.5 * cos(2 * pi() * i / 15) ELSE 1 END * CASE WHEN len(x) - 1 - i < 5 THEN 0.5 - 0.5 * cos(2 * pi() * (len(x) - 1 - i) / 9) ELSE 1 END)), 8) AS faded FROM signals", SIGNALS)
def arr_04_fade(spark, sf_dir):
    y = ar.fade(F.col("x"), F.lit(8), F.lit(5))
    return signals(spark, sf_dir).select("sig", _r(ar.total(F.transform(y, F.abs)), "faded", 8))


@query(
    """SELECT sig, CAST(sum(m) AS BIGINT) AS n_on FROM (SELECT sig, run, CASE WHEN max(p) > 0.1 THEN count(*) FILTER (weak) ELSE 0 END AS m FROM (
        SELECT *, sum(CASE WHEN weak THEN 0 ELSE 1 END) OVER (PARTITION BY sig ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT sig, i, p, p > 0.02 AS weak FROM (SELECT sig, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM signals))) GROUP BY sig, run) GROUP BY sig""",
    SIGNALS,
)
def arr_05_hysteresis(spark, sf_dir):
    return signals(spark, sf_dir).select("sig", F.aggregate(ar.hysteresis(F.col("x"), 0.1, 0.02), F.lit(0), lambda a, v: a + v).cast("long").alias("n_on"))


@query("SELECT sig, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM range(greatest(i - 2, 1), least(i + 1, 64) + 1) r(j) WHERE x[j] > 0.1)) AS BIGINT) AS n_on FROM signals, range(1, 65) u(i) WHERE len(x) = 64 GROUP BY sig", SIGNALS)
def arr_06_dilate(spark, sf_dir):
    mask = F.transform("x", lambda v: (v > 0.1).cast("int"))
    return signals(spark, sf_dir).where("size(x) = 64").select("sig", F.aggregate(ar.dilate(mask, 1, 2), F.lit(0), lambda a, v: a + v).cast("long").alias("n_on"))


ORACLE_SQL["arr_06_dilate"] = f"""WITH {SIGNALS}, fr AS (SELECT sig, unnest(x) > 0.1 AS o, generate_subscripts(x, 1) AS i FROM signals WHERE len(x) = 64)
    SELECT sig, count(*) FILTER (d) AS n_on FROM (SELECT sig, bool_or(o) OVER (PARTITION BY sig ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS d FROM fr) GROUP BY sig"""


@query("SELECT sig, 70 AS n, CAST(len(list_filter(x, lambda v: v > 0)) * 1 AS BIGINT) + 6 AS n_on FROM signals WHERE len(x) = 64", SIGNALS)
def arr_07_13_spread_and_fit(spark, sf_dir):
    mask = F.transform("x", lambda v: (v > 0).cast("int"))
    wide = ar.spread(mask, 1, F.lit(70))
    return signals(spark, sf_dir).where("size(x) = 64").select("sig", F.size(ar.fit(F.col("x"), 70)).alias("n"), F.aggregate(wide, F.lit(0), lambda a, v: a + v).cast("long").alias("n_on"))


@query(
    """SELECT s.sig, coalesce(min_by(i, (abs(i - 32), i)) FILTER (s.x[i] * s.x[i + 1] <= 0), 32) AS at FROM signals s, range(22, 43) u(i) WHERE len(s.x) = 64 GROUP BY s.sig""",
    SIGNALS,
)
def arr_08_zero_crossing(spark, sf_dir):
    return signals(spark, sf_dir).where("size(x) = 64").select("sig", ar.zero_crossing(F.col("x"), F.lit(32), 10).cast("long").alias("at"))


@query(f"SELECT sig, round(sqrt({_SUM.format('x')} / len(x)) / sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] + y[i]) * (x[i] + y[i]))) / len(x)), 7) AS factor FROM pairs", SIGNALS, _PAIRS)
def arr_10_match_mixture(spark, sf_dir):
    return _pairs(spark, sf_dir).select("sig", _r(ar.match_mixture(F.col("x"), F.col("y"), F.col("x")), "factor", 7))


@query(f"SELECT sig, round({_DOT.format('x', 'y')} / (sqrt({_SUM.format('x')}) * sqrt({_SUM.format('y')})), 8) AS cosine FROM pairs", SIGNALS, _PAIRS)
def arr_11_16_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("sig", _r(ar.cosine(F.col("x"), F.col("y")), "cosine", 8))


@query(
    "SELECT g, t, round(sum(v * w) / greatest(sum(w), 1e-8), 8) AS y FROM (SELECT sig // 4 AS g, (sig % 4) * 32 + i AS t, v, 0.5 - 0.5 * cos(2 * pi() * i / 63) AS w FROM (SELECT sig, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM signals WHERE len(x) = 64)) GROUP BY g, t",
    SIGNALS,
)
def arr_12_overlap_add(spark, sf_dir):
    from ..operators.audio import overlap_add

    chunks = signals(spark, sf_dir).where("size(x) = 64").select(F.expr("sig div 4").alias("g"), ((F.col("sig") % 4) * 32).alias("offset"), "x")
    return overlap_add(chunks, ["g"], 64).select("g", "t", _r(F.col("y"), "y", 8))


@query(
    """SELECT sig, frame, k, round(sum(v * w * cos(2 * pi() * k * i / 16)), 6) + 0.0 AS re, round(0.0 - sum(v * w * sin(2 * pi() * k * i / 16)), 6) + 0.0 AS im FROM (
        SELECT sig, frame, i, 0.5 - 0.5 * cos(2 * pi() * i / 16) AS w, CASE WHEN len(x) = 1 THEN x[1] ELSE x[1 + CASE WHEN m >= len(x) THEN 2 * (len(x) - 1) - m ELSE m END] END AS v FROM (
            SELECT sig, x, frame, i, CASE WHEN len(x) = 1 THEN 0 ELSE abs(frame * 4 - 8 + i) % (2 * (len(x) - 1)) END AS m FROM signals, unnest(range(0, len(x) // 4 + 1)) f(frame), range(0, 16) t(i) WHERE len(x) > 0)), range(0, 9) c(k)
    GROUP BY sig, frame, k""",
    SIGNALS,
)
def arr_25_stft(spark, sf_dir):
    from ..operators.spectrum import stft

    pieces = signals(spark, sf_dir).select("sig", F.lit(0).cast("long").alias("offset"), "x")
    found = stft(pieces, ["sig"], 16, 4).select("sig", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
    return found.select("sig", "frame", F.col("k").cast("long").alias("k"), (F.round("c.re", 6) + 0.0).alias("re"), (F.round("c.im", 6) + 0.0).alias("im"))


@query("SELECT sig, i - 1 AS t, round(x[i], 6) AS y FROM signals, unnest(range(1, len(x) + 1)) u(i) WHERE len(x) > 0", SIGNALS)
def arr_25_round_trip(spark, sf_dir):
    """Signals cut into rows of 10 samples, to magnitudes raised to 0.3 and phases, and back."""
    from ..operators.spectrum import from_polar, istft, stft, to_polar

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 10).cast("int")), lambda k: F.struct((k * 10).cast("long").alias("offset"), F.slice("x", k * 10 + 1, F.lit(10)).alias("x")))
    whole = signals(spark, sf_dir).where("size(x) > 0")
    pieces = whole.select("sig", F.explode(cut).alias("p")).select("sig", "p.*")
    spectrum = stft(pieces, ["sig"], 16, 4, frames=5)
    magnitude, phase = to_polar(F.col("re"), F.col("im"), 0.3)
    polar = spectrum.select("sig", "frame", magnitude.alias("m"), phase.alias("p"))
    re, im = from_polar(F.col("m"), F.col("p"), 0.3)
    back = istft(polar.select("sig", "frame", re.alias("re"), im.alias("im")), ["sig"], 16, 4, whole.select("sig", F.size("x").cast("long").alias("length")), samples=20)
    return back.select("sig", "offset", F.posexplode("x").alias("i", "v")).select("sig", (F.col("offset") + F.col("i")).alias("t"), _r(F.col("v"), "y", 6))


@query("SELECT sig, len(x[11:11 + 19]) AS n, round(list_sum(x[11:30]), 8) AS s FROM signals", SIGNALS)
def arr_14_cut(spark, sf_dir):
    part = ar.cut(F.col("x"), F.lit(10), F.lit(20))
    return signals(spark, sf_dir).select("sig", F.size(part).cast("long").alias("n"), _r(ar.total(part), "s", 8))


@query("SELECT sig, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN y[i] > 0 THEN x[i] ELSE 0 END)), 8) AS s FROM pairs", SIGNALS, _PAIRS)
def arr_15_masked(spark, sf_dir):
    mask = F.transform("y", lambda v: (v > 0).cast("int"))
    return _pairs(spark, sf_dir).select("sig", _r(ar.total(ar.masked(F.col("x"), mask)), "s", 8))


@query("SELECT sig, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] - 2 * y[i])), 7) AS es, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] - y[i])), 7) AS sb FROM pairs", SIGNALS, _PAIRS)
def arr_17_components(spark, sf_dir):
    parts = {"speaker2": F.col("y"), "scene": F.col("y"), "event": F.col("y"), "speaker2_reverb": F.lit(None).cast("array<double>"), "event_reverb": F.lit(None).cast("array<double>")}
    es = ar.without_components(F.col("x"), "ER", "ES", parts)
    sb = ar.without_components(F.col("x"), "E", "SB", parts)
    return _pairs(spark, sf_dir).select("sig", _r(ar.total(es), "es", 7), _r(ar.total(sb), "sb", 7))


@query(
    f"""SELECT sig, round(10 * log10((a * a * yy + 1e-8) / (xx - 2 * a * xy + a * a * yy + 1e-8)), 4) AS si_sdr FROM (SELECT sig, (xy + 1e-8) / (yy + 1e-8) AS a, xx, yy, xy FROM (
        SELECT sig, {_SUM.format('x')} AS xx, {_SUM.format('y')} AS yy, {_DOT.format('x', 'y')} AS xy FROM pairs))""",
    SIGNALS, _PAIRS,
)
def arr_20_si_sdr(spark, sf_dir):
    return _pairs(spark, sf_dir).select("sig", _r(ar.si_sdr(F.col("x"), F.col("y")), "si_sdr", 4))


@query(f"SELECT CAST(sig % 3 AS BIGINT) AS variant, count(*) AS n, CAST(sum(CAST(round(si_sdr * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM ({ORACLE_SQL['arr_20_si_sdr']}) GROUP BY 1")
def met_17_by_variant(spark, sf_dir):
    hundredths = F.round(F.col("si_sdr") * 100).cast("long")
    return arr_20_si_sdr(spark, sf_dir).groupBy((F.col("sig") % 3).cast("long").alias("variant")).agg(F.count("*").alias("n"), F.sum(hundredths).alias("hundredths"))


@query("SELECT sig, count(*) FILTER (a >= 0.3) AS active FROM (SELECT sig, c, avg(CASE WHEN abs(v) > 0.1 THEN 1.0 ELSE 0.0 END) AS a FROM (SELECT sig, unnest(x) AS v, (generate_subscripts(x, 1) - 1) // 16 AS c FROM signals) GROUP BY sig, c) GROUP BY sig", SIGNALS)
def arr_22_23_active_chunks(spark, sf_dir):
    active = F.filter(ar.chunks(F.col("x"), 16, 1), lambda c: ar.activity(c, 0.1) >= 0.3)
    return signals(spark, sf_dir).select("sig", F.size(active).cast("long").alias("active"))


@query(f"SELECT sig, round(least(list_max(list_transform(y, lambda v: abs(v))) * b, 0.5), 8) AS peak FROM (SELECT sig, y, sqrt({_SUM.format('x')} / len(x)) / sqrt({_SUM.format('y')} / len(y)) AS b FROM pairs)", SIGNALS, _PAIRS)
def arr_27_rescaled(spark, sf_dir):
    y = ar.rescaled(F.col("y"), F.col("x"), 0.5)
    return _pairs(spark, sf_dir).select("sig", _r(F.array_max(F.transform(y, F.abs)), "peak", 8))
