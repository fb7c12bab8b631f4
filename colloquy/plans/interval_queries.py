"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from .registry import Registry
from .views import SEGMENTS, TOTALS, segments, table, totals

_REGISTRY = Registry()
QUERIES, ORACLE_SQL, query = _REGISTRY.queries, _REGISTRY.oracle, _REGISTRY.query

#: Milliseconds of a recording that one task scans.
STRETCH = 600_000


def _merged(name: str, rule: str, source: str = "segments", keys: str = "rec, speaker") -> str:
    """A chain of common table expressions that merges ``source``; ``rule`` says when a span opens, given a, reached."""
    return f"""{name}_o AS (SELECT {keys}, "start" AS a, "end" AS b, max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {source}),
    {name}_i AS (SELECT {keys}, a, b, sum(CASE WHEN reached IS NULL OR {rule} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM {name}_o),
    {name} AS (SELECT {keys}, min(a) AS "start", max(b) AS "end" FROM {name}_i GROUP BY {keys}, island)"""


_OVERLAPS = f"""{_merged("per", "a > reached")},
    steps AS (SELECT rec, t, sum(d) AS d FROM (SELECT rec, "start" AS t, 1 AS d FROM per UNION ALL SELECT rec, "end", -1 FROM per) GROUP BY rec, t),
    lev AS (SELECT rec, t, sum(d) OVER (PARTITION BY rec ORDER BY t) AS n, lead(t) OVER (PARTITION BY rec ORDER BY t) AS u FROM steps),
    rn AS (SELECT *, sum(CASE WHEN n < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY t) AS run FROM lev),
    crossed AS (SELECT rec, min(t) AS "start", max(u) AS "end" FROM rn WHERE n >= 2 GROUP BY rec, run)"""
_SPEECH = _merged("speech", "a > reached", keys="rec")


@query('SELECT rec, speaker, "start", "end" FROM m', SEGMENTS, _merged("m", "a >= reached"))
def int_01_merge_touching_apart(spark, sf_dir):
    return iv.merge(segments(spark, sf_dir), ["rec", "speaker"], width=STRETCH)


@query('SELECT rec, speaker, "start", "end" FROM m', SEGMENTS, _merged("m", "a - reached >= 400"))
def int_02_merge_close(spark, sf_dir):
    return iv.merge(segments(spark, sf_dir), ["rec", "speaker"], gap=400, width=STRETCH)


@query('SELECT rec, "start", "end" FROM speech', SEGMENTS, _SPEECH)
def int_03_speech(spark, sf_dir):
    return iv.merge(segments(spark, sf_dir), ["rec"], touching=True, width=STRETCH)


_LEFT = """SELECT rec, speaker, "start", "end" FROM (
        SELECT c.rec, c.speaker, coalesce(lag(c.hi) OVER (PARTITION BY c.rec, c.speaker, c.s, c.e ORDER BY c.lo), c.s) AS "start", c.lo AS "end" FROM cuts c
        UNION ALL SELECT rec, speaker, max(hi), e FROM cuts GROUP BY rec, speaker, s, e
        UNION ALL SELECT m.rec, m.speaker, m."start", m."end" FROM m WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.rec = m.rec AND c.speaker = m.speaker AND c.s = m."start")
    ) WHERE "end" - "start" > {0}"""
_CUTS = """cuts AS (SELECT m.rec, m.speaker, m."start" AS s, m."end" AS e, greatest(m."start", o."start") AS lo, least(m."end", o."end") AS hi
        FROM m JOIN crossed o ON m.rec = o.rec AND m."start" < o."end" AND o."start" < m."end")"""


@query(_LEFT.format(1), SEGMENTS, _merged("m", "a >= reached"), _OVERLAPS, _CUTS)
def int_04_subtract(spark, sf_dir):
    turns = segments(spark, sf_dir)
    return iv.subtract(iv.merge(turns, ["rec", "speaker"], width=STRETCH), iv.overlaps(turns, width=STRETCH), ["rec"], least=1, width=STRETCH)


@query('SELECT rec, "start", "end" FROM crossed', SEGMENTS, _OVERLAPS)
def int_05_overlaps(spark, sf_dir):
    return iv.overlaps(segments(spark, sf_dir), width=STRETCH)


_GAPS = """gaps AS (SELECT rec, a AS "start", b AS "end" FROM (
        SELECT rec, coalesce(lag("end") OVER (PARTITION BY rec ORDER BY "start"), 0) AS a, "start" AS b FROM speech
        UNION ALL SELECT t.rec, coalesce(l.last, 0), t.total FROM totals t LEFT JOIN (SELECT rec, max("end") AS last FROM speech GROUP BY rec) l ON l.rec = t.rec) WHERE b - a >= 200)"""


@query('SELECT * FROM gaps', SEGMENTS, TOTALS, _SPEECH, _GAPS)
def int_06_silences(spark, sf_dir):
    turns = segments(spark, sf_dir)
    return iv.gaps(iv.merge(turns, ["rec"], touching=True, width=STRETCH), totals(turns), ["rec"], 200, width=STRETCH)


_WINDOWS = """win AS (SELECT rec, total, k * 60000 AS "start", k * 60000 + 90000 AS "end" FROM totals, unnest(range(0, CAST((total - 90000) // 60000 + 1 AS BIGINT))) AS u(k) WHERE total >= 90000)"""


@query('SELECT rec, total, "start", "end" FROM win', SEGMENTS, TOTALS, _WINDOWS)
def int_09_sliding_windows(spark, sf_dir):
    return iv.sliding(totals(segments(spark, sf_dir)), 90_000, 60_000)


_CLIP = 'least(w."end", {0}."end") - greatest(w."start", {0}."start")'
_MEET = 'w.rec = {0}.rec AND w."start" < {0}."end" AND {0}."start" < w."end"'
_MEASURED = f"""measured AS (SELECT w.rec, w."start", w."end", coalesce(o.overlap, 0) AS overlap, coalesce(o.events, 0) AS events, coalesce(o.longest, 0) AS longest, coalesce(p.speech, 0) AS speech, coalesce(q.s0, 0) AS s0, coalesce(q.s1, 0) AS s1 FROM win w
    LEFT JOIN (SELECT w.rec, w."start", sum({_CLIP.format("o")}) AS overlap, count(*) AS events, max({_CLIP.format("o")}) AS longest FROM win w JOIN crossed o ON {_MEET.format("o")} GROUP BY 1, 2) o ON o.rec = w.rec AND o."start" = w."start"
    LEFT JOIN (SELECT w.rec, w."start", sum({_CLIP.format("s")}) AS speech FROM win w JOIN speech s ON {_MEET.format("s")} GROUP BY 1, 2) p ON p.rec = w.rec AND p."start" = w."start"
    LEFT JOIN (SELECT w.rec, w."start", sum(CASE WHEN s.speaker = 'S0' THEN {_CLIP.format("s")} END) AS s0, sum(CASE WHEN s.speaker = 'S1' THEN {_CLIP.format("s")} END) AS s1 FROM win w JOIN segments s ON {_MEET.format("s")} GROUP BY 1, 2) q ON q.rec = w.rec AND q."start" = w."start")"""


def _measured(spark, sf_dir):
    turns = segments(spark, sf_dir)
    found = iv.measure(iv.sliding(totals(turns), 90_000, 60_000).drop("total"), turns, ["rec"], width=STRETCH)
    spoken = {f"s{i}": F.coalesce(F.col("by_speaker").getItem(f"S{i}"), F.lit(0)) for i in (0, 1)}
    return found.withColumns(spoken).drop("by_speaker")


@query("SELECT rec, \"start\", \"end\", CAST(overlap AS BIGINT) AS overlap, CAST(events AS BIGINT) AS events, CAST(longest AS BIGINT) AS longest, CAST(speech AS BIGINT) AS speech, CAST(s0 AS BIGINT) AS s0, CAST(s1 AS BIGINT) AS s1 FROM measured", SEGMENTS, TOTALS, _WINDOWS, _OVERLAPS, _SPEECH, _MEASURED)
def int_07_measure_windows(spark, sf_dir):
    return _measured(spark, sf_dir)


@query(
    """SELECT w.rec, w.end AS at, coalesce((SELECT min((g."start" + g."end") / 2) FROM gaps g WHERE g.rec = w.rec AND (g."start" + g."end") / 2 BETWEEN w."end" AND w."end" + 5000), CAST(w."end" AS DOUBLE)) AS snapped FROM win w""",
    SEGMENTS, TOTALS, _SPEECH, _GAPS, _WINDOWS,
)
def int_08_snap_outward(spark, sf_dir):
    turns = segments(spark, sf_dir)
    silences = iv.gaps(iv.merge(turns, ["rec"], touching=True, width=600_000), totals(turns), ["rec"], 200, width=600_000)
    ends = iv.sliding(totals(turns), 90_000, 60_000).select("rec", F.col("end").alias("at"), F.col("end").alias("snapped"))
    return iv.snap(ends, silences, ["rec"], "snapped", 5000, 1)


@query(
    """SELECT rec, "start", "end", CASE WHEN next_end IS NULL THEN NULL ELSE greatest(least("end", next_end) - greatest("start", next_start), 0) / (greatest("end", next_end) - least("start", next_start)) END AS iou FROM (
        SELECT rec, "start", "end", lead("start") OVER w AS next_start, lead("end") OVER w AS next_end FROM segments WINDOW w AS (PARTITION BY rec ORDER BY "start", "end", speaker))""",
    SEGMENTS,
)
def int_10_hull_iou(spark, sf_dir):
    order = Window.partitionBy("rec").orderBy("start", "end", "speaker")
    after = segments(spark, sf_dir).withColumn("a", F.lead("start").over(order)).withColumn("b", F.lead("end").over(order))
    return after.select("rec", "start", "end", F.when(F.col("b").isNotNull(), iv.hull_iou(F.col("start"), F.col("end"), F.col("a"), F.col("b"))).alias("iou"))


_SUPPRESSED = """ranked AS (SELECT rec, "start" AS a, "end" AS b, overlap, row_number() OVER (PARTITION BY rec ORDER BY overlap DESC, "start", "end") AS n FROM measured WHERE overlap > 0),
    taken AS (SELECT DISTINCT rec, 0::BIGINT AS n, []::STRUCT(a BIGINT, b BIGINT, overlap BIGINT)[] AS kept FROM ranked
        UNION ALL SELECT t.rec, r.n, CASE WHEN len(list_filter(t.kept, lambda k: greatest(least(k.b, r.b) - greatest(k.a, r.a), 0) > 0.1 * (greatest(k.b, r.b) - least(k.a, r.a)))) = 0
            THEN list_append(t.kept, {'a': CAST(r.a AS BIGINT), 'b': CAST(r.b AS BIGINT), 'overlap': CAST(r.overlap AS BIGINT)}) ELSE t.kept END FROM taken t JOIN ranked r ON r.rec = t.rec AND r.n = t.n + 1)"""


@query(
    """SELECT rec, k.a AS "start", k.b AS "end", k.overlap AS overlap FROM (SELECT rec, unnest(arg_max(kept, n)) AS k FROM taken GROUP BY rec)""",
    "RECURSIVE " + SEGMENTS, TOTALS, _WINDOWS, _OVERLAPS, _SPEECH, _MEASURED, _SUPPRESSED,
)
def int_11_suppress(spark, sf_dir):
    found = _measured(spark, sf_dir).where("overlap > 0").select("rec", "start", "end", "overlap")
    return iv.suppress(found, ["rec"], "overlap", 0.1, width=90_000)


_FILTERED = """SELECT rec, "start", "end", CAST(overlap AS BIGINT) AS overlap, least(s0, s1) / (s0 + s1) AS balance, speech / ("end" - "start") AS density FROM measured
    WHERE overlap >= 1000 AND s0 + s1 > 0 AND least(s0, s1) / (s0 + s1) >= 0.2 AND speech / ("end" - "start") >= 0.3"""


@query(_FILTERED, SEGMENTS, TOTALS, _WINDOWS, _OVERLAPS, _SPEECH, _MEASURED)
def int_12_fragment_candidates(spark, sf_dir):
    found = _measured(spark, sf_dir)
    balance, density = F.least("s0", "s1") / (F.col("s0") + F.col("s1")), F.col("speech") / (F.col("end") - F.col("start"))
    kept = found.where("overlap >= 1000 and s0 + s1 > 0").where((balance >= 0.2) & (density >= 0.3))
    return kept.select("rec", "start", "end", "overlap", balance.alias("balance"), density.alias("density"))


@query(_LEFT.format(0), SEGMENTS, _merged("m", "a >= reached"), _OVERLAPS, _CUTS)
def int_13_solo(spark, sf_dir):
    turns = segments(spark, sf_dir)
    return iv.solo(turns, iv.overlaps(turns, width=STRETCH), width=STRETCH)


@query('SELECT rec, "start", "end" FROM m', SEGMENTS, _OVERLAPS, 'longer AS (SELECT * FROM crossed WHERE "end" - "start" >= 100)', _merged("m", "a - reached >= 2000", "longer", "rec"))
def int_14_regions(spark, sf_dir):
    return iv.select_regions(iv.overlaps(segments(spark, sf_dir)), ["rec"], 100, 2000)


@query(
    """SELECT rec, "start", "end", "start" - fl - least(x / 2 - fr, "start" - fl) AS pad_start, "end" + fr + least(x / 2 - fl, total - "end" - fr) AS pad_end FROM (
        SELECT *, least(x / 2, "start") AS fl, least(x / 2, total - "end") AS fr FROM (SELECT s.*, t.total, greatest(4000 - (s."end" - s."start"), 0) AS x FROM crossed s JOIN totals t ON t.rec = s.rec))""",
    SEGMENTS, TOTALS, _OVERLAPS,
)
def int_15_pad_at_edges(spark, sf_dir):
    turns = segments(spark, sf_dir)
    a, b = iv.pad(F.col("start"), F.col("end"), F.col("total"), F.lit(4000))
    return iv.overlaps(turns).join(totals(turns), "rec").select("rec", "start", "end", a.alias("pad_start"), b.alias("pad_end"))


@query('SELECT s.rec, s."start", s."end", greatest(s."start" - 750, 0) AS pad_start, least(s."end" + 750, t.total) AS pad_end FROM crossed s JOIN totals t ON t.rec = s.rec', SEGMENTS, TOTALS, _OVERLAPS)
def int_16_fixed_pad(spark, sf_dir):
    turns = segments(spark, sf_dir)
    a, b = iv.window_for(F.col("start"), F.col("end"), F.col("total"), "fixed_pad", 750)
    return iv.overlaps(turns).join(totals(turns), "rec").select("rec", "start", "end", a.alias("pad_start"), b.alias("pad_end"))


@query(
    """SELECT rec, speaker, CASE WHEN "start" < p THEN least(p, "end") ELSE "start" END AS "start", "end" FROM (SELECT *, lag("end") OVER (PARTITION BY rec, speaker ORDER BY "start", "end") AS p FROM segments)""",
    SEGMENTS,
)
def int_17_clamp(spark, sf_dir):
    return iv.clamp_emits(segments(spark, sf_dir), ["rec", "speaker"])


@query("""SELECT * FROM (SELECT rec, "start", "end", row_number() OVER (PARTITION BY rec ORDER BY "start", "end") - 1 AS idx FROM crossed) WHERE "end" - "start" >= 150""", SEGMENTS, _OVERLAPS)
def int_18_number_then_drop(spark, sf_dir):
    return iv.number_then_drop(iv.overlaps(segments(spark, sf_dir)), ["rec"], 150)


@query(
    """SELECT rec, speaker, "start", "end", CAST(c AS BIGINT) AS concat_start, CAST(c + "end" - "start" AS BIGINT) AS concat_end FROM (
        SELECT *, coalesce(sum("end" - "start") OVER (PARTITION BY rec, speaker ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (row_number() OVER w - 1) * 100 AS c FROM m WINDOW w AS (PARTITION BY rec, speaker ORDER BY "start", "end"))""",
    SEGMENTS, _merged("m", "a >= reached"),
)
def int_19_shortened_map(spark, sf_dir):
    return iv.shortened_map(iv.merge(segments(spark, sf_dir), ["rec", "speaker"]), ["rec", "speaker"], 100)


@query('SELECT s.rec, speaker, "start", "end", greatest("start", 0) AS concat_start, least("end", total - 5000) AS concat_end FROM segments s JOIN totals t ON t.rec = s.rec WHERE least("end", total - 5000) > greatest("start", 0)', SEGMENTS, TOTALS)
def int_20_full_length_map(spark, sf_dir):
    turns = segments(spark, sf_dir)
    return iv.full_length_map(turns, totals(turns).withColumn("total", F.col("total") - 5000), ["rec"])


@query("""SELECT rec, "start", "end", 'solo' AS kind FROM speech UNION ALL SELECT rec, "start", "end", 'overlap' FROM crossed""", SEGMENTS, _SPEECH, _OVERLAPS)
def int_21_events(spark, sf_dir):
    turns = segments(spark, sf_dir)
    return iv.event_list(iv.merge(turns, ["rec"], touching=True), iv.overlaps(turns))


@query('SELECT o.rec, o."start", least(o."end", t.total - 3000) AS "end", p.speaker FROM crossed o JOIN totals t ON t.rec = o.rec JOIN (SELECT DISTINCT rec, speaker FROM segments) p ON p.rec = o.rec WHERE least(o."end", t.total - 3000) > o."start"', SEGMENTS, TOTALS, _OVERLAPS)
def int_22_fill_regions(spark, sf_dir):
    turns = segments(spark, sf_dir)
    return iv.fill_regions(iv.overlaps(turns), turns.select("rec", "speaker").distinct(), totals(turns).withColumn("total", F.col("total") - 3000), ["rec"])


@query('SELECT rec, "start", CAST(overlap AS BIGINT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY overlap DESC, "start") AS n FROM measured WHERE overlap > 0) WHERE n = 1', SEGMENTS, TOTALS, _WINDOWS, _OVERLAPS, _SPEECH, _MEASURED)
def int_23_best_window(spark, sf_dir):
    turns = segments(spark, sf_dir)
    return iv.best_window(totals(turns), iv.overlaps(turns, width=STRETCH), ["rec"], 90_000, 60_000, width=STRETCH)


@query(
    """SELECT user_id, event_type, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
        SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, run, event_type"""
)
def int_24_run_lengths(spark, sf_dir):
    return iv.run_lengths(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", width=10_000)


@query(
    """SELECT rec, speaker, "start", "end", f AS finding FROM (SELECT rec, speaker, "start", "end", unnest([CASE WHEN "start" % 11 = 0 OR "start" % 13 = 0 THEN 'empty' END, CASE WHEN "end" <= "start" THEN 'not_positive' END,
            CASE WHEN "end" - "start" > 800 THEN 'too_long' END, CASE WHEN p - "start" > 50 THEN 'same_speaker_overlap' END]) AS f FROM (
        SELECT *, lag("end") OVER (PARTITION BY rec, speaker ORDER BY "start", "end") AS p FROM (SELECT rec, speaker, "start", CASE WHEN "start" % 17 = 0 THEN "start" ELSE "end" END AS "end" FROM segments))) WHERE f IS NOT NULL""",
    SEGMENTS,
)
def int_25_lint(spark, sf_dir):
    text = F.when(F.col("start") % 11 == 0, " ").when(F.col("start") % 13 != 0, "x")
    turns = segments(spark, sf_dir).withColumn("text", text).withColumn("end", F.when(F.col("start") % 17 == 0, F.col("start")).otherwise(F.col("end")))
    return iv.lint(turns, ["rec"], longest=800).drop("text")


@query(
    """SELECT rec, speaker, "start", "end" FROM (SELECT *, row_number() OVER (PARTITION BY rec, run ORDER BY "start", "end", speaker) AS n FROM (
        SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY "start", "end", speaker ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND "start" - lag("end") OVER w < 60000 THEN 0 ELSE 1 END AS c FROM segments WINDOW w AS (PARTITION BY rec ORDER BY "start", "end", speaker)))) WHERE n = 3""",
    SEGMENTS,
)
def int_26_repeated_runs(spark, sf_dir):
    return iv.repeated_runs(segments(spark, sf_dir), ["rec"], "speaker", 3, 60_000, width=STRETCH)
