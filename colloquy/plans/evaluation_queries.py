"""Queries of layered scores, fragments, tables of scores and the smaller functions around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..operators import analytics as an
from ..operators import evaluation as ev
from ..operators import fragments as fr
from ..operators import metrics as me
from ..sinks import files as fs
from ..sinks import lines as out
from ..sources import annotations as an_
from ..sources import tables as src
from .metric_queries import _DROPPED, _HYP, COLLAR, _by_speaker, _hypothesis, _merged, _tokens, timed_tokens
from .registry import Registry
from .views import HISTORY, RUNS, SEGMENTS, SIGNALS, UTTERANCES, history, runs, segments, signals, table, totals, utterances

_REGISTRY = Registry()
QUERIES, ORACLE_SQL, query = _REGISTRY.queries, _REGISTRY.oracle, _REGISTRY.query

# layer 1: by the number of a recording its reference is annotated, annotated but empty, or prepared; every other has a stated duration

_NUMBER = "CAST(substr(rec, 2) AS BIGINT)"
_LAYER1 = f"""ref AS (SELECT rec, speaker, "start", "end" FROM segments WHERE {_NUMBER} % 3 = 0 UNION ALL SELECT rec, speaker, "start" + 40, "end" + 40 FROM segments WHERE {_NUMBER} % 3 = 2),
    tot AS (SELECT r.rec, CASE WHEN CAST(substr(r.rec, 2) AS BIGINT) % 2 = 0 THEN max(s.last) + 500 ELSE max(r."end") END AS total FROM ref r JOIN (SELECT rec, max("end") AS last FROM segments GROUP BY rec) s ON s.rec = r.rec GROUP BY r.rec),
    hypc AS (SELECT h.rec, h.speaker, h."start", least(h."end", t.total) AS "end" FROM hyp h JOIN tot t ON t.rec = h.rec WHERE h."start" < t.total),
    refc AS (SELECT h.rec, h.speaker, h."start", least(h."end", t.total) AS "end" FROM ref h JOIN tot t ON t.rec = h.rec WHERE h."start" < t.total)"""
_SCORED = """scored AS (SELECT s.rec, miss, fa, held - agreed AS confusion, total, (miss + fa + held - agreed) / CAST(total AS DOUBLE) AS der FROM (
        SELECT rec, sum(greatest(r - h, 0) * w) AS miss, sum(greatest(h - r, 0) * w) AS fa, sum(least(r, h) * w) AS held, sum(r * w) AS total FROM (
            SELECT rec, sum(r) OVER p AS r, sum(h) OVER p AS h, lead(t) OVER p - t AS w FROM (SELECT rec, t, sum(r) AS r, sum(h) AS h FROM (
                SELECT rec, "start" AS t, 1 AS r, 0 AS h FROM rm UNION ALL SELECT rec, "end", -1, 0 FROM rm UNION ALL SELECT rec, "start", 0, 1 FROM hm UNION ALL SELECT rec, "end", 0, -1 FROM hm) GROUP BY rec, t) WINDOW p AS (PARTITION BY rec ORDER BY t)) GROUP BY rec) s
    JOIN (SELECT rec, CAST(greatest(sum(CASE WHEN substr(r, 2) = substr(h, 2) THEN w ELSE 0 END), sum(CASE WHEN substr(r, 2) <> substr(h, 2) THEN w ELSE 0 END)) AS DOUBLE) AS agreed FROM (
        SELECT a.rec, a.speaker AS r, b.speaker AS h, least(a."end", b."end") - greatest(a."start", b."start") AS w FROM rm a JOIN hm b ON a.rec = b.rec AND a."start" < b."end" AND b."start" < a."end") GROUP BY rec) c ON c.rec = s.rec)"""


def _layer1(spark, sf_dir):
    turns = segments(spark, sf_dir)
    number = F.substring("rec", 2, 9).cast("long")
    recordings = turns.select("rec").distinct().withColumn("has_annotation", number % 3 != 2)
    stated = totals(turns).select("rec", F.when(number % 2 == 0, F.col("total") - 500).alias("total"))
    prepared = turns.withColumn("start", F.col("start") + 40).withColumn("end", F.col("end") + 40)
    return recordings, ev.layer1(ev.reference_turns(recordings, turns.where(number % 3 == 0), prepared), _hypothesis(spark, sf_dir), stated, width=600_000)


@query(
    f"SELECT rec, CASE WHEN {_NUMBER} % 3 = 2 THEN 'rttm' ELSE 'eaf' END AS source, CAST(miss AS BIGINT) AS miss, CAST(fa AS BIGINT) AS false_alarm, CAST(confusion AS DOUBLE) AS confusion, CAST(total AS BIGINT) AS total, der FROM scored",
    SEGMENTS, _HYP, _LAYER1, _merged("rm", "refc"), _merged("hm", "hypc"), _SCORED,
)
def met_12_layer_1(spark, sf_dir):
    return _layer1(spark, sf_dir)[1]


@query(
    "SELECT r.rec, 100 * der AS der_pct, 100 * (miss / CAST(total AS DOUBLE)) AS miss_pct, 100 * (fa / CAST(total AS DOUBLE)) AS fa_pct, 100 * (confusion / CAST(total AS DOUBLE)) AS conf_pct, CAST(total AS BIGINT) AS total_ref FROM (SELECT DISTINCT rec FROM segments) r LEFT JOIN scored s ON s.rec = r.rec",
    SEGMENTS, _HYP, _LAYER1, _merged("rm", "refc"), _merged("hm", "hypc"), _SCORED,
)
def met_15_layer_1_summary(spark, sf_dir):
    recordings, scores = _layer1(spark, sf_dir)
    return ev.summary1(recordings, scores)


# layer 3: roles are the two speakers; the full mode has all recordings, others some; the mixture comes from the first mode that has one

_MODES = """modes AS (SELECT * FROM (VALUES ('full', 1), ('no_sep', 2), ('no_enh', 3)) v(mode, every)),
    paired AS (SELECT rec FROM drops WHERE speaker IN ('user', 'assistant') GROUP BY rec HAVING count(DISTINCT speaker) = 2)"""
_LAYER3 = """scores AS (
    SELECT d.rec, m.mode, x.metric, CAST(sum(CASE x.metric WHEN 'tcpwer' THEN d.t ELSE d.d END) AS BIGINT) AS errors, CAST(sum(d.n) AS BIGINT) AS length FROM drops d JOIN paired b ON b.rec = d.rec JOIN modes m ON d.rec % m.every = 0, (VALUES ('cpwer'), ('tcpwer')) x(metric) GROUP BY d.rec, m.mode, x.metric
    UNION ALL SELECT d.rec, 'mixture', 'orc_wer', CAST(sum(d.d) AS BIGINT), CAST(sum(d.n) AS BIGINT) FROM drops d JOIN paired b ON b.rec = d.rec WHERE d.rec % 2 = 0 OR d.rec % 3 = 0 GROUP BY d.rec)"""


def _layer3(spark, sf_dir):
    ref, hyp = (t.withColumnRenamed("utt_no", "order") for t in timed_tokens(spark, sf_dir))
    hyps = mixtures = None
    for mode, every in (("full", 1), ("no_sep", 2), ("no_enh", 3)):
        rows = hyp.where(F.col("rec") % every == 0).withColumn("mode", F.lit(mode))
        hyps = rows if hyps is None else hyps.unionByName(rows)
        if every > 1:
            # only the first mode's mixture is the recording's: the other one says something else
            mixed = rows.select("rec", "mode", "order", F.when(F.lit(mode) == "no_enh", F.when(F.col("rec") % 2 == 0, F.array(F.lit("#"))).otherwise(F.col("tokens"))).otherwise(F.col("tokens")).alias("tokens"))
            mixtures = mixed if mixtures is None else mixtures.unionByName(mixed)
    return ev.layer3(ref, hyps, mixtures, collar=COLLAR, speakers=("user", "assistant"))


@query("SELECT rec, mode, metric, errors, length FROM scores", UTTERANCES, _DROPPED, _MODES, _LAYER3)
def met_14_layer_3(spark, sf_dir):
    return _layer3(spark, sf_dir)


@query(
    """SELECT rec, max(CASE WHEN mode = 'full' AND metric = 'cpwer' THEN r END) AS full_cpwer, max(CASE WHEN mode = 'no_sep' AND metric = 'cpwer' THEN r END) AS no_sep_cpwer, max(CASE WHEN mode = 'no_enh' AND metric = 'cpwer' THEN r END) AS no_enh_cpwer,
        max(CASE WHEN mode = 'minimal' THEN r END) AS minimal_cpwer, max(CASE WHEN mode = 'full' AND metric = 'tcpwer' THEN r END) AS full_tcpwer, max(CASE WHEN mode = 'mixture' THEN r END) AS mixture_orc_wer
        FROM (SELECT *, 100.0::DOUBLE * errors / greatest(length, 1) AS r FROM scores) GROUP BY rec""",
    UTTERANCES, _DROPPED, _MODES, _LAYER3,
)
def met_15_layer_3_summary(spark, sf_dir):
    return ev.summary3(_layer3(spark, sf_dir))


# tables of scores


@query(
    """SELECT CASE WHEN rec % 2 = 0 THEN 'even' ELSE 'odd' END AS config, 100.0::DOUBLE * sum(d) / sum(n) AS cp, 100.0::DOUBLE * sum(d) / sum(n) AS orc, 'nan'::DOUBLE AS cer, CAST(row_number() OVER (ORDER BY 100.0::DOUBLE * sum(d) / sum(n), CASE WHEN rec % 2 = 0 THEN 'even' ELSE 'odd' END) AS INTEGER) AS rank FROM drops GROUP BY CASE WHEN rec % 2 = 0 THEN 'even' ELSE 'odd' END
    UNION ALL SELECT 'mixture (floor)', 'nan'::DOUBLE, 100.0::DOUBLE * sum(d) / sum(n), 'nan'::DOUBLE, NULL FROM drops""",
    UTTERANCES, _DROPPED,
)
def agg_23_config_table(spark, sf_dir):
    ref, hyp = _tokens(spark, sf_dir)
    cp = me.assigned_errors(_by_speaker(ref), _by_speaker(hyp), ["rec"]).withColumn("config", F.when(F.col("rec") % 2 == 0, "even").otherwise("odd"))
    ref, hyp = (t.withColumn("speaker", F.lit("all")) for t in (ref, hyp))
    orc = me.single_stream_errors(_by_speaker(ref), _by_speaker(hyp), ["rec"])
    tagged = orc.withColumn("config", F.when(F.col("rec") % 2 == 0, "even").otherwise("odd")).withColumn("metric", F.lit("orc"))
    return ev.config_table(cp.withColumn("metric", F.lit("cp")).unionByName(tagged), orc.withColumn("metric", F.lit("orc")))


@query(
    "SELECT sweep, avg(size) AS avg_size, "
    + ", ".join(f"coalesce(max(CASE WHEN variant = '{v}' THEN CAST(size AS VARCHAR) END), '') AS size_{v}" for v in ev.VARIANTS)
    + " FROM (SELECT sweep, max(size) AS size, ['SER', 'SR', 'ER', 'R', 'SE', 'S', 'E', 'C'][size % 11 + 1] AS variant FROM runs WHERE size % 11 < 8 GROUP BY sweep, size % 11) GROUP BY sweep",
    RUNS,
)
def prj_19_wide_row(spark, sf_dir):
    names = F.array(*map(F.lit, ev.VARIANTS))
    rows = runs(spark, sf_dir).where("size % 11 < 8").groupBy("sweep", (F.col("size") % 11).alias("k")).agg(F.max("size").alias("size"))
    return ev.wide_row(rows.withColumn("variant", F.element_at(names, (F.col("k") + 1).cast("int"))), ["sweep"], ["size"])


@query("SELECT c_mktsegment, count(x) AS n, CAST(sum(x) AS BIGINT) AS total FROM (SELECT c_mktsegment, CASE WHEN c_acctbal >= 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS x FROM customer) GROUP BY c_mktsegment")
def agg_14_non_null(spark, sf_dir):
    x = F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") * 100).cast("long"))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(x).alias("n"), F.sum(x).alias("total"))


@query("SELECT name, score / size * 64000 * 30 / 86400 AS d64, score / size * 128000 * 30 / 86400 AS d128 FROM runs", RUNS)
def agg_20_projection(spark, sf_dir):
    days = {f"d{k}": an.projected_days(F.col("score"), F.col("size"), k * 1000, 30) for k in (64, 128)}
    return runs(spark, sf_dir).select("name", *[v.alias(k) for k, v in days.items()])


@query("SELECT sweep, count(*) AS available, count(*) FILTER (n <= 2) AS got, count(DISTINCT CASE WHEN n <= 2 THEN size END) AS used FROM (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY score DESC, name) AS n FROM runs) GROUP BY sweep", RUNS)
def agg_18_audit(spark, sf_dir):
    rows = runs(spark, sf_dir)
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("sweep").orderBy(F.desc("score"), "name"))).where("n <= 2")
    return an.audit(rows, best.drop("n"), "sweep", "size")


@query('SELECT rec, speaker, "start", "end", CASE WHEN n = 1 THEN 5 ELSE 20 END AS fade_in, CASE WHEN n = of THEN 5 ELSE 20 END AS fade_out FROM (SELECT *, row_number() OVER (PARTITION BY rec, speaker ORDER BY "start", "end") AS n, count(*) OVER (PARTITION BY rec, speaker) AS of FROM segments)', SEGMENTS)
def win_06_edge_fades(spark, sf_dir):
    order = Window.partitionBy("rec", "speaker").orderBy("start", "end")
    first, last = F.row_number().over(order) == 1, F.lead("start").over(order).isNull()
    return segments(spark, sf_dir).select("rec", "speaker", "start", "end", F.when(first, 5).otherwise(20).alias("fade_in"), F.when(last, 5).otherwise(20).alias("fade_out"))


@query('SELECT rec, "start", CASE WHEN w < 300 THEN \'light\' WHEN w < 600 THEN \'moderate\' ELSE \'heavy\' END AS overlap_bin, row_number() OVER (ORDER BY CASE WHEN w < 300 THEN \'light\' WHEN w < 600 THEN \'moderate\' ELSE \'heavy\' END, speaker, rec, "start", w) AS place FROM (SELECT *, "end" - "start" AS w FROM segments) QUALIFY place <= 200', SEGMENTS)
def srt_02_several_keys(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("w", F.col("end") - F.col("start")).withColumn("overlap_bin", fr.overlap_bin(F.col("w"), 300, 600))
    keys = ["overlap_bin", "speaker", "rec", "start", "w"]
    best = rows.orderBy(*keys).limit(200)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long")).select("rec", "start", "overlap_bin", "place")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) // 50, turn, role, text) AS place FROM conversations")
def srt_06_stable(spark, sf_dir):
    """Equal keys keep their places: the original order is the last key."""
    order = Window.partitionBy("conv_id").orderBy(F.expr("length(text) div 50"), "turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT rec, list_filter(['S1', 'S0', 'S7'], lambda s: list_contains(l, s)) AS speakers FROM (SELECT rec, list(DISTINCT speaker) AS l FROM segments GROUP BY rec)", SEGMENTS)
def set_06_canonical_order(spark, sf_dir):
    wanted = F.array(*map(F.lit, ("S1", "S0", "S7")))
    return segments(spark, sf_dir).groupBy("rec").agg(F.array_intersect(wanted, F.collect_set("speaker")).alias("speakers"))


@query("SELECT DISTINCT key FROM (SELECT role AS key FROM conversations UNION ALL SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 0)")
def set_07_union_of_keys(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").select(F.create_map("role", F.lit(1)).alias("m"))
    second = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.create_map("c_mktsegment", F.lit(1)).alias("m"))
    return first.unionByName(second).select(F.explode(F.map_keys("m")).alias("key")).distinct()


@query(
    "SELECT rec, CASE WHEN rec % 2 = 0 THEN 'given' ELSE trim(string_agg(trim(text), ' ' ORDER BY utt_no)) END AS text, CASE WHEN rec % 3 = 0 THEN 'en' ELSE 'pl' END AS language FROM utterances GROUP BY rec", UTTERANCES
)
def prj_16_backfilled_text(spark, sf_dir):
    parts = F.transform(F.sort_array(F.collect_list(F.struct("utt_no", "text"))), lambda p: F.struct(p["text"].alias("text")))
    rows = utterances(spark, sf_dir).groupBy("rec").agg(parts.alias("segments"))
    rows = rows.withColumn("text", F.when(F.col("rec") % 2 == 0, "given")).withColumn("language", F.when(F.col("rec") % 3 == 0, "en"))
    return ev.with_text(rows, "pl").drop("segments")


@query("SELECT 'EAEC-' || conv AS conv, CAST(idx AS BIGINT) AS idx, label FROM (SELECT CAST(conv_id AS VARCHAR) AS conv, turn AS idx, CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS label FROM conversations)")
def str_10_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("EDACC-"), F.col("conv_id").cast("string"))
    label = F.when(F.col("role") == "user", "A").otherwise("B")
    rows = c.select(F.concat(name, F.lit("-"), F.col("turn").cast("string"), F.lit(".wav")).alias("path"), F.concat(name, F.lit("-"), label).alias("speaker"))
    return rows.select(src.renamed_prefix(src.audio_path(F.col("path"))["conv"], "EDACC-", "EAEC-").alias("conv"), src.audio_path(F.col("path"))["idx"].alias("idx"), src.speaker_id(F.col("speaker"))["label"].alias("label"))


def _hms(ms):
    seconds = F.concat((F.floor(ms / 1000) % 60).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.concat_ws(":", F.floor(ms / 3_600_000).cast("string"), (F.floor(ms / 60_000) % 60).cast("string"), seconds)


@query("SELECT rec, \"start\", \"end\", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM utterances WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''", UTTERANCES)
def src_08_hours_first(spark, sf_dir):
    """Lines that begin with hours, minutes and seconds of any width."""
    u = utterances(spark, sf_dir)
    line = F.concat(F.lit("[ "), _hms(F.col("start")), F.lit(" → "), _hms(F.col("end")), F.lit(" ]  "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    return an_.timed_text(u.select(F.col("rec").alias("file"), F.col("utt_no").alias("line_no"), line.alias("value"))).select(F.col("file").alias("rec"), "start", "end", "text")


@query("SELECT c_custkey AS mix FROM customer WHERE c_nationkey % 2 = 0")
def prj_01_indoor(spark, sf_dir):
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mix"), F.when(F.col("c_nationkey") % 2 == 0, "r").alias("reverbForSpeaker1"))
    return src.indoor_filter(manifest, ["SER", "R"]).select("mix")


@query(
    "SELECT CAST(user_id % 5 AS BIGINT) AS config, " + ", ".join(f"CASE WHEN sum(l) FILTER (m = {k}) > 0 THEN 100.0::DOUBLE * sum(e) FILTER (m = {k}) / sum(l) FILTER (m = {k}) ELSE 'nan'::DOUBLE END AS m{k}" for k in range(3))
    + " FROM (SELECT user_id, event_id % 3 AS m, event_id % 7 AS e, event_id % 11 AS l FROM events) GROUP BY user_id % 5"
)
def agg_01_by_metric(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("long").alias("config"), F.concat(F.lit("m"), (e % 3).cast("string")).alias("metric"), (e % 7).alias("errors"), (e % 11).alias("length"))
    return an.micro_averages(rows, ["config"], ["m0", "m1", "m2"])


# fragments

RULE = fr.FragmentRule(target=3000, shortest=1500, longest=6000, stride=500, silence=100, radius=800, overlap=200, balance=0.15, density=0.1)


def _fragments(spark, sf_dir):
    turns = segments(spark, sf_dir)
    return fr.find_fragments(turns, totals(turns), ["rec"], rule=RULE)


@query()
def int_12_find_fragments(spark, sf_dir):
    return _fragments(spark, sf_dir)


def _candidates(spark, sf_dir):
    found = _fragments(spark, sf_dir)
    noise = found.select("rec").distinct().select("rec", F.when(F.substring("rec", 2, 9).cast("long") % 2 == 0, "low").alias("noise")).where("noise is not null")
    return fr.candidates(found, noise, (400, 800), 300)


@query()
def sel_01_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query()
def sel_03_two_passes(spark, sf_dir):
    targets = [("heavy", "low", 10, 2), ("moderate", "low", 10, 2), ("light", "low", 5, 5), ("heavy", "unknown", 10, 2)]
    return fr.select_fragments(_candidates(spark, sf_dir), targets, {"low": 2})


# arrays

_X, _Y = "x[1:32]", "x[33:64]"


def _halves(spark, sf_dir):
    s = signals(spark, sf_dir).where(F.size("x") == 64)
    return s.select("sig", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))


@query("SELECT sig, CASE WHEN sig % 2 = 0 THEN list_transform(range(1, 33), lambda i: x[i] + x[i + 32]) ELSE x[1:32] END AS target FROM signals WHERE len(x) = 64", SIGNALS)
def arr_18_clean_target(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _halves(spark, sf_dir).select("sig", F.when(F.col("sig") % 2 == 0, ar.clean_target(a, b, "EB")).otherwise(ar.clean_target(a, b, "ES")).alias("target"))


@query("SELECT sig, n, longest, list_transform(range(1, longest + 1), lambda i: CASE WHEN i <= n THEN x[i] ELSE 0.0::DOUBLE END) AS padded FROM (SELECT *, max(n) OVER (PARTITION BY sig // 8) AS longest FROM (SELECT sig, x, 8 + sig % 13 AS n FROM signals WHERE len(x) = 64))", SIGNALS)
def arr_19_padded_batches(spark, sf_dir):
    cut = signals(spark, sf_dir).where(F.size("x") == 64).select("sig", F.slice("x", F.lit(1), (8 + F.col("sig") % 13).cast("int")).alias("x"))
    longest = F.max(F.size("x")).over(Window.partitionBy(F.expr("sig div 8")))
    return cut.select("sig", F.size("x").cast("long").alias("n"), longest.cast("long").alias("longest"), ar.fit(F.col("x"), longest).alias("padded"))


@query("SELECT sig, CASE WHEN (a + b) >= (c + d) THEN (a + b) / 2 ELSE (c + d) / 2 END AS average, (a + b) < (c + d) AS crossed, CASE WHEN (a + b) >= (c + d) THEN a ELSE b END AS base_first FROM (SELECT sig, x[1] AS a, x[2] AS b, x[3] AS c, x[4] AS d FROM signals WHERE len(x) = 64)", SIGNALS)
def arr_21_better_pairing(spark, sf_dir):
    x = [F.element_at("x", i) for i in (1, 2, 3, 4)]
    best = ar.better_pairing((x[0], x[1]), (x[2], x[3]), (x[0], x[1]))
    return signals(spark, sf_dir).where(F.size("x") == 64).select("sig", best.alias("p")).select("sig", "p.average", "p.crossed", "p.base_first")


@query("SELECT sig, CASE WHEN n < 0.2 THEN 'nan'::DOUBLE ELSE x[1] END AS value FROM (SELECT sig, x, len(list_filter(x, lambda v: abs(v) > 0.15)) / 64.0::DOUBLE AS n FROM signals WHERE len(x) = 64)", SIGNALS)
def arr_23_silent_target(spark, sf_dir):
    return signals(spark, sf_dir).where(F.size("x") == 64).select("sig", ar.or_nan_if_silent(F.element_at("x", 1), F.col("x"), 0.15, 0.2).alias("value"))


@query("SELECT sig, x[1:least(8 + sig % 5, 10)] AS a, x[33:32 + least(8 + sig % 5, 10)] AS b FROM signals WHERE len(x) = 64", SIGNALS)
def arr_24_common_length(spark, sf_dir):
    h = _halves(spark, sf_dir).select("sig", F.slice("a", F.lit(1), (8 + F.col("sig") % 5).cast("int")).alias("a"), F.slice("b", 1, 10).alias("b"))
    a, b = ar.common_length(F.col("a"), F.col("b"))
    return h.select("sig", a.alias("a"), b.alias("b"))


@query("SELECT sig, coalesce(list_max(list_filter(range(greatest(20 - 6, 0), 21), lambda i: abs(x[i + 1]) < 0.1)), 20) AS first, coalesce(list_min(list_filter(range(40, 47), lambda i: abs(x[i + 1]) < 0.1)), 40) AS last FROM signals WHERE len(x) = 64", SIGNALS)
def arr_09_out_to_silence(spark, sf_dir):
    mask = F.transform("x", lambda v: F.when(F.abs(v) < 0.1, 0.0).otherwise(1.0))
    first, last = ar.extend_to_silence(mask, F.lit(20).cast("long"), F.lit(40).cast("long"), 6)
    return signals(spark, sf_dir).where(F.size("x") == 64).select("sig", first.alias("first"), last.alias("last"))


_COS = "(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))"


@query(
    f"SELECT sig, {_COS.format('x[33:48]', 'x[17:32]')} + {_COS.format('x[49:64]', 'x[1:16]')} > {_COS.format('x[33:48]', 'x[1:16]')} + {_COS.format('x[49:64]', 'x[17:32]')} AS swap FROM signals WHERE len(x) = 64 AND list_dot_product(x[1:16], x[1:16]) > 0 AND list_dot_product(x[17:32], x[17:32]) > 0 AND list_dot_product(x[33:48], x[33:48]) > 0 AND list_dot_product(x[49:64], x[49:64]) > 0",
    SIGNALS,
)
def arr_11_swap(spark, sf_dir):
    a, b, c, d = (F.slice("x", i, 16) for i in (1, 17, 33, 49))
    loud = [ar.energy(x) > 0 for x in (a, b, c, d)]
    rows = signals(spark, sf_dir).where(F.size("x") == 64).where(loud[0] & loud[1] & loud[2] & loud[3])
    return rows.select("sig", ar.swap_needed(a, b, c, d).alias("swap"))


@query()
def arr_26_energy_mask(spark, sf_dir):
    return signals(spark, sf_dir).where(F.size("x") == 64).select("sig", ar.energy_mask(F.col("x"), 4, 6, 3, relative=0.6).alias("mask"))


@query(
    """SELECT sig, list_transform(range(0, 7), lambda i: CAST(round_even(coalesce(list_max(list_transform(x[i * 64 // 7 + 1:(i + 1) * 64 // 7], lambda v: abs(v))), 0.0) / list_max(list_transform(x, lambda v: abs(v))) * 100, 0) AS INTEGER)) AS peaks
        FROM signals WHERE len(x) = 64 AND list_max(list_transform(x, lambda v: abs(v))) > 0""",
    SIGNALS,
)
def agg_17_percent_of_peak(spark, sf_dir):
    rows = signals(spark, sf_dir).where(F.size("x") == 64).where(F.array_max(F.transform("x", F.abs)) > 0)
    return rows.select("sig", ar.peaks(F.col("x"), 7).alias("peaks"))


@query(
    """SELECT sig, CASE WHEN len(v) = 0 THEN 'nan'::DOUBLE ELSE (list_sort(v)[(len(v) + 1) // 2] + list_sort(v)[len(v) // 2 + 1]) / 2 END AS median, len(v) AS n_scored, CAST(len(list_filter(k, lambda c: c = 'silent')) AS BIGINT) AS silent,
        CAST(len(list_filter(k, lambda c: c = 'short')) AS BIGINT) AS short, CAST(len(list_filter(k, lambda c: c = 'scored')) - len(v) AS BIGINT) AS errors FROM (
        SELECT sig, list_transform(c, lambda r: CASE WHEN len(r) < 4 THEN 'short' WHEN len(list_filter(r, lambda v: abs(v) > 0.1)) / CAST(len(r) AS DOUBLE) < 0.4 THEN 'silent' ELSE 'scored' END) AS k,
            list_transform(list_filter(c, lambda r: len(r) >= 4 AND len(list_filter(r, lambda v: abs(v) > 0.1)) / CAST(len(r) AS DOUBLE) >= 0.4 AND r[1] > -0.2), lambda r: r[2]) AS v FROM (
            SELECT sig, [x[1:10], x[11:20], x[21:30], x[31:40], x[41:50], x[51:60], x[61:62 + sig % 3]] AS c FROM signals WHERE len(x) = 64))""",
    SIGNALS,
)
def agg_10_chunk_median(spark, sf_dir):
    target = F.slice("x", F.lit(1), (62 + F.col("sig") % 3).cast("int"))
    found = ar.chunk_median(target, target, 10, 4, 0.1, 0.4, lambda e, r: F.when(F.element_at(r, 1) > -0.2, F.element_at(e, 2)))
    rows = signals(spark, sf_dir).where(F.size("x") == 64).select("sig", found.alias("f"))
    counts = {"n_scored": "n_scored", "silent": "n_skipped_silent", "short": "n_skipped_short", "errors": "n_errored"}
    return rows.select("sig", "f.median", *[F.col(f"f.{v}").cast("long").alias(k) for k, v in counts.items()])


@query("SELECT sig, len(x) < 40 OR list_max(list_transform(x, lambda v: abs(v))) < 0.3 AS skip FROM signals WHERE len(x) > 0", SIGNALS)
def prj_23_skippable(spark, sf_dir):
    return signals(spark, sf_dir).where(F.size("x") > 0).select("sig", ar.skippable(F.col("x"), 40, 0.3).alias("skip"))


@query(
    """SELECT sig, CASE WHEN sig % 5 = 0 THEN 'arbitrary (too short)' WHEN sig % 7 = 0 THEN 'arbitrary (weak anchor)' WHEN sig % 11 = 0 THEN 'arbitrary (non-finite cosine)' WHEN x[1] >= x[2] THEN 'straight' ELSE 'swapped' END AS pairing,
        sig % 5 <> 0 AND sig % 7 <> 0 AND sig % 11 <> 0 AND x[1] < x[2] AS swap FROM signals WHERE len(x) = 64""",
    SIGNALS,
)
def sel_06_anchor_decision(spark, sf_dir):
    straight = F.when(F.col("sig") % 11 == 0, F.lit(float("nan"))).otherwise(F.element_at("x", 1))
    samples = F.when(F.col("sig") % 5 == 0, 10).otherwise(5000)
    choice = ev.anchor_decision(straight, F.element_at("x", 2), samples, F.col("sig") % 7 != 0, 1600)
    return signals(spark, sf_dir).where(F.size("x") == 64).select("sig", choice.alias("c")).select("sig", "c.pairing", "c.swap")


@query(
    """SELECT rec AS file, CASE WHEN speaker = 'S0' THEN 'A' ELSE speaker END AS label, "start", "end", 'enh=off · sep=on · bwe=none · asr=w x' AS backends, CASE WHEN CAST(substr(rec, 2) AS BIGINT) % 2 = 0 THEN 2 ELSE 0 END AS n_overlaps FROM segments""",
    SEGMENTS,
)
def src_22_run_of_three(spark, sf_dir):
    turns = segments(spark, sf_dir)
    recs = turns.select(F.col("rec").alias("file")).distinct()
    meta = """{"spk_to_label": {"S0": "A"}, "config": {"enhancement": {"enabled": false, "backend": "e"}, "separation": {"enabled": true}, "post_separation_processing": {"backend": "none"}, "transcription": {"backend": "w", "model_name": "x"}}}"""
    even = F.substring("file", 2, 9).cast("long") % 2 == 0
    routing = recs.where(even).select("file", F.lit('{"overlap_regions": [{"start": 0.0, "end": 1.0}, {"start": 2.0, "end": 3.0}]}').alias("json"))
    return an_.run_of(recs.select("file", F.lit(meta).alias("json")), out.diarization_json(turns).select(F.col("rec").alias("file"), F.col("value").alias("json")), routing)


# joins and sinks


@query("SELECT m.p_partkey AS name, m.p_retailprice AS mix, s.p_size AS source FROM part m JOIN part s ON s.p_partkey = m.p_partkey")
def jon_04_all_sides(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return src.joined_by_name({"mix": p.select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("mix")), "source": p.select(F.col("p_partkey").alias("name"), F.col("p_size").alias("source"))}, "name")


@query("SELECT c.config, r.rec, o.n FROM (VALUES ('a', 0), ('b', 1), ('c', 2)) c(config, k) CROSS JOIN (SELECT DISTINCT rec FROM segments) r JOIN (SELECT rec, count(*) AS n FROM segments GROUP BY rec) o ON o.rec = r.rec AND (CAST(substr(r.rec, 2) AS BIGINT) + c.k) % 3 <> 0", SEGMENTS)
def jon_13_configs_by_recordings(spark, sf_dir):
    """Every config for every recording, but for outputs that are missing; the configs are a short list."""
    turns = segments(spark, sf_dir)
    configs = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(k).alias("k")) for k, c in enumerate("abc")]))
    wanted = turns.select("rec").distinct().select("rec", configs.alias("c")).select("rec", "c.*")
    outputs = turns.groupBy("rec").agg(F.count("*").alias("n")).select("rec", "n", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    outputs = outputs.where((F.substring("rec", 2, 9).cast("long") + F.col("k")) % 3 != 0)
    return wanted.join(outputs, ["rec", "k"]).select("config", "rec", "n")


@query("SELECT variant, epoch, CASE WHEN epoch >= 9 THEN 'all' WHEN epoch >= 4 THEN 'some' WHEN epoch >= 2 THEN 'few' END AS variants FROM history", HISTORY)
def jon_15_as_of(spark, sf_dir):
    schedule = spark.createDataFrame([(4, "some"), (2, "few"), (9, "all")], "since long, variants string")
    return an.as_of(history(spark, sf_dir), schedule, "epoch", "since", "variants").select("variant", "epoch", "variants")


@query(
    """SELECT rec, speaker, "start", "end", 'annotated' AS origin FROM segments WHERE CAST(substr(rec, 2) AS BIGINT) % 3 = 0 AND "start" % 2 = 0
    UNION ALL SELECT rec, speaker, "start", "end", 'text' FROM segments WHERE rec NOT IN (SELECT rec FROM segments WHERE CAST(substr(rec, 2) AS BIGINT) % 3 = 0 AND "start" % 2 = 0)""",
    SEGMENTS,
)
def src_12_preferred_reference(spark, sf_dir):
    """Annotated utterances where a recording has any, else those of its text."""
    from ..sources.tree import preferred_reference

    turns = segments(spark, sf_dir)
    annotated = turns.where((F.substring("rec", 2, 9).cast("long") % 3 == 0) & (F.col("start") % 2 == 0))
    return preferred_reference(annotated.withColumn("origin", F.lit("annotated")), turns.withColumn("origin", F.lit("text")), ["rec"])


#: Shipments of a customer's orders by day, in whole cents; of those of one day the dearest counts.
_SHIPPED = """shipped AS (SELECT o_custkey AS cust, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) // 86400000 AS day, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


@query(
    "SELECT o.o_orderkey, s.price FROM (SELECT o_orderkey, o_custkey, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) // 86400000 AS day FROM orders) o ASOF LEFT JOIN shipped s ON s.cust = o.o_custkey AND s.day <= o.day",
    _SHIPPED,
)
def jon_15_last_shipment(spark, sf_dir):
    """Each order with the dearest item on the last day, up to its own, on which something was shipped to its customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.unix_date(F.to_date("l_shipdate")).alias("since"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))
    shipped = items.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return an.as_of(orders, shipped, "day", "since", "price", keys=["o_custkey"], width=365).select("o_orderkey", "price")


_MATCHED = """pair AS (SELECT s_nationkey AS nation, s_suppkey AS supplier, c_custkey AS customer, abs(s_acctbal - c_acctbal) AS distance FROM supplier JOIN customer ON c_nationkey = s_nationkey),
    taken AS (SELECT DISTINCT s_nationkey AS nation, 0 AS n, []::BIGINT[] AS suppliers, []::BIGINT[] AS customers, []::DOUBLE[] AS distances FROM supplier
        UNION ALL SELECT nation, n + 1, list_append(suppliers, best.supplier), list_append(customers, best.customer), list_append(distances, best.distance) FROM (
            SELECT t.*, (SELECT min({'distance': p.distance, 'supplier': CAST(p.supplier AS BIGINT), 'customer': CAST(p.customer AS BIGINT)}) FROM pair p WHERE p.nation = t.nation AND NOT list_contains(t.suppliers, p.supplier) AND NOT list_contains(t.customers, p.customer)) AS best FROM taken t) WHERE best IS NOT NULL)"""


@query(
    "SELECT nation, unnest(suppliers) AS supplier, unnest(customers) AS customer, round(unnest(distances), 6) AS distance FROM (SELECT nation, arg_max(suppliers, n) AS suppliers, arg_max(customers, n) AS customers, arg_max(distances, n) AS distances FROM taken GROUP BY nation)",
    "RECURSIVE " + _MATCHED,
)
def jon_09_nearest_accounts(spark, sf_dir):
    """Suppliers and customers of a nation, one to one, nearest balances first."""
    from ..operators.matching import match_nearest

    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), F.col("s_suppkey").cast("long").alias("supplier"), F.col("s_acctbal").cast("double").alias("at"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").cast("long").alias("customer"), F.col("c_acctbal").cast("double").alias("at"))
    found = match_nearest(suppliers, customers, "nation", "supplier", "customer", "at", width=2000.0)
    return found.select("nation", "supplier", "customer", F.round("distance", 6).alias("distance"))


@query(
    "SELECT 'sweep: ' || sweep || chr(10) || 'rank: ' || rank || chr(10) || 'size: ' || size AS snippet, sweep, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sweep ORDER BY score DESC, name) AS INTEGER) AS rank FROM runs WHERE state = 'finished') WHERE rank <= 3", RUNS
)
def snk_17_snippets(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("sweep").orderBy(F.desc("score"), "name"))
    best = runs(spark, sf_dir).where("state = 'finished'").withColumn("rank", rank).where("rank <= 3")
    return best.select(out.snippet(["sweep", "rank", "size"]).alias("snippet"), "sweep", "rank")


@query("SELECT rec, 'text' AS kind, string_agg('# ' || CAST(turn AS VARCHAR) || ' ' || role || chr(10) || text, chr(10) ORDER BY turn, role, text) AS value FROM (SELECT conv_id AS rec, turn, role, text FROM conversations WHERE text IS NOT NULL) GROUP BY rec")
def snk_14_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("rec"), F.struct("turn", "role", "text").alias("key"), F.concat(F.lit("# "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), "text").alias("line"))
    return out.joined(c, "rec", "key", "line").withColumn("kind", F.lit("text"))


@query("SELECT rec, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS letters FROM utterances GROUP BY rec", UTTERANCES)
def snk_12_payload(spark, sf_dir):
    """A recording's nested JSON, read back."""
    u = utterances(spark, sf_dir)
    payload = out.payload(u.select("rec", F.col("utt_no").alias("order"), "speaker", "text"), "rec", "order")
    back = payload.select("rec", F.from_json("value", "rec long, rows array<struct<order:long,speaker:string,text:string>>").alias("p"))
    return back.select("rec", F.size("p.rows").cast("long").alias("turns"), F.aggregate("p.rows", F.lit(0).cast("long"), lambda a, r: a + F.length(r["text"])).alias("letters"))


@query()
def snk_18_clips(spark, sf_dir):
    """Clips of signals at the places that a selection names."""
    x = signals(spark, sf_dir).where(F.size("x") == 64).withColumnRenamed("sig", "rec")
    chosen = x.select("rec", F.explode(F.array(F.lit(0.0), F.lit(1.5))).alias("start")).withColumn("end", F.col("start") + 2).withColumn("frag_id", F.format_string("%d__%s", "rec", F.col("start").cast("string")))
    return fs.clips(chosen, x, "rec", 16)
