"""Queries of projections, joins, aggregations, windows, sorting, set operations and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as an
from .registry import Registry
from .views import HISTORY, RUNS, SEGMENTS, TOTALS, UTTERANCES, history, runs, segments, table, totals, utterances

_REGISTRY = Registry()
QUERIES, ORACLE_SQL, query = _REGISTRY.queries, _REGISTRY.oracle, _REGISTRY.query


# projections, filters


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL")
def prj_01_nullable_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").where("quality is not null")


@query('SELECT rec, speaker, "start", "end" FROM segments WHERE "end" - "start" >= 500', SEGMENTS)
def prj_02_minimum_duration(spark, sf_dir):
    return segments(spark, sf_dir).where("end - start >= 500")


@query("SELECT name, score FROM runs WHERE state = 'finished' AND coalesce(CASE WHEN size % 4 = 0 THEN NULL ELSE score END, 0.0) >= 905.0", RUNS)
def prj_03_04_finished_above(spark, sf_dir):
    score = F.when(F.col("size") % 4 != 0, F.col("score"))
    return runs(spark, sf_dir).where((F.col("state") == "finished") & (F.coalesce(score, F.lit(0.0)) >= 905.0)).select("name", "score")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def prj_05_not_yet_processed(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(done, "p_partkey", "left_anti")


@query("SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def prj_06_not_blank(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("trim(text) <> ''").select("conv_id", "turn")


@query(
    """SELECT rec, "start", CASE WHEN w < 300 THEN 'light' WHEN w < 600 THEN 'moderate' ELSE 'heavy' END AS bin, w >= 1000 AS substantive, w * (1 + ("start" % 7)) AS rank_score, round(w / 7.0, 2) AS w_r
       FROM (SELECT *, "end" - "start" AS w FROM segments)""",
    SEGMENTS,
)
def prj_07_to_12_derived(spark, sf_dir):
    w = F.col("end") - F.col("start")
    level = F.when(w < 300, "light").when(w < 600, "moderate").otherwise("heavy")
    return segments(spark, sf_dir).select("rec", "start", level.alias("bin"), (w >= 1000).alias("substantive"), (w * (1 + F.col("start") % 7)).alias("rank_score"), F.round(w / 7.0, 2).alias("w_r"))


@query("SELECT DISTINCT rec, speaker, chr(CAST(64 + dense_rank() OVER (PARTITION BY rec ORDER BY speaker) AS INTEGER)) AS label FROM segments", SEGMENTS)
def prj_13_position_labels(spark, sf_dir):
    rank = F.dense_rank().over(Window.partitionBy("rec").orderBy("speaker"))
    return segments(spark, sf_dir).select("rec", "speaker").distinct().withColumn("label", F.char(64 + rank))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' ELSE role END AS label FROM conversations")
def prj_14_label_map(spark, sf_dir):
    names = F.create_map(F.lit("user"), F.lit("A"), F.lit("assistant"), F.lit("B"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(names[F.col("role")], F.col("role")).alias("label"))


@query("SELECT event_id, greatest(0.0, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE x END) AS t FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'nan'::DOUBLE WHEN event_id % 5 = 2 THEN -value ELSE value END AS x FROM events)")
def prj_15_sane_times(spark, sf_dir):
    from ..functions.text import finite_time

    x = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).when(F.col("event_id") % 5 == 2, -F.col("value")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", finite_time(x.cast("double")).alias("t"))


@query("SELECT c_custkey, concat_ws('/', 'corpus', CASE WHEN c_nationkey % 2 = 0 THEN 'indoor' END, CAST(c_custkey AS VARCHAR)) AS path, concat_ws(' · ', c_mktsegment, CASE WHEN c_nationkey < 5 THEN 'low' END) AS descriptor FROM customer")
def prj_18_20_paths(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = F.concat_ws("/", F.lit("corpus"), F.when(F.col("c_nationkey") % 2 == 0, "indoor"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", path.alias("path"), F.concat_ws(" · ", "c_mktsegment", F.when(F.col("c_nationkey") < 5, "low")).alias("descriptor"))


@query("SELECT a.conv_id, a.turn, a.role, CASE WHEN a.text IS NULL OR b.text IS NULL THEN 'kept' WHEN a.text = b.text THEN 'untouched' ELSE 'corrected' END AS status FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 AND b.role = a.role")
def prj_21_status(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    later = c.select("conv_id", "role", (F.col("turn") - 2).alias("turn"), F.col("text").alias("other"))
    status = F.when(F.col("text").isNull() | F.col("other").isNull(), "kept").when(F.col("text") == F.col("other"), "untouched").otherwise("corrected")
    return c.join(later, ["conv_id", "role", "turn"], "left").select("conv_id", "turn", "role", status.alias("status"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%green%' OR lower(p_name) LIKE '%blue%'")
def prj_22_name_contains(spark, sf_dir):
    wanted = F.array(F.lit("green"), F.lit("blue"))
    return table(spark, sf_dir, "part").where(F.exists(wanted, lambda w: F.contains(F.lower("p_name"), w))).select("p_partkey")


# joins


@query("SELECT o_orderkey, c_mktsegment, coalesce(n_name, 'unknown') AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey WHERE o_orderkey % 10 = 1 OR o_orderkey % 10 <> 1")
def jon_01_03_lookups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey", "left").join(nations, "c_nationkey", "left")
    return joined.select("o_orderkey", "c_mktsegment", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("SELECT conv_id FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING count(DISTINCT role) = 2")
def jon_05_both_sides(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.groupBy("conv_id").agg(F.count_distinct("role").alias("n")).where("n = 2").select("conv_id")


_WHOLE_CELLS = 'cells AS (SELECT rec, k * 30000 AS "from", k * 30000 + 30000 AS "to" FROM (SELECT rec, unnest(range(0, total // 30000 + 1)) AS k FROM totals))'


def _whole_cells(spark, sf_dir):
    ends = totals(segments(spark, sf_dir))
    return ends.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total"), F.lit(30_000).cast("long"))).alias("start")).withColumn("end", F.col("start") + 30_000)


@query('SELECT c.rec, "from" AS "start", s.speaker, s."start" AS b_start, greatest("from", s."start") AS lo, least("to", s."end") AS hi FROM cells c JOIN segments s ON s.rec = c.rec AND s."start" < "to" AND "from" < s."end"', SEGMENTS, TOTALS, _WHOLE_CELLS)
def jon_06_whole_overlap_join(spark, sf_dir):
    from ..operators.intervals import meeting

    return meeting(_whole_cells(spark, sf_dir), segments(spark, sf_dir), ["rec"], width=60_000).select("rec", "start", "speaker", "b_start", "lo", "hi")


@query('SELECT c.rec, "from" AS "start", s.speaker, s."start" AS b_start, greatest("from", s."start") AS lo, least("to", s."end") AS hi FROM cells c JOIN segments s ON s.rec = c.rec AND s."start" < "to" AND "from" < s."end"', SEGMENTS, TOTALS, _WHOLE_CELLS)
def jon_06_overlap_join(spark, sf_dir):
    return jon_06_whole_overlap_join(spark, sf_dir)


@query('SELECT c.rec, "from" AS "start", s.speaker, s."start" AS b_start FROM cells c JOIN segments s ON s.rec = c.rec AND (s."start" + s."end") / 2 BETWEEN "from" AND "to"', SEGMENTS, TOTALS, _WHOLE_CELLS)
def jon_07_whole_midpoint_join(spark, sf_dir):
    from ..operators.intervals import meeting

    cells = _whole_cells(spark, sf_dir).withColumn("end", F.col("end") + 1)
    edge = meeting(cells, segments(spark, sf_dir).withColumns({"a": F.col("start"), "b": F.col("end")}), ["rec"], width=60_000).withColumn("end", F.col("end") - 1)
    return edge.where("(a + b) / 2 between start and end").select("rec", "start", "speaker", F.col("a").alias("b_start"))


@query('SELECT c.rec, "from" AS "start", s.speaker, s."start" AS b_start FROM cells c JOIN segments s ON s.rec = c.rec AND (s."start" + s."end") / 2 BETWEEN "from" AND "to"', SEGMENTS, TOTALS, _WHOLE_CELLS)
def jon_07_midpoint_join(spark, sf_dir):
    return jon_07_whole_midpoint_join(spark, sf_dir)


@query('SELECT w.rec, w."from" AS at, min(s."start") AS "start" FROM cells w JOIN segments s ON s.rec = w.rec AND w."from" BETWEEN s."start" AND s."end" GROUP BY 1, 2', SEGMENTS, TOTALS, _WHOLE_CELLS)
def jon_16_whole_point_in_interval(spark, sf_dir):
    from ..operators.intervals import first_containing

    points = _whole_cells(spark, sf_dir).select("rec", F.col("start").alias("at"))
    return first_containing(points, segments(spark, sf_dir).withColumn("n", F.col("start")), ["rec"], "at", "n", width=60_000).select("rec", "at", "start")


@query('SELECT w.rec, w."from" AS at, min(s."start") AS "start" FROM cells w JOIN segments s ON s.rec = w.rec AND w."from" BETWEEN s."start" AND s."end" GROUP BY 1, 2', SEGMENTS, TOTALS, _WHOLE_CELLS)
def jon_16_point_in_interval(spark, sf_dir):
    return jon_16_whole_point_in_interval(spark, sf_dir)


@query("SELECT a.conv_id, a.turn, a.role, CASE WHEN a.text = b.text THEN 'untouched' WHEN a.text IS NULL OR b.text IS NULL THEN 'kept' ELSE 'corrected' END AS status FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 AND b.role = a.role")
def prj_21_whole_status(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    later = c.select("conv_id", "role", (F.col("turn") - 2).alias("turn"), F.col("text").alias("other"))
    status = F.when(F.col("text") == F.col("other"), "untouched").when(F.col("text").isNull() | F.col("other").isNull(), "kept").otherwise("corrected")
    return c.join(later, ["conv_id", "role", "turn"]).select("conv_id", "turn", "role", status.alias("status"))


_SCORES = "(SELECT vec_id AS sid, CASE WHEN vec_id % 7 <> 0 THEN embedding[1] WHEN vec_id % 3 = 0 THEN 'nan'::FLOAT WHEN vec_id % 3 = 1 THEN 'inf'::FLOAT END AS x, embedding[2] AS y FROM embeddings)"


@query(
    f"""SELECT a.sid AS a, b.sid AS b, CASE WHEN coalesce(isfinite(a.x) AND isfinite(b.y) AND isfinite(a.y) AND isfinite(b.x), false) THEN CASE WHEN a.x + b.y >= a.y + b.x THEN 'straight' ELSE 'swapped' END ELSE 'fixed' END AS choice
    FROM {_SCORES} a JOIN {_SCORES} b ON b.sid = a.sid + 1 WHERE a.sid % 2 = 0"""
)
def jon_11_two_by_two(spark, sf_dir):
    """Two scores each; every seventh first score is not a number, infinite or missing."""
    from ..operators.matching import two_by_two

    odd = F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 3 == 1, F.lit(float("inf")))
    x = F.when(F.col("vec_id") % 7 != 0, F.get("embedding", F.lit(0))).otherwise(odd.cast("float"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sid"), x.alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    a, b = v.where("sid % 2 = 0").alias("a"), v.withColumn("key", F.col("sid") - 1).alias("b")
    return a.join(b, F.col("a.sid") == F.col("b.key")).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"), two_by_two(F.col("a.x"), F.col("b.y"), F.col("a.y"), F.col("b.x")).alias("choice"))


@query("SELECT s.s_suppkey, count(l.l_orderkey) AS lines, coalesce(sum(l.l_quantity), 0.0) AS quantity FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_linenumber = 7 GROUP BY s.s_suppkey")
def jon_12_absent_side(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    joined = table(spark, sf_dir, "supplier").select("s_suppkey").join(lines, "s_suppkey", "left")
    return joined.select("s_suppkey", F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@query("SELECT seg AS config, r_name AS rec, count(*) AS n FROM (SELECT c_mktsegment AS seg, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY 1, 2")
def jon_13_config_by_recording(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    counts = table(spark, sf_dir, "customer").join(F.broadcast(nations), "c_nationkey").groupBy(F.col("c_mktsegment").alias("config"), F.col("r_name").alias("rec"))
    return counts.agg(F.count("*").alias("n"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS present FROM customer")
def jon_14_present(spark, sf_dir):
    has = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("present", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(has, "c_custkey", "left").select("c_custkey", F.coalesce("present", F.lit(False)).alias("present"))


@query("SELECT variant, epoch, (SELECT stage FROM (VALUES (1, 'a'), (4, 'b'), (9, 'c')) s(since, stage) WHERE since <= epoch ORDER BY since DESC LIMIT 1) AS stage FROM history", HISTORY)
def jon_15_schedule(spark, sf_dir):
    schedule = spark.createDataFrame([(1, "a"), (4, "b"), (9, "c")], "since long, stage string")
    return an.as_of(history(spark, sf_dir), schedule, "epoch", "since", "stage").select("variant", "epoch", "stage")


@query("SELECT e.epoch, (SELECT stage FROM (VALUES (1, 'a'), (4, 'b'), (9, 'c')) s(since, stage) WHERE since <= e.epoch ORDER BY since DESC LIMIT 1) AS stage FROM (SELECT DISTINCT epoch FROM history) e", HISTORY)
def sel_08_stage_lookup(spark, sf_dir):
    schedule = spark.createDataFrame([(1, "a"), (4, "b"), (9, "c")], "since long, stage string")
    return an.as_of(history(spark, sf_dir).select("epoch").distinct(), schedule, "epoch", "since", "stage")


# aggregations


@query("SELECT speaker, CASE WHEN sum(w) > 0 THEN 100.0 * sum(e) / sum(w) ELSE 'nan'::DOUBLE END AS rate FROM (SELECT speaker, length(text) AS w, length(text) % 13 AS e FROM utterances) GROUP BY speaker", UTTERANCES)
def agg_01_micro_average(spark, sf_dir):
    u = utterances(spark, sf_dir).select("speaker", F.length("text").alias("w"), (F.length("text") % 13).alias("e"))
    return u.groupBy("speaker").agg(an.micro_rate(F.col("e"), F.col("w")).alias("rate"))


@query("SELECT sweep, avg(score) AS score, avg(size) AS size FROM runs GROUP BY sweep UNION ALL SELECT 'AVERAGE', avg(score), avg(size) FROM (SELECT avg(score) AS score, avg(size) AS size FROM runs GROUP BY sweep)", RUNS)
def agg_02_macro_with_total(spark, sf_dir):
    return an.macro_with_total(runs(spark, sf_dir), "sweep", ["score", "size"]).select("sweep", F.round("score", 6).alias("score"), F.round("size", 6).alias("size"))


ORACLE_SQL["agg_02_macro_with_total"] = f"SELECT sweep, round(score, 6) AS score, round(size, 6) AS size FROM ({ORACLE_SQL['agg_02_macro_with_total']})"


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1")
def agg_03_weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(an.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 9).alias("mean"))


@query("SELECT sweep, max(score) AS most, round(avg(score), 6) AS mean, median(score) AS mid, round(stddev_samp(score), 6) AS spread, count(*) AS n FROM runs WHERE state = 'finished' GROUP BY sweep", RUNS)
def agg_04_05_group_stats(spark, sf_dir):
    kept = runs(spark, sf_dir).where("state = 'finished'").groupBy("sweep")
    return kept.agg(F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean"), F.median("score").alias("mid"), F.round(F.stddev_samp("score"), 6).alias("spread"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def agg_06_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def agg_07_contingency(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return counts.select("o_orderpriority", *[F.coalesce(c.upper(), F.lit(0).cast("long")).alias(c) for c in "fop"])


@query("SELECT round(corr(p_size, p_retailprice), 9) AS size_price, round(corr(p_partkey, p_retailprice), 9) AS key_price FROM part")
def agg_09_correlation(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.round(F.corr("p_size", "p_retailprice"), 9).alias("size_price"), F.round(F.corr("p_partkey", "p_retailprice"), 9).alias("key_price"))


@query("SELECT user_id, median(value) FILTER (value > 5) AS mid, avg(value) FILTER (value > 5) AS mean, count(*) FILTER (value <= 5) AS skipped, count(*) AS n FROM events GROUP BY user_id")
def agg_10_11_chunk_scores(spark, sf_dir):
    scored = F.when(F.col("value") > 5, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.median(scored).alias("mid"), F.avg(scored).alias("mean"), F.count_if(F.col("value") <= 5).alias("skipped"), F.count("*").alias("n"))


@query("SELECT user_id, avg(x) AS mean FROM (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS x FROM events) GROUP BY 1")
def agg_12_nan_skipping(spark, sf_dir):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("user_id", x.alias("x")).groupBy("user_id").agg(an.mean_skipping_nan(F.col("x")).alias("mean"))


@query("SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS mid FROM events GROUP BY 1")
def agg_13_upper_middle(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(an.upper_middle(F.col("value")).alias("mid"))


@query('SELECT rec, count(*) AS turns, sum("end" - "start") AS ms, count(*) FILTER ("end" - "start" > 500) AS long_turns, count(DISTINCT speaker) AS speakers, string_agg(DISTINCT speaker, \',\' ORDER BY speaker) AS names FROM segments GROUP BY rec', SEGMENTS)
def agg_15_22_overview(spark, sf_dir):
    w = F.col("end") - F.col("start")
    return segments(spark, sf_dir).groupBy("rec").agg(F.count("*").alias("turns"), F.sum(w).cast("decimal(38,0)").cast("long").alias("ms"), F.count_if(w > 500).alias("long_turns"), F.count_distinct("speaker").alias("speakers"), F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("names"))


ORACLE_SQL["agg_15_22_overview"] = f"SELECT * REPLACE (CAST(ms AS BIGINT) AS ms) FROM ({ORACLE_SQL['agg_15_22_overview']})"


@query("SELECT vec_id, pos // 8 AS bucket, max(abs(v)) AS peak FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def agg_17_peaks(spark, sf_dir):
    samples = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return samples.groupBy("vec_id", F.floor(F.col("pos") / 8).alias("bucket")).agg(F.max(F.abs("v")).alias("peak"))


@query("SELECT role, CASE WHEN sum(w) = 0 THEN 'inf'::DOUBLE ELSE sum(a) / sum(w) END AS factor FROM (SELECT role, length(text) * 60 AS a, turn AS w FROM conversations) GROUP BY role")
def agg_19_real_time_factor(spark, sf_dir):
    sums = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.length("text") * 60).alias("a"), F.sum("turn").alias("w"))
    return sums.select("role", F.when(F.col("w") == 0, F.lit(float("inf"))).otherwise(F.col("a") / F.nullif("w", F.lit(0))).alias("factor"))


@query("SELECT variant, avg(score) AS mean FROM history WHERE epoch > 1 OR (SELECT count(*) FROM history h WHERE h.variant = history.variant) = 1 GROUP BY variant", HISTORY)
def agg_21_mean_without_first(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("variant"))
    return history(spark, sf_dir).withColumn("n", n).where("epoch > 1 or n = 1").groupBy("variant").agg(F.avg("score").alias("mean"))


# windows


@query("SELECT rec, printf('%s__seg%02d', rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY \"start\", \"end\", speaker) - 1 AS INTEGER)) AS frag_id FROM segments", SEGMENTS)
def win_01_fragment_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("rec").orderBy("start", "end", "speaker")) - 1
    return segments(spark, sf_dir).select("rec", F.format_string("%s__seg%02d", "rec", n).alias("frag_id"))


@query("SELECT variant, epoch, score, score - lag(score) OVER (PARTITION BY variant ORDER BY epoch) AS delta FROM history", HISTORY)
def win_07_deltas(spark, sf_dir):
    return an.deltas(history(spark, sf_dir), ["variant"], "epoch", "score")


@query(
    """SELECT variant, epoch, score, best_before, improved, row_number() OVER (PARTITION BY variant, r ORDER BY epoch) - 1 AS since, row_number() OVER (PARTITION BY variant, r ORDER BY epoch) - 1 >= 3 AS stop FROM (
        SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY variant ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS r FROM (
            SELECT *, b AS best_before, b IS NULL OR score > b AS improved FROM (SELECT *, max(score) OVER (PARTITION BY variant ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM history)))""",
    HISTORY,
)
def win_08_patience(spark, sf_dir):
    return an.patience(history(spark, sf_dir), ["variant"], "epoch", "score", 3)


@query('SELECT variant, epoch, bool_or(score > 30000000) OVER (PARTITION BY variant ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS "on" FROM history', HISTORY)
def win_09_sticky(spark, sf_dir):
    return an.sticky(history(spark, sf_dir), ["variant"], "epoch", F.col("score") > 30_000_000).select("variant", "epoch", "on")


@query(
    """SELECT variant, epoch, CAST(sum(bad) OVER (PARTITION BY variant, r ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM (
        SELECT *, sum(1 - bad) OVER (PARTITION BY variant ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CAST(score < 15000000 AS INTEGER) AS bad FROM history))""",
    HISTORY,
)
def win_10_bad_streak(spark, sf_dir):
    return an.bad_streak(history(spark, sf_dir), ["variant"], "epoch", F.col("score") < 15_000_000).select("variant", "epoch", "streak")


@query("SELECT name, row_number() OVER (PARTITION BY sweep ORDER BY score DESC, name) AS rank FROM runs", RUNS)
def win_11_rank(spark, sf_dir):
    return runs(spark, sf_dir).select("name", F.row_number().over(Window.partitionBy("sweep").orderBy(F.desc("score"), "name")).cast("long").alias("rank"))


# sorting, limits, sets, selection


@query("SELECT name, score FROM runs WHERE state = 'finished' ORDER BY score DESC, name LIMIT 10", RUNS)
def srt_03_top_k(spark, sf_dir):
    return runs(spark, sf_dir).where("state = 'finished'").orderBy(F.desc("score"), "name").limit(10).select("name", "score")


@query("SELECT name FROM runs ORDER BY name LIMIT 20 OFFSET 40", RUNS)
def srt_04_page(spark, sf_dir):
    return runs(spark, sf_dir).select("name").orderBy("name").offset(40).limit(20)


@query("SELECT max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest, o_custkey FROM orders GROUP BY o_custkey")
def srt_07_latest(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT sweep, name FROM (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY name) - 1 AS i, count(*) OVER (PARTITION BY sweep) AS n FROM runs) WHERE n <= 8 OR i IN (SELECT (k * (n - 1)) // 7 FROM range(8) r(k))", RUNS)
def srt_09_systematic_sample(spark, sf_dir):
    w = Window.partitionBy("sweep")
    numbered = runs(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("name")) - 1).withColumn("n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.floor(k * (F.col("n") - 1) / 7))
    return numbered.where((F.col("n") <= 8) | F.array_contains(picks, F.col("i").cast("long"))).select("sweep", "name")


@query()
def srt_05_shuffle(spark, sf_dir):
    return runs(spark, sf_dir).orderBy(F.xxhash64("name", F.lit(42)))


@query("SELECT c_custkey AS id, 'customer' AS source, c_name AS name, NULL::BIGINT AS nation FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_name, s_nationkey FROM supplier")
def set_01_tagged_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit("customer").alias("source"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT conv_id, list_sort(list(DISTINCT role)) = ['assistant', 'user'] AS is_ab FROM conversations GROUP BY conv_id")
def set_02_same_labels(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sort_array(F.collect_set("role")) == F.array(F.lit("assistant"), F.lit("user"))).alias("is_ab"))


@query("SELECT count(*) AS n FROM ((SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part) UNION ALL (SELECT p_partkey FROM part EXCEPT ALL SELECT l_partkey FROM lineitem))")
def set_03_multiset_difference(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("k"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("n"))


@query("SELECT sweep, min(name) AS first FROM runs GROUP BY sweep ORDER BY first", RUNS)
def set_04_ordered_dedupe(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("sweep").agg(F.min("name").alias("first")).orderBy("first")


@query('SELECT rec, t, dense_rank() OVER (PARTITION BY rec ORDER BY t) AS slot FROM (SELECT rec, "start" AS t FROM segments UNION SELECT rec, "end" FROM segments)', SEGMENTS)
def set_05_time_slots(spark, sf_dir):
    s = segments(spark, sf_dir)
    slots = s.select("rec", F.col("start").alias("t")).union(s.select("rec", "end")).distinct()
    return slots.withColumn("slot", F.dense_rank().over(Window.partitionBy("rec").orderBy("t")).cast("long"))


@query()
def sel_02_03_quota(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("cell"), F.col("o_custkey").alias("rec"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("key"))
    cells = [(f"{p}/{s}", 12) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM") for s in "FOP"]
    return an.quota_select(orders, cells, 2)


@query("SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS rank FROM runs WHERE state = 'finished' ORDER BY score DESC, name LIMIT 5", RUNS)
def sel_04_top_configs(spark, sf_dir):
    best = runs(spark, sf_dir).where("state = 'finished'").orderBy(F.desc("score"), "name").limit(5)
    return best.select("name", "score", F.row_number().over(Window.orderBy(F.desc("score"), "name")).cast("long").alias("rank"))


@query('SELECT rec, speaker, sum("end" - "start")::BIGINT AS solo, bool_or(t < 100000) AS weak FROM (SELECT *, sum("end" - "start") OVER (PARTITION BY rec, speaker) AS t FROM segments) GROUP BY rec, speaker', SEGMENTS)
def sel_07_anchors(spark, sf_dir):
    total = segments(spark, sf_dir).groupBy("rec", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("solo"))
    return total.withColumn("weak", F.col("solo") < 100_000)


@query(
    """SELECT name, round(list_min(list_transform(picks, lambda p: sqrt((p.a - a) ** 2 + (p.b - b) ** 2))), 6) AS distance FROM
        (SELECT name, (score - avg(score) OVER ()) / stddev_samp(score) OVER () AS a, (size - avg(size) OVER ()) / stddev_samp(size) OVER () AS b FROM runs),
        (SELECT list({'a': a, 'b': b}) AS picks FROM (SELECT name, (score - avg(score) OVER ()) / stddev_samp(score) OVER () AS a, (size - avg(size) OVER ()) / stddev_samp(size) OVER () AS b FROM runs) WHERE name < 'run000004')""",
    RUNS,
)
def agg_16_distance_to_chosen(spark, sf_dir):
    r = runs(spark, sf_dir)
    return an.distance_to_chosen(r, r.where("name < 'run000004'"), ["score", "size"], "name").select("name", F.round("distance", 6).alias("distance"))


@query("SELECT a.sid, a.x, b.y FROM (SELECT vec_id AS sid, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) a JOIN (SELECT vec_id AS sid, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) b ON b.sid = a.sid")
def jon_04_same_name(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("sid"), F.col("embedding")[0].cast("double").alias("x"))
    return a.join(e.select(F.col("vec_id").alias("sid"), F.col("embedding")[1].cast("double").alias("y")), "sid")


@query('SELECT rec, CAST(min(w) AS BIGINT) AS least, CAST(sum(w) AS BIGINT) AS total, count(*) AS speakers FROM (SELECT rec, speaker, sum("end" - "start") AS w FROM segments GROUP BY rec, speaker) GROUP BY rec', SEGMENTS)
def map_01_02_by_speaker(spark, sf_dir):
    per = segments(spark, sf_dir).groupBy("rec", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("w"))
    maps = per.groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "w"))).alias("m"))
    values = F.map_values("m")
    return maps.select("rec", F.array_min(values).alias("least"), F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.size("m").cast("long").alias("speakers"))


@query('SELECT rec, CAST(sum(w) FILTER (speaker = \'S0\') AS BIGINT) AS spk_s0, CAST(sum(w) FILTER (speaker = \'S1\') AS BIGINT) AS spk_s1 FROM (SELECT *, "end" - "start" AS w FROM segments) GROUP BY rec', SEGMENTS)
def map_03_columns_by_speaker(spark, sf_dir):
    wide = segments(spark, sf_dir).withColumn("w", F.col("end") - F.col("start")).groupBy("rec").pivot("speaker", ["S0", "S1"]).agg(F.sum("w"))
    return wide.select("rec", F.col("S0").alias("spk_s0"), F.col("S1").alias("spk_s1"))


@query("SELECT event_id, event_type, coalesce(json_extract_string(props, '$.missing.deep'), 'none') AS deep FROM events")
def map_04_nested_default(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.coalesce(F.get_json_object("props", "$.missing.deep"), F.lit("none")).alias("deep"))


@query("SELECT name AS path, sweep AS model, state AS task, 'r' || size AS run FROM (SELECT 'x/' || sweep || '/' || state || '/r' || size || '/' || name AS name, sweep, state, size FROM runs)", RUNS)
def src_16_checkpoint_paths(spark, sf_dir):
    from ..sources.annotations import checkpoint_paths

    paths = runs(spark, sf_dir).select(F.concat_ws("/", F.lit("x"), "sweep", "state", F.concat(F.lit("r"), F.col("size").cast("string")), "name").alias("path"))
    return checkpoint_paths(paths)


@query("SELECT conv_id, CASE WHEN sum(w) > 0 THEN sum(e) / CAST(sum(w) AS DOUBLE) ELSE 0.0 END AS rate FROM (SELECT conv_id, length(text) * CAST(turn % 2 AS BIGINT) AS w, length(text) % 5 * CAST(turn % 2 AS BIGINT) AS e FROM conversations) GROUP BY conv_id")
def met_11_session_rates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.length("text") * (F.col("turn") % 2)).alias("w"), (F.length("text") % 5 * (F.col("turn") % 2)).alias("e"))
    sums = c.groupBy("conv_id").agg(F.sum("w").alias("w"), F.sum("e").alias("e"))
    return sums.select("conv_id", an.session_rate(F.col("e"), F.nullif("w", F.lit(0))).alias("rate"))


@query()
def srt_10_seeded_choice(spark, sf_dir):
    variants = F.array(*[F.lit(v) for v in ("SER", "SR", "ER", "R")])
    return runs(spark, sf_dir).select("name", F.element_at(variants, (F.pmod(F.xxhash64("name", F.lit(42)), F.lit(4)) + 1).cast("int")).alias("variant"))
