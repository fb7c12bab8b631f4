"""Queries of text and time functions, and of sources and sinks as formatting and parsing of lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers_pl import in_words, in_words_sql
from ..sinks import lines as out
from ..sources import annotations as src
from .registry import Registry
from .views import SEGMENTS, UTTERANCES, segments, table, utterances

_REGISTRY = Registry()
QUERIES, ORACLE_SQL, query = _REGISTRY.queries, _REGISTRY.oracle, _REGISTRY.query

#: The normalised words of ``text``, and before numbers are spelt.
_PLAIN_TOKENS = (
    r"list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), "
    r"lambda t: t <> '' AND NOT regexp_matches(t, '^(?:y{2,}|e{2,}|m{2,}|hm+|mhm+|yhy)$')), lambda t: CASE WHEN t = 'okej' THEN 'ok' ELSE t END)"
)
TOKENS = f"flatten(list_transform({_PLAIN_TOKENS}, lambda t: CASE WHEN regexp_matches(t, '^[0-9]+$') THEN string_split({in_words_sql('t')}, ' ') ELSE [t] END))"
#: Conversations name few numbers, so every third utterance gets one.
_NUMBERED = "(text || CASE utt_no % 3 WHEN 0 THEN ' Mam ' || CAST(utt_no * rec * 7919 AS VARCHAR) || ' i 007 okej' ELSE '' END)"


@query(f"SELECT rec, utt_no, array_to_string({TOKENS}, ' ') AS norm FROM (SELECT rec, utt_no, {_NUMBERED} AS text FROM utterances)", UTTERANCES)
def str_01_to_07_normalise(spark, sf_dir):
    number = F.concat(F.lit(" Mam "), (F.col("utt_no") * F.col("rec") * 7919).cast("string"), F.lit(" i 007 okej"))
    text = F.concat("text", F.when(F.col("utt_no") % 3 == 0, number).otherwise(""))
    return utterances(spark, sf_dir).select("rec", "utt_no", tx.normalise(text).alias("norm"))


@query(f"SELECT event_id, {in_words_sql('CAST(event_id * 997 AS VARCHAR)')} AS words FROM events")
def str_06_numbers_in_words(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", in_words((F.col("event_id") * 997).cast("string")).alias("words"))


@query(f"SELECT event_id, {in_words_sql("repeat(CAST(event_id * 997 AS VARCHAR), CAST(event_id % 9 + 1 AS INTEGER))")} AS words FROM events")
def str_06_long_numbers_in_words(spark, sf_dir):
    digits = F.repeat((F.col("event_id") * 997).cast("string"), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", in_words(digits).alias("words"))


@query(r"SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]', '_', 'g') AS safe, replace(p_name, 'a', '') AS without, regexp_extract(p_brand, '([0-9]+)', 1) AS number FROM part")
def str_09_to_12_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.safe_name(F.concat_ws("/", "p_name", "p_type")).alias("safe"), F.replace("p_name", F.lit("a"), F.lit("")).alias("without"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS d FROM part")
def str_13_levenshtein(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("d"))


@query(r"SELECT conv_id, turn, role, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: regexp_matches(t, '^(?:the|and|of)$'))) AS n FROM conversations WHERE text IS NOT NULL")
def str_15_token_counts(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "role", F.size(F.filter(words, lambda t: t.rlike("^(?:the|and|of)$"))).cast("long").alias("n"))


@query("SELECT rec, speaker, string_agg(text, ' ' ORDER BY utt_no) AS joined FROM utterances GROUP BY rec, speaker", UTTERANCES)
def str_16_concatenate(spark, sf_dir):
    parts = F.sort_array(F.collect_list(F.struct("utt_no", "text")))
    return utterances(spark, sf_dir).groupBy("rec", "speaker").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("joined"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%d.%02dM', (n + 5000) // 10000 // 100, (n + 5000) // 10000 % 100) WHEN n >= 1000 THEN printf('%d.%02dK', (n + 5) // 10 // 100, (n + 5) // 10 % 100) ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 750 AS n FROM orders)")
def str_17_short_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.short_count(F.col("o_orderkey").cast("long") * 750).alias("label"))


@query("SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS clock, ms AS again FROM (SELECT event_id, event_id * 123 AS ms FROM events)")
def dtm_01_02_clock(spark, sf_dir):
    ms = F.col("event_id") * 123
    e = table(spark, sf_dir, "events").select("event_id", tx.clock(ms).alias("clock"))
    return e.withColumn("again", tx.clock_to_ms(F.replace("clock", F.lit(","), F.lit("."))))


@query("SELECT event_id, round_even(value * 10, 0) AS ms, CAST(trunc(value * 16) AS BIGINT) AS sample FROM events")
def dtm_03_04_rounding(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.bround(F.col("value") * 10, 0).alias("ms"), (F.col("value") * 16).cast("long").alias("sample"))


_SECONDS = 'printf(\'%.3f\', {0} / 1000.0)'


@query(f"""SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY "start", "end", speaker) AS line_no, 'SPEAKER ' || rec || ' 1 ' || {_SECONDS.format('"start"')} || ' ' || {_SECONDS.format('("end" - "start")')} || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS value FROM segments""", SEGMENTS)
def snk_06_rttm(spark, sf_dir):
    return out.rttm(segments(spark, sf_dir))


@query('SELECT rec, speaker, "start", "end" FROM segments', SEGMENTS)
def src_07_rttm_round_trip(spark, sf_dir):
    return src.rttm(out.rttm(segments(spark, sf_dir)).select(F.col("rec").alias("file"), "line_no", "value")).select("rec", "speaker", "start", "end")


@query("SELECT rec, utt_no AS line_no, '[' || printf('%6.2f', \"start\" / 1000.0) || ' → ' || printf('%6.2f', \"end\" / 1000.0) || ']  ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS value FROM utterances", UTTERANCES)
def snk_02_transcript(spark, sf_dir):
    return out.transcript(utterances(spark, sf_dir))


@query("SELECT rec, \"start\", \"end\", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM utterances WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''", UTTERANCES)
def src_08_timed_text_round_trip(spark, sf_dir):
    lines = out.transcript(utterances(spark, sf_dir)).select(F.col("rec").alias("file"), "line_no", "value")
    return src.timed_text(lines).select(F.col("file").alias("rec"), "start", "end", "text")


@query("SELECT rec, speaker, \"start\", \"end\" FROM utterances WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''", UTTERANCES)
def src_09_sections_round_trip(spark, sf_dir):
    u = utterances(spark, sf_dir)
    order = Window.partitionBy("rec").orderBy("speaker", "is_line", "line_no")
    heads = u.select("rec", "speaker", F.lit(0).cast("long").alias("line_no"), F.format_string("=== Speaker %s (X) ===", "speaker").alias("value")).distinct()
    body = u.select("rec", "speaker", F.col("utt_no").alias("line_no"), out.timed_line(F.col("start"), F.col("end"), F.col("text")).alias("value"))
    lines = heads.withColumn("is_line", F.lit(0)).unionByName(body.withColumn("is_line", F.lit(1))).withColumn("n", F.row_number().over(order))
    return src.sectioned_text(lines.select(F.col("rec").alias("file"), F.col("n").alias("line_no"), "value")).select(F.col("file").alias("rec"), "speaker", "start", "end")


@query("SELECT rec, utt_no AS cue, utt_no || chr(10) || printf('%02d:%02d:%02d,%03d', s // 3600000, (s // 60000) % 60, (s // 1000) % 60, s % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', e // 3600000, (e // 60000) % 60, (e // 1000) % 60, e % 1000) || chr(10) || '[' || speaker || '] ' || trim(text) AS value FROM (SELECT *, \"start\" AS s, \"end\" AS e FROM utterances) WHERE trim(text) <> ''", UTTERANCES)
def snk_05_srt(spark, sf_dir):
    return out.srt(utterances(spark, sf_dir))


@query('SELECT rec, t, dense_rank() OVER (PARTITION BY rec ORDER BY t) AS slot FROM (SELECT rec, "start" AS t FROM utterances UNION SELECT rec, greatest("end", "start" + 1) FROM utterances)', UTTERANCES)
def snk_04_eaf_slots(spark, sf_dir):
    return out.time_slots(utterances(spark, sf_dir))


@query('SELECT rec, speaker, "start", "end", text FROM utterances WHERE trim(text) <> \'\'', UTTERANCES)
def src_10_eaf_round_trip(spark, sf_dir):
    files = out.eaf(utterances(spark, sf_dir))
    return src.eaf(files.select(F.col("rec").alias("file"), F.col("value").alias("xml"))).select(F.col("file").cast("long").alias("rec"), "speaker", "start", "end", "text")


@query('SELECT rec, speaker, "start", "end" FROM segments', SEGMENTS)
def src_05_06_json_round_trip(spark, sf_dir):
    return src.diarization_json(out.diarization_json(segments(spark, sf_dir)).select(F.col("rec").alias("file"), F.col("value").alias("json"))).select(F.col("file").alias("rec"), "speaker", "start", "end")


@query("SELECT r.rec, t.n AS turns, CAST(t.ms AS BIGINT) AS ms FROM (SELECT DISTINCT rec FROM segments) r JOIN (SELECT rec, count(*) AS n, sum(\"end\" - \"start\") AS ms FROM segments GROUP BY rec) t ON t.rec = r.rec", SEGMENTS)
def src_22_run_summary(spark, sf_dir):
    turns = src.diarization_json(out.diarization_json(segments(spark, sf_dir)).select(F.col("rec").alias("file"), F.col("value").alias("json")))
    return turns.groupBy(F.col("file").alias("rec")).agg(F.count("*").alias("turns"), F.sum(F.col("end") - F.col("start")).alias("ms"))


@query("SELECT conv_id AS rec, string_agg('# ' || CAST(turn AS VARCHAR) || ' ' || role, chr(10) ORDER BY turn, role, text) AS value FROM conversations GROUP BY conv_id")
def snk_14_text_files(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec"), F.struct("turn", "role", "text").alias("key"), F.concat(F.lit("# "), F.col("turn").cast("string"), F.lit(" "), "role").alias("line"))
    return out.joined(c, "rec", "key", "line")


@query("SELECT k, k LIKE '%done%' AND k NOT LIKE '%remove%' AS done FROM (SELECT 'R' || user_id || '__seg' || event_id || CASE event_id % 3 WHEN 0 THEN ' done' WHEN 1 THEN ' done remove' ELSE '' END AS k FROM events) WHERE k LIKE '%done%' AND k NOT LIKE '%remove%'")
def src_23_status(spark, sf_dir):
    mark = F.when(F.col("event_id") % 3 == 0, " done").when(F.col("event_id") % 3 == 1, " done remove").otherwise("")
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("R"), F.col("user_id").cast("string"), F.lit("__seg"), F.col("event_id").cast("string"), mark).alias("value"))
    return src.done_lines(lines).select(F.col("value").alias("k"), F.lit(True).alias("done"))
