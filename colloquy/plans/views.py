"""The driver's tables seen as recordings, turns, utterances, signals and runs; each view in Spark and as a DuckDB common table expression.

Times are whole milliseconds so that both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, speaker, start, end): ten users of ``events`` are a recording, odd and even ones its two speakers."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    start = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))) div 600000")
    rows = events.select(
        F.concat(F.lit("R"), F.expr("user_id div 10").cast("string")).alias("rec"),
        F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("speaker"),
        start.alias("start"),
        F.expr("(cast(round(value * 100) as bigint) * 10) div 12").alias("w"),
    )
    return rows.where("w > 0").select("rec", "speaker", "start", (F.col("start") + F.col("w")).alias("end"))


SEGMENTS = """segments AS (
  SELECT rec, speaker, s AS "start", s + w AS "end" FROM (
    SELECT 'R' || (user_id // 10) AS rec, 'S' || (user_id % 2) AS speaker,
      (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 600000 AS s,
      (CAST(round(value * 100) AS BIGINT) * 10) // 12 AS w FROM events) WHERE w > 0)"""


def totals(segments: DataFrame) -> DataFrame:
    """(rec, total): a recording ends 1,000 ms after its last turn."""
    return segments.groupBy("rec").agg((F.max("end") + 1000).alias("total"))


TOTALS = 'totals AS (SELECT rec, max("end") + 1000 AS total FROM segments GROUP BY rec)'


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, utt_no, speaker, start, end, text): turns of ``conversations`` at 60 ms a character, one after the other."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    end = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) * 60
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("utt_no"), F.col("role").alias("speaker"), (end - F.length("text") * 60).alias("start"), end.alias("end"), "text").withColumnRenamed("conv_id", "rec")


UTTERANCES = """utterances AS (
  SELECT conv_id AS rec, row_number() OVER w AS utt_no, role AS speaker, CAST(sum(length(text)) OVER r * 60 - length(text) * 60 AS BIGINT) AS "start",
    CAST(sum(length(text)) OVER r * 60 AS BIGINT) AS "end", text FROM conversations WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text), r AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, state, sweep, score, lr, size): parts as experiment runs."""
    return table(spark, sf_dir, "part").select(
        F.format_string("run%06d", "p_partkey").alias("name"),
        F.when(F.col("p_partkey") % 5 == 0, "crashed").otherwise("finished").alias("state"),
        F.col("p_brand").alias("sweep"),
        F.col("p_retailprice").cast("double").alias("score"),
        F.col("p_size").cast("long").alias("size"),
    )


RUNS = """runs AS (
  SELECT printf('run%06d', p_partkey) AS name, CASE WHEN p_partkey % 5 = 0 THEN 'crashed' ELSE 'finished' END AS state, p_brand AS sweep,
    CAST(p_retailprice AS DOUBLE) AS score, CAST(p_size AS BIGINT) AS size FROM part)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, epoch, score): a customer's orders in time as a metric's history, in whole cents."""
    orders = table(spark, sf_dir, "orders")
    epoch = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select(F.col("o_custkey").cast("long").alias("variant"), epoch.cast("long").alias("epoch"), F.round(F.col("o_totalprice") * 100).cast("long").alias("score"))


HISTORY = """history AS (
  SELECT CAST(o_custkey AS BIGINT) AS variant, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch,
    CAST(round(o_totalprice * 100) AS BIGINT) AS score FROM orders)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sig, x): embeddings as short signals."""
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("sig"), F.col("embedding").cast("array<double>").alias("x"))


SIGNALS = "signals AS (SELECT vec_id AS sig, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL)"


def sql(body: str, *views: str) -> str:
    return f"WITH {', '.join(views)} {body}" if views else body
