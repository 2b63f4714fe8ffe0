"""Driver tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript segments with invented timing and metrics, in integer arithmetic so that engines agree."""
    rows = table(spark, sf_dir, "conversations").withColumn("dur_ms", F.greatest(F.char_length("text"), F.lit(1)) * 64)
    end = F.sum("dur_ms").over(Window.partitionBy("conv_id").orderBy("turn"))
    metric = lambda a, b, n: (F.col("turn") * a + F.col("conv_id") * b) % n
    return rows.select(
        "conv_id", "turn", "role", "text", (end - F.col("dur_ms")).alias("start_ms"), end.alias("end_ms"),
        (-(metric(37, 11, 200)) / F.lit(100.0)).alias("avg_logprob"), (metric(53, 29, 100) / F.lit(100.0)).alias("no_speech_prob"), (1 + metric(17, 7, 200) / F.lit(100.0)).alias("compression_ratio"),
    )


#: The same in SQL.
SEGMENTS = """
seg AS (
  SELECT conv_id, turn, role, text, end_ms - dur_ms AS start_ms, end_ms,
         -((turn * 37 + conv_id * 11) % 200) / 100.0::DOUBLE AS avg_logprob,
         ((turn * 53 + conv_id * 29) % 100) / 100.0::DOUBLE AS no_speech_prob,
         1 + ((turn * 17 + conv_id * 7) % 200) / 100.0::DOUBLE AS compression_ratio
  FROM (SELECT *, sum(dur_ms) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS end_ms
        FROM (SELECT *, greatest(length(text), 1) * 64 AS dur_ms FROM conversations))
)"""


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an energy series per user: user_id, frame_idx (from 0), energy, event_id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.col("value").alias("energy"))
    return rows.withColumn("frame_idx", F.row_number().over(w) - 1)


ENERGIES = """
en AS (
  SELECT user_id, event_id, event_type, value AS energy,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx
  FROM events
)"""


def visits(spark: SparkSession, sf_dir: str, minutes: int = 90) -> DataFrame:
    """Events as intervals in microseconds per user."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", at.alias("start_us"), (at + minutes * 60_000_000).alias("end_us"))
