"""Structured Streaming over the events table: replay, windows, state, late rows.

Each query drains its source once (availableNow) into a table in the shared folder and returns that table, so results can be
held against batch SQL. In append mode a window is out once the watermark has passed its end.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from packlens.plans.lineage import folder
from packlens.plans.registry import query

DELAY = "10 minutes"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(out: DataFrame, mode: str = "append") -> DataFrame:
    spark = out.sparkSession
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if mode == "append":
        run = writer.format("parquet").option("path", f"{root}/table").start()
    else:
        run = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/table")).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/table")


CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("t1_outbox_replay", "SELECT DISTINCT event_id % 2000 AS id FROM events")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-least-once replay made idempotent by id."""
    ids = source(spark, sf_dir).select((F.col("event_id") % 2000).alias("id"))
    return drained(ids.dropDuplicates(["id"]))


@query("t2_replay_counters", "SELECT count(*) AS accepted, count(DISTINCT event_id % 2000) AS created, count(*) - count(DISTINCT event_id % 2000) AS duplicates FROM events")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    by_id = events.groupBy((F.col("event_id") % 2000).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return by_id.agg(F.sum("n").alias("accepted"), F.count(F.lit(1)).alias("created"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("t3_lateness", "SELECT event_type, count(*) AS n, count_if(event_id % 10 = 0) AS unsynced FROM events GROUP BY event_type")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(source(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 10 == 0).alias("unsynced")), "complete")


@query("t7_job_progress_stream", "SELECT user_id AS job, count(*) AS total, count_if(event_type = 'purchase') AS completed FROM events GROUP BY user_id")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(source(spark, sf_dir).groupBy(F.col("user_id").alias("job")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("completed")), "complete")


@query("t9_weekly_stream", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1")
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that begin on Monday: the epoch is a Thursday, so windows start four days after it."""
    week = F.window("ts", "7 days", startTime="4 days")
    return drained(source(spark, sf_dir).groupBy(week).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("week"), "n"), "complete")


@query("t10_tumbling", f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}")
def t10_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = source(spark, sf_dir).withWatermark("ts", DELAY).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return drained(agg).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("t10_sliding", f"SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE]) AS start FROM events) s GROUP BY start HAVING start + INTERVAL 30 MINUTE <= {CLOSED}")
def t10_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = source(spark, sf_dir).withWatermark("ts", DELAY).groupBy(F.window("ts", "30 minutes", "15 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return drained(agg).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "t10_session",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events),
    s AS (SELECT user_id, ts, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""",
)
def t10_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = source(spark, sf_dir).withWatermark("ts", DELAY).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return drained(agg).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("t10_watermarked_dedupe")
def t10_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = source(spark, sf_dir).select("ts", F.concat_ws("-", "user_id", "event_type").alias("key")).withWatermark("ts", DELAY)
    return drained(keyed.dropDuplicatesWithinWatermark(["key"]))


@query("t6_running_mean", "SELECT user_id, count(*) AS n, round(avg(value), 3) AS mean FROM events WHERE value IS NOT NULL GROUP BY user_id")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sum of squares per key as state (Welford), updated batch by batch; the last row of a key is its result."""

    def update(key, frames, state):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            for x in f["value"].dropna():
                n += 1
                delta = x - mean
                mean += delta / n
                m2 += delta * (x - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [mean]})

    rows = source(spark, sf_dir).groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, mean double", "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)
    return drained(rows).groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("mean", "n"), 3).alias("mean"))
