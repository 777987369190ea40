"""Structured Streaming over ``events``, drained once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.plans.registry import query
from motorlake.session import shared_path
from motorlake.sources.tables import table
from motorlake.streaming import watch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _records(events: DataFrame) -> DataFrame:
    return events.select(F.concat_ws("-", "user_id", "event_type").alias("key"), F.floor(F.col("value") / 5).cast("double").alias("price"), F.col("ts").cast("timestamp").alias("ts"))


@query(
    "WITH r AS (SELECT user_id || '-' || event_type AS key, CAST(floor(value / 5) AS DOUBLE) AS price, ts FROM events), m AS (SELECT *, lag(price) OVER w AS before, row_number() OVER w AS place FROM r WINDOW w AS (PARTITION BY key ORDER BY ts, price)) SELECT CASE WHEN place = 1 THEN 'new' ELSE 'price_change' END AS kind, count(*) AS n, CAST(sum(price) AS BIGINT) AS price FROM m WHERE place = 1 OR price <> before GROUP BY 1"
)
def stream_new_vs_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys and price changes that a stateful stream finds, summed."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        at = shared_path(spark, "stream")
        found = watch.drain(watch.watch(_records(_events(spark, sf_dir))), f"{at}/out", f"{at}/state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("price").cast("bigint").alias("price"))


@query("WITH r AS (SELECT user_id || '-' || event_type AS key, CAST(floor(value / 5) AS DOUBLE) AS price, ts FROM events), m AS (SELECT *, lag(price) OVER w AS before, row_number() OVER w AS place, first(ts) OVER w AS first_seen FROM r WINDOW w AS (PARTITION BY key ORDER BY ts, price)) SELECT key, CASE WHEN place = 1 THEN 'new' ELSE 'price_change' END AS kind, price, first_seen, ts AS last_seen FROM m WHERE place = 1 OR price <> before")
def batch_new_vs_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.changes_in_batch(_records(table(spark, sf_dir, "events")))


@query("SELECT count(DISTINCT user_id || event_type) AS keys FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "stream")
    first = watch.once(_events(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], delay="60 days")
    return watch.drain(first, f"{at}/out", f"{at}/state").agg(F.count("*").alias("keys"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.windowed(table(spark, sf_dir, "events"))
