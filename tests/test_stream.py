"""The keyed price watch over batches of its own, against the same records in one table."""

import datetime

from motorlake.plans.stream_queries import ROCKS
from motorlake.streaming import watch


def test_price_watch_over_two_batches(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    batches = [[("a", 5.0, at(2)), ("a", 4.0, at(1)), ("b", None, at(1)), ("b", 3.0, at(2)), ("b", None, at(3))], [("a", 5.0, at(3)), ("b", 3.0, at(4)), ("b", 2.0, at(5)), ("c", 1.0, at(1))]]
    schema = "key string, price double, ts timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for records in batches:
            spark.createDataFrame(records, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            found = watch.drain(watch.watch(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    whole = watch.changes_in_batch(spark.createDataFrame([r for b in batches for r in b], schema))
    told = sorted(map(tuple, found.select("key", "kind", "price", "first_seen", "last_seen").collect()), key=str)
    assert told == sorted(map(tuple, whole.collect()), key=str) and len(told) == 5
