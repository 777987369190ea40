"""Continuous collection: keyed state over a stream of records, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, kind string, price double, first_seen bigint, last_seen bigint"
STATE = "price double, first_seen bigint, last_seen bigint"


class PriceWatch(StatefulProcessor):
    """Emits ``new`` for an unknown key and ``price_change`` for another price; otherwise only moves last_seen.

    Records of a batch are taken in order of event time (microseconds), so a late record
    with an old time never overwrites a newer price; it moves nothing. An unknown price
    differs from none. The state is asked and told once for a key and batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("listing", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        price, first, last = known if known else (None, None, None)
        seen = known is not None
        for r in sorted(rows, key=lambda r: (r.ts is None, r.ts or 0, r.price is None, r.price or 0.0)):
            if not seen:
                seen, price, first, last = True, r.price, r.ts, r.ts
                yield Row(key=key[0], kind="new", price=price, first_seen=first, last_seen=last)
            elif r.ts is not None and (last is None or r.ts >= last):
                changed, price, last = None not in (r.price, price) and r.price != price, r.price, r.ts
                if changed:
                    yield Row(key=key[0], kind="price_change", price=price, first_seen=first, last_seen=last)
        self.state.update((price, first, last))

    def close(self) -> None:
        pass


def watch(records: DataFrame) -> DataFrame:
    """(key, price, ts) as a stream to the changes in it; needs the RocksDB state store."""
    timed = records.select("key", "price", F.unix_micros("ts").alias("ts"))
    found = timed.groupBy("key").transformWithState(PriceWatch(), outputStructType=OUT, outputMode="append", timeMode="none")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})


def changes_in_batch(records: DataFrame) -> DataFrame:
    """The same result for a finite table, by a window: what a stream has given once all is read in order of time."""
    from pyspark.sql import Window

    by = Window.partitionBy("key").orderBy("ts", "price")
    before = F.lag("price").over(by)
    rows = records.withColumns({"before": before, "first_seen": F.first("ts").over(by), "place": F.row_number().over(by)})
    kind = F.when(F.col("place") == 1, "new").when(F.col("price") != F.col("before"), "price_change")
    return rows.withColumn("kind", kind).where("kind is not null").select("key", "kind", "price", "first_seen", F.col("ts").alias("last_seen"))


def once(records: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first record of each key, with state kept for as long as records may be late."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if records.isStreaming else records.dropDuplicates(keys)


def windowed(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums of tumbling windows by event type."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all input there is, append to Parquet, and return what the sink holds; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
