"""Incremental address-feed ingest (Y1) on Structured Streaming.

New feed files (uid, id, raw address, stored lookup payload) are read with
``maxFilesPerTrigger``, when set, bounding each micro-batch; each row is parsed in place
(one row per returned address, or one row of nulls on a miss), deduplicated
first-wins on (uid, full_address), stamped, and fanned out to a bronze (full row) and a silver (6 columns) sink.

Without an event time the dedup holds across all batches, and its state grows
with the distinct keys.  With ``event_time`` it holds for ``delay`` after a key's
first event: keys whose time is over leave the state store, which keeps what
the feed brings in about two delays, however long the job runs.  A row that is
older than the watermark is late by more than ``delay``; Spark drops it and
counts it (``numRowsDroppedByWatermark`` of the progress).  The state lives in
RocksDB, on the executors' disks, not in their heap.

The fan-out runs in ``foreachBatch``.  Each batch writes into a folder named
after its batch id with mode ``overwrite``, so a batch replayed after a
failure replaces its own output instead of duplicating it; the checkpoint
makes a re-run of the job skip files it has already committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import address as ad

FEED_SCHEMA = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("full_address", T.StringType()),
    T.StructField("payload", T.StringType()),
])

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stamp(df: DataFrame, now: Column | None) -> DataFrame:
    return df.withColumn("created_at", ad.ingest_stamp(now))


def start_address_ingest(spark: SparkSession, feed_dir: str, bronze_dir: str, silver_dir: str,
                         checkpoint_dir: str, max_files_per_trigger: int | None = None,
                         available_now: bool = True, now: Column | None = None,
                         state_partitions: int | None = None, event_time: str | None = None, delay: str = "1 day"):
    """Start the Y1 stream; returns the ``StreamingQuery``.

    ``event_time`` names the feed's timestamp column, and ``delay`` is how long
    a repeated key counts as a duplicate and a late row is waited for.

    ``state_partitions`` fixes the number of dedup-state partitions of a new
    checkpoint (default: the session's shuffle partitions).  It is recorded
    in the checkpoint at first start and kept on restarts.
    """
    schema = T.StructType(FEED_SCHEMA.fields + ([T.StructField(event_time, T.TimestampType())] if event_time else []))
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    feed = reader.parquet(feed_dir)
    if event_time:
        rows = ad.parse_in_place(feed.withWatermark(event_time, delay), [event_time]).dropDuplicatesWithinWatermark(["uid", "full_address"])
    else:
        rows = ad.parse_in_place(feed).dropDuplicates(["uid", "full_address"])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        stamped = _stamp(batch, now)
        ad_cols = ad.BRONZE_COLUMNS + ["created_at"]
        from ..sources.tables import fan_out
        fan_out(stamped.select(*ad_cols),
                {f"{bronze_dir}/batch_id={batch_id}": None,
                 f"{silver_dir}/batch_id={batch_id}": ad.SILVER_COLUMNS},
                mode="overwrite")

    writer = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    wanted = {STATE_STORE: ROCKSDB} if event_time else {}
    if state_partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    previous = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        return writer.start()   # the query keeps the values it started with
    finally:
        for key, value in previous.items():
            spark.conf.set(key, value)


def batch_equivalent(feed: DataFrame) -> DataFrame:
    """What the stream produces for a static feed (used to check stream = batch)."""
    return ad.parse_in_place(feed).dropDuplicates(["uid", "full_address"])
