"""Stream result equals the batch result; a re-run adds nothing."""
import tempfile

from pyspark.sql import functions as F

from bizlens.operators import address as ad
from bizlens.streaming import ingest

HIT = '({"results":{"common":{"totalCount":"1"},"juso":[{"siNm":"S%d","sggNm":"G","emdNm":"E"}]}})'
MISS = '({"results":{"common":{"totalCount":"0"},"juso":[]}})'


def _feed_rows():
    rows = []
    for i in range(40):
        rows.append((str(i), str(i), f"addr {i} (x, y)", HIT % i if i % 4 else MISS))
    rows += [("3", "99", "addr 3 (x, z)", HIT % 3), ("5", "100", "addr 5  (x)", HIT % 5)]  # duplicates after cleaning
    return rows


def test_stream_equals_batch_and_rerun_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="bizlens-stream-")
    feed = spark.createDataFrame(_feed_rows(), ingest.FEED_SCHEMA)
    feed.repartition(3).write.mode("overwrite").parquet(f"{base}/feed")
    args = (spark, f"{base}/feed", f"{base}/bronze", f"{base}/silver", f"{base}/ckpt")
    ingest.start_address_ingest(*args, max_files_per_trigger=1).awaitTermination()
    silver = spark.read.parquet(f"{base}/silver")
    key = ["uid", "full_address", "siNm", "sggNm", "emdNm"]
    got = sorted(tuple(r) for r in silver.select(*key).collect())
    want = sorted(tuple(r) for r in ingest.batch_equivalent(feed).select(*key).collect())
    assert got == want
    assert len(got) == 40  # 2 duplicates removed, misses kept as null rows
    assert silver.where(F.col("siNm").isNull()).count() == 10
    bronze = spark.read.parquet(f"{base}/bronze")
    assert set(ad.BRONZE_COLUMNS + ["created_at"]) <= set(bronze.columns) and bronze.count() == 40
    # re-run with the same checkpoint: no new batches, no new rows
    ingest.start_address_ingest(*args, max_files_per_trigger=1).awaitTermination()
    assert spark.read.parquet(f"{base}/silver").count() == 40


def test_state_is_bounded_by_the_watermark(spark):
    """Duplicates inside a batch, across batches and beyond the watermark; the state forgets keys whose time is over."""
    base = tempfile.mkdtemp(prefix="bizlens-stream-")
    waves = [[(k, 0) for k in range(60)] + [(k, 1) for k in range(20)], [(k, 5) for k in range(60)], [(k, 100) for k in range(100, 110)],
             [(k, 101) for k in range(30)], [(200, 101), (0, 1)]]
    kept, states, dropped = [], [], []
    for wave in waves:
        rows = spark.createDataFrame([(str(k), str(k), f"addr {k}", HIT % k, h) for k, h in wave], "uid string, id string, full_address string, payload string, h int")
        rows.select("uid", "id", "full_address", "payload", F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * F.col("h")).alias("event_at")).write.mode("append").parquet(f"{base}/feed")
        q = ingest.start_address_ingest(spark, f"{base}/feed", f"{base}/bronze", f"{base}/silver", f"{base}/ckpt", state_partitions=2, event_time="event_at", delay="10 hours")
        q.awaitTermination()
        kept.append(spark.read.parquet(f"{base}/silver").count())
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        dropped.append(sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress))
    assert kept == [60, 60, 70, 100, 101]  # wave 2 is all duplicates; wave 4 counts anew
    assert states[1] == 60 and states[2] == 10 and states[-1] <= 41  # the 60 first keys are forgotten
    assert dropped[-1] == 1  # 100 hours late
