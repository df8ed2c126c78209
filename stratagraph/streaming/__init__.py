"""Event batching: quiet windows, capped windows, late rows; batch and streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


BARRIERS = ("absence", "exclusion")


def quiet_batches(events: DataFrame, gap_seconds: int, key: str = "user_id") -> DataFrame:
    """key, started, ended, hints: a batch ends once `gap_seconds` pass without a hint of its key."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = (micros("ts") - micros(F.lag("ts").over(w))) >= gap_seconds * 1_000_000
    numbered = events.withColumn("_b", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(w))
    return numbered.groupBy(key, "_b").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("hints")).drop("_b")


def quiet_batches_stream(events: DataFrame, gap_seconds: int, delay: str = "1 hour", key: str = "user_id") -> DataFrame:
    """The same as a stream: session windows behind a watermark."""
    session = F.session_window("ts", f"{gap_seconds} seconds")
    return events.withWatermark("ts", delay).groupBy(session.alias("s"), key).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("hints")).select(key, "started", "ended", "hints")


def capped_batches(events: DataFrame, gap_seconds: int, cap_seconds: int, key: str = "user_id", barriers=BARRIERS) -> DataFrame:
    """key, started, ended, hints, reason: flushed by quiet, by the cap after the first hint, or at once by a barrier.

    A batch's end depends on its own begin, which no window frame expresses: rows stream through Python in
    order, with the state of one open batch, whatever a key's size."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, out = None, []
        for frame in frames:
            for k, ts, kind in zip(frame["k"], frame["us"], frame["kind"]):
                if open_ and (open_[0] != k or ts - open_[2] >= gap_seconds * 1_000_000 or ts - open_[1] >= cap_seconds * 1_000_000):
                    capped = open_[0] == k and ts - open_[2] < gap_seconds * 1_000_000
                    out.append((*open_, "cap" if capped else "quiet"))
                    open_ = None
                open_ = (k, open_[1], ts, open_[3] + 1) if open_ else (k, ts, ts, 1)
                if kind in barriers:
                    out.append((*open_, "barrier"))
                    open_ = None
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["k", "a", "b", "hints", "reason"])
                out = []
        yield pd.DataFrame(out + ([(*open_, "quiet")] if open_ else []), columns=["k", "a", "b", "hints", "reason"])

    rows = events.select(F.col(key).alias("k"), micros("ts").alias("us"), F.col("event_type").alias("kind"), "event_id").repartition(key_count(events), "k").sortWithinPartitions("k", "us", "event_id")
    made = rows.drop("event_id").mapInPandas(walk, "k long, a long, b long, hints long, reason string")
    return made.select(F.col("k").alias(key), F.timestamp_micros("a").alias("started"), F.timestamp_micros("b").alias("ended"), "hints", "reason")


def key_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def coalesced(events: DataFrame, key: str = "user_id", repeated: str = "click") -> DataFrame:
    """Runs of one repeated kind collapse to their first event; no other kind is ever dropped, and keys don't mix."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    before = F.lag("event_type").over(w)
    return events.withColumn("_p", before).where(~((F.col("event_type") == repeated) & F.coalesce(F.col("_p") == repeated, F.lit(False)))).drop("_p")


def late_rows(events: DataFrame, lateness_seconds: int) -> DataFrame:
    """Events (in order of arrival, by id) older than the greatest time seen by that much.  Arrival is one order
    over all keys: the greatest time before each block of ids is taken first, then within blocks."""
    block = F.floor(F.col("event_id") / 10_000)
    tops = events.groupBy(block.alias("_blk")).agg(F.max("ts").alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))).select("_blk", "_before")
    w = Window.partitionBy("_blk").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("_blk", block).join(before, "_blk").withColumn("_seen", F.greatest(F.max("ts").over(w), "_before"))
    return seen.where(micros("_seen") - micros("ts") > lateness_seconds * 1_000_000).drop("_blk", "_before", "_seen")


def apply_stream(stream: DataFrame, apply, checkpoint: str, **options):
    """Runs apply(batch, id) on each micro-batch; the caller's merge is idempotent by batch id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
