"""Streaming forms that Spark's own windows, dedup and joins express.

Streams carry `ts` (TIMESTAMP, for the watermark) next to ts_ms. Late rows are
dropped by the watermark; a batch run has no such notion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(df: DataFrame, delay: str, ts_ms: str = "ts_ms") -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(ts_ms)).withWatermark("ts", delay)


def volume_buckets(trades: DataFrame, bucket: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Tumbling volume per (venue, symbol), emitted once the watermark passes the bucket."""
    timed = with_event_time(trades, delay)
    return (
        timed.groupBy(F.window("ts", bucket).alias("w"), "venue", "symbol")
        .agg(F.sum("size").alias("volume"), F.sum(F.col("size") * F.col("price")).alias("notional"),
             F.count(F.lit(1)).alias("trades"))
        .select("venue", "symbol", F.unix_millis("w.start").alias("bucket_ms"), "volume", "notional", "trades")
    )


def sliding_mentions(posts: DataFrame, window: str = "300 seconds", tick: str = "5 seconds",
                     delay: str = "10 seconds") -> DataFrame:
    """Posts, rate per minute and mean sentiment per ticker in windows that slide every tick."""
    timed = with_event_time(posts, delay)
    span = F.col("hi") - F.col("lo")
    n = F.col("posts_in_window")
    return (
        timed.groupBy(F.window("ts", window, tick).alias("w"), "ticker")
        .agg(F.count(F.lit(1)).alias("posts_in_window"), F.avg("sentiment").alias("sentiment"),
             F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
        .select(
            "ticker", F.unix_millis("w.end").alias("tick_ms"), "posts_in_window", "sentiment",
            F.when((n < 2) | (span <= 0), n.cast("double")).otherwise(n * 60_000.0 / span).alias("rate"),
        )
    )


def first_seen(rows: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a key within the watermark delay."""
    return with_event_time(rows, delay).dropDuplicatesWithinWatermark(keys)


def bridge_candidates(deposits: DataFrame, flows: DataFrame, window_s: int = 1800, min_ratio: float = 0.75,
                      delay: str = "1 minute") -> DataFrame:
    """Deposits with every fitting bridge flow of the preceding window (stream-stream interval join).

    Both sides meet on a log-size cell; a flow is copied to the neighbouring cell it
    can fit. Lists all pairs: `state.latest_bridge` finds the newest fit of a deposit without them.
    """
    import math

    reach = math.log(1.0 / min_ratio) * (1.0 + 1e-9)
    width = 4.0 * reach
    cell = lambda c, d: F.floor((F.log(c) + d) / width).cast("bigint")
    left = with_event_time(deposits.where((F.col("direction") == "inflow") & (F.col("usd_value") > 0)), delay).withColumn(
        "cell", cell("usd_value", 0.0))
    right = flows.where(F.col("usd_value") > 0).select(
        F.col("ts_ms").alias("flow_ms"), F.col("usd_value").alias("flow_usd"), "bridge",
        F.explode(F.array_distinct(F.array(cell("usd_value", -reach), cell("usd_value", reach)))).alias("flow_cell"))
    right = right.withColumn("flow_ts", F.timestamp_millis("flow_ms")).withWatermark("flow_ts", delay)
    ratio = F.least("usd_value", "flow_usd") / F.greatest("usd_value", "flow_usd")
    near = (
        (F.col("cell") == F.col("flow_cell")) & (F.col("flow_ts") <= F.col("ts"))
        & (F.col("flow_ts") >= F.col("ts") - F.expr(f"interval {window_s} seconds"))
    )
    return left.join(right, near).where(ratio >= min_ratio).withColumn("size_ratio", F.round(ratio, 3)).drop(
        "cell", "flow_cell", "flow_ts")
