"""Trade-flow operators: volume buckets, cumulative delta and their events.

Trades: venue, symbol, ts_ms, trade_id, price, size, side ('buy'/'sell').
Bucket operators aggregate map-side first, so the per-key windows that follow
see one row per bucket. Per-trade operators use the blocked series helpers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapevigil.functions.scalars import clamp
from tapevigil.operators.rolling import TOTAL, bucket_frame, dynamic_z, rolling_window
from tapevigil.operators.series import DEFAULT_BLOCK_MS, POS, row_frame, running
from tapevigil.plans.storage import settle

KEYS = ["venue", "symbol"]
ORDER = ["ts_ms", "trade_id"]


def volume_buckets(trades: DataFrame, bucket_ms: int = 5_000) -> DataFrame:
    """Size, notional and trade count per tumbling bucket, with its first and last trade."""
    arrival = F.struct(*ORDER)
    return trades.groupBy(
        *KEYS, (F.floor(F.col("ts_ms") / bucket_ms) * bucket_ms).cast("bigint").alias("bucket_ms")
    ).agg(
        F.sum("size").alias("volume"),
        F.sum(F.col("size") * F.col("price")).alias("notional"),
        F.count(F.lit(1)).alias("trades"),
        F.min(F.struct(*ORDER, "size", "price")).alias("first_trade"),
        F.max(F.struct(*ORDER, "size", "price")).alias("last_trade"),
    )


def fill_gaps(buckets: DataFrame, bucket_ms: int = 5_000, window_ms: int = 300_000) -> DataFrame:
    """Insert zero rows for silent buckets, at most window/bucket of them per gap.

    `owner_ms` is the traded bucket a row belongs to; `filled` marks zero rows.
    """
    ordered = Window.partitionBy(*KEYS).orderBy("bucket_ms")
    nxt = F.col("next_bucket_ms")
    last_slot = F.least(nxt - bucket_ms, F.col("bucket_ms") + (window_ms // bucket_ms) * bucket_ms)
    slots = F.when(
        nxt.isNotNull() & (nxt - F.col("bucket_ms") > bucket_ms),
        F.sequence(F.col("bucket_ms"), last_slot, F.lit(bucket_ms)),
    ).otherwise(F.array("bucket_ms"))
    filled = F.col("filled")

    def unless_filled(name: str) -> Column:
        return F.when(~filled, F.col(name))

    return (
        buckets.withColumn("next_bucket_ms", F.lead("bucket_ms").over(ordered))
        .withColumn("next_first", F.lead("first_trade").over(ordered))
        .withColumn("owner_ms", F.col("bucket_ms"))
        .withColumn("bucket_ms", F.explode(slots))
        .withColumn("filled", F.col("bucket_ms") != F.col("owner_ms"))
        .withColumn("volume", F.when(filled, 0.0).otherwise(F.col("volume")))
        .withColumn("notional", F.when(filled, 0.0).otherwise(F.col("notional")))
        .withColumn("trades", F.when(filled, F.lit(0)).otherwise(F.col("trades")))
        .withColumn("first_trade", unless_filled("first_trade"))
        .withColumn("last_trade", unless_filled("last_trade"))
    )


def volume_profile(trades: DataFrame, bucket_ms: int = 5_000, window_ms: int = 300_000) -> DataFrame:
    """Gap-filled buckets with the trailing window's volume, mean and std.

    The window includes the current bucket. `spike_ratio` compares the first
    trade of the next bucket with the window mean, as seen when the bucket
    closes; `bucket_ratio` compares the bucket itself.
    """
    dense = fill_gaps(volume_buckets(trades, bucket_ms), bucket_ms, window_ms)
    frame = bucket_frame(KEYS, window_ms, "bucket_ms")
    dense = (
        dense.withColumn("window_volume", F.sum("volume").over(frame))
        .withColumn("mean_bucket", F.avg("volume").over(frame))
        .withColumn("std_bucket", F.coalesce(F.stddev_samp("volume").over(frame), F.lit(0.0)))
        .withColumn("window_buckets", F.count("volume").over(frame))
    )
    mean = F.col("mean_bucket")
    return dense.withColumn(
        "bucket_ratio", F.when(mean > 1e-12, F.col("volume") / mean).otherwise(1.0)
    )


def volume_scores(profile: DataFrame, bucket_ms: int = 5_000, window_ms: int = 300_000,
                  threshold: float = 3.0, block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """volume_z in log space, its trigger level and the exceeded flag."""
    per_window = window_ms // max(bucket_ms, 1)
    scored = dynamic_z(
        profile, KEYS, ["bucket_ms"], "volume", half_life_s=window_ms / 4000.0,
        window=max(60, per_window), warmup=max(10, per_window // 4), base_threshold=threshold,
        zero_is_normal=True, log_space=True, ts="bucket_ms", out="volume_z", threshold="volume_threshold",
        block_ms=max(block_ms, 1000 * bucket_ms),
    )
    return scored.withColumn(
        "exceeded", F.coalesce(F.col("volume_z") > F.col("volume_threshold"), F.lit(False))
    )


def volume_breakouts(trades: DataFrame, bucket_ms: int = 5_000, window_ms: int = 300_000,
                     k: float = 3.0, min_buckets: int = 20) -> DataFrame:
    """Buckets whose volume exceeds mean + k sigma of their trailing window."""
    profile = volume_profile(trades, bucket_ms, window_ms)
    z = F.when(F.col("window_buckets") >= min_buckets, F.when(
        F.col("std_bucket") <= 1e-12, 0.0
    ).otherwise((F.col("volume") - F.col("mean_bucket")) / F.col("std_bucket")))
    return profile.withColumn("z", z).where(~F.col("filled") & (F.col("z") > k))


def bucket_closures(profile: DataFrame) -> DataFrame:
    """One row per closed traded bucket with the window state seen at its closing trade.

    The closing trade is the next bucket's first trade, so silent buckets in
    between have already entered the window. The last bucket of a key is open.
    """
    owned = Window.partitionBy(*KEYS, "owner_ms").orderBy("bucket_ms").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    mean = F.col("mean_bucket")
    names = ["window_volume", "mean_bucket", "std_bucket"]
    if "volume_threshold" in profile.columns:
        names.append("volume_threshold")
    out = profile
    for name in names:
        out = out.withColumn(name, F.last(name).over(owned))
    return (
        out.where(~F.col("filled") & F.col("next_bucket_ms").isNotNull())
        .withColumn("close_ts_ms", F.col("next_first.ts_ms"))
        .withColumn("close_price", F.col("next_first.price"))
        .withColumn(
            "spike_ratio",
            F.when(mean > 1e-12, F.col("next_first.size") / mean).otherwise(F.lit(1.0)),
        )
    )


def signed_notional() -> Column:
    value = F.col("size") * F.col("price")
    return F.when(F.col("side") == "buy", value).otherwise(-value)


def cumulative_delta(trades: DataFrame, session: str | None = None,
                     block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """CVD and trade number per (venue, symbol); buy ratio per session when one is given."""
    value = F.col("size") * F.col("price")
    buys = {
        "__buy": F.when(F.col("side") == "buy", value).otherwise(0.0),
        "__all": value,
    }
    flows = {"cvd": signed_notional(), POS: F.lit(1)}
    if session is None:
        out = running(trades, KEYS, ORDER, flows | buys, block_ms=block_ms, total=TOTAL)
    else:
        out = running(trades, KEYS, ORDER, flows, block_ms=block_ms, total=TOTAL)
        out = running(out, [*KEYS, session], ORDER, buys | {"session_cvd": signed_notional()},
                      block_ms=block_ms)
    ratio = F.when(F.col("__all") > 0, F.col("__buy") / F.col("__all")).otherwise(F.lit(0.5))
    return out.withColumn("buy_ratio", ratio).drop("__buy", "__all")


def price_divergence(deltas: DataFrame, keep: int = 200, need: int = 20) -> DataFrame:
    """Signed gap between CVD and price direction over the latest trades, in [-1, 1]."""

    step = max(math.isqrt(keep), 1)

    def expr(spec):
        # The peak of the frame is that of short frames inside it, so that no frame is read anew for each row.
        start = spec.rowsBetween(Window.unboundedPreceding, 0)
        row, far = F.struct("price", "cvd"), keep - step
        return {
            "__peak": F.max(F.abs("cvd")).over(spec.rowsBetween(1 - step, 0)),
            "__rows": F.least(F.row_number().over(spec), F.lit(keep)),
            "__from": F.coalesce(F.lag(row, keep - 1).over(spec), F.first(row).over(start)),
            "__peaks": F.greatest(*[F.lag("__peak", k).over(spec) for k in (0, *range(step, far, step), far)]),
        }

    framed = row_frame(deltas, KEYS, ORDER, keep - 1, expr, pos=POS)
    p0, c0, peak = F.col("__from.price"), F.col("__from.cvd"), F.col("__peaks")
    scale = F.when(peak == 0, F.lit(1.0)).otherwise(peak)
    price_move = clamp((F.col("price") - p0) / p0 * 100.0, -1.0, 1.0)
    cvd_move = clamp((F.col("cvd") - c0) / scale, -1.0, 1.0)
    known = (F.col("__rows") >= need) & (p0 > 0)
    divergence = F.when(known, clamp((cvd_move - price_move) / 2.0, -1.0, 1.0)).otherwise(0.0)
    return framed.withColumn("divergence", divergence).drop("__peak", "__rows", "__from", "__peaks")


def window_delta(trades: DataFrame, window_ms: int = 300_000) -> DataFrame:
    """Signed notional over the trailing window, per trade."""
    swept = rolling_window(trades.withColumn("__signed", signed_notional()), KEYS, ORDER, "__signed",
                           window_ms, prefix="__d_")
    return swept.withColumn("window_delta", F.col("__d_sum")).drop(
        "__signed", *[f"__d_{c}" for c in ("count", "first_ts", "sum", "mean", "var", "std")]
    )


def absorption(divergence: Column, z: Column) -> Column:
    strength = F.abs(divergence) * clamp(F.abs(F.coalesce(z, F.lit(0.0))) / 3.0, 0.0, 1.0)
    return F.when(F.abs(divergence) < 0.25, 0.0).otherwise(clamp(strength, 0.0, 1.0))


def delta_scores(trades: DataFrame, window_ms: int = 300_000, session: str | None = None,
                 block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """Per trade: cvd, buy_ratio, divergence, window_delta, cvd_z and absorption."""
    flows = settle(window_delta(price_divergence(cumulative_delta(trades, session, block_ms)), window_ms))
    scored = dynamic_z(flows, KEYS, ORDER, "window_delta", half_life_s=window_ms / 3000.0, window=300,
                       warmup=20, base_threshold=2.5, zero_is_normal=True, out="cvd_z",
                       threshold=None, block_ms=block_ms)
    return scored.withColumn("absorption", absorption(F.col("divergence"), F.col("cvd_z")))


def volume_events(closures: DataFrame, bucket_ms: int = 5_000, window_ms: int = 300_000) -> DataFrame:
    """Volume observations in event layout, from bucket_closures over volume_scores."""
    running_trades = Window.partitionBy(*KEYS).orderBy("bucket_ms").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return closures.withColumn("__seen", F.sum("trades").over(running_trades) + 1).select(
        F.concat_ws("-", F.lit("vol"), "venue", "symbol", "bucket_ms").alias("event_id"),
        F.col("close_ts_ms").alias("ts_ms"),
        F.lit("exchange").alias("source_type"),
        "venue",
        F.col("symbol").alias("asset_pair"),
        F.lit("volume").alias("metric_type"),
        F.col("window_volume").alias("raw_value"),
        F.col("volume_z").alias("normalized_z_score"),
        (F.col("window_volume") * F.col("close_price")).alias("usd_value"),
        F.lit(1.0).alias("confidence"),
        F.struct(
            F.lit(window_ms // 1000).alias("window_s"),
            F.lit(bucket_ms // 1000).alias("bucket_s"),
            F.round("mean_bucket", 8).alias("mean_bucket"),
            F.round("std_bucket", 8).alias("std_bucket"),
            F.round("volume_threshold", 3).alias("threshold"),
            "exceeded",
            F.round("spike_ratio", 3).alias("spike_ratio"),
            F.col("__seen").alias("trades"),
            F.col("close_price").alias("price"),
        ).alias("meta"),
    )


def cvd_events(closures: DataFrame, deltas: DataFrame) -> DataFrame:
    """CVD observations at each bucket closure: the state just after the closing trade."""
    closing = closures.select(
        *KEYS, "bucket_ms", F.col("next_first.ts_ms").alias("ts_ms"),
        F.col("next_first.trade_id").alias("trade_id"),
    )
    return deltas.join(closing, [*KEYS, *ORDER]).select(
        F.concat_ws("-", F.lit("cvd"), "venue", "symbol", "bucket_ms").alias("event_id"),
        "ts_ms",
        F.lit("exchange").alias("source_type"),
        "venue",
        F.col("symbol").alias("asset_pair"),
        F.lit("cvd").alias("metric_type"),
        F.col("cvd").alias("raw_value"),
        F.col("cvd_z").alias("normalized_z_score"),
        F.lit(None).cast("double").alias("usd_value"),
        F.lit(1.0).alias("confidence"),
        F.struct(
            F.round("window_delta", 2).alias("window_delta"),
            F.round("buy_ratio", 4).alias("buy_ratio"),
            F.round("divergence", 4).alias("divergence"),
            F.round("absorption", 4).alias("absorption"),
            "price",
            F.when(F.col("buy_ratio") > 0.5, "buy").otherwise("sell").alias("aggressive_side"),
        ).alias("meta"),
    )


def pair_snapshot(metrics: DataFrame, scored_buckets: DataFrame, deltas: DataFrame) -> DataFrame:
    """Current state per (venue, symbol): latest book, latest bucket, latest trade."""
    book = metrics.groupBy(*KEYS).agg(
        F.max(F.struct("ts_ms", "snapshot_id", "obi", "weighted_obi", "obi_z", "spread_bps",
                       "bid_depth", "ask_depth")).alias("b")
    )
    closed = scored_buckets.where(F.col("next_bucket_ms").isNotNull())
    still_open = scored_buckets.where(F.col("next_bucket_ms").isNull()).select(
        *KEYS, F.col("volume").alias("open_volume")
    )
    bucket = closed.groupBy(*KEYS).agg(
        F.max(F.struct("bucket_ms", "window_volume", "mean_bucket", "volume_z")).alias("v")
    ).join(still_open, KEYS, "left")
    flow = deltas.groupBy(*KEYS).agg(
        F.max(F.struct("ts_ms", "trade_id", "price", "cvd", "cvd_z", "divergence", "absorption",
                       "buy_ratio")).alias("d"),
        F.count(F.lit(1)).alias("trades"),
    )
    zero = F.lit(0.0)
    mean = F.col("v.mean_bucket")
    return flow.join(bucket, KEYS, "left").join(book, KEYS, "left").select(
        *KEYS,
        F.col("d.price").alias("price"),
        F.coalesce("b.obi", zero).alias("obi"),
        F.coalesce("b.weighted_obi", zero).alias("obi_weighted"),
        F.coalesce("b.obi_z", zero).alias("obi_z"),
        F.coalesce("b.spread_bps", zero).alias("spread_bps"),
        F.coalesce("b.bid_depth", zero).alias("bid_depth"),
        F.coalesce("b.ask_depth", zero).alias("ask_depth"),
        F.coalesce("v.window_volume", zero).alias("volume_5m"),
        F.coalesce("v.volume_z", zero).alias("volume_z"),
        F.coalesce(F.when(mean > 1e-12, F.col("open_volume") / mean), F.lit(1.0)).alias(
            "volume_spike_ratio"
        ),
        F.col("d.cvd").alias("cvd"),
        F.coalesce("d.cvd_z", zero).alias("cvd_z"),
        F.col("d.divergence").alias("cvd_divergence"),
        F.col("d.absorption").alias("absorption"),
        F.col("d.buy_ratio").alias("buy_ratio"),
        F.col("trades").cast("double").alias("trades"),
    )
