"""Order-book operators over snapshots.

Books: venue, symbol, ts_ms, snapshot_id, bids, asks with
ARRAY<STRUCT<price DOUBLE, size DOUBLE>> sides. Depth is quote notional
(price x size). Everything up to the metrics is one narrow projection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapevigil.functions import kernels
from tapevigil.functions.scalars import obi_direction
from tapevigil.operators.folds import CHUNK_ROWS, cooldown_gate
from tapevigil.operators.rolling import dynamic_z
from tapevigil.operators.series import DEFAULT_BLOCK_MS, HALO, POS, per_chunk, row_chunks, row_index, with_previous
from tapevigil.plans.storage import settle

KEYS = ["venue", "symbol"]
ORDER = ["ts_ms", "snapshot_id"]


def books_from_levels(levels: DataFrame) -> DataFrame:
    """Level rows (side 'bid'/'ask', price, size) to one row per snapshot."""
    level = F.struct("price", "size")
    return levels.groupBy(*KEYS, *ORDER).agg(
        F.collect_list(F.when(F.col("side") == "bid", level)).alias("bids"),
        F.collect_list(F.when(F.col("side") == "ask", level)).alias("asks"),
    )


def sort_side(levels: Column, descending: bool, depth: int | None = None) -> Column:
    live = F.sort_array(F.filter(levels, lambda l: l["size"] > 0), asc=not descending)
    return F.slice(live, 1, depth) if depth else live


def normalise_books(books: DataFrame, depth: int | None = None) -> DataFrame:
    """Drop empty levels, sort bids down and asks up, keep `depth` levels."""
    return books.withColumn("bids", sort_side(F.col("bids"), True, depth)).withColumn(
        "asks", sort_side(F.col("asks"), False, depth)
    )


def _best(side: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(side), F.lit(1))["price"], F.lit(0.0))


def _total(levels: Column, f) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, l: acc + f(l))


def book_metrics(books: DataFrame, levels: int = 20, decay_bps: float = 25.0) -> DataFrame:
    """Best prices, mid, spread, depth, imbalance and distance-weighted imbalance."""
    mid = F.col("mid_price")
    both = (F.size("bids") > 0) & (F.size("asks") > 0)
    top_bids, top_asks = F.slice("bids", 1, levels), F.slice("asks", 1, levels)

    def weighted(l: Column) -> Column:
        distance = F.abs(l["price"] - mid) / mid * 10_000.0
        decay = F.exp(-distance / max(decay_bps, 1e-6))
        return l["price"] * l["size"] * F.when(mid > 0, decay).otherwise(F.lit(1.0))

    def share(a: Column, b: Column) -> Column:
        return F.when(a + b > 0, (a - b) / (a + b)).otherwise(F.lit(0.0))

    out = (
        books.withColumn("best_bid", _best("bids"))
        .withColumn("best_ask", _best("asks"))
        .withColumn(
            "mid_price",
            F.when(both, (F.col("best_bid") + F.col("best_ask")) / 2.0)
            .when(F.col("best_bid") != 0, F.col("best_bid"))
            .otherwise(F.col("best_ask")),
        )
        .withColumn(
            "spread_bps",
            F.when(both & (mid > 0), (F.col("best_ask") - F.col("best_bid")) / mid * 10_000.0)
            .otherwise(F.lit(0.0)),
        )
        .withColumn("bid_depth", _total(top_bids, lambda l: l["price"] * l["size"]))
        .withColumn("ask_depth", _total(top_asks, lambda l: l["price"] * l["size"]))
        .withColumn("__wb", _total(top_bids, weighted))
        .withColumn("__wa", _total(top_asks, weighted))
    )
    return (
        out.withColumn("obi", share(F.col("bid_depth"), F.col("ask_depth")))
        .withColumn("weighted_obi", share(F.col("__wb"), F.col("__wa")))
        .withColumn("direction", obi_direction(F.col("obi")))
        .withColumn(
            "levels",
            F.least(F.lit(levels), F.greatest(F.size(top_bids), F.size(top_asks))),
        )
        .drop("__wb", "__wa")
    )


def obi_percentile(metrics: DataFrame, keep: int = 600, need: int = 30,
                   block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """Share of the latest `keep` imbalances (current included) that are <= the current one."""
    names = metrics.columns

    def ranked(rows: pa.Table) -> pa.Table:
        start = int(pc.sum(rows[HALO]).as_py() or 0)
        obi = rows["obi"].cast(pa.float64()).combine_chunks()
        below, seen = kernels.trailing_rank(
            obi.to_numpy(zero_copy_only=False), ~np.asarray(obi.is_null()), start, keep)
        share = np.where(seen < need, 0.5, below / np.maximum(seen, 1))
        return rows.slice(start).select(names).append_column("obi_percentile", pa.array(share, pa.float64()))

    chunked = row_chunks(row_index(metrics, KEYS, ORDER, block_ms=block_ms), keep - 1)
    schema = T.StructType([*metrics.schema.fields, T.StructField("obi_percentile", T.DoubleType())])
    return per_chunk(chunked, KEYS, [POS], ranked, schema)


def obi_scores(metrics: DataFrame, obi_threshold: float = 0.35,
               block_ms: int = DEFAULT_BLOCK_MS, **z_args) -> DataFrame:
    """obi_z, its trigger level and the anomalous flag (large |obi| or large |z|)."""
    args = {"half_life_s": 120.0, "window": 300, "warmup": 20, "base_threshold": 3.0} | z_args
    slim = metrics.select(*KEYS, *ORDER, "obi")
    scored = dynamic_z(slim, KEYS, ORDER, "obi", out="obi_z", threshold="obi_z_threshold",
                       block_ms=block_ms, **args)
    flag = (F.abs("obi") >= obi_threshold) | F.coalesce(
        F.abs("obi_z") >= F.col("obi_z_threshold"), F.lit(False)
    )
    return scored.withColumn("anomalous", flag)


def wall_changes(books: DataFrame, levels: int = 20, floor: float = 50_000.0,
                 depth_share: float = 0.05, min_removed: float = 0.5,
                 block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """Large levels of the previous snapshot that lost at least half their size.

    Adds `walls`, an array of (side, price, size_removed, notional, absorbed_pct);
    absorbed_pct is positive when the price traded through the level and negative
    when it was pulled. Needs book_metrics columns.
    """
    prev = with_previous(books, KEYS, ORDER, {"prev_bids": "bids", "prev_asks": "asks"},
                         block_ms=block_ms)
    limit = F.greatest(F.lit(floor), F.col("bid_depth") * depth_share)

    def side_walls(side: str, before: str, now: str, through) -> Column:
        current = F.slice(F.col(now), 1, levels)

        def describe(l: Column) -> Column:
            left = F.coalesce(
                F.try_element_at(F.filter(current, lambda c: c["price"] == l["price"]), F.lit(-1))["size"],
                F.lit(0.0),
            )
            removed = l["size"] - left
            pct = removed / l["size"]
            return F.struct(
                F.lit(side).alias("side"),
                l["price"].alias("price"),
                removed.alias("size_removed"),
                (l["price"] * removed).alias("notional"),
                F.when(through(l["price"]), pct).otherwise(-pct).alias("absorbed_pct"),
                (l["price"] * l["size"]).alias("__was"),
            )

        described = F.transform(F.slice(F.coalesce(F.col(before), F.array().cast(
            "array<struct<price:double,size:double>>")), 1, levels), describe)
        kept = F.filter(
            described,
            lambda w: (w["__was"] >= limit) & (w["size_removed"] > 0)
            & (F.abs(w["absorbed_pct"]) >= min_removed),
        )
        return F.transform(kept, lambda w: w.dropFields("__was"))

    walls = F.concat(
        side_walls("buy", "prev_bids", "bids", lambda p: p >= F.col("best_bid")),
        side_walls("sell", "prev_asks", "asks", lambda p: p <= F.col("best_ask")),
    )
    w = F.col("walls")
    return (
        prev.withColumn("walls", walls)
        .drop("prev_bids", "prev_asks")
        .withColumn("spoofed_walls", F.size(F.filter(w, lambda x: x["absorbed_pct"] < 0)))
        .withColumn("absorbed_walls", F.size(F.filter(w, lambda x: x["absorbed_pct"] > 0)))
        .withColumn("wall_notional", _total(w, lambda x: x["notional"]))
    )


def wall_events(with_walls: DataFrame) -> DataFrame:
    return with_walls.select(*KEYS, *ORDER, F.explode("walls").alias("w")).select(
        *KEYS, *ORDER, "w.*"
    )


def emission_gate(scored: DataFrame, interval_ms: int = 500, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows to publish: every anomalous one, else at most one per interval since the last."""
    gated = cooldown_gate(scored, KEYS, ORDER, interval_ms, forced="anomalous", chunk_rows=chunk_rows)
    return gated.where("gate_sent").drop("gate_sent", "gate_reason", "gate_since_ms", "gate_count")


def order_book_events(books: DataFrame, levels: int = 20, decay_bps: float = 25.0,
                      obi_threshold: float = 0.35, interval_ms: int = 500,
                      block_ms: int = DEFAULT_BLOCK_MS, **z_args) -> DataFrame:
    """Published order-book observations in the normalised event layout."""
    metrics = settle(book_metrics(normalise_books(books), levels, decay_bps))
    walls = wall_changes(metrics, levels, block_ms=block_ms).drop("bids", "asks", "walls")
    ranked = obi_percentile(walls, block_ms=block_ms)
    # Books without a mid price still feed the baselines but are never published.
    flags = obi_scores(metrics, obi_threshold, block_ms, **z_args).drop("obi")
    full = settle(ranked.join(flags, [*KEYS, *ORDER]).where(F.col("mid_price") > 0))
    return emission_gate(full, interval_ms).select(
        F.concat_ws("-", F.lit("ob"), "venue", "symbol", "snapshot_id").alias("event_id"),
        "ts_ms",
        F.lit("exchange").alias("source_type"),
        "venue",
        F.col("symbol").alias("asset_pair"),
        F.lit("order_book").alias("metric_type"),
        F.col("obi").alias("raw_value"),
        F.col("obi_z").alias("normalized_z_score"),
        (F.col("bid_depth") + F.col("ask_depth")).alias("usd_value"),
        F.lit(1.0).alias("confidence"),
        F.struct(
            F.round("weighted_obi", 5).alias("weighted_obi"),
            F.round("bid_depth", 2).alias("bid_depth"),
            F.round("ask_depth", 2).alias("ask_depth"),
            F.round("spread_bps", 3).alias("spread_bps"),
            "mid_price",
            "direction",
            "levels",
            F.round("obi_percentile", 4).alias("obi_percentile"),
            "spoofed_walls",
            "absorbed_walls",
            F.round("wall_notional", 2).alias("wall_notional"),
            "anomalous",
        ).alias("meta"),
    )
