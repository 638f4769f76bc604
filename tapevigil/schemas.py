"""Fixed vocabulary and schemas of the normalised event model."""

from __future__ import annotations

from pyspark.sql import types as T

# Event taxonomy.
SOURCE_TYPES = ("exchange", "onchain", "social", "derived")
METRIC_TYPES = (
    "volume", "order_book", "cvd", "trade", "price",
    "wallet_transfer", "liquidity", "bridge_flow",
    "social_mentions", "social_sentiment", "bot_farm",
    "manipulation_score",
)

# The twenty features in model order. Neutral is 0, except the spike ratio.
FEATURES = (
    "volume_z", "volume_spike_ratio", "obi", "obi_abs", "obi_z", "spread_bps", "cvd_z",
    "cvd_divergence", "venue_dispersion", "wall_activity",
    "whale_inflow_z", "net_flow_norm", "liquidity_drop", "bridge_activity", "bridge_to_cex",
    "mention_z", "mention_accel", "sentiment", "sentiment_abs", "bot_farm_score",
)
NEUTRAL = {name: 1.0 if name == "volume_spike_ratio" else 0.0 for name in FEATURES}

LEVELS = "array<struct<price:double,size:double>>"

# meta keys that later operators read; everything else stays in meta_json.
META = T.StructType([
    T.StructField("spike_ratio", T.DoubleType()),
    T.StructField("spread_bps", T.DoubleType()),
    T.StructField("spoofed_walls", T.LongType()),
    T.StructField("absorbed_walls", T.LongType()),
    T.StructField("divergence", T.DoubleType()),
    T.StructField("direction", T.StringType()),
    T.StructField("bridge_precursor", T.StringType()),
    T.StructField("acceleration", T.DoubleType()),
])

# One line of a recorded session.
WIRE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("asset_pair", T.StringType()),
    T.StructField("metric_type", T.StringType()),
    T.StructField("raw_value", T.DoubleType()),
    T.StructField("normalized_z_score", T.DoubleType()),
    T.StructField("usd_value", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("meta", T.StringType()),
    T.StructField("ingest_ns", T.LongType()),
])
