"""Recorded events: reading, validation, channels, writing.

Event rows carry ts_ms (epoch milliseconds) and a typed `meta` struct.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapevigil.functions.scalars import base_asset
from tapevigil.schemas import META, METRIC_TYPES, SOURCE_TYPES, WIRE

EVENT_COLUMNS = [
    "event_id", "ts_ms", "source_type", "venue", "asset_pair", "metric_type", "raw_value",
    "normalized_z_score", "usd_value", "confidence", "meta",
]
_BAD = "_corrupt"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines (batch or stream) to events plus `problem`, NULL for a usable line.

    Blank lines are dropped. A line without a timestamp is refused: results
    depend on event time only, never on the clock of the reader.
    """
    with_bad = T.StructType([*WIRE.fields, T.StructField(_BAD, T.StringType())])
    text = lines.where(F.trim(column) != "")
    e = text.withColumn("__e", F.from_json(
        column, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    )).withColumn("__keys", F.json_object_keys(F.col(column)))
    allowed = F.array(*[F.lit(f.name) for f in WIRE.fields])
    extra = F.size(F.array_except(F.col("__keys"), allowed)) > 0
    rows = e.select(column, "__e.*", extra.alias("__extra"))
    shaped = rows.select(
        F.col(column).alias("line"),
        F.col("event_id"),
        F.col("timestamp").alias("ts_ms"),
        "source_type", "venue", "asset_pair", "metric_type", "raw_value", "normalized_z_score",
        "usd_value",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.from_json("meta", META).alias("meta"),
        F.when(F.col(_BAD).isNotNull(), "malformed").when(F.col("__extra"), "unknown field").alias("__p"),
    )
    checked = validate(shaped)
    return checked.withColumn("problem", F.coalesce("__p", "problem")).drop("__p")


def validate(events: DataFrame) -> DataFrame:
    """Normalise symbol and venue and name the first broken rule in `problem`."""
    finite = ~F.isnan("raw_value") & (F.abs("raw_value") != F.lit(float("inf")))
    missing = (
        F.col("ts_ms").isNull() | F.col("source_type").isNull() | F.col("venue").isNull()
        | F.col("asset_pair").isNull() | F.col("metric_type").isNull() | F.col("raw_value").isNull()
    )
    problem = (
        F.when(missing, "missing field")
        .when(~F.col("source_type").isin(*SOURCE_TYPES), "unknown source")
        .when(~F.col("metric_type").isin(*METRIC_TYPES), "unknown metric")
        .when(~finite, "raw value not finite")
        .when(~F.col("confidence").between(0.0, 1.0), "confidence out of range")
    )
    return (
        events.withColumn("asset_pair", F.upper(F.trim("asset_pair")))
        .withColumn("venue", F.lower(F.trim("venue")))
        .withColumn("problem", problem)
    )


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNull()).select(*EVENT_COLUMNS)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNotNull())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of recorded JSONL files; pass to usable() / rejected()."""
    return parse_lines(spark.read.text(path))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Record events as JSON lines, one folder per metric type."""
    wire_events(events).write.mode(mode).partitionBy("metric_folder").json(path)


def wire_events(events: DataFrame) -> DataFrame:
    meta = "meta_json" if "meta_json" in events.columns else F.to_json("meta")
    return events.select(
        "event_id", F.col("ts_ms").alias("timestamp"), "source_type", "venue", "asset_pair",
        "metric_type", "raw_value", "normalized_z_score", "usd_value", "confidence",
        (F.parse_json(meta) if isinstance(meta, Column) else F.parse_json(F.col(meta))).alias("meta"),
        F.col("metric_type").alias("metric_folder"),
    )


def as_events(df: DataFrame) -> DataFrame:
    """Reduce an operator's event rows to the common layout, typing `meta`."""
    have = set(df.schema["meta"].dataType.names) if "meta" in df.columns else set()
    fields = [
        (F.col(f"meta.{f.name}").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in META.fields
    ]
    return df.withColumn("meta", F.struct(*fields)).select(*EVENT_COLUMNS)


def with_channel(events: DataFrame, prefix: str = "market") -> DataFrame:
    return events.withColumn("base_asset", base_asset(F.col("asset_pair"))).withColumn(
        "channel", F.concat_ws(".", F.lit(prefix), "source_type", "metric_type")
    )


def channel_matches(channel: Column, *patterns: str) -> Column:
    """Glob match on a channel name (`*`, `?`, `[abc]`, `[!abc]`)."""
    return F.coalesce(*[F.nullif(channel.rlike(_glob(p)), F.lit(False)) for p in patterns], F.lit(False))


def _glob(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + body + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def signals_as_events(signals: DataFrame) -> DataFrame:
    """Publish scored signals back as manipulation_score events."""
    composite_z = F.try_element_at("features", F.lit("composite_z"))
    return signals.select(
        F.concat_ws("-", F.lit("sig"), F.col("signal_id").cast("string")).alias("event_id"),
        "ts_ms",
        F.lit("derived").alias("source_type"),
        "venue",
        "asset_pair",
        F.lit("manipulation_score").alias("metric_type"),
        F.col("score").alias("raw_value"),
        composite_z.alias("normalized_z_score"),
        F.lit(None).cast("double").alias("usd_value"),
        F.lit(1.0).alias("confidence"),
        F.struct("signal_id", "severity", "reasons", "contributions", "ml_score", "rule_score").alias(
            "meta"
        ),
    )
