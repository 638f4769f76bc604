"""Social payload tables to posts, and training rows to feature arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.functions.text import extract_tickers
from tapevigil.schemas import FEATURES


def match_tickers(text: Column, tracked: Sequence[str]) -> Column:
    """Tracked cashtags; without any, tracked names found anywhere in the text."""
    names = F.array(*[F.lit(t) for t in tracked])
    tagged = F.array_intersect(names, extract_tickers(text))
    mentioned = F.filter(names, lambda t: F.contains(F.lower(text), F.lower(t)))
    return F.when(F.size(tagged) > 0, tagged).otherwise(mentioned)


def posts_from_tweets(tweets: DataFrame, users: DataFrame, tracked: Sequence[str],
                      as_of_ms: Column | None = None, platform: str = "x") -> DataFrame:
    """Join tweets with their authors.

    tweets: id, author_id, text, created_at (ISO text), reference_types;
    users: id, created_at, followers_count, tweet_count. Ages are taken at
    `as_of_ms`, by default the post's own time.
    """
    authors = users.select(
        F.col("id").cast("string").alias("author_id"),
        F.unix_millis(F.try_to_timestamp("created_at")).alias("__born"),
        F.col("followers_count").alias("author_followers"),
        F.col("tweet_count").alias("author_post_count"),
    )
    ts = F.unix_millis(F.try_to_timestamp("created_at"))
    posts = tweets.select(
        F.lit(platform).alias("platform"),
        F.col("id").cast("string").alias("post_id"),
        F.coalesce(F.col("author_id").cast("string"), F.lit("")).alias("author_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        ts.alias("ts_ms"),
        F.array_contains(
            F.coalesce("reference_types", F.array().cast("array<string>")), "replied_to"
        ).alias("is_reply"),
    )
    now = F.col("ts_ms") if as_of_ms is None else as_of_ms
    return (
        posts.join(authors, "author_id", "left")
        .withColumn("tickers", match_tickers(F.col("text"), tracked))
        .withColumn("author_age_days", (now - F.col("__born")) / 86_400_000.0)
        .drop("__born")
    )


def posts_from_channel(messages: DataFrame, tracked: Sequence[str], platform: str = "telegram") -> DataFrame:
    """Channel messages that mention a tracked ticker; the sender defaults to 'channel'."""
    return (
        messages.where(F.coalesce("text", F.lit("")) != "")
        .withColumn("tickers", match_tickers(F.col("text"), tracked))
        .where(F.size("tickers") > 0)
        .select(
            F.lit(platform).alias("platform"),
            F.col("id").cast("string").alias("post_id"),
            F.coalesce(F.col("sender_id").cast("string"), F.lit("channel")).alias("author_id"),
            "text",
            "ts_ms",
            "tickers",
            F.col("participants").alias("author_followers"),
        )
    )


def training_vectors(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines holding {"values": [...]} or a bare array; only full-width rows survive."""
    options = {"allowNonNumericNumbers": "true"}
    values = F.coalesce(
        F.from_json(column, "struct<values:array<double>>", options)["values"],
        F.from_json(column, "array<double>", options),
    )
    return (
        lines.withColumn("values", values)
        .where(F.size("values") == len(FEATURES))
        .select(F.transform("values", finite_or_zero).alias("values"))
    )


def finite_or_zero(v: Column) -> Column:
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)
