"""Replay of recorded events: vectors on a tick grid, scores, peaks and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapevigil.operators import forest
from tapevigil.operators.features import feature_grid, informative
from tapevigil.operators.forest import ForestModel
from tapevigil.operators.scoring import score_vectors, signals
from tapevigil.plans.storage import settle


def replay(events: DataFrame, model: ForestModel | None = None, tick_ms: int = 1_000,
           ttl_ms: int = 600_000, factor: float = 0.9, on_events: bool = True, fit: bool = False, **grid) -> DataFrame:
    """Signals for every informative vector; decays apply once per sweep.

    Scoring happens at ends of ticks, so it does not depend on which event happened
    to arrive a second after the previous sweep: at those that end with an event, or
    at all of them without on_events. With `fit`, and without a model, a forest is
    trained on the replay's own vectors first; a replay too short for one goes without.
    """
    vectors = informative(feature_grid(events, tick_ms, ttl_ms, factor, on_events=on_events, **grid))
    if fit and model is None:
        vectors = settle(vectors)
        model = forest.fit(vectors, identity=["asset", "ts_ms"])
    return signals(score_vectors(vectors, model))


def peak_scores(sigs: DataFrame, n: int = 15) -> DataFrame:
    return (
        sigs.groupBy("asset_pair").agg(F.max("score").alias("peak_score"))
        .orderBy(F.desc("peak_score"), "asset_pair").limit(n)
    )


def replay_alerts(sigs: DataFrame, threshold: float = 80.0) -> DataFrame:
    return sigs.where(F.col("score") >= threshold)


def replay_span(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        ((F.max("ts_ms") - F.min("ts_ms")) / 60_000.0).alias("minutes"),
    )


def replay_summary(parsed: DataFrame, sigs: DataFrame, threshold: float = 80.0) -> DataFrame:
    """One row about the replay of parsed lines: events, lines skipped, minutes, assets and signals scored, alerts.

    An empty recording has no minutes (NULL) and zeros elsewhere.
    """
    good, nothing = F.col("problem").isNull(), F.lit(None)
    lines = parsed.select(
        good.alias("event"), F.when(good, F.col("ts_ms")).alias("ts_ms"),
        nothing.cast("string").alias("asset_pair"), nothing.cast("double").alias("score"))
    scored = sigs.select(nothing.cast("boolean").alias("event"), nothing.cast("bigint").alias("ts_ms"), "asset_pair", "score")
    return lines.unionByName(scored).agg(
        F.count_if("event").alias("events"),
        F.count_if(~F.col("event")).alias("skipped"),
        ((F.max("ts_ms") - F.min("ts_ms")) / 60_000.0).alias("minutes"),
        F.count_distinct("asset_pair").alias("assets"),
        F.count("score").alias("signals"),
        F.count_if(F.col("score") >= threshold).alias("alerts"),
    )
