"""Composite score, signals and the questions asked of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.functions.scalars import clamp, layer, severity, text
from tapevigil.operators.features import is_urgent
from tapevigil.operators.forest import ForestModel, ml_scores
from tapevigil.operators.rules import WEIGHTS, rule_scores, self_evident
from tapevigil.schemas import FEATURES


def composite(scored: DataFrame, trained: bool = True, ml_blend: float = 0.5) -> DataFrame:
    """Blend rule_score and ml_score by coverage; the model may lift a verdict, not veto it."""
    rule, ml = F.col("rule_score"), F.col("ml_score")
    if trained:
        blend = min(max(ml_blend, 0.0), 1.0) * clamp(F.col("coverage") + 0.34, 0.0, 1.0)
        blended = (1.0 - blend) * rule + blend * ml
        value = F.when((rule >= 60) & (ml < rule), F.greatest(blended, rule * 0.9 + ml * 0.1)).otherwise(blended)
        unusual = F.when(
            (ml >= 70) & (rule < 40), text("ML flags unusual multi-feature state (%.0f/100)", ml)
        )
        reasons = F.array_compact(F.concat(F.col("rule_reasons"), F.array(unusual)))
    else:
        value, reasons = rule, F.col("rule_reasons")
    thin = (F.col("coverage") <= 0.34) & ~self_evident()
    score = clamp(F.when(thin, value * 0.82).otherwise(value), 0.0, 100.0)
    out = layer(scored, score=score)
    return layer(out, severity=severity(F.col("score")), reasons=F.slice(reasons, 1, 8))


def top_features(limit: int = 10, floor: float = 0.05, digits: int = 4) -> Column:
    """Map of the largest |value| features above `floor`, largest first."""
    ranked = F.sort_array(F.filter(
        F.array(*[
            F.struct((-F.abs(F.col(f))).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("name"), F.col(f).alias("v"))
            for i, f in enumerate(FEATURES)
        ]),
        lambda e: e["k"] < -floor,
    ))
    return F.map_from_entries(F.transform(
        F.slice(ranked, 1, limit), lambda e: F.struct(e["name"], F.round(e["v"], digits))
    ))


def contributions(digits: int = 2) -> Column:
    return F.create_map(
        F.lit("exchange"), F.round("ex", digits), F.lit("onchain"), F.round("oc", digits),
        F.lit("social"), F.round("so", digits),
    )


def score_vectors(vectors: DataFrame, model: ForestModel | None = None,
                  weights: Mapping[str, float] = WEIGHTS, ml_blend: float = 0.5) -> DataFrame:
    """Rules, forest and composite for every vector."""
    return composite(rule_scores(ml_scores(vectors, model), weights), model is not None, ml_blend)


def signals(scored: DataFrame, venue: str = "aggregate") -> DataFrame:
    """Explainable verdict rows."""
    return scored.select(
        F.concat_ws("-", "asset", F.col("ts_ms").cast("string")).alias("signal_id"),
        "ts_ms",
        F.col("asset").alias("asset_pair"),
        (F.col("venue") if "venue" in scored.columns else F.lit(venue)).alias("venue"),
        "score", "severity", "ml_score", "rule_score",
        contributions().alias("contributions"),
        top_features().alias("features"),
        "reasons",
        F.lit(0.0).alias("latency_ms"),
    )


def urgent_events(events: DataFrame) -> DataFrame:
    """Events extreme enough to be scored at once."""
    return events.where(is_urgent())


def select_signals(sigs: DataFrame, urgent_assets: DataFrame, floor: float = 40.0,
                   alert_threshold: float = 80.0) -> DataFrame:
    """Signals worth publishing: a score of `floor`, or an urgent event of the asset."""
    urgent = urgent_assets.select("asset_pair").distinct().withColumn("urgent", F.lit(True))
    return (
        sigs.join(urgent, "asset_pair", "left")
        .withColumn("urgent", F.coalesce("urgent", F.lit(False)))
        .where((F.col("score") >= floor) | F.col("urgent"))
        .withColumn("alert", F.col("score") >= alert_threshold)
    )


def risk_board(sigs: DataFrame, n: int = 10, key: str = "asset_pair",
               order: Sequence[str] = ("ts_ms", "signal_id")) -> DataFrame:
    """Latest score per asset, highest first."""
    row = F.struct(*order, "score")
    return (
        sigs.groupBy(key).agg(F.max(row).alias("r")).select(key, F.col("r.score").alias("score"))
        .orderBy(F.desc("score"), key).limit(n)
    )


def asset_report(scored: DataFrame, asset: str | None = None) -> DataFrame:
    """Latest verdict per asset with contributions, freshness, active features and reasons."""
    chosen = scored if asset is None else scored.where(F.col("asset") == asset.upper())
    cols = ["ex", "oc", "so", "rule_score", "ml_score", "score", "severity", "coverage", "exchange_fresh",
            "onchain_fresh", "social_fresh", "reasons", *FEATURES]
    last = chosen.groupBy("asset").agg(F.max_by(F.struct(*cols), "ts_ms").alias("r"), F.max("ts_ms").alias("ts_ms"))
    flat = last.select("asset", "ts_ms", "r.*")
    return flat.select(
        "asset", "ts_ms", "score", "severity", "rule_score", "ml_score",
        contributions().alias("contributions"), "coverage", (F.col("coverage") <= 0.34).alias("thin_data"),
        "exchange_fresh", "onchain_fresh", "social_fresh",
        top_features(12, digits=3).alias("active_features"), F.slice("reasons", 1, 7).alias("reasons"),
    )


def book_report(snapshots: DataFrame, symbol: str | None = None, obi_threshold: float = 0.35, n: int = 6) -> DataFrame:
    """Per pair, its venues by depth, with the lopsided-book warning and a divergence note."""
    from pyspark.sql import Window

    from tapevigil.functions.scalars import obi_direction

    chosen = snapshots if symbol is None else snapshots.where(F.col("symbol") == symbol)
    depth = F.col("bid_depth") + F.col("ask_depth")
    div = F.col("cvd_divergence")
    ranked = Window.partitionBy("symbol").orderBy(F.desc(depth), "venue")
    return (
        chosen.withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= n)
        .withColumn("warn", F.abs("obi") >= obi_threshold)
        .withColumn("direction", obi_direction(F.col("obi")))
        .withColumn("note", F.when(div > 0.25, "absorption by passive wall").when(
            div < -0.25, "markup without real buying"))
    )
