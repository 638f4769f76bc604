"""Alert gating, summaries, history, and detection quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.functions.scalars import score_rank, text
from tapevigil.operators.folds import CHUNK_ROWS, cooldown_gate
from tapevigil.operators.ranks import quantiles
from tapevigil.operators.series import on_keys

ALERT_KEYS = ["asset_pair", "venue"]
ALERT_ORDER = ["ts_ms", "signal_id"]

# Thresholds of the confusion table.
THRESHOLDS = (40, 50, 60, 70, 80, 90)


def above_threshold(signals: DataFrame, min_score: float = 80.0) -> DataFrame:
    return signals.where(F.col("score") >= min_score)


def route_alerts(signals: DataFrame, min_score: float = 80.0, cooldown_ms: int = 300_000,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Decide for every signal whether it is sent, and why.

    Per (asset, venue) the first alert goes out, then one of higher severity than
    the last sent, or one a cooldown after it. Signals below min_score, or without a
    score, do not touch that state.
    """
    eligible = above_threshold(signals, min_score).withColumn("severity_rank", score_rank(F.col("score")))
    gated = cooldown_gate(eligible, ALERT_KEYS, ALERT_ORDER, cooldown_ms, rank="severity_rank",
                          chunk_rows=chunk_rows)
    left_s = (F.lit(cooldown_ms) - F.col("gate_since_ms")) / 1000.0
    why = F.col("gate_reason")
    decided = gated.select(
        *signals.columns,
        F.col("gate_sent").alias("sent"),
        F.when(why == "first", "first alert").when(why == "escalation", "severity escalation")
        .when(why == "elapsed", "cooldown elapsed")
        .otherwise(text("cooldown (%.0fs left)", left_s)).alias("reason"),
        why.alias("reason_code"),
        F.col("gate_count").alias("alert_count"),
    )
    below = signals.where(~F.coalesce(F.col("score") >= min_score, F.lit(False))).select(
        *signals.columns, F.lit(False).alias("sent"), F.lit("below threshold").alias("reason"),
        F.lit("below").alias("reason_code"), F.lit(None).cast("bigint").alias("alert_count"),
    )
    return decided.unionByName(below)


def dispatch_summary(routed: DataFrame, by: Sequence[str] = (*ALERT_KEYS, "reason_code")) -> DataFrame:
    return routed.groupBy(*by).agg(
        F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("suppressed")
    )


def alert_history(sent: DataFrame, asset: str | None = None, n: int = 12, buffer: int | None = None) -> DataFrame:
    """Newest n alerts, optionally of one asset and only of the newest `buffer` of all assets."""
    newest = sent if buffer is None else sent.orderBy(*[F.desc(c) for c in ALERT_ORDER]).limit(buffer)
    chosen = newest if asset is None else newest.where(F.col("asset_pair") == asset)
    return chosen.orderBy(*[F.desc(c) for c in ALERT_ORDER]).limit(n)


# --- detection quality --------------------------------------------------------


def _ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    )


def _confusion(df: DataFrame, tests: Sequence[tuple[Column, Column]], name: str, label: str) -> DataFrame:
    """One aggregation pass holds every test's counts; the single result row is then unpivoted."""
    truth = F.col(label) == 1
    parts = []
    for i, (_, hit) in enumerate(tests):
        parts += [
            F.count_if(hit & truth).alias(f"tp{i}"),
            F.count_if(hit & ~truth).alias(f"fp{i}"),
            F.count_if(~hit & truth).alias(f"fn{i}"),
        ]
    rows = F.array(*[
        F.struct(key.alias(name), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
        for i, (key, _) in enumerate(tests)
    ])
    return _ratios(df.agg(*parts).select(F.inline(rows)))


def threshold_table(scored: DataFrame, label: str = "label", thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 at each score threshold."""
    return _confusion(scored, [(F.lit(t), F.col("score") >= t) for t in thresholds], "threshold", label)


def baseline_table(scored: DataFrame, label: str = "label") -> DataFrame:
    """One-line baselines next to the full score at 80."""
    vz, obi = F.col("volume_z"), F.abs("obi")
    tests = [
        (F.lit("volume_z > 3"), vz > 3.0),
        (F.lit("|obi| > 0.35"), obi > 0.35),
        (F.lit("four thresholds"), (vz > 2.5) | (obi > 0.3) | (F.col("bot_farm_score") > 0.5)
         | (F.col("liquidity_drop") > 0.3)),
        (F.lit("full score >= 80"), F.col("score") >= 80),
    ]
    return _confusion(scored, tests, "detector", label)


def scenario_table(scored: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Mean, interpolated p10/p90 and share at or above 80 per scenario."""
    means = scored.groupBy(scenario).agg(
        F.avg("score").alias("mean_score"),
        F.avg((F.col("score") >= 80).cast("double")).alias("share_80"),
        F.count(F.lit(1)).alias("n"),
    )
    ranks = quantiles(scored, [scenario], "score", {"p10": 0.1, "p90": 0.9}).drop("n")
    return on_keys(means, ranks, [scenario], "left").select(scenario, "mean_score", "p10", "p90", "share_80", "n")
