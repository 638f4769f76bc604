"""Rule engine: twenty features to an explainable 0-100 score. One projection, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.functions.scalars import clamp, layer, once, text

# Source weights.
WEIGHTS = {"exchange": 0.40, "onchain": 0.35, "social": 0.25}



def _f(name: str) -> Column:
    return F.col(name)


def _mag(name: str) -> Column:
    return F.abs(F.col(name))


def _pct(x: Column) -> Column:
    return text("%.0f%%", x * 100)


def _points(*terms: Column) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _if(cond: Column, value) -> Column:
    return F.when(cond, value).otherwise(F.lit(0.0))


def _ladder(*steps: tuple[Column, Column | float]) -> Column:
    out = None
    for cond, value in steps:
        v = value if isinstance(value, Column) else F.lit(float(value))
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(F.lit(0.0))


@once
def _exchange_columns() -> dict[str, Column]:
    vz, obi, obi_abs, obi_z = _f("volume_z"), _f("obi"), _f("obi_abs"), _f("obi_z")
    cvd, div = _f("cvd_z"), _f("cvd_divergence")
    walls, spread, disp, spike = _f("wall_activity"), _f("spread_bps"), _f("venue_dispersion"), _f("volume_spike_ratio")
    loud_book = (F.abs(obi_z) > 3.0) & (obi_abs >= 0.30)
    one_sided = (F.abs(cvd) > 2.5) & (vz > -0.5)

    # Wash trading: heavy volume with no delta, a flat book and a tight spread. Only
    # judged when a book and a flow were actually observed.
    observed = (spread > 0) & ((obi_abs > 0) | (obi_z != 0)) & ((cvd != 0) | (div != 0))
    neutral = (F.abs(cvd) < 1.2) & (F.abs(div) < 0.2)
    tight = spread < 1.0
    confirms = neutral.cast("int") + (obi_abs < 0.2).cast("int") + tight.cast("int")
    washing = (vz > 2.5) & (spike > 3.0) & observed & (confirms >= 2)

    points = _points(
        _ladder((vz > 3.0, clamp(25.0 * (vz - 3.0) / 5.0 + 25.0, 0, 50)), (vz > 2.0, 12.0)),
        _if(obi_abs > 0.35, clamp(30.0 * (obi_abs - 0.35) / 0.5, 0, 30)),
        _if(loud_book, clamp(22.0 * (F.abs(obi_z) - 3.0) / 4.0 + 8.0, 0, 30)),
        _if(one_sided, clamp(15.0 * (F.abs(cvd) - 2.5) / 3.0, 0, 15)),
        _if(F.abs(div) > 0.4, clamp(20.0 * F.abs(div), 0, 20)),
        _if(walls > 1.0, clamp(10.0 * walls / 3.0, 0, 10)),
        _if(disp > 0.5, clamp(12.0 * disp, 0, 12)),
        _if(washing, clamp(18.0 * confirms + 8.0 * (vz - 2.5), 0, 55)),
    )
    reasons = F.array(
        F.when(vz > 3.0, text("volume %.1fσ above 5m baseline", vz)),
        F.when(obi_abs > 0.35, text("order book %s %s-heavy", _pct(obi_abs), F.when(obi > 0, "bid").otherwise("ask"))),
        F.when(loud_book, text("book imbalance %.1fσ vs its own baseline (OBI %+.2f)", obi_z, obi)),
        F.when(one_sided, text("CVD %.1fσ — one-sided aggression", cvd)),
        F.when(F.abs(div) > 0.4, F.concat(F.lit("price/CVD divergence — "), F.when(
            div > 0, "absorption by passive wall").otherwise("markup without real buying"))),
        F.when(walls > 1.0, F.lit("large passive walls pulled/consumed")),
        F.when(disp > 0.5, text("cross-venue book disagreement (%.2f)", disp)),
        F.when(washing, F.concat(
            text("wash-trading signature: %.0fx volume with no net delta, flat book", spike),
            F.when(tight, ", abnormally tight spread").otherwise(""))),
    )
    wash = _if(washing, clamp(confirms / 3.0 * (vz / 5.0), 0, 1))
    return dict(ex=clamp(points, 0, 100), wash=wash, ex_reasons=reasons)


def exchange_rules(df: DataFrame) -> DataFrame:
    """Adds ex (0-100), wash (0-1) and ex_reasons."""
    return layer(df, **_exchange_columns())


@once
def _onchain_columns() -> dict[str, Column]:
    whale, net, drop = _f("whale_inflow_z"), _f("net_flow_norm"), _f("liquidity_drop")
    to_cex, bridge = _f("bridge_to_cex"), _f("bridge_activity")
    points = _points(
        _if(whale > 2.0, clamp(30.0 * (whale - 2.0) / 4.0 + 15.0, 0, 45)),
        _ladder((net > 0.3, clamp(25.0 * net, 0, 25)), (net < -0.3, clamp(10.0 * F.abs(net), 0, 10))),
        _if(drop > 0.30, clamp(40.0 * drop, 0, 40)),
        _ladder((to_cex > 0.3, clamp(25.0 * to_cex, 0, 25)), (bridge > 0.4, clamp(12.0 * bridge, 0, 12))),
    )
    reasons = F.array(
        F.when(whale > 2.0, text("whale transfer %.1fσ vs history", whale)),
        F.when(net > 0.3, text("net CEX deposits (flow index %+.2f)", net))
        .when(net < -0.3, "large CEX withdrawals — supply squeeze setup"),
        F.when(drop > 0.30, text("DEX liquidity -%.0f%% in one block", drop * 100)),
        F.when(to_cex > 0.3, "bridged stablecoins landing on CEX (pre-positioning)")
        .when(bridge > 0.4, "elevated bridge stablecoin flow"),
    )
    return dict(oc=clamp(points, 0, 100), oc_reasons=reasons)


def onchain_rules(df: DataFrame) -> DataFrame:
    return layer(df, **_onchain_columns())


@once
def _social_columns() -> dict[str, Column]:
    mz, accel, farm = _f("mention_z"), _f("mention_accel"), _f("bot_farm_score")
    mood, mood_abs = _f("sentiment"), _f("sentiment_abs")
    points = _points(
        _ladder((mz > 3.0, clamp(30.0 * (mz - 3.0) / 5.0 + 20.0, 0, 50)), (mz > 2.0, 10.0)),
        _if(accel > 0.4, clamp(20.0 * accel, 0, 20)),
        _ladder((farm > 0.5, clamp(45.0 * farm, 0, 45)), (farm > 0.3, 12.0)),
        _if(mood_abs > 0.6, clamp(15.0 * mood_abs, 0, 15)),
    )
    reasons = F.array(
        F.when(mz > 3.0, text("mention rate %.1fσ above baseline", mz)),
        F.when(accel > 0.4, F.lit("mention volume accelerating")),
        F.when(farm > 0.5, text("bot-farm pattern (confidence %s)", _pct(farm))),
        F.when(mood_abs > 0.6, text("extreme %s sentiment (%+.2f)", F.when(mood > 0, "bullish").otherwise("bearish"), mood)),
    )
    return dict(so=clamp(points, 0, 100), so_reasons=reasons)


def social_rules(df: DataFrame) -> DataFrame:
    return layer(df, **_social_columns())


def fuse(df: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Noisy-OR of the three sources, never below their weighted mean; adds fused and active."""
    scores = {"exchange": F.col("ex"), "onchain": F.col("oc"), "social": F.col("so")}
    defaults = {"exchange": 0.4, "onchain": 0.35, "social": 0.25}
    weighted = _points(*[s * weights.get(k, defaults[k]) for k, s in scores.items()])
    clean = F.lit(1.0)
    for k, s in scores.items():
        w = min(max(0.70 + 0.75 * weights.get(k, 0.33), 0.0), 1.0)
        clean = clean * (1.0 - clamp(s / 100.0, 0.0, 0.985) * w)
    active = _points(*[(s >= 30).cast("int") for s in scores.values()])
    base = F.greatest(weighted, (1.0 - clean) * 100.0 * 0.95)
    return layer(df, active=active, fused=base * F.when(active >= 2, 1.0 + 0.18 * (active - 1)).otherwise(1.0))


def _playbooks() -> list[tuple[Column, float, str]]:
    return [
        ((_f("volume_z") > 3) & (_f("bot_farm_score") > 0.5) & (_f("sentiment") > 0.3), 12.0,
         "⚑ pump-and-dump signature (volume + shills + euphoria)"),
        ((_f("liquidity_drop") > 0.3) & (_f("net_flow_norm") > 0.2), 15.0,
         "⚑ rug-pull signature (LP drain + exchange deposits)"),
        ((_f("obi_abs") > 0.5) & (_f("wall_activity") > 1.0) & (_mag("cvd_divergence") > 0.3), 10.0,
         "⚑ spoofing/layering signature"),
        ((_f("whale_inflow_z") > 3) & (_f("mention_z") > 3) & (_f("sentiment") > 0.4), 10.0,
         "⚑ distribution-into-hype signature"),
    ]


def artificial() -> Column:
    """Strongest marker of orchestrated activity, 0-1."""
    return F.greatest(
        _f("bot_farm_score"),
        _if(_f("wall_activity") > 0.7, clamp(_f("obi_abs") / 0.6, 0, 1)),
        _f("liquidity_drop"),
        clamp(_f("bridge_to_cex"), 0, 1),
        clamp(_mag("cvd_divergence") / 0.6, 0, 1),
        clamp(_f("venue_dispersion") / 0.8, 0, 1),
        clamp(F.greatest(F.lit(0.0), _f("net_flow_norm")) / 0.5, 0, 1),
        _f("wash"),
    )


def stress() -> Column:
    """How dislocated the book and the tape are by themselves, 0-1."""
    return F.greatest(
        clamp((_mag("cvd_z") - 3.0) / 4.0, 0, 1),
        clamp((_mag("obi_z") - 3.0) / 4.0, 0, 1),
        clamp((_f("obi_abs") - 0.6) / 0.35, 0, 1),
        clamp((_f("volume_z") - 5.0) / 5.0, 0, 1),
    )


def self_evident() -> Column:
    """Volume, book and delta are all extreme."""
    return (_f("volume_z") > 3.0) & (_f("obi_abs") > 0.5) & (_mag("cvd_z") > 3.0)


def rule_scores(vectors: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Adds ex/oc/so, rule_score and rule_reasons (all texts, in rule order)."""
    out = fuse(social_rules(onchain_rules(exchange_rules(vectors))), weights)
    plays = _playbooks()
    base = F.col("fused")
    for cond, bonus, _ in plays:
        base = base + _if(cond, F.lit(bonus))
    out = layer(out, base=base, __art=artificial(), __stress=stress())
    loud = (_f("volume_z") > 2.0) | (_f("mention_z") > 2.0)
    damp = 0.40 + 0.60 * (F.col("__art") / 0.45)
    damp = damp + (1.0 - damp) * F.col("__stress")
    out = layer(out, damping=F.when(loud & (F.col("__art") < 0.45), damp).otherwise(F.lit(1.0)))
    shock = self_evident()
    product = (_f("volume_z") / 3.0) * (_f("obi_abs") / 0.5) * (_mag("cvd_z") / 3.0)
    floor = clamp(62.0 + F.least(product, F.lit(8.0)) * 5.0, 0, 100)
    damped = F.col("base") * F.col("damping")
    score = clamp(F.when(shock, F.greatest(damped, floor)).otherwise(damped), 0, 100)
    headline = F.when(shock, text(
        "⚑ %s: volume %.1fσ, book %s one-sided, CVD %+.1fσ",
        F.when(_f("cvd_z") < 0, "SELL-OFF").otherwise("BUY PANIC"), _f("volume_z"), _pct(_f("obi_abs")), _f("cvd_z"),
    ))
    tail = F.array(
        F.when(F.col("active") >= 2, text("corroborated across %d independent data sources", F.col("active"))),
        *[F.when(cond, F.lit(text)) for cond, _, text in plays],
        F.when(F.col("damping") < 0.9, F.lit("organic-activity profile — no artificial-flow markers")),
    )
    reasons = F.array_compact(
        F.concat(F.array(headline), F.col("ex_reasons"), F.col("oc_reasons"), F.col("so_reasons"), tail)
    )
    return layer(out, rule_score=score, rule_reasons=reasons).drop(
        "ex_reasons", "oc_reasons", "so_reasons", "fused", "base", "active", "__art", "__stress", "damping"
    )
