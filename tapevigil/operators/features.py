"""Feature vectors per asset: as of one moment, or on a grid of scoring ticks.

Events (tapevigil.sources.events layout) are first thinned to the latest
observation per series and tick, which aggregates map-side; only those rows are
expanded to the ticks they stay valid for. A series is one (asset, metric) and,
for exchange metrics, one venue.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapevigil.functions.scalars import (
    accel_index,
    base_asset,
    bridge_index,
    clamp,
    hit_index,
    net_flow_index,
    spread_index,
    wall_index,
)
from tapevigil.operators.series import DEFAULT_BLOCK_MS, fill_forward, positions
from tapevigil.plans.storage import settle
from tapevigil.schemas import FEATURES, NEUTRAL

EXCHANGE = ("volume", "order_book", "cvd")
OBSERVED = EXCHANGE + (
    "wallet_transfer", "liquidity", "bridge_flow", "social_mentions", "social_sentiment", "bot_farm",
)
TTL_MS = 600_000
HALF_LIFE_S = 120.0
CONCURRENT_MS = 5_000
SWEEP_BLOCK = 65_536  # ticks; a block holds at most two rows of each


def with_neutral(df: DataFrame, known: Mapping[str, Column], extra: Sequence[Column]) -> DataFrame:
    """Select `extra` plus the twenty features, neutral where not given."""
    return df.select(
        *extra, *[known.get(f, F.lit(NEUTRAL[f])).cast("double").alias(f) for f in FEATURES]
    )


def is_urgent() -> Column:
    """Whether an event is extreme enough for its asset to be scored at once."""
    metric, zero = F.col("metric_type"), F.lit(0.0)
    extreme = (
        (F.abs(F.coalesce("normalized_z_score", zero)) >= 4.0)
        | ((metric == "liquidity") & (F.abs("raw_value") >= 30))
        | ((metric == "bot_farm") & (F.col("raw_value") >= 0.6))
        | ((metric == "wallet_transfer") & (F.coalesce("usd_value", zero) >= 5_000_000))
    )
    return F.coalesce(extreme & (metric != "manipulation_score"), F.lit(False))


def observations(events: DataFrame, with_urgent: bool = False) -> DataFrame:
    """Events that carry features, keyed by asset; venue is blank where it does not matter.

    with_urgent adds `urgent` and the urgent events of other metrics, whose metric is then blank.
    """
    metric = F.col("metric_type")
    truthy = F.col("meta.bridge_precursor").isNotNull() & ~F.col("meta.bridge_precursor").isin(
        "", "null", "false", "{}"
    )
    observed = metric.isin(*OBSERVED)
    urgent = [is_urgent().alias("urgent")] if with_urgent else []
    return events.where(observed | is_urgent() if with_urgent else observed).select(
        base_asset(F.col("asset_pair")).alias("asset"),
        (F.when(observed, metric).otherwise("") if with_urgent else metric).alias("metric"),
        F.when(metric.isin(*EXCHANGE), F.col("venue")).otherwise("").alias("venue"),
        "ts_ms",
        "event_id",
        F.col("raw_value").alias("value"),
        F.col("normalized_z_score").alias("z"),
        F.coalesce("usd_value", F.lit(0.0)).alias("usd"),
        F.coalesce("meta.spike_ratio", F.lit(1.0)).alias("spike"),
        F.coalesce("meta.spread_bps", F.lit(0.0)).alias("spread"),
        (F.coalesce("meta.spoofed_walls", F.lit(0)) + F.coalesce("meta.absorbed_walls", F.lit(0))).alias("walls"),
        F.coalesce("meta.divergence", F.lit(0.0)).alias("divergence"),
        F.coalesce("meta.acceleration", F.lit(0.0)).alias("acceleration"),
        F.coalesce("meta.direction", F.lit("")).alias("direction"),
        truthy.cast("int").alias("hit"),
        *urgent,
    )


STATE_COLUMNS = ("ts_ms", "value", "z", "spike", "spread", "walls", "divergence", "acceleration")


def latest(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Newest observation per series within `by` (ties by event_id)."""
    row = F.struct("ts_ms", "event_id", *[c for c in STATE_COLUMNS if c != "ts_ms"])
    return (
        obs.groupBy(*by, "asset", "metric", "venue")
        .agg(F.max(row).alias("o"))
        .select(*by, "asset", "metric", "venue", *[F.col(f"o.{c}").alias(c) for c in STATE_COLUMNS])
    )


def decayed_totals(obs: DataFrame, tick_ms: int, factor: float, decay_every: int = 1) -> DataFrame:
    """Inflow, outflow, bridge USD and bridge hits per (asset, tick) that has flows.

    An event counts from the first tick at or after it. After every `decay_every`-th
    tick the USD totals are multiplied by `factor` and the hit counter loses one,
    never below zero. With E decays before a tick the totals are
    sum(x * factor^(E_now - E_then)); the exponent is taken relative to blocks
    of epochs, long enough that older blocks fall below double precision.
    Rows that come with a `tick` keep it.
    """
    tick = F.col("tick") if "tick" in obs.columns else tick_of("ts_ms", tick_ms)
    flows = obs.where(F.col("metric").isin("wallet_transfer", "bridge_flow")).groupBy(
        "asset", tick.alias("tick")
    ).agg(
        F.sum(F.when((F.col("metric") == "wallet_transfer") & (F.col("direction") == "inflow"), F.col("usd")).otherwise(0.0)).alias("x_in"),
        F.sum(F.when((F.col("metric") == "wallet_transfer") & (F.col("direction") == "outflow"), F.col("usd")).otherwise(0.0)).alias("x_out"),
        F.sum(F.when(F.col("metric") == "bridge_flow", F.col("usd")).otherwise(0.0)).alias("x_bridge"),
        F.sum(F.when(F.col("metric") == "wallet_transfer", F.col("hit")).otherwise(0)).alias("x_hit"),
    )
    span = max(1, math.ceil(100.0 / -math.log(factor))) if factor < 1.0 else 1 << 40
    rows = flows.withColumn("epoch", epochs(F.col("tick"), decay_every)).withColumn(
        "blk", F.floor(F.col("epoch") / span).cast("bigint")
    )
    inside = Window.partitionBy("asset", "blk").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("asset").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("asset").orderBy("blk")
    since_start = F.col("epoch") - F.col("blk") * span
    names = ("in", "out", "bridge")
    ends = rows.groupBy("asset", "blk").agg(
        *[F.sum(F.col(f"x_{n}") * F.pow(F.lit(factor), span - since_start)).alias(f"e_{n}") for n in names]
    )
    carry = ends.select(
        "asset", "blk",
        *[
            F.coalesce(
                F.lag(f"e_{n}").over(earlier)
                * F.pow(F.lit(factor), (F.col("blk") - F.lag("blk").over(earlier) - 1) * span),
                F.lit(0.0),
            ).alias(f"c_{n}")
            for n in names
        ],
    )
    # Reflected walk: +hits on arrival, -1 per epoch, floored at zero.
    arrived = F.sum("x_hit").over(whole)
    out = (
        rows.withColumn("__arrived", arrived)
        .withColumn("__free", F.col("__arrived") - F.col("epoch"))
        .withColumn("__low", F.min(F.col("__arrived") - F.col("x_hit") - F.col("epoch")).over(whole))
    )
    out = out.join(carry, ["asset", "blk"])
    for n in names:
        scaled = F.sum(F.col(f"x_{n}") * F.pow(F.lit(factor), -since_start)).over(inside)
        out = out.withColumn(f"{n}_usd", (scaled + F.col(f"c_{n}")) * F.pow(F.lit(factor), since_start))
    return out.select(
        "asset", "tick", "epoch", "in_usd", "out_usd", "bridge_usd",
        (F.col("__free") - F.least(F.lit(0), F.col("__low"))).alias("hits"),
    )


def epochs(tick: Column, decay_every: int) -> Column:
    """Decays applied before scoring `tick`."""
    return F.floor((tick - 1) / decay_every).cast("bigint")


def tick_of(ts: str, tick_ms: int) -> Column:
    """The first tick at or after a time."""
    return F.ceil(F.col(ts) / tick_ms).cast("bigint")


def event_sweeps(events: DataFrame, tick_ms: int) -> DataFrame:
    """(tick, sweep): the ticks that end with an event of any asset, numbered from 1 in order of time."""
    ticks = events.where("ts_ms is not null").select(tick_of("ts_ms", tick_ms).alias("tick")).distinct()
    return settle(positions(ticks, [], ["tick"], out="sweep")[0].select("tick", "sweep"))


def last_sweeps(ticks: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(tick, last_sweep): the last sweep at or before each different tick of `ticks`."""
    both = sweeps.select("tick", "sweep", F.lit(0).alias("asked")).unionByName(
        ticks.select("tick").distinct().select("tick", F.lit(None).cast("bigint").alias("sweep"), F.lit(1).alias("asked")))
    filled = fill_forward(both, [], ["tick", "asked"], "sweep", "last_sweep", ts="tick", block_ms=SWEEP_BLOCK)
    return filled.where("asked = 1").select("tick", "last_sweep")


def _assemble(obs: DataFrame, ttl_ms: int, half_life_s: float, concurrent_ms: int,
              extra: Sequence[Column] = ()) -> DataFrame:
    """Aggregate valid observations per (asset, at_ms) into raw feature inputs.

    A row is one series' latest observation at `at_ms`; expired rows are ignored.
    """
    age_ms = F.col("at_ms") - F.col("ts_ms")
    fresh = age_ms <= ttl_ms
    decay = F.pow(F.lit(0.5), age_ms / 1000.0 / half_life_s)

    def when(metric: str, value: Column, also: Column | None = None) -> Column:
        cond = fresh & (F.col("metric") == metric)
        return F.when(cond if also is None else cond & also, value)

    def peak(metric: str, column: str) -> Column:
        return strongest(when(metric, F.col(column) * decay))

    def strongest(v: Column) -> Column:
        """The value furthest from zero, the positive one of two: of plain extremes, which are hashed and not sorted."""
        return F.when(F.max(v) >= -F.min(v), F.max(v)).otherwise(F.min(v))

    def only(metric: str, column: str) -> Column:
        return F.max(when(metric, F.col(column)))

    close = age_ms <= concurrent_ms
    d = F.col("divergence")
    return obs.groupBy("asset", "at_ms").agg(
        peak("volume", "z").alias("vol_z"),
        F.max(when("volume", F.col("spike"))).alias("spike"),
        peak("order_book", "value").alias("obi"),
        peak("order_book", "z").alias("obi_z"),
        F.max(when("order_book", F.col("value"), close)).alias("obi_hi"),
        F.min(when("order_book", F.col("value"), close)).alias("obi_lo"),
        F.max(when("order_book", F.col("spread"))).alias("spread"),
        F.sum(when("order_book", F.col("walls"))).alias("walls"),
        peak("cvd", "z").alias("cvd_z"),
        strongest(when("cvd", d)).alias("div"),
        F.count(when("wallet_transfer", F.lit(1))).alias("n_transfer"),
        only("wallet_transfer", "z").alias("whale_z"),
        F.max(when("liquidity", F.abs("value"))).alias("drop"),
        F.count(when("social_mentions", F.lit(1))).alias("n_mentions"),
        only("social_mentions", "z").alias("mention_z"),
        only("social_mentions", "acceleration").alias("accel"),
        only("social_sentiment", "value").alias("sentiment"),
        only("bot_farm", "value").alias("farm"),
        F.max("ts_ms").alias("last_update_ms"),
        *extra,
    )


def _vector(inputs: DataFrame) -> DataFrame:
    """Clamp and scale the inputs into the twenty features, freshness and coverage."""
    zero = F.lit(0.0)

    def z(name: str) -> Column:
        return clamp(F.coalesce(F.col(name), zero), -20.0, 20.0)

    def unit(name: str, low: float = -1.0, high: float = 1.0) -> Column:
        return clamp(F.coalesce(F.col(name), zero), low, high)

    usd = {n: F.coalesce(F.col(f"{n}_usd"), zero) for n in ("in", "out", "bridge")}
    exchange = F.col("vol_z").isNotNull() | F.col("obi").isNotNull() | F.col("cvd_z").isNotNull()
    onchain = (F.col("n_transfer") > 0) | F.col("drop").isNotNull() | (usd["bridge"] > 0)
    social = F.col("n_mentions") > 0
    coverage = (exchange.cast("int") + onchain.cast("int") + social.cast("int")) / 3.0
    known = {
        "volume_z": z("vol_z"),
        "volume_spike_ratio": clamp(F.greatest(F.coalesce("spike", F.lit(1.0)), F.lit(1.0)), 0.0, 50.0),
        "obi": unit("obi"),
        "obi_abs": F.abs(unit("obi")),
        "obi_z": z("obi_z"),
        "spread_bps": spread_index(F.coalesce("spread", zero)),
        "cvd_z": z("cvd_z"),
        "cvd_divergence": unit("div"),
        "venue_dispersion": clamp(F.coalesce(F.col("obi_hi") - F.col("obi_lo"), zero), 0.0, 2.0),
        "wall_activity": wall_index(F.coalesce("walls", F.lit(0))),
        "whale_inflow_z": z("whale_z"),
        "net_flow_norm": net_flow_index(usd["in"] - usd["out"]),
        "liquidity_drop": clamp(F.coalesce(F.col("drop"), zero) / 100.0, 0.0, 1.0),
        "bridge_activity": bridge_index(usd["bridge"]),
        "bridge_to_cex": hit_index(F.coalesce("hits", F.lit(0))),
        "mention_z": z("mention_z"),
        "mention_accel": accel_index(F.coalesce("accel", zero)),
        "sentiment": unit("sentiment"),
        "sentiment_abs": F.abs(unit("sentiment")),
        "bot_farm_score": unit("farm", 0.0),
    }
    shaped = [
        F.col("asset"),
        F.col("at_ms").alias("ts_ms"),
        exchange.alias("exchange_fresh"),
        onchain.alias("onchain_fresh"),
        social.alias("social_fresh"),
        coverage.alias("coverage"),
        F.col("last_update_ms"),
    ]
    features = [known[f].alias(f) for f in FEATURES]
    # The generator keeps later filters on features from being rewritten over the inputs.
    return inputs.select(F.inline(F.array(F.struct(*shaped, *features))))


def features_at(events: DataFrame, at_ms: int, ttl_ms: int = TTL_MS, tick_ms: int = 5_000,
                factor: float = 0.85, decay_every: int = 1, half_life_s: float = HALF_LIFE_S,
                concurrent_ms: int = CONCURRENT_MS) -> DataFrame:
    """One vector per asset as of `at_ms`; decays happen on multiples of tick_ms."""
    known = observations(events.where(F.col("ts_ms") <= at_ms))
    state = latest(known, []).withColumn("at_ms", F.lit(at_ms).cast("bigint"))
    totals = decayed_totals(known, tick_ms, factor, decay_every)
    last = totals.groupBy("asset").agg(F.max(F.struct("tick", "epoch", "in_usd", "out_usd", "bridge_usd", "hits")).alias("t"))
    now_tick = F.lit(-(-at_ms // tick_ms))
    aged = age_totals(last.select("asset", "t.*"), epochs(now_tick, decay_every), factor)
    return _vector(_assemble(state, ttl_ms, half_life_s, concurrent_ms).join(aged, "asset", "left"))


def vectors_from_state(state: DataFrame, ttl_ms: int = TTL_MS, half_life_s: float = HALF_LIFE_S,
                       concurrent_ms: int = CONCURRENT_MS) -> DataFrame:
    """Vectors from rows that carry each asset's latest observations and flow totals (streaming state)."""
    totals = [F.max(c).alias(c) for c in ("in_usd", "out_usd", "bridge_usd", "hits")]
    return _vector(_assemble(state, ttl_ms, half_life_s, concurrent_ms, totals))


def age_totals(totals: DataFrame, epoch_now: Column, factor: float) -> DataFrame:
    passed = epoch_now - F.col("epoch")
    shrink = F.pow(F.lit(factor), passed)
    out = totals
    for name in ("in_usd", "out_usd", "bridge_usd"):
        out = out.withColumn(name, F.col(name) * shrink)
    return out.withColumn("hits", F.greatest(F.lit(0), F.col("hits") - passed)).drop("tick", "epoch")


def feature_grid(events: DataFrame, tick_ms: int = 1_000, ttl_ms: int = TTL_MS, factor: float = 0.9,
                 decay_every: int = 1, block_ms: int = DEFAULT_BLOCK_MS, half_life_s: float = HALF_LIFE_S,
                 concurrent_ms: int = CONCURRENT_MS, on_events: bool = False) -> DataFrame:
    """Vectors for every (asset, tick) at which the asset has an observation within the TTL.

    Each thinned observation covers the ticks until its series' next one or its
    expiry, so the expanded rows number exactly the covered grid cells.

    With on_events only ticks that end with an event of some asset are swept: nothing is
    scored, and nothing decays, in between. Ticks are then counted as sweeps, so short
    ticks cost what there are events, not what there are seconds.
    """
    tick = tick_of("ts_ms", tick_ms)
    expiry = F.floor((F.col("ts_ms") + ttl_ms) / tick_ms).cast("bigint")
    obs = observations(events)
    if on_events:
        sweeps = event_sweeps(events, tick_ms)
        numbered = obs.withColumn("__tick", tick).join(
            sweeps.select(F.col("tick").alias("__tick"), F.col("sweep").alias("tick")), "__tick").drop("__tick")
        thin = latest(numbered, ["tick"]).withColumn("__expiry", expiry)
        ends = last_sweeps(thin.select(F.col("__expiry").alias("tick")), sweeps)
        thin = thin.join(ends.select(F.col("tick").alias("__expiry"), F.col("last_sweep").alias("__last")), "__expiry").drop("__expiry")
    else:
        numbered = obs.withColumn("tick", tick)
        thin = latest(numbered, ["tick"]).withColumn("__last", expiry)
    series = Window.partitionBy("asset", "metric", "venue").orderBy("tick")
    until = F.greatest(F.least(F.lead("tick").over(series) - 1, F.col("__last")), F.col("tick"))
    cells = thin.withColumn("__until", until).withColumn("tick", F.explode(F.sequence(F.col("tick"), F.col("__until"))))
    if on_events:
        moments = sweeps.select(F.col("sweep").alias("tick"), (F.col("tick") * tick_ms).alias("at_ms"))
        grid = cells.drop("__until", "__last").join(moments, "tick")
    else:
        grid = cells.drop("__until", "__last").withColumn("at_ms", F.col("tick") * tick_ms)
    inputs = settle(_assemble(grid, ttl_ms, half_life_s, concurrent_ms, [F.max("tick").alias("tick")]))
    totals = decayed_totals(numbered, tick_ms, factor, decay_every).select(
        "asset", "tick", F.struct("epoch", "in_usd", "out_usd", "bridge_usd", "hits").alias("flow"),
    )
    # Every tick with flows also has an observation, so the totals join exactly and carry forward.
    filled = fill_forward(inputs.join(totals, ["asset", "tick"], "left"), ["asset"], ["at_ms"], "flow",
                          "flow", ts="at_ms", block_ms=max(block_ms, 1000 * tick_ms))
    flat = filled.select(
        *[c for c in filled.columns if c != "flow"],
        *[F.col(f"flow.{c}").alias(c) for c in ("epoch", "in_usd", "out_usd", "bridge_usd", "hits")],
    )
    return _vector(age_totals(flat, epochs(F.col("tick"), decay_every), factor))


def informative(vectors: DataFrame) -> DataFrame:
    """Vectors with at least one fresh source and one feature off its neutral value."""
    off = F.lit(False)
    for f in FEATURES:
        off = off | (F.abs(F.col(f) - NEUTRAL[f]) > 1e-9)
    return vectors.where((F.col("coverage") > 0) & off)


def prune_idle(vectors: DataFrame, max_idle_s: int = 3600) -> DataFrame:
    return vectors.where((F.col("ts_ms") - F.col("last_update_ms")) / 1000.0 <= max_idle_s)


def feature_array() -> Column:
    return F.array(*[F.col(f) for f in FEATURES])
