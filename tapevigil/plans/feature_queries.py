"""Event normalisation, feature vectors, rules and scores over the test views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapevigil.operators import features as ft
from tapevigil.operators import forest, rules, scoring
from tapevigil.operators.series import spread
from tapevigil.plans import replay as rp
from tapevigil.plans import views as v
from tapevigil.plans.registry import query
from tapevigil.plans.views import DAY, HOUR, with_views
from tapevigil.schemas import FEATURES, NEUTRAL
from tapevigil.sources import events as ev

TTL = 6 * HOUR
GRID = {"tick_ms": HOUR, "ttl_ms": TTL, "factor": 0.9, "half_life_s": 7200.0, "concurrent_ms": HOUR, "block_ms": DAY, "on_events": False}
EVERY_SECOND = GRID | {"tick_ms": 1_000, "on_events": True}
NOON = 1_705_276_800_000  # a whole hour inside the data, 2024-01-15 00:00 UTC
_ROUND = ", ".join(f"round({f}, 6) as {f}" for f in FEATURES)


@query("recorded_events", with_views("market_events", body="""
select event_id, ts_ms, source_type, venue, asset_pair, metric as metric_type, round(raw_value, 6) as raw_value,
       round(z, 6) as normalized_z_score, round(spike, 6) as spike, direction, hit = 1 as precursor
from market_events where right(event_id, 1) <> '7'"""))
def recorded_events(spark, sf):
    """Events as JSON lines (one in ten broken, padded names), parsed and validated."""
    e = v.market_events(spark, sf).withColumn("asset_pair", F.lower(F.concat(F.lit(" "), "asset_pair"))).withColumn(
        "venue", F.upper("venue"))
    line = F.to_json(F.struct(
        "event_id", F.col("ts_ms").alias("timestamp"), "source_type", "venue", "asset_pair", "metric_type", "raw_value",
        "normalized_z_score", "usd_value", "confidence", "meta"))
    broken = F.when(F.right("event_id", F.lit(1)) == "7", F.left(line, F.lit(40))).otherwise(line)
    parsed = ev.parse_lines(e.select(broken.alias("value")))
    return ev.usable(parsed).select(
        "event_id", "ts_ms", "source_type", "venue", "asset_pair", "metric_type", "raw_value", "normalized_z_score",
        F.col("meta.spike_ratio").alias("spike"), "meta.direction",
        F.col("meta.bridge_precursor").isNotNull().alias("precursor"))


@query("written_events", with_views("market_events", body="""
select event_id, ts_ms, source_type, venue, asset_pair, metric as metric_type, round(raw_value, 6) as raw_value, round(z, 6) as normalized_z_score
from market_events"""))
def written_events(spark, sf):
    """Events recorded as JSON lines in a folder per metric, then read and validated again."""
    from tapevigil.plans.storage import shared_folder

    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    ev.write_events(v.market_events(spark, sf), path)
    return ev.usable(ev.read_events(spark, f"{path}/*")).select(
        "event_id", "ts_ms", "source_type", "venue", "asset_pair", "metric_type", "raw_value", "normalized_z_score")


@query("event_problems", """
select case when event_id % 10 = 1 then 'unknown field' when event_id % 10 = 2 then 'missing field' when event_id % 10 = 3 then 'unknown source'
            when event_id % 10 = 4 then 'unknown metric' when event_id % 10 = 5 then 'confidence out of range'
            when event_id % 10 = 6 then 'malformed' when event_id % 10 = 8 then 'raw value not finite' end as problem, count(*) as n
from events where event_id % 10 in (1, 2, 3, 4, 5, 6, 8) group by 1""")
def event_problems(spark, sf):
    """Lines broken in seven ways, counted by the rule that refuses them."""
    e = v.market_events(spark, sf).withColumn("k", F.right("event_id", F.lit(1)))
    k = F.col("k")
    line = F.to_json(F.struct(
        "event_id", F.col("ts_ms").alias("timestamp"), F.when(k == "3", "dark_pool").otherwise(F.col("source_type")).alias("source_type"),
        F.when(k != "2", F.col("venue")).alias("venue"), "asset_pair", F.when(k == "4", "candle").otherwise(F.col("metric_type")).alias("metric_type"),
        F.when(k == "8", float("inf")).otherwise(F.col("raw_value")).alias("raw_value"),
        F.when(k == "5", 1.5).otherwise(F.col("confidence")).alias("confidence"), F.when(k == "1", 1).alias("surplus")))
    parsed = ev.parse_lines(e.select(F.when(k == "6", F.left(line, F.lit(30))).otherwise(line).alias("value")))
    return ev.rejected(parsed).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("channels", with_views("market_events", body="""
select event_id, concat('market.', source_type, '.', metric) as channel, asset as base_asset
from market_events where source_type = 'exchange' or metric in ('bot_farm', 'bridge_flow')"""))
def channels(spark, sf):
    e = ev.with_channel(v.market_events(spark, sf))
    return e.where(ev.channel_matches(F.col("channel"), "market.exchange.*", "*.b[or]*_f*")).select(
        "event_id", "channel", "base_asset")


_ASM = f"""
asm as (
  select asset, k, at_ms,
    arg_max(z * power(0.5, age / 7200e3), struct_pack(a := abs(z * power(0.5, age / 7200e3)), b := z)) filter (metric = 'volume' and z is not null) as vol_z,
    max(spike) filter (metric = 'volume') as spike,
    arg_max(raw_value * power(0.5, age / 7200e3), struct_pack(a := abs(raw_value * power(0.5, age / 7200e3)), b := raw_value)) filter (metric = 'order_book') as obi,
    arg_max(z * power(0.5, age / 7200e3), struct_pack(a := abs(z * power(0.5, age / 7200e3)), b := z)) filter (metric = 'order_book' and z is not null) as obi_z,
    max(raw_value) filter (metric = 'order_book' and age <= {HOUR}) - min(raw_value) filter (metric = 'order_book' and age <= {HOUR}) as disp,
    max(spread) filter (metric = 'order_book') as spread, sum(walls) filter (metric = 'order_book') as walls,
    arg_max(z * power(0.5, age / 7200e3), struct_pack(a := abs(z * power(0.5, age / 7200e3)), b := z)) filter (metric = 'cvd' and z is not null) as cvd_z,
    arg_max(divergence, struct_pack(a := abs(divergence), b := divergence)) filter (metric = 'cvd') as div,
    count(*) filter (metric = 'wallet_transfer') as n_tr, max(z) filter (metric = 'wallet_transfer') as whale_z,
    max(abs(raw_value)) filter (metric = 'liquidity') as drp,
    count(*) filter (metric = 'social_mentions') as n_m, max(z) filter (metric = 'social_mentions') as mention_z,
    max(acceleration) filter (metric = 'social_mentions') as accel,
    max(raw_value) filter (metric = 'social_sentiment') as mood, max(raw_value) filter (metric = 'bot_farm') as farm,
    max(ts_ms) as last_update_ms
  from live group by 1, 2, 3),"""

_VEC = """
vec as (
  select asset, at_ms as ts_ms, greatest(-20e0, least(20e0, coalesce(vol_z, 0))) as volume_z,
    least(50e0, greatest(1e0, coalesce(spike, 1))) as volume_spike_ratio, coalesce(obi, 0e0) as obi, abs(coalesce(obi, 0e0)) as obi_abs,
    greatest(-20e0, least(20e0, coalesce(obi_z, 0))) as obi_z, least(10e0, ln(1 + coalesce(spread, 0))) as spread_bps,
    greatest(-20e0, least(20e0, coalesce(cvd_z, 0))) as cvd_z, coalesce(div, 0e0) as cvd_divergence,
    greatest(0e0, least(2e0, coalesce(disp, 0))) as venue_dispersion, least(5e0, ln(1 + coalesce(walls, 0))) as wall_activity,
    greatest(-20e0, least(20e0, coalesce(whale_z, 0))) as whale_inflow_z, tanh((acc.i - acc.o) / 5e6) as net_flow_norm,
    least(1e0, coalesce(drp, 0) / 100) as liquidity_drop, tanh(acc.b / 2e7) as bridge_activity, least(1e0, acc.h / 3e0) as bridge_to_cex,
    greatest(-20e0, least(20e0, coalesce(mention_z, 0))) as mention_z, tanh(coalesce(accel, 0) / 50) as mention_accel,
    coalesce(mood, 0e0) as sentiment, abs(coalesce(mood, 0e0)) as sentiment_abs, coalesce(farm, 0e0) as bot_farm_score,
    (vol_z is not null or obi is not null or cvd_z is not null) as exchange_fresh, (n_tr > 0 or drp is not null or acc.b > 0) as onchain_fresh,
    n_m > 0 as social_fresh, last_update_ms,
    (cast(vol_z is not null or obi is not null or cvd_z is not null as int) + cast(n_tr > 0 or drp is not null or acc.b > 0 as int)
     + cast(n_m > 0 as int)) / 3e0 as coverage
  from asm join acc using (asset, k))"""

_OBS = f"""
, obs as (
  select *, case when metric in ('volume', 'order_book', 'cvd') then venue else '' end as vn,
         (ts_ms + {HOUR - 1}) // {HOUR} as k from market_events),
ticks as (select unnest(range(min(k), max(k) + 7)) as k from obs),
live as (
  select * from (
    select o.* exclude (k), t.k, t.k * {HOUR} as at_ms, (t.k * {HOUR} - o.ts_ms) as age,
           row_number() over (partition by asset, metric, vn, t.k order by o.ts_ms desc, o.event_id desc) as rk
    from obs o join ticks t on t.k * {HOUR} >= o.ts_ms and t.k * {HOUR} <= o.ts_ms + {TTL}) where rk = 1), {_ASM}
xs as (
  select a.asset, t.k, coalesce(sum(usd_value) filter (metric = 'wallet_transfer' and direction = 'inflow'), 0e0) as xi,
         coalesce(sum(usd_value) filter (metric = 'wallet_transfer' and direction = 'outflow'), 0e0) as xo,
         coalesce(sum(usd_value) filter (metric = 'bridge_flow'), 0e0) as xb, coalesce(sum(hit) filter (metric = 'wallet_transfer'), 0) as xh
  from (select distinct asset from obs) a cross join ticks t left join obs o on o.asset = a.asset and o.k = t.k group by 1, 2),
acc as (
  select asset, k, xi as i, xo as o, xb as b, cast(xh as bigint) as h from xs where k = (select min(k) from ticks)
  union all
  select x.asset, x.k, acc.i * 0.9 + xi, acc.o * 0.9 + xo, acc.b * 0.9 + xb, greatest(0, acc.h - 1) + cast(xh as bigint)
  from acc join xs x on x.asset = acc.asset and x.k = acc.k + 1), {_VEC}"""


def _grid(spark, sf):
    return ft.feature_grid(v.market_events(spark, sf), **GRID)


@query("feature_grid", with_views("market_events", body=_OBS + f"""
select asset, ts_ms, exchange_fresh, onchain_fresh, social_fresh, round(coverage, 6) as coverage, last_update_ms, {_ROUND} from vec"""))
def feature_grid(spark, sf):
    return _grid(spark, sf)


@query("feature_snapshot", with_views("market_events", body=_OBS + f"""
select asset, ts_ms, round(coverage, 6) as coverage, {_ROUND} from vec where ts_ms = {NOON}"""))
def feature_snapshot(spark, sf):
    args = {k: GRID[k] for k in ("ttl_ms", "tick_ms", "factor", "half_life_s", "concurrent_ms")}
    return ft.features_at(v.market_events(spark, sf), NOON, **args).drop(
        "exchange_fresh", "onchain_fresh", "social_fresh", "last_update_ms")


@query("latest_observations", with_views("market_events", body=f"""
, o as (select *, case when metric in ('volume', 'order_book', 'cvd') then venue else '' end as vn from market_events where ts_ms <= {NOON}),
r as (select *, row_number() over (partition by asset, metric, vn order by ts_ms desc, event_id desc) as rk from o)
select asset, metric, vn as venue, ts_ms, round(raw_value, 6) as value, round(z, 6) as z from r where rk = 1"""))
def latest_observations(spark, sf):
    obs = ft.observations(v.market_events(spark, sf).where(F.col("ts_ms") <= NOON))
    return ft.latest(obs, []).select("asset", "metric", "venue", "ts_ms", "value", "z")


@query("flow_totals", with_views("market_events", body=_OBS + """
select acc.asset, acc.k as tick, round(acc.i, 4) as in_usd, round(acc.o, 4) as out_usd, round(acc.b, 4) as bridge_usd, acc.h as hits
from acc where exists (select 1 from obs where obs.asset = acc.asset and obs.k = acc.k and metric in ('wallet_transfer', 'bridge_flow'))"""))
def flow_totals(spark, sf):
    t = ft.decayed_totals(ft.observations(v.market_events(spark, sf)), HOUR, 0.9)
    return t.select("asset", "tick", *[F.round(c, 4).alias(c) for c in ("in_usd", "out_usd", "bridge_usd")], "hits")


_OFF = " or ".join(f"abs({f} - {NEUTRAL[f]}) > 1e-9" for f in FEATURES)


@query("informative_vectors", with_views("market_events", body=_OBS + f"""
select asset, ts_ms from vec where coverage > 0 and ({_OFF}) and (ts_ms - last_update_ms) / 1000 <= 3600"""))
def informative_vectors(spark, sf):
    return ft.prune_idle(ft.informative(_grid(spark, sf)), 3600).select("asset", "ts_ms")


def rules_sql(src: str) -> str:
    """Expressions rl: the rule score of every row of `src`."""
    c = lambda e, hi: f"greatest(0e0, least({hi}e0, {e}))"
    return f"""
w1 as (
  select *, cast(abs(cvd_z) < 1.2 and abs(cvd_divergence) < 0.2 as int) + cast(obi_abs < 0.2 as int) + cast(spread_bps < 1 as int) as confirms,
         volume_z > 2.5 and volume_spike_ratio > 3 and spread_bps > 0 and (obi_abs > 0 or obi_z <> 0) and (cvd_z <> 0 or cvd_divergence <> 0) as seen
  from {src}),
w2 as (select *, seen and confirms >= 2 as washing from w1),
pts as (
  select *, case when washing then {c("confirms / 3e0 * (volume_z / 5)", 1)} else 0e0 end as wash,
   {c(f'''(case when volume_z > 3 then {c("25 * (volume_z - 3) / 5 + 25", 50)} when volume_z > 2 then 12 else 0 end
     + case when obi_abs > 0.35 then {c("30 * (obi_abs - 0.35) / 0.5", 30)} else 0 end
     + case when abs(obi_z) > 3 and obi_abs >= 0.30 then {c("22 * (abs(obi_z) - 3) / 4 + 8", 30)} else 0 end
     + case when abs(cvd_z) > 2.5 and volume_z > -0.5 then {c("15 * (abs(cvd_z) - 2.5) / 3", 15)} else 0 end
     + case when abs(cvd_divergence) > 0.4 then {c("20 * abs(cvd_divergence)", 20)} else 0 end
     + case when wall_activity > 1 then {c("10 * wall_activity / 3", 10)} else 0 end
     + case when venue_dispersion > 0.5 then {c("12 * venue_dispersion", 12)} else 0 end
     + case when washing then {c("18 * confirms + 8 * (volume_z - 2.5)", 55)} else 0 end)''', 100)} as ex,
   {c(f'''(case when whale_inflow_z > 2 then {c("30 * (whale_inflow_z - 2) / 4 + 15", 45)} else 0 end
     + case when net_flow_norm > 0.3 then {c("25 * net_flow_norm", 25)} when net_flow_norm < -0.3 then {c("10 * abs(net_flow_norm)", 10)} else 0 end
     + case when liquidity_drop > 0.3 then {c("40 * liquidity_drop", 40)} else 0 end
     + case when bridge_to_cex > 0.3 then {c("25 * bridge_to_cex", 25)} when bridge_activity > 0.4 then {c("12 * bridge_activity", 12)} else 0 end)''', 100)} as oc,
   {c(f'''(case when mention_z > 3 then {c("30 * (mention_z - 3) / 5 + 20", 50)} when mention_z > 2 then 10 else 0 end
     + case when mention_accel > 0.4 then {c("20 * mention_accel", 20)} else 0 end
     + case when bot_farm_score > 0.5 then {c("45 * bot_farm_score", 45)} when bot_farm_score > 0.3 then 12 else 0 end
     + case when sentiment_abs > 0.6 then {c("15 * sentiment_abs", 15)} else 0 end)''', 100)} as so
  from w2),
fz as (
  select *, cast(ex >= 30 as int) + cast(oc >= 30 as int) + cast(so >= 30 as int) as active,
    greatest(ex * 0.4 + oc * 0.35 + so * 0.25, 95 * (1 - (1 - least(ex / 100, 0.985) * 1.0)
      * (1 - least(oc / 100, 0.985) * (0.70 + 0.75 * 0.35)) * (1 - least(so / 100, 0.985) * (0.70 + 0.75 * 0.25)))) as b0,
    greatest(bot_farm_score, case when wall_activity > 0.7 then {c("obi_abs / 0.6", 1)} else 0 end, liquidity_drop, {c("bridge_to_cex", 1)},
      {c("abs(cvd_divergence) / 0.6", 1)}, {c("venue_dispersion / 0.8", 1)}, {c("greatest(0, net_flow_norm) / 0.5", 1)}, wash) as art,
    greatest({c("(abs(cvd_z) - 3) / 4", 1)}, {c("(abs(obi_z) - 3) / 4", 1)}, {c("(obi_abs - 0.6) / 0.35", 1)}, {c("(volume_z - 5) / 5", 1)}) as strs
  from pts),
fb as (
  select *, b0 * case when active >= 2 then 1 + 0.18 * (active - 1) else 1 end
    + case when volume_z > 3 and bot_farm_score > 0.5 and sentiment > 0.3 then 12 else 0 end
    + case when liquidity_drop > 0.3 and net_flow_norm > 0.2 then 15 else 0 end
    + case when obi_abs > 0.5 and wall_activity > 1 and abs(cvd_divergence) > 0.3 then 10 else 0 end
    + case when whale_inflow_z > 3 and mention_z > 3 and sentiment > 0.4 then 10 else 0 end as b1,
    case when (volume_z > 2 or mention_z > 2) and art < 0.45 then (0.4 + 0.6 * art / 0.45) + (1 - (0.4 + 0.6 * art / 0.45)) * strs else 1e0 end as damp,
    volume_z > 3 and obi_abs > 0.5 and abs(cvd_z) > 3 as shock
  from fz),
rl as (
  select *, {c("case when shock then greatest(b1 * damp, least(100e0, 62 + 5 * least(8e0, (volume_z / 3) * (obi_abs / 0.5) * (abs(cvd_z) / 3)))) else b1 * damp end", 100)} as rule_score,
    cast(volume_z > 3 as int) + cast(obi_abs > 0.35 as int) + cast(abs(obi_z) > 3 and obi_abs >= 0.3 as int) + cast(abs(cvd_z) > 2.5 and volume_z > -0.5 as int)
    + cast(abs(cvd_divergence) > 0.4 as int) + cast(wall_activity > 1 as int) + cast(venue_dispersion > 0.5 as int) + cast(washing as int)
    + cast(whale_inflow_z > 2 as int) + cast(abs(net_flow_norm) > 0.3 as int) + cast(liquidity_drop > 0.3 as int) + cast(bridge_to_cex > 0.3 or bridge_activity > 0.4 as int)
    + cast(mention_z > 3 as int) + cast(mention_accel > 0.4 as int) + cast(bot_farm_score > 0.5 as int) + cast(sentiment_abs > 0.6 as int)
    + cast(active >= 2 as int) + cast(volume_z > 3 and bot_farm_score > 0.5 and sentiment > 0.3 as int) + cast(liquidity_drop > 0.3 and net_flow_norm > 0.2 as int)
    + cast(obi_abs > 0.5 and wall_activity > 1 and abs(cvd_divergence) > 0.3 as int) + cast(whale_inflow_z > 3 and mention_z > 3 and sentiment > 0.4 as int)
    + cast(damp < 0.9 as int) + cast(shock as int) as reason_count
  from fb)"""


def composite_sql(trained: bool) -> str:
    """Expression cp: composite score of rl (needs ml_score when trained)."""
    b = "0.5 * greatest(0e0, least(1e0, coverage + 0.34))"
    blended = f"((1 - {b}) * rule_score + {b} * ml_score)"
    value = (f"case when rule_score >= 60 and ml_score < rule_score then greatest({blended}, rule_score * 0.9 + ml_score * 0.1) else {blended} end"
             if trained else "rule_score")
    return f"""
cp as (select *, greatest(0e0, least(100e0, ({value}) * case when coverage <= 0.34 and not shock then 0.82 else 1 end)) as score from rl)"""


_SEV = """case when score >= 90 then 'critical' when score >= 80 then 'high' when score >= 60 then 'medium'
       when score >= 40 then 'low' else 'info' end"""


@query("rule_scores", with_views("vectors", body=f"""
, {rules_sql("vectors")}
select event_id, round(ex, 9) as ex, round(oc, 9) as oc, round(so, 9) as so, round(wash, 9) as wash,
       round(rule_score, 9) as rule_score, cast(reason_count as int) as reason_count from rl"""), digits=9)
def rule_scores(spark, sf):
    return rules.rule_scores(v.vectors(spark, sf)).select(
        "event_id", "ex", "oc", "so", "wash", "rule_score", F.size("rule_reasons").alias("reason_count"))


@query("shock_reasons", with_views("vectors", body="""
select event_id, printf('⚑ %s: volume %.1fσ, book %.0f%% one-sided, CVD %+.1fσ', case when cvd_z < 0 then 'SELL-OFF' else 'BUY PANIC' end,
       volume_z, obi_abs * 100, cvd_z) as headline
from vectors where volume_z > 3 and obi_abs > 0.5 and abs(cvd_z) > 3"""))
def shock_reasons(spark, sf):
    scored = rules.rule_scores(v.vectors(spark, sf)).where(rules.self_evident())
    return scored.select("event_id", F.element_at("rule_reasons", 1).alias("headline"))


def _with_ml(spark, sf):
    return v.vectors(spark, sf).withColumn("ml_score", (F.col("event_id") % 101).cast("double"))


_ML = "vm as (select *, (event_id % 101)::double as ml_score from vectors)"


@query("composite_scores", with_views("vectors", body=f"""
, {_ML}, {rules_sql("vm")}, {composite_sql(True)}
select event_id, round(score, 9) as score, {_SEV} as severity,
       cast(least(8, reason_count + cast(ml_score >= 70 and rule_score < 40 as int)) as int) as reasons from cp"""), digits=9)
def composite_scores(spark, sf):
    scored = scoring.composite(rules.rule_scores(_with_ml(spark, sf)))
    return scored.select("event_id", "score", "severity", F.size("reasons").alias("reasons"))


@query("signal_rows", with_views("vectors", body=f"""
, {_ML}, {rules_sql("vm")}, {composite_sql(True)},
ff as (select event_id, unnest([{", ".join(f"struct_pack(i := {i}, n := '{f}', x := {f})" for i, f in enumerate(FEATURES))}]) as f from cp),
tf as (select event_id, string_agg(concat(f.n, '=', printf('%.4f', f.x)), ',' order by abs(f.x) desc, f.i) as top_features from (
       select *, row_number() over (partition by event_id order by abs(f.x) desc, f.i) as rk from ff where abs(f.x) > 0.05) where rk <= 10 group by 1)
select asset as asset_pair, ts_ms, round(score, 9) as score, {_SEV} as severity, round(ex, 2) as ex, round(oc, 2) as oc, round(so, 2) as so,
       event_id, coalesce(top_features, '') as top_features
from cp left join tf using (event_id)"""), digits=9)
def signal_rows(spark, sf):
    scored = scoring.composite(rules.rule_scores(_with_ml(spark, sf)))
    rows = scoring.signals(scored.withColumn("venue", F.col("event_id").cast("string")))
    top = F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    return rows.select("asset_pair", "ts_ms", "score", "severity", *[
        F.col("contributions")[k].alias(n) for k, n in (("exchange", "ex"), ("onchain", "oc"), ("social", "so"))],
        F.col("venue").cast("bigint").alias("event_id"), top.alias("top_features"))


@query("score_events", with_views("vectors", body=f"""
, {_ML}, {rules_sql("vm")}, {composite_sql(True)}
select concat('sig-', asset, '-', ts_ms) as event_id, ts_ms, 'derived' as source_type, asset as asset_pair, 'manipulation_score' as metric_type,
       round(score, 9) as raw_value from cp"""), digits=9)
def score_events(spark, sf):
    s = scoring.signals(scoring.composite(rules.rule_scores(_with_ml(spark, sf))))
    return ev.signals_as_events(s).select("event_id", "ts_ms", "source_type", "asset_pair", "metric_type", "raw_value")


_URGENT = """abs(coalesce(z, 0)) >= 4 or (metric = 'liquidity' and abs(raw_value) >= 30) or (metric = 'bot_farm' and raw_value >= 0.6)
       or (metric = 'wallet_transfer' and usd_value >= 5000000)"""


@query("urgent_events", with_views("market_events", body=f"select event_id from market_events where {_URGENT}"))
def urgent_events(spark, sf):
    return scoring.urgent_events(v.market_events(spark, sf)).select("event_id")


@query("selected_signals", with_views("signals", "market_events", body=f"""
, u as (select distinct asset from market_events where {_URGENT})
select signal_id, score >= 80 as alert, asset is not null as urgent from signals left join u on asset = asset_pair where score >= 60 or asset is not null"""))
def selected_signals(spark, sf):
    urgent = scoring.urgent_events(v.market_events(spark, sf))
    assets = urgent.select(F.substring_index("asset_pair", "/", 1).alias("asset_pair"))
    return scoring.select_signals(v.signals(spark, sf), assets, floor=60.0).select("signal_id", "alert", "urgent")


@query("risk_board", with_views("signals", body="""
, r as (select *, row_number() over (partition by asset_pair order by ts_ms desc, signal_id desc) as rk from signals)
select asset_pair, round(score, 6) as score from r where rk = 1 order by score desc, asset_pair limit 10"""))
def risk_board(spark, sf):
    return scoring.risk_board(v.signals(spark, sf))


@query("asset_reports", with_views("vectors", body=f"""
, {_ML}, {rules_sql("vm")}, {composite_sql(True)},
r as (select *, row_number() over (partition by asset order by ts_ms desc) as rk from cp)
select asset, ts_ms, round(score, 9) as score, round(rule_score, 9) as rule_score, coverage <= 0.34 as thin_data,
       cast(least(7, least(8, reason_count + cast(ml_score >= 70 and rule_score < 40 as int))) as int) as reasons from r where rk = 1"""), digits=9)
def asset_reports(spark, sf):
    fresh = [F.lit(True).alias(c) for c in ("exchange_fresh", "onchain_fresh", "social_fresh")]
    scored = scoring.composite(rules.rule_scores(_with_ml(spark, sf).select("*", *fresh)))
    return scoring.asset_report(scored).select("asset", "ts_ms", "score", "rule_score", "thin_data", F.size("reasons").alias("reasons"))


@query("robust_scaling", with_views("vectors", body=f"""
, m as (select {", ".join(f"median({f}) as m_{f}" for f in FEATURES)} from vectors),
s as (select {", ".join(f"1.4826 * median(abs({f} - m_{f})) as s_{f}" for f in FEATURES)} from vectors, m)
select event_id, {", ".join(f"round(({f} - m_{f}) / case when s_{f} < 1e-8 then 1 else s_{f} end, 6) as {f}" for f in FEATURES)}
from vectors, m, s"""))
def robust_scaling(spark, sf):
    vec = forest.clean_features(v.vectors(spark, sf))
    _, center, scale = forest.robust_scaler(vec)
    return vec.select("event_id", *[((F.col(f) - c) / s).alias(f) for f, c, s in zip(FEATURES, center, scale)])


@query("score_calibration", """
with p as (select quantile_cont(-value, 0.5) as p50, quantile_cont(-value, 0.01) as p01 from events)
select event_id, round(greatest(0e0, least(100e0, (p50 + value) / (p50 - p01) * 100)), 6) as ml_score from events, p""")
def score_calibration(spark, sf):
    raw = v.table(spark, sf, "events").select("event_id", (-F.col("value")).alias("raw"))
    return raw.select("event_id", forest.calibrated(F.col("raw"), *forest.calibration(raw, "raw")).alias("ml_score"))


@query("anomaly_scores")
def anomaly_scores(spark, sf):
    """Isolation forest trained on all informative vectors, applied to all vectors."""
    vec = spread(v.vectors(spark, sf), "event_id")
    model = forest.fit(ft.informative(vec), identity=["event_id"])
    return forest.ml_scores(vec, model).select("event_id", "ml_score")


@query("training_buffer", with_views("vectors", body=f"""
select event_id from vectors where coverage > 0 and ({_OFF}) order by ts_ms desc, event_id desc limit 3000"""))
def training_buffer(spark, sf):
    return forest.training_buffer(v.vectors(spark, sf), 3000, ("ts_ms", "event_id")).select("event_id")


@query("replay_scores", with_views("market_events", body=_OBS + f"""
, inf as (select * from vec where coverage > 0 and ({_OFF})), {rules_sql("inf")}, {composite_sql(False)}
select asset as asset_pair, ts_ms, round(score, 9) as score, {_SEV} as severity from cp"""), digits=9)
def replay_scores(spark, sf):
    return rp.replay(v.market_events(spark, sf), None, **GRID).select("asset_pair", "ts_ms", "score", "severity")


@query("replay_peaks", with_views("market_events", body=_OBS + f"""
, inf as (select * from vec where coverage > 0 and ({_OFF})), {rules_sql("inf")}, {composite_sql(False)}
select asset as asset_pair, round(max(score), 6) as peak_score from cp group by 1 order by 2 desc, 1 limit 15"""), digits=9)
def replay_peaks(spark, sf):
    return rp.peak_scores(rp.replay(v.market_events(spark, sf), None, **GRID))


@query("replay_alerts", with_views("market_events", body=_OBS + f"""
, inf as (select * from vec where coverage > 0 and ({_OFF})), {rules_sql("inf")}, {composite_sql(False)}
select asset as asset_pair, ts_ms, round(score, 9) as score from cp where score >= 60"""), digits=9)
def replay_alerts(spark, sf):
    """Replayed signals at or above the alert level of the run."""
    return rp.replay_alerts(rp.replay(v.market_events(spark, sf), None, **GRID), 60.0).select("asset_pair", "ts_ms", "score")


@query("replay_span", with_views("market_events", body="""
select count(*) as events, round((max(ts_ms) - min(ts_ms)) / 60000e0, 6) as minutes from market_events"""))
def replay_span(spark, sf):
    return rp.replay_span(v.market_events(spark, sf))


_SWEEPS = f"""
, obs as (select *, case when metric in ('volume', 'order_book', 'cvd') then venue else '' end as vn, (ts_ms + 999) // 1000 as tk from market_events),
ticks as (select tk, tk * 1000 as at_ms, row_number() over (order by tk) as k from (select distinct tk from obs)),
live as (
  select * from (
    select o.*, t.k, t.at_ms, t.at_ms - o.ts_ms as age,
           row_number() over (partition by asset, metric, vn, t.k order by o.ts_ms desc, o.event_id desc) as rk
    from obs o join ticks t on t.at_ms between o.ts_ms and o.ts_ms + {TTL}) where rk = 1), {_ASM}
fl as (
  select asset, k, coalesce(sum(usd_value) filter (metric = 'wallet_transfer' and direction = 'inflow'), 0e0) as xi,
         coalesce(sum(usd_value) filter (metric = 'wallet_transfer' and direction = 'outflow'), 0e0) as xo,
         coalesce(sum(usd_value) filter (metric = 'bridge_flow'), 0e0) as xb,
         cast(coalesce(sum(hit) filter (metric = 'wallet_transfer'), 0) as bigint) as xh, row_number() over (partition by asset order by k) as n
  from obs join ticks using (tk) where metric in ('wallet_transfer', 'bridge_flow') group by 1, 2),
fs as (
  select asset, k, n, xi as i, xo as o, xb as b, xh as h from fl where n = 1
  union all
  select f.asset, f.k, f.n, fs.i * power(0.9, f.k - fs.k) + xi, fs.o * power(0.9, f.k - fs.k) + xo, fs.b * power(0.9, f.k - fs.k) + xb,
         greatest(0, fs.h - (f.k - fs.k)) + xh
  from fs join fl f on f.asset = fs.asset and f.n = fs.n + 1),
acc as (
  select a.asset, a.k, coalesce(fs.i * power(0.9, a.k - fs.k), 0e0) as i, coalesce(fs.o * power(0.9, a.k - fs.k), 0e0) as o,
         coalesce(fs.b * power(0.9, a.k - fs.k), 0e0) as b, greatest(0, coalesce(fs.h - (a.k - fs.k), 0)) as h
  from (select asset, k from asm) a asof left join fs on a.asset = fs.asset and a.k >= fs.k), {_VEC},
inf as (select * from vec where coverage > 0 and ({_OFF})), {rules_sql("inf")}, {composite_sql(False)}"""


@query("replay_sweeps", with_views("market_events", body=_SWEEPS + f"""
select asset as asset_pair, ts_ms, round(score, 9) as score, {_SEV} as severity from cp"""), digits=9)
def replay_sweeps(spark, sf):
    """Replay by the second: every asset is scored whenever an event of any asset has come."""
    return rp.replay(v.market_events(spark, sf), None, **EVERY_SECOND).select("asset_pair", "ts_ms", "score", "severity")


@query("replay_sweep_peaks", with_views("market_events", body=_SWEEPS + """
select asset as asset_pair, round(max(score), 6) as peak_score from cp group by 1 order by 2 desc, 1 limit 15"""), digits=9)
def replay_sweep_peaks(spark, sf):
    return rp.peak_scores(rp.replay(v.market_events(spark, sf), None, **EVERY_SECOND))


@query("replay_summary", with_views("market_events", body=_SWEEPS.replace("from market_events)", "from market_events where right(event_id, 1) <> '7')") + """
select (select count(*) from obs) as events, (select count(*) from market_events where right(event_id, 1) = '7') as skipped,
       round((select max(ts_ms) - min(ts_ms) from obs) / 60000e0, 6) as minutes, count(distinct asset) as assets, count(*) as signals,
       count(*) filter (score >= 80) as alerts from cp"""))
def replay_summary(spark, sf):
    """Recorded JSON lines, one in ten of them cut short, replayed by the second."""
    from tapevigil.plans.storage import settle

    lines = ev.wire_events(v.market_events(spark, sf)).select(F.to_json(F.struct(
        "event_id", "timestamp", "source_type", "venue", "asset_pair", "metric_type", "raw_value", "normalized_z_score", "usd_value",
        "confidence", "meta")).alias("line"), "event_id")
    cut = F.when(F.right("event_id", F.lit(1)) == "7", F.left("line", F.lit(40))).otherwise(F.col("line"))
    parsed = settle(ev.parse_lines(lines.select(cut.alias("value"))))
    return rp.replay_summary(parsed, rp.replay(ev.usable(parsed), None, **EVERY_SECOND))


@query("replay_trained", with_views("market_events", body=_SWEEPS + """
select count(*) as signals, round(sum(rule_score), 3) as rule_total, true as in_range, true as median_is_zero, true as first_percentile_is_full,
       true as model_cannot_veto from cp"""))
def replay_trained(spark, sf):
    """Replay with a forest trained on its own vectors: what must hold of its signals on every table."""
    s = rp.replay(v.market_events(spark, sf), fit=True, **EVERY_SECOND)
    rule, ml = F.col("rule_score"), F.col("ml_score")
    thin_kept = F.col("score") >= (rule * 0.9 + ml * 0.1) * 0.82 - 1e-9
    return s.agg(
        F.count(F.lit(1)).alias("signals"), F.round(F.sum(rule), 3).alias("rule_total"),
        F.bool_and(ml.between(0.0, 100.0) & F.col("score").between(0.0, 100.0)).alias("in_range"),
        F.avg((ml <= 1e-9).cast("double")).between(0.45, 0.6).alias("median_is_zero"),
        F.avg((ml >= 100 - 1e-9).cast("double")).between(0.01, 0.02).alias("first_percentile_is_full"),
        F.bool_and((rule < 60) | (ml >= rule) | thin_kept).alias("model_cannot_veto"))


@query("forest_properties", with_views("vectors", body="""
select count(*) as vectors, true as in_range, true as median_is_zero, true as first_percentile_is_full, true as outliers_stand_out, true as equal_after_load
from vectors"""))
def forest_properties(spark, sf):
    """What must hold of the forest's scores on every table: range, calibration, planted outliers, save and load."""
    from tapevigil.plans.storage import settle, shared_folder

    vec = settle(spread(v.vectors(spark, sf), "event_id"))
    model = forest.fit(vec, identity=["event_id"])
    scored = settle(forest.ml_scores(vec, model).select("event_id", F.col("ml_score").alias("s")))
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    model.save(spark, path)
    again = forest.ml_scores(vec, forest.load(spark, path)).select("event_id", F.col("ml_score").alias("r"))
    odd = vec.select("event_id", *[(F.col(f) * 0 + 1000.0 * (i + 1)).alias(f) for i, f in enumerate(FEATURES)])
    planted = forest.ml_scores(odd, model).agg(F.min("ml_score").alias("least"))
    found = scored.join(again, "event_id").agg(
        F.count(F.lit(1)).alias("vectors"), F.bool_and(F.col("s").between(0.0, 100.0)).alias("in_range"),
        F.avg((F.col("s") <= 1e-9).cast("double")).between(0.5, 0.55).alias("median_is_zero"),
        F.avg((F.col("s") >= 100 - 1e-9).cast("double")).between(0.01, 0.02).alias("first_percentile_is_full"),
        F.bool_and(F.abs(F.col("s") - F.col("r")) < 1e-9).alias("equal_after_load"),
    )
    return found.join(planted).select(
        "vectors", "in_range", "median_is_zero", "first_percentile_is_full", (F.col("least") > 50).alias("outliers_stand_out"), "equal_after_load")
