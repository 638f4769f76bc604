"""Streaming operators run over the test views, with batch SQL as their twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapevigil.plans import views as v
from tapevigil.plans.alert_queries import _ROUTE
from tapevigil.plans.feature_queries import _ASM, _OFF, _SEV, _URGENT, _VEC, GRID, TTL, composite_sql, rules_sql
from tapevigil.plans.registry import query
from tapevigil.plans.storage import shared_folder
from tapevigil.plans.streams import drained, feed, feed_in_turn
from tapevigil.plans.views import DAY, HOUR, with_views
from tapevigil.streaming import scoring, state, windows

MINUTE = 60_000
MIDDLE = 1_705_276_800_000  # 2024-01-15 00:00 UTC, inside the data
TURN = 3 * DAY

#: Trades by forty accounts of each venue, so that some fall silent for days.
_ACCOUNTS = "select * replace (concat(venue, '-', trade_id % 40) as venue) from trades"


@query("stream_volume_buckets", with_views("trades", body=f"""
select venue, symbol, ts_ms // {HOUR} * {HOUR} as bucket_ms, round(sum(size), 6) as volume, round(sum(size * price), 6) as notional, count(*) as trades
from trades group by 1, 2, 3 having bucket_ms + {HOUR} <= (select max(ts_ms) from trades) - {MINUTE}"""))
def stream_volume_buckets(spark, sf):
    """Tumbling windows that the watermark has passed."""
    return drained(spark, windows.volume_buckets(feed(v.trades(spark, sf)), "1 hour", "1 minute"))


@query("stream_mentions", with_views("texts", body=f"""
, t as (select texts.ticker, texts.ts_ms, (user_id % 21 - 10) / 11e0 as s from texts join events on event_id = post_id),
w as (select *, unnest(range(1, 7)) * {HOUR} + ts_ms // {HOUR} * {HOUR} as tick_ms from t)
select ticker, tick_ms, count(*) as posts_in_window, round(avg(s), 6) as sentiment,
       round(case when count(*) < 2 or max(ts_ms) - min(ts_ms) <= 0 then count(*)::double else count(*) * 60000e0 / (max(ts_ms) - min(ts_ms)) end, 6) as rate
from w group by 1, 2 having tick_ms <= (select max(ts_ms) from t) - {MINUTE}"""))
def stream_mentions(spark, sf):
    """Sliding windows of six hours, every hour."""
    e = v.table(spark, sf, "events").select("event_id", ((F.col("user_id") % 21 - 10) / 11.0).alias("sentiment"))
    posts = v.texts(spark, sf).join(e, F.col("event_id") == F.col("post_id")).select("ticker", "ts_ms", "sentiment")
    return drained(spark, windows.sliding_mentions(feed(posts), "6 hours", "1 hour", "1 minute"))


@query("stream_first_seen", with_views("trades", body="select distinct venue, symbol from trades"))
def stream_first_seen(spark, sf):
    """Keys of a stream, once each within the watermark delay."""
    rows = v.trades(spark, sf).select("venue", "symbol", "ts_ms")
    return drained(spark, windows.first_seen(feed(rows), ["venue", "symbol"], "3650 days")).select("venue", "symbol")


@query("stream_routed_alerts", with_views("signals", body=_ROUTE + """
select signal_id, sent, reason_code, alert_count from routed where reason_code <> 'below'"""))
def stream_routed_alerts(spark, sf):
    """Cooldown and escalation from keyed state."""
    state.enable_state_store(spark)
    routed = state.route_alerts(feed(v.signals(spark, sf)), min_score=60.0, cooldown_ms=DAY)
    return drained(spark, routed).select("signal_id", "sent", "reason_code", "alert_count")


@query("stream_closed_buckets", with_views("trades", body=f"""
, b as (select venue, symbol, ts_ms // {HOUR} * {HOUR} as bucket_ms, sum(size) as volume, count(*) as trades from trades group by 1, 2, 3)
select venue, symbol, bucket_ms, round(volume, 6) as volume, trades from b
qualify bucket_ms < max(bucket_ms) over (partition by venue, symbol)"""))
def stream_closed_buckets(spark, sf):
    """Buckets that a later trade of their pair closes."""
    state.enable_state_store(spark)
    closed = drained(spark, state.flushed_buckets(feed(v.trades(spark, sf)), HOUR, DAY, HOUR))
    return closed.where("closed_by = 'trade'").select("venue", "symbol", "bucket_ms", "volume", "trades")


@query("stream_late_rows", with_views("trades", body=f"""
, t as (select *, trade_id % 50 = 0 as late from trades),
wm as (select max(ts_ms) filter (not late and ts_ms < {MIDDLE}) - {MINUTE} as passed, max(ts_ms) - {MINUTE} as finally from t)
select venue, symbol, ts_ms // {HOUR} * {HOUR} as bucket_ms, round(sum(size), 6) as volume, count(*) as trades, count(*) filter (late) as late_trades
from t, wm where not late or ts_ms // {HOUR} * {HOUR} + {HOUR} > passed
group by venue, symbol, bucket_ms, finally having bucket_ms + {HOUR} <= finally"""))
def stream_late_rows(spark, sf):
    """Windows of a feed in which one trade of fifty comes after all others: those of closed windows are dropped.

    A batch drops what the batch before it had closed, which knew the first turn's times.
    """
    trades = v.trades(spark, sf).withColumn("late", F.col("trade_id") % 50 == 0)
    turn = F.when(F.col("late"), 2).when(F.col("ts_ms") < MIDDLE, 0).otherwise(1)
    timed = windows.with_event_time(feed_in_turn(trades, turn), "1 minute")
    counted = timed.groupBy(F.window("ts", "1 hour").alias("w"), "venue", "symbol").agg(
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"), F.count_if("late").alias("late_trades"))
    return drained(spark, counted.select("venue", "symbol", F.unix_millis("w.start").alias("bucket_ms"), "volume", "trades", "late_trades"))


@query("stream_silent_buckets", with_views("trades", body=f"""
, t as ({_ACCOUNTS}),
b as (select venue, symbol, ts_ms // {HOUR} * {HOUR} as bucket_ms, sum(size) as volume, count(*) as trades from t group by 1, 2, 3),
n as (select *, bucket_ms // {TURN} as turn, lead(bucket_ms) over (partition by venue, symbol order by bucket_ms) // {TURN} as next_turn from b),
m as (select ts_ms // {TURN} as w, max(max(ts_ms)) over (order by ts_ms // {TURN}) as upto from t group by 1),
l as (select w, lag(upto) over (order by w) as before, lead(w) over (order by w) as following from m),
s as (select n.*, case when next_turn is null then (select max(upto) from m) when l.w > turn then l.before end as seen
      from n left join l on l.following = n.next_turn)
select venue, symbol, bucket_ms, round(volume, 6) as volume, trades from s where bucket_ms + {3 * HOUR} <= seen - 1000"""))
def stream_silent_buckets(spark, sf):
    """Buckets that silence closes, by timers over a feed of one micro-batch every three days."""
    state.enable_state_store(spark)
    trades = v.trades(spark, sf).withColumn("venue", F.concat("venue", F.lit("-"), (F.col("trade_id") % 40).cast("string")))
    turns = feed_in_turn(trades, F.floor(F.col("ts_ms") / TURN))
    closed = drained(spark, state.flushed_buckets(turns, HOUR, DAY, 2 * HOUR))
    return closed.where("closed_by = 'timer'").select("venue", "symbol", "bucket_ms", "volume", "trades")


@query("stream_bridge_matches", with_views("trades", body=f"""
, d as (select trade_id, ts_ms, size * 1000 as usd_value from trades),
f as (select ts_ms as flow_ms, size * 1000 as flow_usd, venue as bridge from trades where trade_id % 3 = 0 and size > 0),
m as (select trade_id, ts_ms, flow_ms, flow_usd, bridge, round(least(usd_value, flow_usd) / greatest(usd_value, flow_usd), 3) as size_ratio,
             row_number() over (partition by trade_id order by flow_ms desc, flow_usd desc, bridge desc) as rk
      from d join f on flow_ms between ts_ms - {6 * HOUR} and ts_ms and least(usd_value, flow_usd) / greatest(usd_value, flow_usd) >= 0.75
      where usd_value > 0)
select trade_id, ts_ms, flow_ms, round(flow_usd, 6) as flow_usd, bridge, size_ratio from m
where rk = 1 and ts_ms < (select max(ts_ms) from trades) - {DAY}"""))
def stream_bridge_matches(spark, sf):
    """The newest flow of each deposit; deposits of the last day are still open."""
    t = v.trades(spark, sf)
    deposits = t.select("trade_id", "ts_ms", (F.col("size") * 1000).alias("usd_value"), F.lit("inflow").alias("direction"))
    flows = t.where("trade_id % 3 = 0").select("ts_ms", (F.col("size") * 1000).alias("usd_value"), F.col("venue").alias("bridge"))
    state.enable_state_store(spark)
    found = drained(spark, state.latest_bridge(feed(deposits), feed(flows), "trade_id", 6 * 3600))
    last = t.agg(F.max("ts_ms").alias("last"))
    return found.join(last, F.col("ts_ms") < F.col("last") - DAY).select("trade_id", "ts_ms", "flow_ms", "flow_usd", "bridge", "size_ratio")


SWEEP = 4 * HOUR  # of a six-hour TTL, so that a silent asset is put out once more
SILENT = "VIEW"  # has no events after MIDDLE
SETTLED = 10_000  # the watermark's delay

_STREAM_SIGNALS = f"""
, e as (select * from market_events where asset <> '{SILENT}' or ts_ms < {MIDDLE}),
obs as (select *, case when metric in ('volume', 'order_book', 'cvd') then venue else '' end as vn, (ts_ms + {HOUR - 1}) // {HOUR} as tk,
               coalesce(sum(hit) filter (metric = 'wallet_transfer') over (
                 partition by asset order by ts_ms, event_id rows between unbounded preceding and 1 preceding), 0) as hits_before from e),
turns as (select asset, max(ts_ms) as at_ms, bool_or({_URGENT}) as urgent from obs group by asset, ts_ms // {TURN}),
moments as (
  select * from turns union all
  select asset, max(at_ms) + {SWEEP}, false from turns group by 1 having max(at_ms) + {SWEEP} <= (select max(ts_ms) from e) - {SETTLED}),
live as (
  select * from (
    select o.*, m.at_ms as k, m.at_ms, m.at_ms - o.ts_ms as age,
           row_number() over (partition by o.asset, metric, vn, m.at_ms order by o.ts_ms desc, o.event_id desc) as rk
    from obs o join moments m on m.asset = o.asset and o.ts_ms between m.at_ms - {TTL} and m.at_ms) where rk = 1), {_ASM}
past as (select o.*, m.at_ms, (m.at_ms + {HOUR - 1}) // {HOUR} as now, usd_value * power(0.9, (m.at_ms + {HOUR - 1}) // {HOUR} - tk) as x
         from obs o join moments m on m.asset = o.asset and o.ts_ms <= m.at_ms),
acc as (
  select asset, at_ms as k, coalesce(sum(x) filter (metric = 'wallet_transfer' and direction = 'inflow'), 0e0) as i,
         coalesce(sum(x) filter (metric = 'wallet_transfer' and direction = 'outflow'), 0e0) as o,
         coalesce(sum(x) filter (metric = 'bridge_flow'), 0e0) as b,
         greatest(0, coalesce(sum(hit) filter (metric = 'wallet_transfer') - max(now) - min(hits_before - tk) filter (metric = 'wallet_transfer'), 0)) as h
  from past group by 1, 2), {_VEC},
inf as (select * from vec where coverage > 0 and ({_OFF})), {rules_sql("inf")}, {composite_sql(False)},
sg as (select cp.*, m.urgent from cp join moments m on m.asset = cp.asset and m.at_ms = cp.ts_ms where score >= 30 or m.urgent)
select asset as asset_pair, ts_ms, round(score, 9) as score, {_SEV} as severity from sg"""


@query("stream_signals", with_views("market_events", body=_STREAM_SIGNALS), digits=9)
def stream_signals(spark, sf):
    """Signals that a feed of one micro-batch every three days publishes, with a silent asset's sweep by a timer."""
    state.enable_state_store(spark)
    events = v.market_events(spark, sf).where((F.col("asset_pair") != f"{SILENT}/USDT") | (F.col("ts_ms") < MIDDLE))
    place = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    stream = scoring.score_stream(
        feed_in_turn(events, F.floor(F.col("ts_ms") / TURN)), f"{place}/signals", f"{place}/state", floor=30.0,
        **{k: GRID[k] for k in ("ttl_ms", "tick_ms", "factor", "half_life_s", "concurrent_ms")}, sweep_ms=SWEEP)
    stream.awaitTermination()
    return scoring.published(spark, f"{place}/signals").select("asset_pair", "ts_ms", "score", "severity")
