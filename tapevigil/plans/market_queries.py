"""Order books, trade flow and universe scans over the test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapevigil.functions.scalars import base_asset
from tapevigil.operators import discovery as d
from tapevigil.operators import orderbook as ob
from tapevigil.operators import scoring
from tapevigil.operators import trades as tr
from tapevigil.plans import views as v
from tapevigil.plans.registry import query
from tapevigil.plans.series_queries import _dynamic_sql, _FRAME
from tapevigil.plans.storage import settle
from tapevigil.plans.views import DAY, HOUR, with_views
from tapevigil.sources import market

PAIR = ["venue", "symbol"]
SNAP = ["venue", "symbol", "ts_ms", "snapshot_id"]
YEAR_BLOCK = 90 * DAY

# Books as ranked level rows, then one row of metrics per snapshot.
_BOOK = """
, lv as (
  select *, row_number() over (partition by snapshot_id, venue, symbol, ts_ms, side
            order by case when side = 'bid' then -price else price end) as rk
  from book_levels where size > 0),
best as (
  select venue, symbol, ts_ms, snapshot_id,
         coalesce(max(price) filter (side = 'bid'), 0e0) as best_bid,
         coalesce(min(price) filter (side = 'ask'), 0e0) as best_ask,
         count(*) filter (side = 'bid') as nb, count(*) filter (side = 'ask') as na,
         coalesce(sum(price * size) filter (side = 'bid' and rk <= 20), 0e0) as bid_depth,
         coalesce(sum(price * size) filter (side = 'ask' and rk <= 20), 0e0) as ask_depth
  from lv group by 1, 2, 3, 4),
mids as (
  select *, case when nb > 0 and na > 0 then (best_bid + best_ask) / 2 when best_bid <> 0 then best_bid
            else best_ask end as mid_price from best),
wts as (
  select snapshot_id, venue, symbol, ts_ms,
         coalesce(sum(price * size * exp(-abs(price - mid_price) / mid_price * 10000 / 25)) filter (side = 'bid' and rk <= 20), 0e0) as wb,
         coalesce(sum(price * size * exp(-abs(price - mid_price) / mid_price * 10000 / 25)) filter (side = 'ask' and rk <= 20), 0e0) as wa
  from lv join mids using (snapshot_id, venue, symbol, ts_ms) group by 1, 2, 3, 4),
met as (
  select *, (wb - wa) / (wb + wa) as weighted_obi, (bid_depth - ask_depth) / (bid_depth + ask_depth) as obi,
         case when nb > 0 and na > 0 then (best_ask - best_bid) / mid_price * 10000 else 0e0 end as spread_bps,
         least(20, greatest(nb, na)) as levels
  from mids join wts using (snapshot_id, venue, symbol, ts_ms))"""


def _metrics(spark, sf):
    return ob.book_metrics(v.books(spark, sf))


@query("normalized_trades", with_views("trades", body="""
select trade_id, price, size, case when size > 20 then side when size > 10 then 'buy' else 'sell' end as side
from trades where size > 2 and price > 110"""))
def normalized_trades(spark, sf):
    raw = v.trades(spark, sf).select(
        "trade_id", (F.col("price")).alias("price"), F.col("size"),
        F.when(F.col("size") > 20, F.col("side")).when(F.col("size") > 10, None).otherwise("SELL").alias("side"))
    shifted = raw.withColumn("price", F.col("price") - 110).withColumn("size", F.col("size") - 2)
    return market.normalise_trades(shifted).select(
        "trade_id", (F.col("price") + 110).alias("price"), (F.col("size") + 2).alias("size"), "side")


@query("normalized_books", with_views("book_levels", body="""
select snapshot_id, side, cast(rk as int) as place, round(price, 6) as price, size from (
  select *, row_number() over (partition by snapshot_id, venue, symbol, ts_ms, side
            order by case when side = 'bid' then -price else price end) as rk
  from book_levels where size > 25) where rk <= 3"""))
def normalized_books(spark, sf):
    levels = v.book_levels(spark, sf).withColumn("size", F.col("size") - 25)
    books = ob.normalise_books(ob.books_from_levels(levels), depth=3)
    sides = [
        books.select("snapshot_id", F.lit(side).alias("side"), F.posexplode(col).alias("i", "l"))
        for side, col in (("bid", "bids"), ("ask", "asks"))
    ]
    return sides[0].unionByName(sides[1]).select(
        "snapshot_id", "side", (F.col("i") + 1).alias("place"), F.col("l.price").alias("price"),
        (F.col("l.size") + 25).alias("size"))


@query("venue_messages", with_views("trades", body="""
select trade_id, ts_ms, price, size, side from trades"""))
def venue_messages(spark, sf):
    """Trades written as raw messages of three venue dialects, then parsed back."""
    t = v.trades(spark, sf)
    p, q = F.col("price").cast("string"), F.col("size").cast("string")
    sell = F.col("side") == "sell"
    binance = F.to_json(F.struct(
        F.lit("s@aggTrade").alias("stream"),
        F.struct(F.lit("aggTrade").alias("e"), F.col("ts_ms").alias("T"), p.alias("p"), q.alias("q"), sell.alias("m")).alias("data")))
    bybit = F.to_json(F.struct(
        F.lit("publicTrade.X").alias("topic"), F.col("ts_ms").alias("ts"),
        F.array(F.struct(F.col("ts_ms").alias("T"), p.alias("p"), q.alias("v"), F.initcap("side").alias("S"))).alias("data")))
    mexc = F.to_json(F.struct(
        F.lit("spot@public.deals").alias("c"),
        F.struct(F.array(F.struct(F.col("ts_ms").alias("t"), p.alias("p"), q.alias("v"),
                                  F.when(sell, "2").otherwise("1").alias("S"))).alias("deals")).alias("d")))
    raw = t.select(
        F.element_at(F.array(F.lit("binance"), F.lit("bybit"), F.lit("mexc")), F.substring("venue", 2, 1).cast("int") + 1).alias("venue"),
        F.col("trade_id").cast("string").alias("symbol"),
        F.when(F.col("venue") == "v0", binance).when(F.col("venue") == "v1", bybit).otherwise(mexc).alias("raw"),
        F.lit(0).cast("bigint").alias("recv_ms"))
    return market.trades_from_messages(raw).select(
        F.col("symbol").cast("bigint").alias("trade_id"), "ts_ms", "price", "size", "side")


@query("book_messages", with_views("trades", body="""
select trade_id, ts_ms, round(price, 6) as best_bid, round(price + 1, 6) as best_ask, 2 as bids, 1 as asks, round(size * 2, 6) as second_size from trades"""))
def book_messages(spark, sf):
    """Books written as raw messages of three venue dialects, then parsed back."""
    t = v.trades(spark, sf)
    text = lambda c: c.cast("string")
    bids = [(F.col("price"), F.col("size")), (F.col("price") - 1, F.col("size") * 2)]
    asks = [(F.col("price") + 1, F.col("size"))]
    pairs = lambda side: F.array(*[F.array(text(p), text(q)) for p, q in side])
    rows = lambda side: F.array(*[F.struct(text(p).alias("p"), text(q).alias("v")) for p, q in side])
    binance = F.to_json(F.struct(F.lit("s@depth20").alias("stream"), F.struct(
        F.col("ts_ms").alias("E"), pairs(bids).alias("bids"), pairs(asks).alias("asks")).alias("data")))
    bybit = F.to_json(F.struct(F.lit("orderbook.50.X").alias("topic"), F.col("ts_ms").alias("ts"), F.struct(
        pairs(bids).alias("b"), pairs(asks).alias("a")).alias("data")))
    mexc = F.to_json(F.struct(F.lit("spot@public.limit.depth").alias("c"), F.col("ts_ms").alias("t"), F.struct(
        rows(bids).alias("bids"), rows(asks).alias("asks")).alias("d")))
    raw = t.select(
        F.element_at(F.array(F.lit("binance"), F.lit("bybit"), F.lit("mexc")), F.substring("venue", 2, 1).cast("int") + 1).alias("venue"),
        F.col("trade_id").cast("string").alias("symbol"),
        F.when(F.col("venue") == "v0", binance).when(F.col("venue") == "v1", bybit).otherwise(mexc).alias("raw"),
        F.lit(0).cast("bigint").alias("recv_ms"))
    b = market.books_from_messages(raw)
    return b.select(
        F.col("symbol").cast("bigint").alias("trade_id"), "ts_ms", F.col("bids")[0]["price"].alias("best_bid"), F.col("asks")[0]["price"].alias("best_ask"),
        F.size("bids").alias("bids"), F.size("asks").alias("asks"), F.col("bids")[1]["size"].alias("second_size"))


@query("book_metrics", with_views("book_levels", body=_BOOK + """
select snapshot_id, best_bid, best_ask, round(mid_price, 6) as mid_price, round(spread_bps, 6) as spread_bps,
       round(bid_depth, 6) as bid_depth, round(ask_depth, 6) as ask_depth, round(obi, 6) as obi,
       round(weighted_obi, 6) as weighted_obi, cast(levels as int) as levels,
       case when obi > 0.05 then 'bid_heavy' when obi < -0.05 then 'ask_heavy' else 'balanced' end as direction
from met"""))
def book_metrics(spark, sf):
    return _metrics(spark, sf).select(
        "snapshot_id", "best_bid", "best_ask", "mid_price", "spread_bps", "bid_depth", "ask_depth", "obi",
        "weighted_obi", "levels", "direction")


@query("book_percentiles", with_views("book_levels", body=_BOOK + """
, h as (select snapshot_id, round(obi, 9) as obi, array_agg(round(obi, 9)) over (partition by venue, symbol
        order by ts_ms, snapshot_id rows between 599 preceding and current row) as l from met)
select snapshot_id, round(case when len(l) < 30 then 0.5e0
       else len(list_filter(l, lambda x: x <= obi)) / len(l) end, 6) as obi_percentile from h"""))
def book_percentiles(spark, sf):
    # Numbering the books and ranking them are two passes.
    m = settle(_metrics(spark, sf).select(*SNAP, F.round("obi", 9).alias("obi")))
    return ob.obi_percentile(m, block_ms=YEAR_BLOCK).select("snapshot_id", "obi_percentile")


@query("book_scores", with_views("book_levels", body=_BOOK + f"""
, src as (select venue, symbol, ts_ms, snapshot_id, obi from met),
{_dynamic_sql("src", "venue, symbol", "ts_ms, snapshot_id", "ts_ms", "obi", 1e7, 300, 20, 3.0, False)}
select snapshot_id, round(z, 6) as obi_z, round(threshold, 6) as level,
       abs(obi) >= 0.35 or coalesce(abs(z) >= threshold, false) as anomalous from dyn"""))
def book_scores(spark, sf):
    scored = ob.obi_scores(_metrics(spark, sf), block_ms=YEAR_BLOCK, half_life_s=1e7)
    return scored.select("snapshot_id", "obi_z", F.col("obi_z_threshold").alias("level"), "anomalous")


_WALL_JOIN = """
, seq as (select *, lag(snapshot_id) over (partition by venue, symbol order by ts_ms, snapshot_id) as prev_id from met),
pair as (
  select s.snapshot_id, s.best_bid, s.best_ask, s.bid_depth, p.side, p.price, p.size as was,
         coalesce(n.size, 0e0) as now_size
  from seq s join lv p on p.snapshot_id = s.prev_id and p.rk <= 20
       left join lv n on n.snapshot_id = s.snapshot_id and n.side = p.side and n.price = p.price and n.rk <= 20),
walls as (
  select snapshot_id, case when side = 'bid' then 'buy' else 'sell' end as side, price,
         was - now_size as size_removed, price * (was - now_size) as notional,
         case when (side = 'bid' and price >= best_bid) or (side = 'ask' and price <= best_ask)
              then (was - now_size) / was else -(was - now_size) / was end as absorbed_pct
  from pair where price * was >= greatest(2000e0, bid_depth * 0.05) and was > now_size
       and (was - now_size) / was >= 0.5)"""


def _walls(spark, sf):
    return ob.wall_changes(_metrics(spark, sf), floor=2_000.0, block_ms=YEAR_BLOCK)


@query("book_walls", with_views("book_levels", body=_BOOK + _WALL_JOIN + """
select snapshot_id, side, price, size_removed, round(notional, 6) as notional,
       round(absorbed_pct, 6) as absorbed_pct from walls"""))
def book_walls(spark, sf):
    return ob.wall_events(_walls(spark, sf)).drop("venue", "symbol", "ts_ms")


# Publishing decision row by row: forced rows always, others an interval after the last.
def _gate_sql(source: str, interval: int) -> str:
    return f"""
gnum as (select *, row_number() over (partition by venue, symbol order by ts_ms, snapshot_id) as rn from {source}),
gate as (
  select venue, symbol, snapshot_id, rn, ts_ms as last, true as sent from gnum where rn = 1
  union all
  select n.venue, n.symbol, n.snapshot_id, n.rn, case when ok then n.ts_ms else g.last end, ok
  from gate g join gnum n on n.venue = g.venue and n.symbol = g.symbol and n.rn = g.rn + 1,
       lateral (select n.anomalous or n.ts_ms - g.last >= {interval} as ok) l)"""


@query("book_emissions", with_views("book_levels", body=_BOOK + f"""
, fl as (select *, abs(obi) >= 0.9 as anomalous from met),
{_gate_sql("fl", 7 * DAY)}
select snapshot_id from gate where sent"""))
def book_emissions(spark, sf):
    flagged = _metrics(spark, sf).select(*SNAP, (F.abs("obi") >= 0.9).alias("anomalous"))
    return ob.emission_gate(flagged, 7 * DAY).select("snapshot_id")


@query("order_book_events", with_views("book_levels", body=_BOOK + _WALL_JOIN.replace("2000e0", "50000e0") + f"""
, src as (select venue, symbol, ts_ms, snapshot_id, obi from met),
{_dynamic_sql("src", "venue, symbol", "ts_ms, snapshot_id", "ts_ms", "obi", 1e7, 300, 20, 3.0, False)},
fl as (select dyn.*, abs(dyn.obi) >= 0.35 or coalesce(abs(z) >= threshold, false) as anomalous from dyn),
{_gate_sql("fl", 7 * DAY)},
w as (select snapshot_id, count(*) filter (absorbed_pct < 0) as spoofed, count(*) filter (absorbed_pct > 0) as absorbed,
             sum(notional) as wn from walls group by 1)
select concat('ob-', m.venue, '-', m.symbol, '-', m.snapshot_id) as event_id, m.ts_ms, m.venue,
       m.symbol as asset_pair, round(m.obi, 6) as raw_value, round(fl.z, 6) as normalized_z_score,
       round(bid_depth + ask_depth, 6) as usd_value, round(round(spread_bps, 3), 6) as spread_bps,
       cast(coalesce(spoofed, 0) as int) as spoofed_walls, cast(coalesce(absorbed, 0) as int) as absorbed_walls,
       round(coalesce(wn, 0e0), 2) as wall_notional, fl.anomalous
from gate join met m using (snapshot_id) join fl using (snapshot_id) left join w using (snapshot_id)
where sent"""))
def order_book_events(spark, sf):
    e = ob.order_book_events(v.books(spark, sf), interval_ms=7 * DAY, block_ms=YEAR_BLOCK, half_life_s=1e7)
    return e.select(
        "event_id", "ts_ms", "venue", "asset_pair", "raw_value", "normalized_z_score", "usd_value",
        "meta.spread_bps", "meta.spoofed_walls", "meta.absorbed_walls", "meta.wall_notional", "meta.anomalous")


# --- trade flow ---------------------------------------------------------------

_BUCKET = f"""
, bk as (
  select venue, symbol, ts_ms // {HOUR} * {HOUR} as bucket_ms, sum(size) as volume, sum(size * price) as notional,
         count(*) as trades, arg_min(size, ts_ms::hugeint * 10000000 + trade_id) as first_size,
         arg_min(price, ts_ms::hugeint * 10000000 + trade_id) as first_price,
         min(ts_ms::hugeint * 10000000 + trade_id) as first_key
  from trades group by 1, 2, 3),
nx as (
  select *, lead(bucket_ms) over w as next_ms, lead(first_size) over w as next_size,
         lead(first_price) over w as next_price, lead(first_key) over w as next_key
  from bk window w as (partition by venue, symbol order by bucket_ms)),
dense as (
  select venue, symbol, bucket_ms as owner_ms, unnest(range(bucket_ms, case when next_ms is null then bucket_ms + 1
           else least(next_ms - {HOUR}, bucket_ms + {DAY}) + 1 end, {HOUR})) as bucket_ms from nx),
gf as (
  select dense.*, dense.bucket_ms <> owner_ms as filled, coalesce(volume, 0e0) as volume
  from dense left join bk on bk.venue = dense.venue and bk.symbol = dense.symbol and bk.bucket_ms = dense.bucket_ms),
prof as (
  select *, sum(volume) over w as window_volume, avg(volume) over w as mean_bucket,
         coalesce(stddev_samp(volume) over w, 0e0) as std_bucket, count(*) over w as window_buckets
  from gf window w as (partition by venue, symbol order by bucket_ms range between {DAY} preceding and current row))"""


def _profile(spark, sf):
    return tr.volume_profile(v.trades(spark, sf), HOUR, DAY)


@query("volume_buckets", with_views("trades", body=_BUCKET + """
select venue, symbol, bucket_ms, round(volume, 6) as volume, round(notional, 6) as notional, trades from bk"""))
def volume_buckets(spark, sf):
    return tr.volume_buckets(v.trades(spark, sf), HOUR).select(*PAIR, "bucket_ms", "volume", "notional", "trades")


@query("gap_filled_buckets", with_views("trades", body=_BUCKET + """
select venue, symbol, bucket_ms, owner_ms, filled, round(volume, 6) as volume from gf"""))
def gap_filled_buckets(spark, sf):
    return tr.fill_gaps(tr.volume_buckets(v.trades(spark, sf), HOUR), HOUR, DAY).select(
        *PAIR, "bucket_ms", "owner_ms", "filled", "volume")


@query("volume_profile", with_views("trades", body=_BUCKET + """
select venue, symbol, bucket_ms, round(window_volume, 6) as window_volume, round(mean_bucket, 6) as mean_bucket,
       round(std_bucket, 6) as std_bucket,
       round(case when mean_bucket > 1e-12 then volume / mean_bucket else 1e0 end, 6) as bucket_ratio from prof"""))
def volume_profile(spark, sf):
    return _profile(spark, sf).select(*PAIR, "bucket_ms", "window_volume", "mean_bucket", "std_bucket", "bucket_ratio")


@query("volume_breakouts", with_views("trades", body=_BUCKET + """
select venue, symbol, bucket_ms, round(volume, 6) as volume, round(mean_bucket, 6) as mean_bucket,
       round(std_bucket, 6) as std_bucket, round((volume - mean_bucket) / std_bucket, 6) as z
from prof where not filled and window_buckets >= 20 and std_bucket > 1e-12
     and (volume - mean_bucket) / std_bucket > 3"""))
def volume_breakouts(spark, sf):
    return tr.volume_breakouts(v.trades(spark, sf), HOUR, DAY).select(
        *PAIR, "bucket_ms", "volume", "mean_bucket", "std_bucket", "z")


@query("spike_ratios", with_views("trades", body=_BUCKET + """
, lastrow as (select *, row_number() over (partition by venue, symbol, owner_ms order by bucket_ms desc) as back from prof)
select l.venue, l.symbol, l.owner_ms as bucket_ms, cast(nx.next_key // 10000000 as bigint) as close_ts_ms,
       round(case when mean_bucket > 1e-12 then next_size / mean_bucket else 1e0 end, 6) as spike_ratio
from lastrow l join nx on nx.venue = l.venue and nx.symbol = l.symbol and nx.bucket_ms = l.owner_ms
where back = 1 and next_ms is not null"""))
def spike_ratios(spark, sf):
    return tr.bucket_closures(_profile(spark, sf)).select(*PAIR, "bucket_ms", "close_ts_ms", "spike_ratio")


_VOLUME_Z = _dynamic_sql("prof", "venue, symbol", "bucket_ms", "bucket_ms", "ln(1 + volume)", 21600.0, 60, 10, 3.0, True)


@query("volume_scores", with_views("trades", body=_BUCKET + f"""
, {_VOLUME_Z}
select venue, symbol, bucket_ms, round(z, 6) as volume_z, round(threshold, 6) as volume_threshold,
       coalesce(z > threshold, false) as exceeded from dyn"""))
def volume_scores(spark, sf):
    return tr.volume_scores(_profile(spark, sf), HOUR, DAY).select(
        *PAIR, "bucket_ms", "volume_z", "volume_threshold", "exceeded")


@query("volume_events", with_views("trades", body=_BUCKET + f"""
, {_VOLUME_Z},
lastrow as (select *, row_number() over (partition by venue, symbol, owner_ms order by bucket_ms desc) as back from dyn),
own as (select venue, symbol, bucket_ms, z, coalesce(z > threshold, false) as exceeded from dyn where not filled)
select concat('vol-', l.venue, '-', l.symbol, '-', l.owner_ms) as event_id,
       cast(nx.next_key // 10000000 as bigint) as ts_ms, l.venue, l.symbol as asset_pair,
       round(window_volume, 6) as raw_value, round(own.z, 6) as normalized_z_score,
       round(window_volume * next_price, 6) as usd_value, round(threshold, 3) as threshold, own.exceeded,
       round(case when mean_bucket > 1e-12 then next_size / mean_bucket else 1e0 end, 3) as spike_ratio
from lastrow l join nx on nx.venue = l.venue and nx.symbol = l.symbol and nx.bucket_ms = l.owner_ms
     join own on own.venue = l.venue and own.symbol = l.symbol and own.bucket_ms = l.owner_ms
where back = 1 and next_ms is not null"""))
def volume_events(spark, sf):
    e = tr.volume_events(tr.bucket_closures(tr.volume_scores(_profile(spark, sf), HOUR, DAY)), HOUR, DAY)
    return e.select("event_id", "ts_ms", "venue", "asset_pair", "raw_value", "normalized_z_score", "usd_value",
                    "meta.threshold", "meta.exceeded", "meta.spike_ratio")


_CVD = """
, cv as (
  select *, sum(case when side = 'buy' then size * price else -size * price end) over w as cvd,
         sum(case when side = 'buy' then size * price else 0 end) over w as buys, sum(size * price) over w as alls
  from trades window w as (partition by venue, symbol order by ts_ms, trade_id rows unbounded preceding)),
dv as (
  select *, first_value(price) over w as p0, first_value(cvd) over w as c0, max(abs(cvd)) over w as peak, count(*) over w as n
  from cv window w as (partition by venue, symbol order by ts_ms, trade_id rows between 199 preceding and current row)),
flow as (
  select *, case when n < 20 then 0e0 else greatest(-1e0, least(1e0,
            (greatest(-1e0, least(1e0, (cvd - c0) / case when peak = 0 then 1e0 else peak end))
             - greatest(-1e0, least(1e0, (price - p0) / p0 * 100))) / 2)) end as divergence
  from dv)"""
_DELTA = f"""
, wd as (select *, sum(case when side = 'buy' then size * price else -size * price end) {_FRAME.format(w=DAY)} as window_delta from flow)"""


@query("cumulative_delta", with_views("trades", body=_CVD + """
select trade_id, round(cvd, 4) as cvd, round(case when alls > 0 then buys / alls else 0.5e0 end, 6) as buy_ratio from cv"""))
def cumulative_delta(spark, sf):
    return tr.cumulative_delta(v.trades(spark, sf), block_ms=DAY).select("trade_id", F.round("cvd", 4).alias("cvd"), "buy_ratio")


@query("session_buy_ratio", with_views("trades", body=f"""
select trade_id, round(sum(case when side = 'buy' then size * price else 0 end) over w / sum(size * price) over w, 6) as buy_ratio,
       round(sum(case when side = 'buy' then size * price else -size * price end) over w, 4) as session_cvd
from trades window w as (partition by venue, symbol, ts_ms // {7 * DAY} order by ts_ms, trade_id rows unbounded preceding)"""))
def session_buy_ratio(spark, sf):
    t = v.trades(spark, sf).withColumn("week", F.floor(F.col("ts_ms") / (7 * DAY)).cast("bigint"))
    return tr.cumulative_delta(t, "week", block_ms=DAY).select(
        "trade_id", "buy_ratio", F.round("session_cvd", 4).alias("session_cvd"))


@query("price_divergence", with_views("trades", body=_CVD + """
select trade_id, round(divergence, 6) as divergence from flow"""))
def price_divergence(spark, sf):
    deltas = tr.cumulative_delta(v.trades(spark, sf), block_ms=DAY)
    return tr.price_divergence(deltas).select("trade_id", "divergence")


@query("window_delta", with_views("trades", body=_CVD + _DELTA + """
select trade_id, round(window_delta, 4) as window_delta from wd"""))
def window_delta(spark, sf):
    return tr.window_delta(v.trades(spark, sf), DAY).select("trade_id", F.round("window_delta", 4).alias("window_delta"))


_CVD_Z = _CVD + _DELTA + f"""
, {_dynamic_sql("wd", "venue, symbol", "ts_ms, trade_id", "ts_ms", "window_delta", 28800.0, 300, 20, 2.5, True)},
ab as (select *, case when abs(divergence) < 0.25 then 0e0 else greatest(0e0, least(1e0, abs(divergence)
              * greatest(0e0, least(1e0, abs(coalesce(z, 0)) / 3)))) end as absorption from dyn)"""


def _deltas(spark, sf):
    return tr.delta_scores(v.trades(spark, sf), DAY, block_ms=DAY)


@query("delta_scores", with_views("trades", body=_CVD_Z + """
select trade_id, round(z, 5) as cvd_z, round(absorption, 5) as absorption from ab"""))
def delta_scores(spark, sf):
    return _deltas(spark, sf).select("trade_id", F.round("cvd_z", 5).alias("cvd_z"), F.round("absorption", 5).alias("absorption"))


@query("cvd_events", with_views("trades", body=_BUCKET + _CVD_Z + """
select concat('cvd-', ab.venue, '-', ab.symbol, '-', nx.bucket_ms) as event_id, ab.ts_ms, ab.venue,
       ab.symbol as asset_pair, round(cvd, 4) as raw_value, round(z, 5) as normalized_z_score,
       round(buys / alls, 4) as buy_ratio,
       round(divergence, 4) as divergence, case when buys / alls > 0.5 then 'buy' else 'sell' end as aggressive_side
from nx join ab on ab.venue = nx.venue and ab.symbol = nx.symbol
     and ab.ts_ms = nx.next_key // 10000000 and ab.trade_id = nx.next_key % 10000000
where next_ms is not null"""))
def cvd_events(spark, sf):
    e = tr.cvd_events(tr.bucket_closures(_profile(spark, sf)), _deltas(spark, sf))
    return e.select("event_id", "ts_ms", "venue", "asset_pair", F.round("raw_value", 4).alias("raw_value"),
                    F.round("normalized_z_score", 5).alias("normalized_z_score"),
                    "meta.buy_ratio", "meta.divergence", "meta.aggressive_side")


def _aligned_metrics(spark, sf):
    """Book metrics under the pair names of the trades, so that both sides meet."""
    names = F.element_at(F.create_map(*[F.lit(x) for x in (
        "F", "v0", "O", "v1", "P", "v2")]), F.col("venue"))
    pairs = F.element_at(F.create_map(*[F.lit(x) for x in (
        "1-URGENT", "CLICK/USDT", "2-HIGH", "ERROR/USDT", "3-MEDIUM", "VIEW/USDT", "4-NOT SPECIFIED", "PURCHASE/USDT",
        "5-LOW", "SIGNUP/USDT")]), F.col("symbol"))
    return _metrics(spark, sf).withColumn("venue", names).withColumn("symbol", pairs).withColumn(
        "obi_z", F.lit(None).cast("double"))


_SNAPS = _BUCKET + _CVD_Z + _BOOK + f"""
, vz as (select venue, symbol, bucket_ms, owner_ms, window_volume, mean_bucket from prof),
closed as (
  select vz.*, row_number() over (partition by vz.venue, vz.symbol order by vz.bucket_ms desc) as back
  from vz join nx on nx.venue = vz.venue and nx.symbol = vz.symbol and nx.bucket_ms = vz.owner_ms where next_ms is not null),
opened as (select venue, symbol, volume from nx where next_ms is null),
lastd as (select *, row_number() over (partition by venue, symbol order by ts_ms desc, trade_id desc) as back,
                 count(*) over (partition by venue, symbol) as cnt from ab),
names as (
  select *, case venue when 'F' then 'v0' when 'O' then 'v1' else 'v2' end as v,
         case symbol when '1-URGENT' then 'CLICK/USDT' when '2-HIGH' then 'ERROR/USDT' when '3-MEDIUM' then 'VIEW/USDT'
              when '4-NOT SPECIFIED' then 'PURCHASE/USDT' else 'SIGNUP/USDT' end as s from met),
lastb as (select *, row_number() over (partition by v, s order by ts_ms desc, snapshot_id desc) as back from names),
snap as (
  select d.venue, d.symbol, d.price, coalesce(b.obi, 0) as obi, coalesce(b.weighted_obi, 0) as obi_weighted, coalesce(b.spread_bps, 0) as spread_bps,
         coalesce(b.bid_depth, 0) as bid_depth, coalesce(b.ask_depth, 0) as ask_depth, c.window_volume as volume_5m,
         coalesce(case when c.mean_bucket > 1e-12 then o.volume / c.mean_bucket end, 1e0) as volume_spike_ratio,
         d.cvd, coalesce(d.z, 0) as cvd_z, d.divergence as cvd_divergence, d.buys / d.alls as buy_ratio, cast(d.cnt as double) as trades
  from lastd d left join closed c on c.venue = d.venue and c.symbol = d.symbol and c.back = 1
       left join opened o on o.venue = d.venue and o.symbol = d.symbol
       left join lastb b on b.v = d.venue and b.s = d.symbol and b.back = 1
  where d.back = 1)"""


def _snapshots(spark, sf):
    profile = _profile(spark, sf).withColumn("volume_z", F.lit(None).cast("double"))
    return tr.pair_snapshot(_aligned_metrics(spark, sf), profile, _deltas(spark, sf))


@query("pair_snapshots", with_views("trades", "book_levels", body=_SNAPS + """
select venue, symbol, price, round(obi, 6) as obi, round(obi_weighted, 6) as obi_weighted, round(spread_bps, 6) as spread_bps,
       round(bid_depth, 6) as bid_depth, round(ask_depth, 6) as ask_depth, round(volume_5m, 6) as volume_5m,
       round(volume_spike_ratio, 6) as volume_spike_ratio, round(cvd, 4) as cvd, round(cvd_z, 5) as cvd_z,
       round(cvd_divergence, 6) as cvd_divergence, round(buy_ratio, 6) as buy_ratio, trades from snap"""))
def pair_snapshots(spark, sf):
    snap = _snapshots(spark, sf)
    return snap.withColumn("cvd", F.round("cvd", 4)).withColumn("cvd_z", F.round("cvd_z", 5)).drop(
        "obi_z", "volume_z", "absorption")


@query("book_report", with_views("trades", "book_levels", body=_SNAPS + """
, p as (select *, row_number() over (partition by symbol order by bid_depth + ask_depth desc, venue) as place from snap)
select symbol, venue, cast(place as int) as place, round(bid_depth, 6) as bid_depth, round(ask_depth, 6) as ask_depth, round(obi, 6) as obi,
       abs(obi) >= 0.35 as warn, case when obi > 0.05 then 'bid_heavy' when obi < -0.05 then 'ask_heavy' else 'balanced' end as direction,
       case when cvd_divergence > 0.25 then 'absorption by passive wall' when cvd_divergence < -0.25 then 'markup without real buying' end as note
from p where place <= 3"""))
def book_report(spark, sf):
    """Each pair's venues by depth, of the current snapshots."""
    return scoring.book_report(_snapshots(spark, sf), n=3).select(
        "symbol", "venue", "place", "bid_depth", "ask_depth", "obi", "warn", "direction", "note")


# --- universe scans -------------------------------------------------------------

_PARAMS = {
    "min_volume_usd": 10_000.0, "max_volume_usd": 5_000_000.0, "new_listing_min_volume_usd": 2_000.0,
    "volume_surge_ratio": 1.5, "new_listing_grace_h": 3.0,
}

_UNIVERSE = """
, uni as (
  select *, coalesce(percentage, 0e0) as change_pct,
         quote_volume > 0 and coalesce(abs(coalesce(percentage, 0e0) - (last_px - open_px) / open_px * 100) > 15, false) as rejected
  from tickers where split_part(symbol, '/', -1) in ('USDT', 'USDC', 'USD', 'FDUSD', 'USD1')),
seen as (
  select *, quote_volume > 0 and not rejected as accepted,
         scan = min(scan) over (partition by venue, symbol) and scan > min(scan) over (partition by venue) as is_new
  from uni),
listed as (
  select *, max(case when is_new and accepted then scan_ms end) over (partition by venue, symbol) as l_ms from seen),
hist as (
  select * exclude (vols), list_sort(vols) as vols, len(vols) as n from (
    select *, array_agg(quote_volume) over (partition by venue, symbol order by scan rows between 24 preceding and 1 preceding) as vols
    from listed where accepted)),
base as (
  select *, case when n >= 3 then vols[cast(n // 2 as int) + 1] end as baseline,
         (scan_ms - case when scan_ms >= l_ms then l_ms end) / 3600000e0 as age_h from hist),
judge as (
  select *, quote_volume / baseline as surge, abs(change_pct) >= 15 as moving,
         coalesce(quote_volume / baseline >= 1.5, false) as surging, coalesce(age_h <= 3, false) as in_grace,
         abs(change_pct) >= 10 or quote_volume >= 10000 as active from base),
cand as (
  select *, case when moving then least(40e0, 10 * ln(1 + abs(change_pct) / 15) / ln(2)) else 0 end
         + case when surging then least(surge, 20e0) * 3 else 0 end
         + case when not is_new and in_grace and active then 25 else 0 end
         + case when is_new and active then 60 else 0 end as score
  from judge where quote_volume >= case when in_grace then 2000 else 10000 end and quote_volume <= 5000000
       and (moving or surging or (not is_new and in_grace and active) or (is_new and active))),
perbase as (
  select * from (select *, row_number() over (partition by venue, scan, split_part(symbol, '/', 1)
         order by quote_volume desc, score desc, symbol) as rk from cand) where rk = 1),
sel as (select * from (select *, row_number() over (partition by venue, scan order by score desc, symbol) as rank from perbase)
        where rank <= 8)"""


@query("quoted_tickers", with_views("tickers", body="""
select venue, symbol, scan, round(quote_volume, 6) as quote_volume from tickers where symbol like '%/USDT' or symbol like '%/USDC'"""))
def quoted_tickers(spark, sf):
    return d.quoted(v.tickers(spark, sf)).select("venue", "symbol", "scan", "quote_volume")


@query("ticker_checks", with_views("tickers", body=_UNIVERSE + """
select venue, symbol, scan, round(change_pct, 6) as change_pct, rejected from uni"""))
def ticker_checks(spark, sf):
    return d.check_tickers(d.quoted(v.tickers(spark, sf))).select("venue", "symbol", "scan", "change_pct", "rejected")


@query("volume_surges", with_views("tickers", body=_UNIVERSE + """
select venue, symbol, scan, round(baseline, 6) as baseline, round(quote_volume / baseline, 6) as surge from base"""))
def volume_surges(spark, sf):
    accepted = d.check_tickers(d.quoted(v.tickers(spark, sf))).where("quote_volume > 0 and not rejected")
    return d.volume_baseline(accepted).select("venue", "symbol", "scan", "baseline", "surge")


@query("new_listings", with_views("tickers", body=_UNIVERSE + """
select venue, symbol, scan, is_new, case when scan_ms >= l_ms then l_ms end as listed_ms from listed"""))
def new_listings(spark, sf):
    universe = d.check_tickers(d.quoted(v.tickers(spark, sf))).withColumn(
        "accepted", (F.col("quote_volume") > 0) & ~F.col("rejected"))
    return d.listing_age(universe).select("venue", "symbol", "scan", "is_new", "listed_ms")


@query("scan_candidates", with_views("tickers", body=_UNIVERSE + """
select venue, symbol, scan, round(score, 6) as score from cand"""))
def scan_candidates(spark, sf):
    return d.scan_candidates(v.tickers(spark, sf), **_PARAMS).select("venue", "symbol", "scan", "score")


@query("scan_selection", with_views("tickers", body=_UNIVERSE + """
select venue, symbol, scan, cast(rank as int) as rank, round(score, 6) as score from sel"""))
def scan_selection(spark, sf):
    return d.discover(v.tickers(spark, sf), max_symbols=8, **_PARAMS).select("venue", "symbol", "scan", "rank", "score")


@query("pinned_watchlist", with_views("tickers", body=_UNIVERSE + """
, pins as (select venue, scan, symbol, case symbol when 'Brand11/USDT' then 1 else 2 end as position
           from tickers where symbol in ('Brand11/USDT', 'Brand12/EUR'))
select venue, scan, symbol, cast(min(position) as int) as position from (
  select venue, scan, symbol, position from pins union all select venue, scan, symbol, rank + 2 from sel)
group by 1, 2, 3"""))
def pinned_watchlist(spark, sf):
    t = v.tickers(spark, sf)
    return d.watchlist(d.discover(t, max_symbols=8, **_PARAMS), t, ("Brand11/USDT", "Brand12/EUR"))


@query("corroborated_moves", with_views("tickers", body=_UNIVERSE + """
, raw as (select venue, scan, split_part(symbol, '/', 1) as b, arg_max(percentage, symbol) as move
          from uni where percentage is not null group by 1, 2, 3),
moves as (select * from raw union all select venue, scan, split_part(symbol, '/', 1), change_pct from sel)
select s.venue, s.symbol, s.scan, round(s.change_pct, 6) as change_pct from sel s
where abs(change_pct) < 30
   or not exists (select 1 from moves m where m.scan = s.scan and m.b = split_part(s.symbol, '/', 1) and m.venue <> s.venue)
   or exists (select 1 from moves m where m.scan = s.scan and m.b = split_part(s.symbol, '/', 1) and m.venue <> s.venue
              and m.move * s.change_pct > 0 and abs(m.move - s.change_pct) <= 40)"""))
def corroborated_moves(spark, sf):
    t = v.tickers(spark, sf)
    chosen = d.discover(t, max_symbols=8, **_PARAMS)
    return d.corroborate(chosen, d.base_moves(t, chosen), threshold_pct=30.0).select("venue", "symbol", "scan", "change_pct")


@query("watch_changes", with_views("tickers", body=_UNIVERSE + """
, cur as (select distinct venue, symbol from sel where scan % 2 = 0), want as (select distinct venue, symbol from sel where scan % 3 = 0)
select venue, symbol, 'add' as action from want where (venue, symbol) not in (select venue, symbol from cur)
union all
select venue, symbol, 'drop' from cur where (venue, symbol) not in (select venue, symbol from want) and symbol <> 'Brand11/USDT'"""))
def watch_changes(spark, sf):
    chosen = d.discover(v.tickers(spark, sf), max_symbols=8, **_PARAMS)
    return d.watch_changes(
        chosen.where("scan % 2 = 0").select(*PAIR), chosen.where("scan % 3 = 0").select(*PAIR), ("Brand11/USDT",))


_MARKETS = """
, mk as (select venue, symbol, true as spot, case when sum(trades) % 7 = 0 then false when sum(trades) % 7 < 3 then null else true end as active
         from tickers where venue <> 'v3' group by 1, 2)"""


def _markets(spark, sf):
    n = F.sum("trades") % 7
    return v.tickers(spark, sf).where("venue <> 'v3'").groupBy(*PAIR).agg(
        F.lit(True).alias("spot"), F.when(n == 0, False).when(n < 3, None).otherwise(True).alias("active"))


@query("unlisted_pairs", with_views("tickers", body=_UNIVERSE + _MARKETS + """
, ok as (select venue, symbol from mk where coalesce(active, true))
select distinct venue, symbol from sel where venue in (select venue from ok) and (venue, symbol) not in (select venue, symbol from ok)"""))
def unlisted_pairs(spark, sf):
    chosen = d.discover(v.tickers(spark, sf), max_symbols=8, **_PARAMS)
    return d.unlisted_pairs(chosen.select(*PAIR).distinct(), _markets(spark, sf))


@query("scan_statistics", with_views("tickers", body=_UNIVERSE + """
, ps as (select venue, scan, count(*) as pairs, count(*) filter (rejected) as rejected, max(scan_ms) as scan_ms from uni group by 1, 2)
select venue, count(*) as scans, arg_max(pairs, scan) as last_universe, cast(sum(rejected) as bigint) as rejected,
       max(scan_ms) as last_scan_ms,
       (select count(distinct symbol) from uni u where u.venue = ps.venue) as universe
from ps group by venue"""))
def scan_statistics(spark, sf):
    return d.scan_statistics(v.tickers(spark, sf))


@query("movers", with_views("tickers", body=_UNIVERSE + """
, mv as (select * from (
  select *, row_number() over (partition by venue, scan, split_part(symbol, '/', 1) order by quote_volume desc, score desc, symbol) as rk
  from (select *, 10 * ln(1 + abs(change_pct) / 15) / ln(2) as raw_score, least(40e0, 10 * ln(1 + abs(change_pct) / 15) / ln(2)) as score
        from seen where accepted and abs(change_pct) >= 15 and quote_volume between 10000 and 5000000)) where rk = 1),
top as (select * from (select *, row_number() over (partition by venue, scan order by score desc, symbol) as r from mv) where r <= 5)
select scan, venue, symbol, round(change_pct, 6) as change_pct, cast(place as int) as place from (
  select *, row_number() over (partition by scan order by abs(change_pct) desc, venue, symbol) as place from top) where place <= 5"""))
def movers(spark, sf):
    found = d.movers(v.tickers(spark, sf), limit=5, min_volume_usd=10_000.0, max_volume_usd=5_000_000.0)
    return found.select("scan", "venue", "symbol", "change_pct", "place")


def _reports(spark, sf):
    trades = v.trades(spark, sf)
    candles = tr.volume_buckets(trades, HOUR).select(*PAIR, F.col("bucket_ms").alias("minute_ms"), "volume")
    last = trades.groupBy(*PAIR).agg(
        F.max_by("price", F.struct("ts_ms", "trade_id")).alias("price"), F.sum("size").alias("quote_volume"),
        F.lit(0.0).alias("change_pct"))
    book = _aligned_metrics(spark, sf)
    newest = book.groupBy(*PAIR).agg(F.max(F.struct("ts_ms", "snapshot_id", "obi", "bid_depth", "ask_depth", "spread_bps")).alias("b"))
    return d.pair_report(newest.select(*PAIR, "b.*"), candles, last)


_REPORT = _BUCKET + _BOOK + """
, names as (
  select *, case venue when 'F' then 'v0' when 'O' then 'v1' else 'v2' end as v,
         case symbol when '1-URGENT' then 'CLICK/USDT' when '2-HIGH' then 'ERROR/USDT' when '3-MEDIUM' then 'VIEW/USDT'
              when '4-NOT SPECIFIED' then 'PURCHASE/USDT' else 'SIGNUP/USDT' end as s from met),
lastb as (select *, row_number() over (partition by v, s order by ts_ms desc, snapshot_id desc) as back from names),
cd as (select *, row_number() over (partition by venue, symbol order by bucket_ms desc) as age from bk),
st as (
  select venue, symbol, count(*) as candles, max(case when age = 1 then volume end) as lv,
         avg(case when age > 1 then ln(1 + volume) end) as mu, stddev_pop(case when age > 1 then ln(1 + volume) end) as sd,
         avg(case when age > 1 then volume end) as mean_raw from cd where age <= 60 group by 1, 2),
px as (select venue, symbol, arg_max(price, ts_ms::hugeint * 10000000 + trade_id) as price, sum(size) as quote_volume from trades group by 1, 2),
rep as (
  select px.venue, px.symbol, price, quote_volume, coalesce(obi, 0e0) as obi, coalesce(bid_depth, 0e0) as bid_depth,
         coalesce(ask_depth, 0e0) as ask_depth, coalesce(spread_bps, 0e0) as spread_bps,
         case when candles >= 10 then case when sd > 1e-9 then (ln(1 + lv) - mu) / sd else 0e0 end else 0e0 end as volume_z,
         case when candles >= 10 then greatest(0e0, least(50e0, lv / mean_raw)) else 1e0 end as volume_spike_ratio
  from px join st using (venue, symbol) left join lastb on v = px.venue and s = px.symbol and back = 1)"""


@query("pair_reports", with_views("trades", "book_levels", body=_REPORT + """
select venue, symbol, price, round(quote_volume, 6) as quote_volume, round(obi, 6) as obi, round(spread_bps, 6) as spread_bps,
       round(volume_z, 6) as volume_z, round(volume_spike_ratio, 6) as volume_spike_ratio from rep"""))
def pair_reports(spark, sf):
    return _reports(spark, sf).select(*PAIR, "price", "quote_volume", "obi", "spread_bps", "volume_z", "volume_spike_ratio")


@query("best_venues", with_views("trades", "book_levels", body=_REPORT + """
select symbol, arg_max(venue, bid_depth + ask_depth) as best_venue, round(max(bid_depth + ask_depth), 6) as depth,
       array_to_string(list_sort(array_agg(venue)), ',') as venues from rep group by symbol"""))
def best_venues(spark, sf):
    return d.best_venue(_reports(spark, sf)).withColumn("venues", F.array_join("venues", ","))


@query("report_vectors", with_views("trades", "book_levels", body=_REPORT + """
select venue, split_part(symbol, '/', 1) as asset, round(greatest(-20e0, least(20e0, volume_z)), 6) as volume_z,
       round(abs(obi), 6) as obi_abs, round(least(10e0, ln(1 + spread_bps)), 6) as spread_bps,
       round(volume_spike_ratio, 6) as volume_spike_ratio, round(1 / 3e0, 6) as coverage, 0e0 as cvd_z from rep"""))
def report_vectors(spark, sf):
    return d.report_features(_reports(spark, sf)).select(
        "venue", "asset", "volume_z", "obi_abs", "spread_bps", "volume_spike_ratio", "coverage", "cvd_z")


@query("resolved_symbols", with_views("tickers", body=_MARKETS + """
, ok as (select venue, upper(symbol) as symbol, list_position(['USDT', 'USDC', 'USD', 'FDUSD', 'USD1'], split_part(symbol, '/', -1)) as pref
         from mk where coalesce(active, true)),
q as (select distinct p_brand, replace(p_brand, '#', '') as b from part)
select concat(' ', lower(b), ' ') as query, venue, arg_min(symbol, pref) as symbol from q join ok
  on split_part(symbol, '/', 1) = upper(b) and pref > 0 group by 1, 2
union all
select concat(b, '/USDC'), venue, symbol from q join ok on symbol = upper(concat(b, '/USDC'))"""))
def resolved_symbols(spark, sf):
    brands = v.table(spark, sf, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("b")).distinct()
    asked = brands.select(F.concat(F.lit(" "), F.lower("b"), F.lit(" ")).alias("query")).unionByName(
        brands.select(F.concat("b", F.lit("/USDC")).alias("query")))
    return d.resolve_symbol(_markets(spark, sf).withColumn("symbol", F.upper("symbol")), asked)


@query("similar_symbols", with_views("tickers", body=_MARKETS + """
select distinct symbol from mk where coalesce(active, true) and contains(split_part(symbol, '/', 1), '1')
   and split_part(symbol, '/', -1) in ('USDT', 'USDC') order by symbol limit 12"""))
def similar_symbols(spark, sf):
    return d.similar_symbols(_markets(spark, sf), " 1/x")


@query("base_assets", with_views("tickers", body="""
select distinct concat(symbol, ':', venue) as pair, split_part(split_part(concat(symbol, ':', venue), '/', 1), ':', 1) as base_asset
from tickers"""))
def base_assets(spark, sf):
    pair = F.concat("symbol", F.lit(":"), "venue")
    return v.tickers(spark, sf).select(pair.alias("pair"), base_asset(pair).alias("base_asset")).distinct()
