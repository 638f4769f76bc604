"""Transfers, bridges, pools and chain decoders over the test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapevigil.operators import flows as fl
from tapevigil.plans import views as v
from tapevigil.plans.registry import query
from tapevigil.plans.series_queries import _dynamic_sql
from tapevigil.plans.views import DAY, TRANSFER_ORDER, with_views
from tapevigil.sources import chain, registry

FLOW = ["chain", "symbol"]
BIG_BLOCK = 90 * DAY
ORDER_SQL = ", ".join(TRANSFER_ORDER)
# The rows of a transfer are identified by all listed columns; queries return a readable id.
ROW_ID = "concat_ws('/', ts_ms, order_id, line, chain, symbol, from_addr, to_addr)"


def _id():
    return F.concat_ws("/", *[F.col(c).cast("string") for c in TRANSFER_ORDER]).alias("row_id")


def _hex(n: str) -> str:
    return f"concat('0x', lpad(to_hex({n}), 64, '0'))"


@query("transfer_logs", """
select l_orderkey * 8 + l_linenumber as log_index, concat('0x', lpad(lower(to_hex(l_suppkey)), 40, '0')) as from_addr,
       concat('0x', lpad(lower(to_hex(l_partkey)), 40, '0')) as to_addr,
       cast(cast(l_extendedprice * 100 as bigint) as double) as raw_amount, l_orderkey as block,
       round(cast(l_extendedprice * 100 as bigint) / 1e6, 6) as amount, round(cast(l_extendedprice * 100 as bigint) / 1e6, 6) as usd_value
from lineitem where l_linenumber <> 3""")
def transfer_logs(spark, sf):
    """Line items written as token transfer logs, decoded and valued by the token table."""
    word = lambda c, n: F.concat(F.lit("0x"), F.lpad(F.hex(c), n, "0"))
    units = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    logs = v.table(spark, sf, "lineitem").select(
        F.lit("ethereum").alias("chain"),
        F.lit("0xDAC17F958D2ee523a2206206994597C13D831ec7").alias("address"),
        F.when(F.col("l_linenumber") == 3, F.array(F.lit(chain.TRANSFER_TOPIC))).otherwise(F.array(
            F.upper(F.lit(chain.TRANSFER_TOPIC)), word(F.col("l_suppkey"), 64), word(F.col("l_partkey"), 64))).alias("topics"),
        F.when(F.col("l_linenumber") == 2, units.cast("string")).otherwise(word(units, 64)).alias("data"),
        F.concat(F.lit("0x"), F.hex("l_orderkey")).alias("blockNumber"), F.lit("0xabc").alias("transactionHash"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("logIndex"))
    decoded = chain.token_amounts(chain.transfer_logs(logs), registry.tokens(spark))
    return decoded.select("log_index", "from_addr", "to_addr", "raw_amount", "block", "amount", "usd_value")


@query("pool_payloads", """
select event_id, cast(event_id as double) * 18446744073709551616 + 7 as reserve0, cast(user_id as double) as reserve1, epoch_us(ts) // 1000 as reserve_ts
from events where event_id % 5 <> 0
union all select event_id, null, null, null from events where event_id % 5 = 0""")
def pool_payloads(spark, sf):
    """Reserve call results: two wide words and a time; cut-off ones decode to NULL."""
    e = v.table(spark, sf, "events")
    word = lambda c: F.lpad(F.hex(c), 64, "0")
    big = F.concat(F.lpad(F.hex("event_id"), 48, "0"), F.lpad(F.hex(F.lit(7).cast("bigint")), 16, "0"))
    whole = F.concat(F.lit("0x"), big, word(F.col("user_id")), word(v.millis("ts")))
    raw = F.when(F.col("event_id") % 5 == 0, F.substring(whole, 1, 100)).otherwise(whole)
    return chain.pool_reserves(e.select("event_id", raw.alias("raw"))).select(
        "event_id", "reserve0", "reserve1", "reserve_ts")


@query("balance_changes", """
with b as (
  select l_orderkey as tx, l_linenumber as account_index, l_returnflag as mint,
         sum(case when l_linestatus = 'O' then l_quantity end) as pre, sum(case when l_linestatus = 'F' then l_quantity end) as post,
         max(case when l_linestatus = 'F' then concat('o', l_linenumber) end) as po,
         max(case when l_linestatus = 'O' then concat('p', l_linenumber) end) as pr
  from lineitem group by 1, 2, 3)
select tx, account_index, mint, coalesce(po, pr) as owner, round(coalesce(post, 0) - coalesce(pre, 0), 6) as delta,
       coalesce(post, 0e0) as post_balance
from b where abs(coalesce(post, 0) - coalesce(pre, 0)) >= 1e-12""")
def balance_changes(spark, sf):
    side = v.table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("accountIndex"), F.col("l_returnflag").alias("mint"), "l_linestatus"
    ).agg(F.sum("l_quantity").alias("uiAmount"))
    who = F.concat(F.when(F.col("l_linestatus") == "O", "p").otherwise("o"), F.col("accountIndex").cast("string"))
    entry = F.struct("accountIndex", "mint", who.alias("owner"), "uiAmount")
    txs = side.groupBy("tx").agg(
        F.collect_list(F.when(F.col("l_linestatus") == "O", entry)).alias("pre"),
        F.collect_list(F.when(F.col("l_linestatus") == "F", entry)).alias("post"))
    return chain.balance_changes(txs)


@query("new_signatures", """
select signature, min(ts_ms) as ts_ms from (
  select concat('s', user_id, '-', event_type) as signature, epoch_us(ts) // 1000 as ts_ms, event_id % 6 = 0 as failed from events)
where not failed group by 1""")
def new_signatures(spark, sf):
    e = v.table(spark, sf, "events").select(
        F.concat(F.lit("s"), "user_id", F.lit("-"), "event_type").alias("signature"), v.millis("ts").alias("ts_ms"),
        F.when(F.col("event_id") % 6 == 0, "failed").alias("err"), "event_id")
    return chain.new_signatures(e, ["ts_ms", "event_id"]).select("signature", "ts_ms")


@query("transfer_directions", with_views("transfers", "cex_wallets", body=f"""
select {ROW_ID} as row_id, case when f.address is not null and t.address is not null then 'internal' when t.address is not null then 'inflow'
       when f.address is not null then 'outflow' else 'unrelated' end as direction
from transfers left join cex_wallets f on f.address = from_addr left join cex_wallets t on t.address = to_addr"""))
def transfer_directions(spark, sf):
    labelled = fl.with_labels(v.transfers(spark, sf), v.cex_wallets(spark, sf), "cex")
    return labelled.select(_id(), fl.direction(F.col("cex_from"), F.col("cex_to")).alias("direction"))


_WHALES = """
, whales as (
  select tr.*, case when t.address is not null then 'inflow' else 'outflow' end as direction, coalesce(t.label, f.label) as counterparty
  from transfers tr left join cex_wallets f on f.address = from_addr left join cex_wallets t on t.address = to_addr
  where usd_value >= {usd} and (f.address is null) <> (t.address is null))"""


def _whales(spark, sf, usd=50_000.0):
    return fl.whale_transfers(v.transfers(spark, sf), v.cex_wallets(spark, sf), usd)


@query("whale_transfers", with_views("transfers", "cex_wallets", body=_WHALES.format(usd=50000) + f"""
select {ROW_ID} as row_id, direction, counterparty, round(usd_value, 6) as usd_value from whales"""))
def whale_transfers(spark, sf):
    return _whales(spark, sf).select(_id(), "direction", "counterparty", "usd_value")


@query("balance_whales", with_views("transfers", "cex_wallets", body=f"""
select {ROW_ID} as signature, case when line % 2 = 0 then 'inflow' else 'outflow' end as direction,
       coalesce(label, 'unknown_sol_cex') as counterparty, round(usd_value, 6) as usd_value, case when line % 2 = 0 then from_addr else '' end as to_addr
from transfers left join cex_wallets on address = from_addr where usd_value >= 50000 and (address is not null or from_addr = 's7')"""))
def balance_whales(spark, sf):
    """Transfers seen as balance changes of the sender's account."""
    t = v.transfers(spark, sf)
    mint = F.lit("EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v")
    sign = F.when(F.col("line") % 2 == 0, 1.0).otherwise(-1.0)
    changes = t.select(_id().alias("signature"), mint.alias("mint"), F.col("from_addr").alias("owner"),
                       (F.col("usd_value") * sign).alias("delta"), F.lit("s7").alias("wallet"),
                       F.col("order_id").alias("slot"), "ts_ms")
    found = fl.balance_whales(changes, registry.tokens(spark), v.cex_wallets(spark, sf), 50_000.0)
    return found.select(F.col("tx_hash").alias("signature"), "direction", "counterparty", "usd_value", "to_addr")


_BRIDGES = """
, flows as (
  select tr.*, coalesce(t.label, f.label) as bridge, case when t.address is not null then 'into_bridge' else 'out_of_bridge' end as bdir
  from transfers tr left join bridges f on f.address = from_addr left join bridges t on t.address = to_addr
  where usd_value >= {usd} and (f.address is not null or t.address is not null))"""


def _bridges(spark, sf, usd=80_000.0):
    return fl.bridge_flows(v.transfers(spark, sf), v.bridges(spark, sf), usd)


@query("bridge_flows", with_views("transfers", "bridges", body=_BRIDGES.format(usd=80000) + f"""
select {ROW_ID} as row_id, bridge, bdir as direction, round(usd_value, 6) as usd_value from flows"""))
def bridge_flows(spark, sf):
    return _bridges(spark, sf).select(_id(), "bridge", "direction", "usd_value")


@query("bridge_events", with_views("transfers", "bridges", body=_BRIDGES.format(usd=80000) + """
select chain as venue, symbol as asset_pair, 'bridge_flow' as metric_type, ts_ms, round(amount, 6) as raw_value, round(usd_value, 6) as usd_value,
       bridge, bdir as direction from flows"""))
def bridge_events(spark, sf):
    """Bridge flows on the event scale."""
    return fl.bridge_events(_bridges(spark, sf), TRANSFER_ORDER).select(
        "venue", "asset_pair", "metric_type", "ts_ms", "raw_value", "usd_value", "meta.bridge", "meta.direction")


_NET = f"""
, net as (select *, sum(case when direction = 'inflow' then usd_value else -usd_value end)
          over (partition by chain, symbol order by {ORDER_SQL} rows unbounded preceding) as net_flow_usd from whales)"""


@query("net_flows", with_views("transfers", "cex_wallets", body=_WHALES.format(usd=30000) + _NET + f"""
select {ROW_ID} as row_id, round(net_flow_usd, 4) as net_flow_usd from net"""))
def net_flows(spark, sf):
    out = fl.net_flow(_whales(spark, sf, 30_000.0), TRANSFER_ORDER, block_ms=BIG_BLOCK)
    return out.select(_id(), F.round("net_flow_usd", 4).alias("net_flow_usd"))


_FLOW_Z = _dynamic_sql("net", "chain, symbol", ORDER_SQL, "ts_ms", "usd_value", 1800.0, 200, 8, 2.5, False)


@query("flow_scores", with_views("transfers", "cex_wallets", body=_WHALES.format(usd=30000) + _NET + f"""
, {_FLOW_Z}
select {ROW_ID} as row_id, round(z, 6) as flow_z from dyn"""))
def flow_scores(spark, sf):
    return fl.flow_scores(_whales(spark, sf, 30_000.0), TRANSFER_ORDER, BIG_BLOCK).select(_id(), "flow_z")


_MATCH = f"""
, cand as (
  select w.*, f.bridge, f.usd_value as f_usd, f.ts_ms as f_ts, {ROW_ID.replace("ts_ms", "f.ts_ms").replace("order_id", "f.order_id").replace("line,", "f.line,").replace("chain,", "f.chain,").replace("symbol,", "f.symbol,").replace("from_addr", "f.from_addr").replace("to_addr", "f.to_addr")} as flow_id
  from whales w join flows f on w.direction = 'inflow' and f.ts_ms between w.ts_ms - {7 * DAY} and w.ts_ms
       and least(f.usd_value, w.usd_value) / greatest(f.usd_value, w.usd_value) >= 0.75),
pick as (select *, row_number() over (partition by {ORDER_SQL} order by f_ts desc, flow_id desc) as rk from cand)"""


def _matched(spark, sf):
    flows = _bridges(spark, sf, 40_000.0).withColumn("flow_id", _id())
    return fl.match_bridges(_whales(spark, sf), flows, TRANSFER_ORDER, "flow_id", window_ms=7 * DAY)


@query("bridge_deposits", with_views("transfers", "cex_wallets", "bridges",
                                     body=_WHALES.format(usd=50000) + _BRIDGES.format(usd=40000) + _MATCH + f"""
select {ROW_ID} as row_id, bridge, round(f_usd, 6) as usd, round((ts_ms - f_ts) / 1000e0, 1) as lag_s, flow_id from pick where rk = 1"""))
def bridge_deposits(spark, sf):
    m = _matched(spark, sf).where(F.col("precursor").isNotNull())
    return m.select(_id(), "precursor.bridge", "precursor.usd", "precursor.lag_s", "precursor.flow_id")


@query("pool_values", """
select event_id, round(case when event_id % 3 = 0 then value / 1e3 * 2 when event_id % 3 = 1 then user_id / 1e3 * 2
       else user_id / 1e15 + value / 1e3 end, 6) as tvl_usd from events""")
def pool_values(spark, sf):
    third = F.col("event_id") % 3
    e = v.table(spark, sf, "events").select(
        "event_id",
        F.when(third == 1, "USDC").otherwise("PEPE").alias("token0"), F.when(third == 0, "USDT").otherwise("WETH").alias("token1"),
        F.when(third == 1, 6).otherwise(18).alias("decimals0"), F.lit(6).alias("decimals1"),
        F.col("user_id").cast("double").alias("reserve0"), F.col("value").alias("reserve1"))
    return fl.pool_tvl(e, registry.tokens(spark)).select("event_id", (F.col("tvl_usd") * 1000.0).alias("tvl_usd"))


_DRAINS = """
, pv as (select *, lag(tvl_usd) over w as prev, lag(block) over w as prev_block from pool_reserves window w as (partition by pool order by ts_ms, event_id)),
dr as (select *, (prev - tvl_usd) / prev * 100 as drop_pct from pv where prev > 0 and (prev - tvl_usd) / prev * 100 >= 30
       and greatest(1, block - prev_block) <= 3)"""


def _drains(spark, sf):
    return fl.liquidity_drains(v.pool_reserves(spark, sf), ["ts_ms", "event_id"], block_ms=DAY)


@query("liquidity_drains", with_views("pool_reserves", body=_DRAINS + """
select event_id, pool, round(prev, 6) as prev_tvl_usd, round(drop_pct, 6) as drop_pct from dr"""))
def liquidity_drains(spark, sf):
    return _drains(spark, sf).select("event_id", "pool", "prev_tvl_usd", "drop_pct")


@query("liquidity_events", with_views("pool_reserves", body=_DRAINS + """
select concat('lq-', pool, '-', block) as event_id, ts_ms, split_part(pool, '/', 1) as asset_pair, round(-drop_pct, 6) as raw_value,
       round(least(10e0, drop_pct / 30 * 3), 6) as normalized_z_score, round(tvl_usd, 6) as usd_value from dr"""))
def liquidity_events(spark, sf):
    return fl.liquidity_events(_drains(spark, sf), ["pool", "block"]).select(
        "event_id", "ts_ms", "asset_pair", "raw_value", "normalized_z_score", "usd_value")


@query("transfer_events", with_views("transfers", "cex_wallets", "bridges",
                                     body=_WHALES.format(usd=50000) + _NET + _BRIDGES.format(usd=40000) + _MATCH + f"""
, {_FLOW_Z}
select concat('wt-', replace({ROW_ID.replace("'/'", "'-'")}, '/', '/')) as event_id, dyn.venue_ as venue, symbol as asset_pair,
       round(amount, 6) as raw_value, round(z, 6) as normalized_z_score, round(net_flow_usd, 2) as net_flow_usd,
       p.flow_id is not null as has_precursor
from (select *, chain as venue_ from dyn) dyn left join (select {ORDER_SQL}, flow_id from pick where rk = 1) p using ({ORDER_SQL})"""))
def transfer_events(spark, sf):
    from tapevigil.plans.storage import settle

    whales = settle(_matched(spark, sf))
    scored = fl.flow_scores(fl.net_flow(whales, TRANSFER_ORDER, BIG_BLOCK), TRANSFER_ORDER, BIG_BLOCK)
    return fl.transfer_events(scored, TRANSFER_ORDER).select(
        "event_id", "venue", "asset_pair", "raw_value", "normalized_z_score", "meta.net_flow_usd",
        F.col("meta.bridge_precursor").isNotNull().alias("has_precursor"))


@query("recent_whales", with_views("transfers", "cex_wallets", body=_WHALES.format(usd=50000) + f"""
select {ROW_ID} as row_id, direction, round(usd_value, 6) as usd_value from whales
order by {", ".join(c + " desc" for c in TRANSFER_ORDER)} limit 12"""))
def recent_whales(spark, sf):
    return fl.recent_whales(_whales(spark, sf), TRANSFER_ORDER).select(_id(), "direction", "usd_value")


@query("whale_totals", with_views("transfers", "cex_wallets", body=_WHALES.format(usd=50000) + """
, t as (select symbol, sum(case when direction = 'inflow' then usd_value else 0 end) as i, sum(case when direction = 'outflow' then usd_value else 0 end) as o,
        count(*) as transfers from whales group by 1)
select symbol, round(i, 4) as inflow_usd, round(o, 4) as outflow_usd, transfers, round(i - o, 4) as net_usd,
       case when i - o > 0 then 'sell pressure building' else 'accumulation / supply squeeze' end as pressure from t"""))
def whale_totals(spark, sf):
    t = fl.whale_totals(_whales(spark, sf), ["symbol"])
    return t.select("symbol", *[F.round(c, 4).alias(c) for c in ("inflow_usd", "outflow_usd", "net_usd")], "transfers", "pressure")


@query("flow_board", with_views("transfers", "cex_wallets", body=_WHALES.format(usd=50000) + """
select chain, symbol, round(sum(case when direction = 'inflow' then usd_value else -usd_value end), 4) as net_flow_usd
from whales group by 1, 2 order by abs(sum(case when direction = 'inflow' then usd_value else -usd_value end)) desc, 1, 2 limit 15"""))
def flow_board(spark, sf):
    return fl.flow_board(_whales(spark, sf)).select(*FLOW, F.round("net_flow_usd", 4).alias("net_flow_usd"))


@query("recent_bridges", with_views("transfers", "bridges", body=_BRIDGES.format(usd=80000) + f"""
select {ROW_ID} as row_id, bridge from flows order by {", ".join(c + " desc" for c in TRANSFER_ORDER)} limit 4"""))
def recent_bridges(spark, sf):
    return fl.recent_bridges(_bridges(spark, sf), TRANSFER_ORDER).select(_id(), "bridge")
