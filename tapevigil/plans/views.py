"""Market-shaped views over the test tables, as DataFrames and as SQL text.

The SQL text of a view is the same definition for another engine, so results
can be compared query by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000
DAY = 86_400_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def millis(name: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp (the session zone is pinned to UTC)."""
    return F.unix_millis(F.col(name).cast("timestamp"))


def trades(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("trade_id"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("venue"),
        F.concat(F.upper("event_type"), F.lit("/USDT")).alias("symbol"),
        millis("ts").alias("ts_ms"),
        (100 + F.regexp_extract("props", "[0-9]+", 0).cast("int") * 0.5).alias("price"),
        F.col("value").alias("size"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
    )


def book_levels(spark, sf) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    n = F.col("l_linenumber")
    bid = F.col("l_linestatus") == "O"
    # Line items of an order are summed before the join, which thins the larger side first.
    per_line = li.groupBy("l_orderkey", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("size"))
    return per_line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.col("o_orderstatus").alias("venue"),
        F.col("o_orderpriority").alias("symbol"),
        millis("o_orderdate").alias("ts_ms"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 100 - 0.1 * n).otherwise(100 + 0.1 * n).alias("price"),
        "size",
    )


def books(spark, sf) -> DataFrame:
    from tapevigil.operators.orderbook import books_from_levels, normalise_books

    return normalise_books(books_from_levels(book_levels(spark, sf)))


def tickers(spark, sf) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    quote = F.when(F.col("l_linenumber") % 3 == 0, "USDT").when(F.col("l_linenumber") % 3 == 1, "USDC").otherwise("EUR")
    price = F.col("l_extendedprice")
    early = F.dayofmonth("l_shipdate") <= 15
    grouped = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.concat(F.lit("v"), (F.col("l_suppkey") % 4).cast("string")).alias("venue"),
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), quote).alias("symbol"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint").alias("scan"),
    ).agg(
        F.sum(price).alias("quote_volume"),
        F.avg(F.when(early, price)).alias("open_px"),
        F.avg(F.when(~early, price)).alias("last_px"),
        F.count(F.lit(1)).alias("trades"),
    )
    change = (F.col("last_px") - F.col("open_px")) / F.col("open_px") * 100.0
    skewed = (F.col("scan") + F.col("trades")) % 10 == 0
    months = (F.floor(F.col("scan") / 100) * 12 + F.col("scan") % 100).cast("bigint")
    return grouped.withColumn("percentage", change + F.when(skewed, 40.0).otherwise(0.0)).withColumn(
        "scan_ms", months * HOUR
    )


def transfers(spark, sf) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    out = F.col("l_returnflag") == "R"
    cust = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    supp = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    joined = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
    )
    # Identical lines of an order are one transfer, so that the listed columns identify a row.
    return joined.groupBy(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        millis("l_shipdate").alias("ts_ms"),
        F.concat(F.lit("chain"), (F.col("s_nationkey") % 3).cast("string")).alias("chain"),
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("symbol"),
        F.when(out, cust).otherwise(supp).alias("from_addr"),
        F.when(out, supp).otherwise(cust).alias("to_addr"),
    ).agg(F.sum("l_quantity").alias("amount"), F.sum("l_extendedprice").alias("usd_value")).withColumn(
        "stable", F.lit(True)
    )


TRANSFER_ORDER = ["ts_ms", "order_id", "line", "chain", "symbol", "from_addr", "to_addr"]


def cex_wallets(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey % 10 = 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("address"), F.col("c_name").alias("label"))


def bridges(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("address"), F.col("s_name").alias("label"))


def pool_reserves(spark, sf) -> DataFrame:
    from tapevigil.operators.series import row_index

    e = table(spark, sf, "events").select(
        F.concat(F.upper("event_type"), F.lit("/WETH")).alias("pool"), millis("ts").alias("ts_ms"), "event_id",
        F.col("value").alias("tvl_usd"), F.lit("chain0").alias("chain"))
    return row_index(e, ["pool"], ["ts_ms", "event_id"], "block", block_ms=DAY)


def posts(spark, sf) -> DataFrame:
    e, d = table(spark, sf, "events"), table(spark, sf, "documents")
    return e.join(d, F.col("doc_id") == F.col("event_id")).select(
        F.col("event_id").alias("post_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author_id"),
        "text",
        millis("ts").alias("ts_ms"),
        F.upper("event_type").alias("ticker"),
        (F.col("user_id") % 60 + 0.01 * (F.col("user_id") % 7)).alias("author_age_days"),
        ((F.col("user_id") * 7) % 500).alias("author_followers"),
    )


def texts(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    m, u = F.col("event_id") % 6, F.col("user_id") % 8
    lead = F.when(m == 0, "very").when(m == 1, "not").when(m == 2, "slightly").when(m == 3, "totally not").otherwise("looks")
    mood = (
        F.when(u == 0, "bullish").when(u == 1, "bearish").when(u == 2, "moon").when(u == 3, "scam")
        .when(u == 4, "up").when(u == 5, "weak").when(u == 6, "breakout rally").otherwise("steady")
    )
    return e.select(
        F.col("event_id").alias("post_id"), F.upper("event_type").alias("ticker"), millis("ts").alias("ts_ms"),
        F.concat(F.lit("$"), F.upper("event_type"), F.lit(" "), lead, F.lit(" "), mood,
                 F.lit(" see https://example.org/a by @user")).alias("text"))


def signals(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("signal_id"), F.upper("event_type").alias("asset_pair"),
        F.lit("aggregate").alias("venue"), millis("ts").alias("ts_ms"),
        F.least(F.lit(100.0), 50 + F.col("value") * 0.5).alias("score"))


def vectors(spark, sf) -> DataFrame:
    from tapevigil.operators.features import with_neutral

    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    known = {
        "volume_z": v / 20.7 - 1.5, "volume_spike_ratio": 1 + v / 30,
        "obi": (u % 20 - 10) / 10.0, "obi_abs": F.abs((u % 20 - 10) / 10.0), "obi_z": (e % 13 - 6) * 0.8,
        "cvd_z": (e % 17 - 8) * 0.7, "cvd_divergence": (e % 11 - 5) / 6.0, "wall_activity": (e % 5) * 0.5,
        "whale_inflow_z": (u % 9) * 0.6, "net_flow_norm": (e % 7 - 3) / 4.0, "liquidity_drop": (u % 10) / 12.0,
        "mention_z": (e % 19) * 0.4, "sentiment": (e % 21 - 10) / 11.0, "sentiment_abs": F.abs((e % 21 - 10) / 11.0),
        "bot_farm_score": (u % 25) / 25.0, "spread_bps": (e % 4) * 0.6,
    }
    return with_neutral(table(spark, sf, "events"), known, [
        e.alias("event_id"), F.upper("event_type").alias("asset"), millis("ts").alias("ts_ms"),
        ((e % 3 + 1) / 3.0).alias("coverage"),
        F.when(e % 3 == 0, 1).otherwise(0).alias("label"),
        F.concat(F.lit("s"), (u % 4).cast("string")).alias("scenario"),
    ])


def market_events(spark, sf) -> DataFrame:
    """Normalised events of every metric, derived row by row from the event table."""
    from tapevigil.sources.events import as_events

    e, u, x = F.col("event_id"), F.col("user_id"), F.col("value")
    names = F.array(*[F.lit(m) for m in EVENT_METRICS])
    kind = (e % len(EVENT_METRICS) + 1).cast("int")
    metric = F.element_at(names, kind)
    raw = (
        F.when(metric == "order_book", (u % 20 - 10) / 10.0).when(metric == "social_sentiment", (e % 21 - 10) / 11.0)
        .when(metric == "bot_farm", (u % 25) / 25.0).when(metric == "liquidity", -(u % 60).cast("double")).otherwise(x)
    )
    source = F.when(kind <= 3, "exchange").when(kind <= 6, "onchain").otherwise("social")
    meta = F.struct(
        (1 + x / 30).alias("spike_ratio"), ((e % 4) * 3.0).alias("spread_bps"), (e % 3).alias("spoofed_walls"),
        (u % 2).alias("absorbed_walls"), ((e % 11 - 5) / 6.0).alias("divergence"),
        F.when(u % 2 == 0, "inflow").otherwise("outflow").alias("direction"),
        F.when(u % 5 == 0, '{"bridge":"b"}').alias("bridge_precursor"), x.alias("acceleration"),
    )
    return as_events(table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.lpad(e.cast("string"), 12, "0")).alias("event_id"), millis("ts").alias("ts_ms"),
        source.alias("source_type"), F.concat(F.lit("v"), (u % 3).cast("string")).alias("venue"),
        F.concat(F.upper("event_type"), F.lit("/USDT")).alias("asset_pair"), metric.alias("metric_type"),
        raw.alias("raw_value"), F.when(e % 11 != 0, (e % 17 - 8) * 0.7).alias("normalized_z_score"),
        (x * 200_000.0).alias("usd_value"), F.lit(1.0).alias("confidence"), meta.alias("meta")))


EVENT_METRICS = (
    "volume", "order_book", "cvd", "wallet_transfer", "liquidity", "bridge_flow",
    "social_mentions", "social_sentiment", "bot_farm",
)


# --- the same views as SQL ------------------------------------------------------

SQL = {
    "trades": """
select event_id as trade_id, concat('v', cast(user_id % 3 as varchar)) as venue,
       concat(upper(event_type), '/USDT') as symbol, epoch_us(ts) // 1000 as ts_ms,
       100 + cast(regexp_extract(props, '[0-9]+', 0) as int) * 0.5e0 as price,
       value as size, case when event_id % 2 = 0 then 'buy' else 'sell' end as side
from events""",
    "book_levels": """
select l_orderkey as snapshot_id, o_orderstatus as venue, o_orderpriority as symbol,
       epoch_us(o_orderdate) // 1000 as ts_ms, case when l_linestatus = 'O' then 'bid' else 'ask' end as side,
       case when l_linestatus = 'O' then 100 - 0.1e0 * l_linenumber
            else 100 + 0.1e0 * l_linenumber end as price,
       sum(l_quantity) as size
from lineitem join orders on l_orderkey = o_orderkey
group by l_orderkey, o_orderstatus, o_orderpriority, epoch_us(o_orderdate) // 1000, l_linestatus, l_linenumber""",
    "tickers": """
select *, (last_px - open_px) / open_px * 100e0
          + case when (scan + trades) % 10 = 0 then 40e0 else 0e0 end as percentage,
       (scan // 100 * 12 + scan % 100) * 3600000 as scan_ms
from (
  select concat('v', cast(l_suppkey % 4 as varchar)) as venue,
         concat(replace(p_brand, '#', ''), '/',
                case l_linenumber % 3 when 0 then 'USDT' when 1 then 'USDC' else 'EUR' end) as symbol,
         cast(year(l_shipdate) * 100 + month(l_shipdate) as bigint) as scan,
         sum(l_extendedprice) as quote_volume,
         avg(case when day(l_shipdate) <= 15 then l_extendedprice end) as open_px,
         avg(case when day(l_shipdate) > 15 then l_extendedprice end) as last_px,
         count(*) as trades
  from lineitem join part on l_partkey = p_partkey
  group by 1, 2, 3)""",
    "transfers": """
select l_orderkey as order_id, l_linenumber as line, epoch_us(l_shipdate) // 1000 as ts_ms,
       concat('chain', cast(s_nationkey % 3 as varchar)) as chain,
       replace(p_brand, '#', '') as symbol,
       case when l_returnflag = 'R' then concat('c', cast(o_custkey as varchar))
            else concat('s', cast(l_suppkey as varchar)) end as from_addr,
       case when l_returnflag = 'R' then concat('s', cast(l_suppkey as varchar))
            else concat('c', cast(o_custkey as varchar)) end as to_addr,
       sum(l_quantity) as amount, sum(l_extendedprice) as usd_value, true as stable
from lineitem join orders on l_orderkey = o_orderkey
     join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
group by 1, 2, 3, 4, 5, 6, 7""",
    "cex_wallets": """
select concat('c', cast(c_custkey as varchar)) as address, c_name as label
from customer where c_custkey % 10 = 0""",
    "bridges": """
select concat('s', cast(s_suppkey as varchar)) as address, s_name as label
from supplier where s_suppkey % 5 = 0""",
    "pool_reserves": """
select concat(upper(event_type), '/WETH') as pool, epoch_us(ts) // 1000 as ts_ms, event_id, value as tvl_usd,
       'chain0' as chain,
       row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as block
from events""",
    "posts": """
select event_id as post_id, concat('u', cast(user_id as varchar)) as author_id,
       text, epoch_us(ts) // 1000 as ts_ms, upper(event_type) as ticker,
       user_id % 60 + 0.01e0 * (user_id % 7) as author_age_days,
       (user_id * 7) % 500 as author_followers
from events join documents on doc_id = event_id""",
    "texts": """
select event_id as post_id, upper(event_type) as ticker, epoch_us(ts) // 1000 as ts_ms,
       concat('$', upper(event_type), ' ',
              case event_id % 6 when 0 then 'very' when 1 then 'not' when 2 then 'slightly'
                   when 3 then 'totally not' else 'looks' end, ' ',
              case user_id % 8 when 0 then 'bullish' when 1 then 'bearish' when 2 then 'moon'
                   when 3 then 'scam' when 4 then 'up' when 5 then 'weak'
                   when 6 then 'breakout rally' else 'steady' end,
              ' see https://example.org/a by @user') as text
from events""",
    "signals": """
select event_id as signal_id, upper(event_type) as asset_pair, 'aggregate' as venue,
       epoch_us(ts) // 1000 as ts_ms, least(100e0, 50 + value * 0.5e0) as score
from events""",
    "market_events": """
select concat('e', lpad(cast(event_id as varchar), 12, '0')) as event_id, epoch_us(ts) // 1000 as ts_ms,
       case when event_id % 9 < 3 then 'exchange' when event_id % 9 < 6 then 'onchain' else 'social' end as source_type,
       concat('v', cast(user_id % 3 as varchar)) as venue, concat(upper(event_type), '/USDT') as asset_pair,
       upper(event_type) as asset,
       ['volume', 'order_book', 'cvd', 'wallet_transfer', 'liquidity', 'bridge_flow', 'social_mentions',
        'social_sentiment', 'bot_farm'][cast(event_id % 9 + 1 as int)] as metric,
       case event_id % 9 when 1 then (user_id % 20 - 10) / 10e0 when 7 then (event_id % 21 - 10) / 11e0
            when 8 then (user_id % 25) / 25e0 when 4 then -(user_id % 60)::double else value end as raw_value,
       case when event_id % 11 <> 0 then (event_id % 17 - 8) * 0.7e0 end as z, value * 200000e0 as usd_value,
       1 + value / 30 as spike, (event_id % 4) * 3e0 as spread, event_id % 3 + user_id % 2 as walls,
       (event_id % 11 - 5) / 6e0 as divergence, case when user_id % 2 = 0 then 'inflow' else 'outflow' end as direction,
       case when user_id % 5 = 0 then 1 else 0 end as hit, value as acceleration
from events""",
    "vectors": """
select event_id, upper(event_type) as asset, epoch_us(ts) // 1000 as ts_ms,
       (event_id % 3 + 1) / 3e0 as coverage,
       case when event_id % 3 = 0 then 1 else 0 end as label,
       concat('s', cast(user_id % 4 as varchar)) as scenario,
       value / 20.7e0 - 1.5e0 as volume_z, 1 + value / 30 as volume_spike_ratio,
       (user_id % 20 - 10) / 10e0 as obi, abs((user_id % 20 - 10) / 10e0) as obi_abs,
       (event_id % 13 - 6) * 0.8e0 as obi_z, (event_id % 4) * 0.6e0 as spread_bps,
       (event_id % 17 - 8) * 0.7e0 as cvd_z,
       (event_id % 11 - 5) / 6e0 as cvd_divergence, 0e0 as venue_dispersion,
       (event_id % 5) * 0.5e0 as wall_activity, (user_id % 9) * 0.6e0 as whale_inflow_z,
       (event_id % 7 - 3) / 4e0 as net_flow_norm, (user_id % 10) / 12e0 as liquidity_drop,
       0e0 as bridge_activity, 0e0 as bridge_to_cex,
       (event_id % 19) * 0.4e0 as mention_z, 0e0 as mention_accel,
       (event_id % 21 - 10) / 11e0 as sentiment, abs((event_id % 21 - 10) / 11e0) as sentiment_abs,
       (user_id % 25) / 25e0 as bot_farm_score
from events""",
}


def with_views(*names: str, body: str) -> str:
    """SQL text: the named views as common table expressions, then the body.

    A body may go on with more expressions by starting with a comma.
    """
    views = ",\n".join(f"{n} as ({SQL[n].strip()})" for n in names)
    body = body.strip()
    glue = "" if body.startswith(",") else "\n"
    return f"with recursive {views}{glue}{body}" if views else body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column, so that summation order does not matter to a comparison."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])
