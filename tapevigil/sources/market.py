"""Raw venue messages to trades and books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.schemas import LEVELS

TRADE_COLUMNS = ["venue", "symbol", "ts_ms", "price", "size", "side"]
BOOK_COLUMNS = ["venue", "symbol", "ts_ms", "bids", "asks"]

_PAIRS = "array<array<string>>"
_PV = "array<struct<p:string,v:string>>"


def normalise_trades(raw: DataFrame) -> DataFrame:
    """Drop non-positive prices and sizes; anything not explicitly another side is a buy."""
    side = F.when(F.coalesce(F.nullif("side", F.lit("")), F.lit("buy")) == "buy", "buy").otherwise("sell")
    return raw.where((F.col("price") > 0) & (F.col("size") > 0)).withColumn("side", side)


def _from_pairs(levels: Column, depth: int | None = None) -> Column:
    levels = F.slice(levels, 1, depth) if depth else levels
    return F.transform(levels, lambda l: F.struct(
        l[0].cast("double").alias("price"), l[1].cast("double").alias("size")))


def _from_structs(levels: Column) -> Column:
    return F.transform(levels, lambda l: F.struct(
        l["p"].cast("double").alias("price"), l["v"].cast("double").alias("size")))


def _levels(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(LEVELS))


# Message shapes of the three supported venue dialects.
_BINANCE_BODY = f"e:string,T:bigint,p:string,q:string,m:boolean,bids:{_PAIRS},asks:{_PAIRS},b:{_PAIRS},a:{_PAIRS}"
_BINANCE = f"struct<stream:string,data:struct<{_BINANCE_BODY}>,{_BINANCE_BODY}>"
_BYBIT_BOOK = f"struct<topic:string,ts:bigint,data:struct<b:{_PAIRS},a:{_PAIRS}>>"
_BYBIT_TRADE = "struct<topic:string,ts:bigint,data:array<struct<T:bigint,p:string,v:string,S:string>>>"
_MEXC_DATA = f"struct<bids:{_PV},asks:{_PV},deals:array<struct<t:bigint,p:string,v:string,S:string>>>"
_MEXC = f"struct<c:string,channel:string,t:bigint,d:{_MEXC_DATA},data:{_MEXC_DATA}>"


def _parse(messages: DataFrame, venue: str, shape: str) -> DataFrame:
    return messages.where(F.col("venue") == venue).withColumn("m", F.from_json("raw", shape))


def _binance(messages: DataFrame) -> DataFrame:
    parsed = _parse(messages, "binance", _BINANCE)
    names = ("e", "T", "p", "q", "m", "bids", "asks", "b", "a")
    data = F.when(F.col("m.data").isNotNull(), F.col("m.data")).otherwise(
        F.struct(*[F.col(f"m.{n}").alias(n) for n in names])
    )
    # The event time key differs from the event type key only in case, so it is read by path.
    event_ms = F.coalesce(F.get_json_object("raw", "$.data.E"), F.get_json_object("raw", "$.E")).cast("bigint")
    is_book = F.coalesce(F.col("m.stream").contains("depth"), F.lit(False)) | (
        F.col("d.bids").isNotNull() & F.col("d.asks").isNotNull()
    )
    return parsed.withColumn("d", data).withColumn("event_ms", event_ms).withColumn("is_book", is_book)


def trades_from_messages(messages: DataFrame) -> DataFrame:
    """Trades out of raw messages: venue, symbol, raw (JSON text), recv_ms."""
    recv = F.col("recv_ms")
    binance = _binance(messages).where(~F.col("is_book") & (F.col("d.e") == "aggTrade")).select(
        "venue", "symbol", F.coalesce("d.T", recv).alias("ts_ms"),
        F.col("d.p").cast("double").alias("price"), F.col("d.q").cast("double").alias("size"),
        # The buyer being the maker means the aggressor sold.
        F.when(F.coalesce("d.m", F.lit(False)), "sell").otherwise("buy").alias("side"),
    )
    bybit = (
        _parse(messages, "bybit", _BYBIT_TRADE)
        .where(F.col("m.topic").startswith("publicTrade"))
        .withColumn("t", F.explode("m.data"))
        .select(
            "venue", "symbol", F.coalesce("t.T", recv).alias("ts_ms"),
            F.col("t.p").cast("double").alias("price"), F.col("t.v").cast("double").alias("size"),
            F.when(F.lower(F.coalesce("t.S", F.lit("buy"))) == "buy", "buy").otherwise("sell").alias("side"),
        )
    )
    mexc = (
        _parse(messages, "mexc", _MEXC)
        .where(~_channel().contains("depth") & _channel().contains("deals"))
        .withColumn("t", F.explode(F.coalesce("m.d.deals", "m.data.deals")))
        .select(
            "venue", "symbol", F.coalesce("t.t", recv).alias("ts_ms"),
            F.col("t.p").cast("double").alias("price"), F.col("t.v").cast("double").alias("size"),
            F.when(F.coalesce("t.S", F.lit("1")) == "1", "buy").otherwise("sell").alias("side"),
        )
    )
    return binance.unionByName(bybit).unionByName(mexc)


def _channel() -> Column:
    return F.coalesce("m.c", "m.channel", F.lit(""))


def books_from_messages(messages: DataFrame) -> DataFrame:
    """Book snapshots out of raw messages."""
    recv = F.col("recv_ms")
    binance = _binance(messages).where("is_book").select(
        "venue", "symbol", F.coalesce("event_ms", recv).alias("ts_ms"),
        _levels(_from_pairs(F.coalesce("d.bids", "d.b"))).alias("bids"),
        _levels(_from_pairs(F.coalesce("d.asks", "d.a"))).alias("asks"),
    )
    bybit = _parse(messages, "bybit", _BYBIT_BOOK).where(
        F.col("m.topic").startswith("orderbook") & F.col("m.data").isNotNull()
    ).select(
        "venue", "symbol", F.coalesce("m.ts", recv).alias("ts_ms"),
        _levels(_from_pairs(F.col("m.data.b"))).alias("bids"),
        _levels(_from_pairs(F.col("m.data.a"))).alias("asks"),
    )
    mexc = _parse(messages, "mexc", _MEXC).where(_channel().contains("depth")).select(
        "venue", "symbol", F.coalesce("m.t", recv).alias("ts_ms"),
        _levels(_from_structs(F.coalesce("m.d.bids", "m.data.bids"))).alias("bids"),
        _levels(_from_structs(F.coalesce("m.d.asks", "m.data.asks"))).alias("asks"),
    )
    return binance.unionByName(bybit).unionByName(mexc)
