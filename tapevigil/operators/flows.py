"""Transfer, bridge and pool operators.

Transfers: chain, symbol, ts_ms, from_addr, to_addr, amount, usd_value plus
whatever identifies a row (`order` must be a total order led by ts_ms).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapevigil.functions.kernels import last_in_band, ratio_band
from tapevigil.operators.rolling import dynamic_z
from tapevigil.operators.series import CHUNK, DEFAULT_BLOCK_MS, HALO, POS, positions, row_chunks, running, spread, with_previous
from tapevigil.plans.storage import settle
from tapevigil.sources.registry import address_key

FLOW_KEYS = ["chain", "symbol"]

#: Rows of each side that one task of a match holds.
MATCH_ROWS = 1 << 15


def with_labels(transfers: DataFrame, registry: DataFrame, prefix: str) -> DataFrame:
    """Left-join a label table (address, label) on both ends of each transfer."""
    out = transfers
    for end in ("from", "to"):
        side = registry.select(
            F.col("address").alias(f"__{end}_key"), F.col("label").alias(f"{prefix}_{end}")
        )
        out = (
            out.withColumn(f"__{end}_key", address_key(F.col(f"{end}_addr")))
            .join(side, f"__{end}_key", "left")
            .drop(f"__{end}_key")
        )
    return out


def direction(from_label: Column, to_label: Column) -> Column:
    f, t = from_label.isNotNull(), to_label.isNotNull()
    return (
        F.when(f & t, "internal").when(t, "inflow").when(f, "outflow").otherwise("unrelated")
    )


def whale_transfers(transfers: DataFrame, wallets: DataFrame, threshold_usd: float = 500_000.0) -> DataFrame:
    """Large deposits to and withdrawals from known wallets, with the wallet's label."""
    big = transfers.where(F.col("usd_value") >= threshold_usd)
    labelled = with_labels(big, wallets, "cex").withColumn(
        "direction", direction(F.col("cex_from"), F.col("cex_to"))
    )
    return (
        labelled.where(F.col("direction").isin("inflow", "outflow"))
        .withColumn("counterparty", F.coalesce("cex_to", "cex_from"))
        .drop("cex_from", "cex_to")
    )


def balance_whales(changes: DataFrame, tokens: DataFrame, wallets: DataFrame,
                   threshold_usd: float = 500_000.0, chain: str = "solana") -> DataFrame:
    """Large balance changes of known wallets or of the watched wallet."""
    t = tokens.where(F.col("chain") == chain).select(
        F.col("address").alias("__mint"), "symbol", "price_usd"
    )
    labels = wallets.select(F.col("address").alias("__owner"), F.col("label").alias("__label"))
    usd = F.abs("delta") * F.col("price_usd")
    inflow = F.col("delta") > 0
    return (
        changes.withColumn("__mint", address_key(F.col("mint")))
        .join(t, "__mint")
        .withColumn("usd_value", usd)
        .where(F.col("usd_value") >= threshold_usd)
        .withColumn("__owner", address_key(F.col("owner")))
        .join(labels, "__owner", "left")
        .where(F.col("__label").isNotNull() | (F.col("owner") == F.col("wallet")))
        .select(
            F.lit(chain).alias("chain"), F.col("mint").alias("token"), "symbol",
            F.when(inflow, "").otherwise(F.col("owner")).alias("from_addr"),
            F.when(inflow, F.col("owner")).otherwise("").alias("to_addr"),
            F.abs("delta").alias("amount"), "usd_value",
            F.when(inflow, "inflow").otherwise("outflow").alias("direction"),
            F.coalesce("__label", F.lit("unknown_sol_cex")).alias("counterparty"),
            F.col("signature").alias("tx_hash"), F.col("slot").alias("block"), "ts_ms",
        )
    )


def bridge_flows(transfers: DataFrame, bridges: DataFrame, threshold_usd: float = 1_000_000.0) -> DataFrame:
    """Large stable-token transfers with a bridge on either side (`stable` column)."""
    big = transfers.where((F.col("usd_value") >= threshold_usd) & F.col("stable"))
    labelled = with_labels(big, bridges, "bridge")
    return (
        labelled.where(F.col("bridge_from").isNotNull() | F.col("bridge_to").isNotNull())
        .withColumn("bridge", F.coalesce("bridge_to", "bridge_from"))
        .withColumn(
            "direction", F.when(F.col("bridge_to").isNotNull(), "into_bridge").otherwise("out_of_bridge")
        )
        .drop("bridge_from", "bridge_to")
    )


def signed_usd() -> Column:
    return F.when(F.col("direction") == "inflow", F.col("usd_value")).otherwise(-F.col("usd_value"))


def net_flow(whales: DataFrame, order: Sequence[str], block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """Running deposits minus withdrawals per (chain, symbol)."""
    return running(whales, FLOW_KEYS, order, {"net_flow_usd": signed_usd()}, block_ms=block_ms)


def flow_scores(whales: DataFrame, order: Sequence[str], block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """z of |usd| per (chain, symbol)."""
    sized = whales.withColumn("__usd", F.abs("usd_value"))
    return dynamic_z(sized, FLOW_KEYS, order, "__usd", half_life_s=1800.0, window=200, warmup=8,
                     base_threshold=2.5, out="flow_z", threshold=None, block_ms=block_ms).drop("__usd")


def match_bridges(whales: DataFrame, flows: DataFrame, order: Sequence[str], flow_id: str,
                  window_ms: int = 1_800_000, min_ratio: float = 0.75, chunk_rows: int = MATCH_ROWS) -> DataFrame:
    """For every deposit the latest earlier bridge flow of similar size, any token or chain.

    min/max of the two USD values >= min_ratio means their logs differ by at most
    ln(1/min_ratio). Both sides are put into log-size cells several times that wide; only
    flows near a border are copied across it. Inside a cell each side is cut by time into
    chunks of at most `chunk_rows` rows, and a chunk of deposits meets only the chunks of
    flows that its window reaches, one pair of chunks in a task. There a tree finds each
    deposit's latest fitting flow in logarithmic time; the latest of all chunks is kept. Adds
    `precursor` (bridge, usd, lag_s, size_ratio, flow_id), NULL when nothing fits; of flows
    at one time the one with the greatest id. Rows without time or size match nothing.
    """
    reach = float(np.log(1.0 / min_ratio)) * (1.0 + 1e-9)
    width = 4.0 * reach
    size = F.log("usd_value")

    def cell(shift: float) -> Column:
        return F.floor((size + shift) / width).cast("bigint")

    known = (F.col("usd_value") > 0) & F.col("ts_ms").isNotNull()
    rows = settle(whales.withColumn("__row", F.monotonically_increasing_id()))
    deposits = rows.where((F.col("direction") == "inflow") & known).select("__row", "ts_ms", "usd_value", cell(0.0).alias("__cell"))
    nearby = flows.where(known).select(
        F.col("ts_ms").alias("f_ts"), F.col("usd_value").alias("f_usd"), F.col("bridge").alias("f_bridge"),
        F.col(flow_id).alias("f_id"), F.explode(F.array_distinct(F.array(cell(-reach), cell(reach)))).alias("__cell"),
    )

    def cut(side: DataFrame, by: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        """The rows with their chunk, and the chunks with their first and last time."""
        chunked = row_chunks(positions(side, ["__cell"], by)[0], 0, chunk_rows).withColumnRenamed(CHUNK, name).drop(HALO, POS)
        return chunked, chunked.groupBy("__cell", name).agg(F.min(by[0]).alias(f"{name}_from"), F.max(by[0]).alias(f"{name}_to"))

    deposits, d_chunks = cut(deposits, ["ts_ms", "__row"], "__d")
    nearby, f_chunks = cut(nearby, ["f_ts", "f_id"], "__f")
    reached = (F.col("__f_from") <= F.col("__d_to")) & (F.col("__f_to") >= F.col("__d_from") - window_ms)
    pairs = settle(d_chunks.join(f_chunks, "__cell").where(reached).select("__cell", "__d", "__f"))
    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField("f_ts", T.LongType()), T.StructField("precursor", T.StructType([
        T.StructField("bridge", T.StringType()),
        T.StructField("usd", T.DoubleType()),
        T.StructField("lag_s", T.DoubleType()),
        T.StructField("size_ratio", T.DoubleType()),
        T.StructField("flow_id", flows.schema[flow_id].dataType),
    ]))])

    def latest_fit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["f_ts", "f_id"], kind="stable").reset_index(drop=True)
        f_ts, ts, usd = right["f_ts"].to_numpy(), left["ts_ms"].to_numpy(), left["usd_value"].to_numpy(float)
        at = last_in_band(right["f_usd"].to_numpy(float), *ratio_band(usd, min_ratio), np.searchsorted(f_ts, ts, "right"))
        fits = np.flatnonzero((at >= 0) & (f_ts[at] >= ts - window_ms)) if len(f_ts) else []
        out, chosen = left.iloc[fits], right.iloc[at[fits]]
        matched = [
            {"bridge": bridge, "usd": size, "lag_s": round((t - f) / 1000.0, 1), "size_ratio": round(min(size, u) / max(size, u), 3), "flow_id": i}
            for bridge, size, i, f, t, u in zip(*(chosen[c].tolist() for c in ("f_bridge", "f_usd", "f_id", "f_ts")), out["ts_ms"].tolist(), out["usd_value"].tolist())
        ]
        return pd.DataFrame({"__row": out["__row"].to_numpy(), "f_ts": chosen["f_ts"].to_numpy(), "precursor": pd.Series(matched, dtype=object)})

    meet = ["__cell", "__d", "__f"]
    matched = (
        spread(deposits.join(pairs, ["__cell", "__d"]), *meet).groupBy(*meet)
        .cogroup(spread(nearby.join(pairs, ["__cell", "__f"]), *meet).groupBy(*meet))
        .applyInPandas(latest_fit, schema)
    )
    best = matched.groupBy("__row").agg(F.max_by("precursor", F.struct("f_ts", "precursor.flow_id")).alias("precursor"))
    return rows.join(best, "__row", "left").drop("__row")


def pool_tvl(reserves: DataFrame, tokens: DataFrame) -> DataFrame:
    """TVL from whichever side has a price (side 1 first), doubled; unpriced pools add amounts."""
    prices = tokens.groupBy("symbol").agg(F.first("price_usd").alias("__p"))
    out = reserves
    for side in ("0", "1"):
        p = prices.select(F.col("symbol").alias(f"__s{side}"), F.col("__p").alias(f"__p{side}"))
        out = (
            out.withColumn(f"__s{side}", F.upper(f"token{side}"))
            .join(p, f"__s{side}", "left")
            .withColumn(f"amount{side}", F.col(f"reserve{side}") / F.pow(F.lit(10.0), F.col(f"decimals{side}")))
        )
    tvl = (
        F.when(F.col("__p1") > 0, F.col("amount1") * F.col("__p1") * 2)
        .when(F.col("__p0") > 0, F.col("amount0") * F.col("__p0") * 2)
        .otherwise(F.col("amount0") + F.col("amount1"))
    )
    return out.withColumn("tvl_usd", tvl).drop("__s0", "__s1", "__p0", "__p1")


def liquidity_drains(pools: DataFrame, order: Sequence[str], keys: Sequence[str] = ("pool",),
                     min_drop_pct: float = 30.0, max_blocks: int = 3,
                     block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """Polls whose TVL fell by min_drop_pct or more since the previous poll, within max_blocks."""
    prev = with_previous(pools, list(keys), order, {"prev_tvl_usd": "tvl_usd", "__prev_block": "block"},
                         block_ms=block_ms)
    was = F.col("prev_tvl_usd")
    elapsed = F.greatest(F.lit(1), F.col("block") - F.col("__prev_block"))
    return (
        prev.where(was > 0)
        .withColumn("drop_pct", (was - F.col("tvl_usd")) / was * 100.0)
        .withColumn("blocks_elapsed", elapsed)
        .where((F.col("drop_pct") >= min_drop_pct) & (F.col("blocks_elapsed") <= max_blocks))
        .drop("__prev_block")
    )


def _event(prefix: str, event_id: Sequence[str], venue: str, asset: Column, metric: str, raw: Column,
           z: Column, usd: Column, meta: Column) -> list[Column]:
    return [
        F.concat_ws("-", F.lit(prefix), *[F.col(c).cast("string") for c in event_id]).alias("event_id"),
        F.col("ts_ms"),
        F.lit("onchain").alias("source_type"),
        F.col(venue).alias("venue"),
        asset.alias("asset_pair"),
        F.lit(metric).alias("metric_type"),
        raw.alias("raw_value"),
        z.alias("normalized_z_score"),
        usd.alias("usd_value"),
        F.lit(1.0).alias("confidence"),
        meta.alias("meta"),
    ]


def transfer_events(whales: DataFrame, event_id: Sequence[str]) -> DataFrame:
    """wallet_transfer events from rows carrying flow_z, net_flow_usd and precursor."""
    meta = F.struct(
        "direction", "counterparty", F.round("net_flow_usd", 2).alias("net_flow_usd"),
        F.when(F.col("precursor").isNotNull(), F.to_json("precursor")).alias("bridge_precursor"),
    )
    return whales.select(*_event("wt", event_id, "chain", F.col("symbol"), "wallet_transfer",
                                 F.col("amount"), F.col("flow_z"), F.col("usd_value"), meta))


def bridge_events(flows: DataFrame, event_id: Sequence[str]) -> DataFrame:
    return flows.select(*_event("br", event_id, "chain", F.col("symbol"), "bridge_flow", F.col("amount"),
                                F.lit(None).cast("double"), F.col("usd_value"),
                                F.struct("bridge", "direction")))


def liquidity_events(drains: DataFrame, event_id: Sequence[str], min_drop_pct: float = 30.0,
                     venue: str = "chain") -> DataFrame:
    """Drains on the event scale: raw = -drop%, pseudo z = min(10, 3 * drop / threshold)."""
    z = F.least(F.lit(10.0), F.col("drop_pct") / max(min_drop_pct, 1e-9) * 3.0)
    meta = F.struct(
        "pool", F.round("prev_tvl_usd", 2).alias("prev_tvl_usd"), F.round("tvl_usd", 2).alias("new_tvl_usd"),
        F.round("drop_pct", 2).alias("drop_pct"), "block",
    )
    return drains.select(*_event("lq", event_id, venue, F.upper(F.substring_index("pool", "/", 1)),
                                 "liquidity", -F.col("drop_pct"), z, F.col("tvl_usd"), meta))


def recent_whales(whales: DataFrame, order: Sequence[str], symbol: str | None = None, n: int = 12) -> DataFrame:
    """The newest transfers, optionally of one symbol."""
    chosen = whales if symbol is None else whales.where(F.col("symbol") == symbol)
    return chosen.orderBy(*[F.desc(c) for c in order]).limit(n)


def whale_totals(whales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inflow, outflow, net and the pressure they imply."""
    usd = F.col("usd_value")
    totals = whales.groupBy(*by).agg(
        F.sum(F.when(F.col("direction") == "inflow", usd).otherwise(0.0)).alias("inflow_usd"),
        F.sum(F.when(F.col("direction") == "outflow", usd).otherwise(0.0)).alias("outflow_usd"),
        F.count(F.lit(1)).alias("transfers"),
    )
    net = F.col("inflow_usd") - F.col("outflow_usd")
    return totals.withColumn("net_usd", net).withColumn(
        "pressure",
        F.when(net > 0, "sell pressure building").otherwise("accumulation / supply squeeze"),
    )


def flow_board(whales: DataFrame, n: int = 15) -> DataFrame:
    """Largest absolute net flows by (chain, symbol)."""
    return (
        whales.groupBy(*FLOW_KEYS).agg(F.sum(signed_usd()).alias("net_flow_usd"))
        .orderBy(F.desc(F.abs("net_flow_usd")), *FLOW_KEYS)
        .limit(n)
    )


def recent_bridges(flows: DataFrame, order: Sequence[str], n: int = 4) -> DataFrame:
    return flows.orderBy(*[F.desc(c) for c in order]).limit(n)
