"""Decoders for token transfer logs, pool reserves and balance differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.functions.scalars import bind
from tapevigil.sources.registry import address_key

# Fixed value: topic of the ERC-20 Transfer(address,address,uint256) event.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"

LIMB = 16


def hex_double(digits: Column) -> Column:
    """Unsigned hex digits of any length as DOUBLE, in 64-bit limbs."""
    def combine(padded: Column) -> Column:
        limbs = F.transform(
            F.sequence(F.lit(0), (F.length(padded) / LIMB).cast("int") - 1),
            lambda i: F.conv(F.substr(padded, i * LIMB + 1, F.lit(LIMB)), 16, 10).cast("double"),
        )
        return F.aggregate(limbs, F.lit(0.0), lambda acc, v: acc * float(2**64) + v)

    width = (F.ceil(F.length(digits) / LIMB) * LIMB).cast("int")
    return F.when(F.length(digits) > 0, bind(F.lpad(digits, width, "0"), combine)).otherwise(F.lit(0.0))


def number(text: Column) -> Column:
    """0x-hex or decimal text; NULL or anything unreadable counts as 0."""
    is_hex = text.rlike("^0x[0-9a-fA-F]+$")
    return F.when(is_hex, hex_double(F.substr(text, F.lit(3)))).otherwise(
        F.coalesce(F.when(text.rlike("^[+-]?[0-9]+$"), text.cast("double")), F.lit(0.0))
    )


def transfer_logs(logs: DataFrame) -> DataFrame:
    """ERC-20 transfers: token, from_addr, to_addr, raw_amount, block, tx_hash, log_index."""
    is_transfer = (F.size("topics") >= 3) & (F.lower(F.try_element_at("topics", F.lit(1))) == TRANSFER_TOPIC)
    # CASE keeps the topic reads behind the size check.
    topic = lambda i: F.lower(F.right(F.try_element_at("topics", F.lit(i)), F.lit(40)))
    carried = [c for c in ("chain", "ts_ms") if c in logs.columns]
    return logs.where(is_transfer).select(
        *carried,
        F.lower(F.coalesce("address", F.lit(""))).alias("token"),
        F.concat(F.lit("0x"), topic(2)).alias("from_addr"),
        F.concat(F.lit("0x"), topic(3)).alias("to_addr"),
        number(F.col("data")).alias("raw_amount"),
        number(F.col("blockNumber")).cast("bigint").alias("block"),
        F.coalesce("transactionHash", F.lit("")).alias("tx_hash"),
        number(F.col("logIndex")).cast("bigint").alias("log_index"),
    )


def token_amounts(transfers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Keep transfers of known tokens; scale raw_amount and value it in USD.

    The token list is small and read from a table, so whether it is broadcast is
    left to the size check of the optimiser.
    """
    t = tokens.select(
        "chain", F.col("address").alias("__token"), "symbol", "decimals", "price_usd", "stable"
    )
    return (
        transfers.withColumn("__token", address_key(F.col("token")))
        .join(t, ["chain", "__token"])
        .withColumn("amount", F.col("raw_amount") / F.pow(F.lit(10.0), F.col("decimals")))
        .withColumn("usd_value", F.col("amount") * F.col("price_usd"))
        .drop("__token")
    )


def pool_reserves(calls: DataFrame, column: str = "raw") -> DataFrame:
    """getReserves() payloads: reserve0, reserve1, reserve_ts; NULL when too short."""
    raw = F.col(column)
    whole = F.length(raw) >= 194
    word = lambda i: F.substr(raw, F.lit(3 + 64 * i), F.lit(64))
    return (
        calls.withColumn("reserve0", F.when(whole, hex_double(word(0))))
        .withColumn("reserve1", F.when(whole, hex_double(word(1))))
        .withColumn("reserve_ts", F.when(whole, hex_double(word(2)).cast("bigint")))
    )


def balance_changes(txs: DataFrame) -> DataFrame:
    """Per (transaction, account, mint) balance change above 1e-12, without a shuffle.

    `pre` and `post` are ARRAY<STRUCT<accountIndex, mint, owner, uiAmount>> of the
    same transaction, so the outer join of the two lists happens inside the row.
    """
    empty = F.array().cast("array<struct<accountIndex:int,mint:string,owner:string,uiAmount:double>>")
    pre, post = F.coalesce("pre", empty), F.coalesce("post", empty)

    def ids(side: Column) -> Column:
        return F.transform(side, lambda b: F.struct(b["accountIndex"].alias("i"), b["mint"].alias("m")))

    def pick(side: Column, key: Column) -> Column:
        same = F.filter(side, lambda b: b["accountIndex"].eqNullSafe(key["i"]) & b["mint"].eqNullSafe(key["m"]))
        return F.try_element_at(same, F.lit(-1))

    def owner(side: Column, key: Column) -> Column:
        return F.nullif(pick(side, key)["owner"], F.lit(""))

    zero = F.lit(0.0)
    changes = F.transform(
        F.array_distinct(F.concat(ids(pre), ids(post))),
        lambda k: F.struct(
            k["m"].alias("mint"),
            F.coalesce(owner(post, k), owner(pre, k), F.lit("")).alias("owner"),
            k["i"].alias("account_index"),
            (F.coalesce(pick(post, k)["uiAmount"], zero) - F.coalesce(pick(pre, k)["uiAmount"], zero)).alias("delta"),
            F.coalesce(pick(post, k)["uiAmount"], zero).alias("post_balance"),
        ),
    )
    kept = F.filter(changes, lambda c: F.abs(c["delta"]) >= 1e-12)
    rest = [c for c in txs.columns if c not in ("pre", "post")]
    return txs.select(*rest, F.explode(kept).alias("c")).select(*rest, "c.*")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the earliest; pre-aggregated map-side, so hot keys shuffle once."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def new_signatures(signatures: DataFrame, order: list[str]) -> DataFrame:
    """Successful, non-empty signatures, each once."""
    ok = signatures.where((F.coalesce("signature", F.lit("")) != "") & F.col("err").isNull())
    return first_seen(ok, ["signature"], order)
