"""Known wallets, bridges, tokens and pools as small tables, and address keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labelled exchange wallets (chain, address, label).
CEX_WALLETS = (
    ("ethereum", "0x28c6c06298d514db089934071355e5743bf21d60", "binance_14"),
    ("ethereum", "0x21a31ee1afc51d94c2efccaa2092ad1028285549", "binance_15"),
    ("ethereum", "0xdfd5293d8e347dfe59e90efd55b2956a1343963d", "binance_16"),
    ("ethereum", "0x56eddb7aa87536c09ccc2793473599fd21a8b17f", "binance_17"),
    ("ethereum", "0x9696f59e4d72e237be84ffd425dcad154bf96976", "binance_18"),
    ("ethereum", "0x4976a4a02f38326660d17bf34b431dc6e2eb2327", "binance_19"),
    ("ethereum", "0xf977814e90da44bfa03b6295a0616a897441acec", "binance_cold_8"),
    ("ethereum", "0xa9d1e08c7793af67e9d92fe308d5697fb81d3e43", "coinbase_10"),
    ("ethereum", "0x71660c4005ba85c37ccec55d0c4493e66fe775d3", "coinbase_1"),
    ("ethereum", "0x503828976d22510aad0201ac7ec88293211d23da", "coinbase_2"),
    ("ethereum", "0xddfabcdc4d8ffc6d5beaf154f18b778f892a0740", "coinbase_3"),
    ("ethereum", "0xf89d7b9c864f589bbf53a82105107622b35eaa40", "bybit_hot"),
    ("ethereum", "0xa7efae728d2936e78bda97dc267687568dd593f3", "okx_hot"),
    ("ethereum", "0x0d0707963952f2fba59dd06f2b425ace40b492fe", "gate_hot"),
    ("ethereum", "0x1c4b70a3968436b9a0a9cf5205c787eb81bb558c", "gate_2"),
    ("ethereum", "0x0211f3cedbef3143223d3acf0e589747933e8527", "mexc_hot"),
    ("ethereum", "0x3cc936b795a188f0e246cbb2d74c5bd190aecf18", "mexc_2"),
    ("ethereum", "0x75e89d5979e4f6fba9f97c104c2f0afb3f1dcb88", "mexc_3"),
    ("ethereum", "0x2b5634c42055806a59e9107ed44d43c426e58258", "kucoin_hot"),
    ("ethereum", "0x46340b20830761efd32832a74d7169b29feb9758", "crypto_com"),
    ("bsc", "0x8894e0a0c962cb723c1976a4421c95949be2d4e3", "binance_bsc_hot"),
    ("bsc", "0xe2fc31f816a9b94326492132018c3aecc4a93ae1", "binance_bsc_2"),
    ("bsc", "0x4982085c9e2f89f2ecb8131eca71afad896e89cb", "mexc_bsc"),
    ("solana", "5tzFkiKscXHK5ZXCGbXZxdw7gTjjD1mBwuoFbhUvuAi9", "binance_sol_hot"),
    ("solana", "9WzDXwBbmkg8ZTbNMqUxvQRAyrZzDsGYdLVL9zYtAWWM", "binance_sol_2"),
    ("solana", "2ojv9BAiHUrvsm9gxDe7fJSzbNZSJcxZvf8dqmWGHG8S", "coinbase_sol"),
    ("solana", "AC5RDfQFmDS1deWZos921JfqscXdByf8BKHs5ACWjtW2", "bybit_sol"),
    ("solana", "ASTyfSima4LLAdDgoFGkgqoKowG1LZFDr9fAQrg7iaJZ", "mexc_sol"),
)

# Bridge contracts (chain, address, label).
BRIDGES = (
    ("ethereum", "0x8484ef722627bf18ca5ae6bcf031c23e6e922b30", "polygon_pos_erc20"),
    ("ethereum", "0xa0c68c638235ee32657e8f720a23cec1bfc77c77", "polygon_pos_plasma"),
    ("ethereum", "0x3ee18b2214aff97000d974cf647e7c347e8fa585", "wormhole_portal"),
    ("ethereum", "0x99c9fc46f92e8a1c0dec1b1747d010903e884be1", "optimism_gateway"),
    ("ethereum", "0x8315177ab297ba92a06054ce80a67ed4dbd7ed3a", "arbitrum_bridge"),
    ("ethereum", "0x3154cf16ccdb4c6d922629664174b904d80f2c35", "base_bridge"),
    ("ethereum", "0x40ec5b33f54e0e8a33a975908c5ba1c14e5bbbdf", "polygon_zkevm"),
    ("ethereum", "0xd19d4b5d358258f05d7b411e21a1460d11b0876f", "linea_bridge"),
    ("bsc", "0xb6f6d86a8f9879a9c87f643768d9efc38c1da6e7", "stargate_bsc"),
)

# Tokens (chain, symbol, address, decimals, usd price, stable).
TOKENS = (
    ("ethereum", "USDT", "0xdac17f958d2ee523a2206206994597c13d831ec7", 6, 1.0, True),
    ("ethereum", "USDC", "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", 6, 1.0, True),
    ("ethereum", "WETH", "0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2", 18, 0.0, False),
    ("ethereum", "WBTC", "0x2260fac5e5542a773aa44fbcfedf7c193bc2c599", 8, 0.0, False),
    ("ethereum", "PEPE", "0x6982508145454ce325ddbe47a25d4ec3d2311933", 18, 0.0, False),
    ("ethereum", "SHIB", "0x95ad61b0a150d79219dcf64e1e6cc01f0b64c4ce", 18, 0.0, False),
    ("ethereum", "LINK", "0x514910771af9ca656af840dff83e8264ecf986ca", 18, 0.0, False),
    ("ethereum", "ARB", "0xb50721bcf8d664c30412cfbc6cf7a15145234ad1", 18, 0.0, False),
    ("bsc", "USDT", "0x55d398326f99059ff775485246999027b3197955", 18, 1.0, True),
    ("solana", "USDC", "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v", 6, 1.0, True),
    ("solana", "USDT", "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB", 6, 1.0, True),
    ("solana", "BONK", "DezXAZ8z7PnrnRJjz3wXBoRgixCa6xjnB7YaB1pPB263", 5, 0.0, False),
    ("solana", "WIF", "EKpQGSJtjMFqKZ9KQanSqYXRcF8fBopzLHYxdM65zcjm", 6, 0.0, False),
)

# Constant-product pools (chain, name, address, token0, token1, decimals0, decimals1).
POOLS = (
    ("ethereum", "PEPE/WETH", "0xa43fe16908251ee70ef74718545e4fe6c5ccec9f", "PEPE", "WETH", 18, 18),
    ("ethereum", "SHIB/WETH", "0x811beed0119b4afce20d2583eb608c6f7af1954f", "SHIB", "WETH", 18, 18),
    ("ethereum", "USDC/WETH", "0xb4e16d0168e52d35cacd2c6185b44281ec28c9dc", "USDC", "WETH", 6, 18),
)

_LABELLED = "chain string, address string, label string"
_TOKEN = "chain string, symbol string, address string, decimals int, price_usd double, stable boolean"
_POOL = (
    "chain string, name string, address string, token0 string, token1 string, "
    "decimals0 int, decimals1 int"
)


def address_key(address: Column) -> Column:
    """Trimmed; hex addresses (0x in either case) lower-cased, others left as they are."""
    a = F.trim(address)
    return F.when(F.lower(F.substring(a, 1, 2)) == "0x", F.lower(a)).otherwise(a)


def _table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """Inline rows as VALUES, so the optimiser knows their exact size."""
    names = [field.split()[0] for field in ddl.split(", ")]
    text = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}" for v in row) + ")" for row in rows
    )
    typed = ", ".join(f"CAST({f.split()[0]} AS {f.split()[1]}) AS {f.split()[0]}" for f in ddl.split(", "))
    return spark.sql(f"SELECT {typed} FROM VALUES {text} AS t({', '.join(names)})")


def _keyed(df: DataFrame, *unique: str) -> DataFrame:
    return df.withColumn("address", address_key(F.col("address"))).dropDuplicates(list(unique))


def cex_wallets(spark: SparkSession, chains=None, extra: DataFrame | None = None) -> DataFrame:
    return _labelled(spark, CEX_WALLETS, chains, extra)


def bridges(spark: SparkSession, chains=None, extra: DataFrame | None = None) -> DataFrame:
    return _labelled(spark, BRIDGES, chains, extra)


def _labelled(spark, fixed, chains, extra) -> DataFrame:
    rows = [r for r in fixed if chains is None or r[0] in chains]
    base = _table(spark, rows, _LABELLED).select("address", "label")
    if extra is None:
        return _keyed(base, "address")
    added = _keyed(extra.select("address", "label"), "address")
    return _keyed(base, "address").join(added, "address", "left_anti").unionByName(added)


def tokens(spark: SparkSession, chains=None, extra: DataFrame | None = None) -> DataFrame:
    rows = [r for r in TOKENS if chains is None or r[0] in chains]
    base = _table(spark, rows, _TOKEN)
    both = base if extra is None else base.unionByName(extra)
    return _keyed(both.withColumn("symbol", F.upper("symbol")), "chain", "address")


def pools(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    base = _table(spark, POOLS, _POOL)
    both = base if extra is None else base.unionByName(extra)
    return both.withColumn("address", F.lower("address")).dropDuplicates(["address"])
