"""Universe scans: ranking a venue's tickers, corroboration, watchlists.

Tickers: venue, symbol, scan (orderable scan number), scan_ms (scan time),
quote_volume, percentage, open_px, last_px. Every scan of the table is ranked
at once; history per (venue, symbol) is one row per scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapevigil.functions.scalars import clamp, text

# Fixed value: quote currencies in preference order.
QUOTES = ("USDT", "USDC", "USD", "FDUSD", "USD1")

SCAN_KEYS = ["venue", "scan"]
PAIR = ["venue", "symbol"]


def quote_of(symbol: Column) -> Column:
    return F.when(F.contains(symbol, F.lit("/")), F.substring_index(symbol, "/", -1)).otherwise("")


def scan_base(symbol: Column) -> Column:
    return F.substring_index(symbol, "/", 1)


def quoted(tickers: DataFrame, quotes: Sequence[str] = QUOTES) -> DataFrame:
    return tickers.where(quote_of(F.col("symbol")).isin(*quotes))


def derived_change(open_px: Column, last_px: Column) -> Column:
    return F.when((open_px > 0) & (last_px != 0), (last_px - open_px) / open_px * 100.0)


def check_tickers(tickers: DataFrame, max_disagreement_pp: float = 15.0) -> DataFrame:
    """Add `change_pct` and `rejected` (reported change contradicts open/last)."""
    change = F.coalesce("percentage", F.lit(0.0))
    implied = derived_change(F.col("open_px"), F.col("last_px"))
    bad = F.coalesce(F.abs(change - implied) > max_disagreement_pp, F.lit(False))
    return tickers.withColumn("change_pct", change).withColumn(
        "rejected", (F.coalesce("quote_volume", F.lit(0.0)) > 0) & bad
    )


def volume_baseline(accepted: DataFrame, keep: int = 24, need: int = 3) -> DataFrame:
    """Upper median of the up to `keep` earlier volumes of the pair, and the surge over it."""
    before = Window.partitionBy(*PAIR).orderBy("scan").rowsBetween(-keep, -1)
    ordered = F.sort_array(F.collect_list("quote_volume").over(before))
    n = F.size(ordered)
    baseline = F.when(n >= need, F.element_at(ordered, (F.floor(n / 2) + 1).cast("int")))
    return accepted.withColumn("baseline", baseline).withColumn(
        "surge", F.when(F.col("baseline") > 0, F.col("quote_volume") / F.col("baseline"))
    )


def listing_age(universe: DataFrame) -> DataFrame:
    """First appearance of each pair and whether it is new in this scan.

    A pair counts as known from its first row, whatever its volume; pairs of a
    venue's first scan are never new. `listed_ms` is the first scan at which the
    pair, unseen before, also traded with an accepted ticker.
    """
    seen = Window.partitionBy(*PAIR)
    first_scan = universe.groupBy("venue").agg(F.min("scan").alias("__venue_first"))
    return (
        universe.withColumn("__first", F.min("scan").over(seen))
        .join(first_scan, "venue")
        .withColumn("is_new", (F.col("scan") == F.col("__first")) & (F.col("scan") > F.col("__venue_first")))
        .withColumn(
            "listed_ms",
            F.max(F.when(F.col("is_new") & F.col("accepted"), F.col("scan_ms"))).over(seen),
        )
        .withColumn("listed_ms", F.when(F.col("scan_ms") >= F.col("listed_ms"), F.col("listed_ms")))
        .drop("__first", "__venue_first")
    )


def scan_candidates(
    tickers: DataFrame,
    quotes: Sequence[str] = QUOTES,
    min_volume_usd: float = 100_000.0,
    max_volume_usd: float = 50_000_000.0,
    min_change_pct: float = 15.0,
    volume_surge_ratio: float = 3.0,
    track_new_listings: bool = True,
    new_listing_grace_h: float = 48.0,
    new_listing_min_volume_usd: float = 20_000.0,
    new_listing_min_change_pct: float = 10.0,
    max_disagreement_pp: float = 15.0,
    history: bool = True,
) -> DataFrame:
    """Pairs worth watching per scan, with their score and reasons.

    With history=False every scan is judged alone, as for an on-demand sweep.
    """
    universe = check_tickers(quoted(tickers, quotes), max_disagreement_pp).withColumn(
        "accepted", (F.coalesce("quote_volume", F.lit(0.0)) > 0) & ~F.col("rejected")
    )
    if history:
        judged = volume_baseline(listing_age(universe).where("accepted"))
    else:
        judged = (
            universe.where("accepted")
            .withColumn("is_new", F.lit(False))
            .withColumn("listed_ms", F.lit(None).cast("bigint"))
            .withColumn("surge", F.lit(None).cast("double"))
            .withColumn("baseline", F.lit(None).cast("double"))
        )
    volume, change = F.col("quote_volume"), F.col("change_pct")
    size = F.abs(change)
    age_h = (F.col("scan_ms") - F.col("listed_ms")) / 3_600_000.0
    in_grace = F.coalesce(age_h <= new_listing_grace_h, F.lit(False))
    floor = (
        F.when(in_grace, F.lit(new_listing_min_volume_usd)).otherwise(F.lit(min_volume_usd))
        if track_new_listings
        else F.lit(min_volume_usd)
    )
    active = (size >= new_listing_min_change_pct) | (volume >= min_volume_usd)
    moving = size >= min_change_pct
    surging = F.coalesce(F.col("surge") >= volume_surge_ratio, F.lit(False))
    recent = F.lit(track_new_listings) & ~F.col("is_new") & in_grace & active
    fresh = F.col("is_new") & active
    points = (
        F.when(moving, F.least(F.lit(40.0), 10.0 * F.log1p(size / min_change_pct) / math.log(2.0))).otherwise(0.0)
        + F.when(surging, F.least(F.col("surge"), F.lit(20.0)) * 3.0).otherwise(0.0)
        + F.when(recent, 25.0).otherwise(0.0)
        + F.when(fresh, 60.0).otherwise(0.0)
    )
    reasons = F.array_compact(F.array(
        F.when(moving, F.concat(
            F.when(change > 0, "pump ").otherwise("dump "), text("%+.0f%%", change))),
        F.when(surging, text("volume %.1fx baseline", F.col("surge"))),
        F.when(recent, text("new listing (%.1fh old)", age_h)),
        F.when(fresh, F.lit("newly listed")),
    ))
    return (
        judged.where((volume >= floor) & (volume <= max_volume_usd))
        .withColumn("score", points)
        .withColumn("reasons", reasons)
        .where(F.size("reasons") > 0)
        .select(
            *SCAN_KEYS, "symbol", "scan_ms", "quote_volume", "change_pct", "score",
            F.array_join("reasons", ", ").alias("reason"),
        )
    )


def one_per_base(candidates: DataFrame) -> DataFrame:
    """Keep the highest-volume pair of each base asset per venue and scan."""
    best = Window.partitionBy(*SCAN_KEYS, "__base").orderBy(
        F.desc("quote_volume"), F.desc("score"), "symbol"
    )
    return (
        candidates.withColumn("__base", scan_base(F.col("symbol")))
        .withColumn("__rk", F.row_number().over(best))
        .where("__rk = 1")
        .drop("__rk", "__base")
    )


def top_per_scan(candidates: DataFrame, max_symbols: int = 25) -> DataFrame:
    ranked = Window.partitionBy(*SCAN_KEYS).orderBy(F.desc("score"), "symbol")
    return candidates.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= max_symbols)


def discover(tickers: DataFrame, max_symbols: int = 25, **params) -> DataFrame:
    return top_per_scan(one_per_base(scan_candidates(tickers, **params)), max_symbols)


def watchlist(selected: DataFrame, tickers: DataFrame, pinned: Sequence[str] = ()) -> DataFrame:
    """Pinned pairs present in the scan first, then the discoveries, each once."""
    found = selected.select(*SCAN_KEYS, "symbol", (F.lit(len(pinned)) + F.col("rank")).alias("position"))
    if not pinned:
        return found
    order = F.create_map(*[v for i, s in enumerate(pinned) for v in (F.lit(s), F.lit(i + 1))])
    fixed = tickers.where(F.col("symbol").isin(*pinned)).select(
        *SCAN_KEYS, "symbol", F.element_at(order, F.col("symbol")).alias("position")
    )
    return fixed.unionByName(found).groupBy(*SCAN_KEYS, "symbol").agg(F.min("position").alias("position"))


def base_moves(tickers: DataFrame, selected: DataFrame, quotes: Sequence[str] = QUOTES) -> DataFrame:
    """What each venue says about a base asset in a scan: its raw change and its candidates' changes.

    A venue listing several quotes of one base contributes the last one by symbol.
    """
    raw = (
        quoted(tickers, quotes)
        .where(F.col("percentage").isNotNull())
        .groupBy(*SCAN_KEYS, scan_base(F.col("symbol")).alias("base"))
        .agg(F.max_by("percentage", "symbol").alias("move"))
    )
    flagged = selected.select(
        *SCAN_KEYS, scan_base(F.col("symbol")).alias("base"), F.col("change_pct").alias("move")
    )
    return raw.unionByName(flagged)


def corroborate(selected: DataFrame, moves: DataFrame, threshold_pct: float = 50.0,
                band_pp: float = 40.0) -> DataFrame:
    """Drop extreme moves that other venues contradict.

    A move below the threshold passes; otherwise another venue must show the same
    base moving the same way within `band_pp`, or no other venue may list it.
    The moves of a base in a scan are gathered into one short list (one entry per
    venue and candidate), so no pair of rows is ever joined.
    """
    gathered = moves.groupBy("scan", "base").agg(
        F.collect_list(F.struct("venue", "move")).alias("__moves")
    )
    extreme = F.abs("change_pct") >= threshold_pct
    others = F.filter(F.col("__moves"), lambda m: m["venue"] != F.col("venue"))
    agrees = F.exists(
        others,
        lambda m: (m["move"] * F.col("change_pct") > 0)
        & (F.abs(m["move"] - F.col("change_pct")) <= band_pp),
    )
    alone = F.size(F.coalesce(others, F.array().cast("array<struct<venue:string,move:double>>"))) == 0
    return (
        selected.withColumn("base", scan_base(F.col("symbol")))
        .join(gathered, ["scan", "base"], "left")
        .where(~extreme | alone | F.coalesce(agrees, F.lit(False)))
        .drop("__moves", "base")
    )


def watch_changes(current: DataFrame, wanted: DataFrame, pinned: Sequence[str] = ()) -> DataFrame:
    """Pairs to subscribe ('add') and to let go ('drop'); pinned pairs are never dropped."""
    add = wanted.select(*PAIR).distinct().join(current, PAIR, "left_anti").withColumn("action", F.lit("add"))
    gone = current.select(*PAIR).distinct().join(wanted, PAIR, "left_anti")
    if pinned:
        gone = gone.where(~F.col("symbol").isin(*pinned))
    return add.unionByName(gone.withColumn("action", F.lit("drop")))


def listed_markets(markets: DataFrame) -> DataFrame:
    return markets.where(F.col("spot") & F.coalesce("active", F.lit(True))).select(*PAIR).distinct()


def unlisted_pairs(watched: DataFrame, markets: DataFrame) -> DataFrame:
    """Watched pairs their venue does not trade; venues without a market list are left alone."""
    listed = listed_markets(markets)
    return watched.join(listed.select("venue").distinct(), "venue", "left_semi").join(
        listed, PAIR, "left_anti"
    )


def scan_statistics(tickers: DataFrame, quotes: Sequence[str] = QUOTES,
                    max_disagreement_pp: float = 15.0) -> DataFrame:
    """Per venue: scans, known pairs, pairs in the latest scan, rejected tickers, scan age."""
    universe = check_tickers(quoted(tickers, quotes), max_disagreement_pp)
    per_scan = universe.groupBy(*SCAN_KEYS).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("rejected").alias("rejected"),
        F.max("scan_ms").alias("scan_ms"),
    )
    known = universe.select(*PAIR).distinct().groupBy("venue").agg(F.count(F.lit(1)).alias("universe"))
    return (
        per_scan.groupBy("venue")
        .agg(
            F.count(F.lit(1)).alias("scans"),
            F.max_by("pairs", "scan").alias("last_universe"),
            F.sum("rejected").alias("rejected"),
            F.max("scan_ms").alias("last_scan_ms"),
        )
        .join(known, "venue")
    )


def movers(tickers: DataFrame, limit: int = 15, **params) -> DataFrame:
    """Largest absolute moves across venues, each scan judged without history."""
    limit = max(1, limit)
    found = discover(tickers, max_symbols=limit, history=False, **params)
    ranked = Window.partitionBy("scan").orderBy(F.desc(F.abs("change_pct")), "venue", "symbol")
    return found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= limit)


# --- on-demand market questions ----------------------------------------------


def pair_report(last_book: DataFrame, candles: DataFrame, last_ticker: DataFrame,
                need: int = 10, keep: int = 60) -> DataFrame:
    """Point-in-time row per pair: book metrics, log-volume z of the last candle, spike ratio.

    candles: venue, symbol, minute_ms, volume; at most the newest `keep` are used.
    """
    newest = Window.partitionBy(*PAIR).orderBy(F.desc("minute_ms"))
    recent = candles.withColumn("__age", F.row_number().over(newest)).where(F.col("__age") <= keep)
    log_volume = F.log1p(F.greatest("volume", F.lit(0.0)))
    earlier = F.col("__age") > 1
    stats = recent.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("candles"),
        F.max(F.when(~earlier, F.col("volume"))).alias("__last"),
        F.max(F.when(~earlier, log_volume)).alias("__last_log"),
        F.avg(F.when(earlier, log_volume)).alias("__mu"),
        F.stddev_pop(F.when(earlier, log_volume)).alias("__sd"),
        F.avg(F.when(earlier, F.col("volume"))).alias("__mean"),
    )
    enough = F.col("candles") >= need
    mean = F.when(F.col("__mean") == 0, F.lit(1.0)).otherwise(F.col("__mean"))
    zero = F.lit(0.0)
    return (
        last_ticker.select(*PAIR, "price", "change_pct", "quote_volume")
        .join(last_book.select(*PAIR, "obi", "bid_depth", "ask_depth", "spread_bps"), PAIR, "left")
        .join(stats, PAIR, "left")
        .select(
            *PAIR, "price", "change_pct", "quote_volume",
            *[F.coalesce(c, zero).alias(c) for c in ("obi", "bid_depth", "ask_depth", "spread_bps")],
            F.when(enough, F.when(F.col("__sd") > 1e-9, (F.col("__last_log") - F.col("__mu")) / F.col("__sd"))
                   .otherwise(zero)).otherwise(zero).alias("volume_z"),
            F.when(enough, clamp(F.col("__last") / mean, 0.0, 50.0)).otherwise(F.lit(1.0)).alias(
                "volume_spike_ratio"
            ),
            F.when(enough, F.col("candles")).otherwise(F.lit(0)).cast("bigint").alias("candles"),
            (F.coalesce("price", zero) > 0).alias("ok"),
        )
    )


def resolve_symbol(markets: DataFrame, queries: DataFrame, quotes: Sequence[str] = QUOTES) -> DataFrame:
    """Concrete pair per venue for each query: an exact pair, or the first quote that is listed."""
    listed = listed_markets(markets)
    q = queries.withColumn("q", F.upper(F.trim("query")))
    exact = q.where(F.contains("q", F.lit("/"))).join(
        listed, F.col("q") == F.col("symbol")
    ).select("query", *PAIR)
    pref = F.array_position(F.array(*[F.lit(x) for x in quotes]), quote_of(F.col("symbol")))
    bare = (
        q.where(~F.contains("q", F.lit("/")))
        .join(
            listed.withColumn("pref", pref).where("pref > 0").withColumn(
                "base", F.substr("symbol", F.lit(1), F.length("symbol") - F.length(quote_of(F.col("symbol"))) - 1)
            ),
            F.col("q") == F.col("base"),
        )
        .groupBy("query", "venue")
        .agg(F.min_by("symbol", "pref").alias("symbol"))
    )
    return exact.unionByName(bare.select("query", *PAIR))


def similar_symbols(markets: DataFrame, fragment: str, limit: int = 12,
                    quotes: Sequence[str] = QUOTES) -> DataFrame:
    """Listed pairs whose base contains the fragment, in alphabetical order."""
    frag = fragment.strip().upper().split("/")[0]
    return (
        listed_markets(markets)
        .where(quote_of(F.col("symbol")).isin(*quotes) & F.contains(scan_base(F.col("symbol")), F.lit(frag)))
        .select("symbol").distinct().orderBy("symbol").limit(limit)
    )


def best_venue(reports: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """The deepest usable report per pair, and every venue that lists it."""
    depth = F.col("bid_depth") + F.col("ask_depth")
    key = F.struct(depth.alias("d"), F.col("venue"))
    return reports.groupBy(*by).agg(
        F.max_by("venue", F.when(F.col("ok"), key)).alias("best_venue"),
        F.max(F.when(F.col("ok"), depth)).alias("depth"),
        F.sort_array(F.collect_set("venue")).alias("venues"),
    )


def report_features(reports: DataFrame) -> DataFrame:
    """Reports as feature vectors: only the exchange block is known, coverage 1/3."""
    from tapevigil.operators.features import with_neutral

    known = {
        "volume_z": clamp(F.col("volume_z"), -20.0, 20.0),
        "volume_spike_ratio": F.col("volume_spike_ratio"),
        "obi": clamp(F.col("obi"), -1.0, 1.0),
        "obi_abs": F.abs(clamp(F.col("obi"), -1.0, 1.0)),
        "spread_bps": clamp(F.log1p(F.greatest("spread_bps", F.lit(0.0))), 0.0, 10.0),
    }
    return with_neutral(
        reports, known,
        [F.col("venue"), scan_base(F.col("symbol")).alias("asset"), F.lit(1.0 / 3.0).alias("coverage")],
    )
