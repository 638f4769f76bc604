"""Mention, sentiment and coordinated-account operators.

Posts: post_id, author_id, text, ts_ms, ticker, author_age_days,
author_followers, and `sentiment` where the mean is asked for. Mention series
are thinned to one row per (ticker, tick) before any window runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapevigil.functions.scalars import clamp, sentiment_label, text
from tapevigil.functions.text import fingerprint
from tapevigil.operators.cells import blocked, cells, similar
from tapevigil.operators.rolling import dynamic_z
from tapevigil.operators.series import DEFAULT_CHUNK_ROWS, on_keys, running_by_rows
from tapevigil.plans.storage import settle

KEYS = ["ticker"]
GROUP = ["ticker", "eval_ms"]


def fan_out(posts: DataFrame, tracked: Sequence[str]) -> DataFrame:
    """One row per post and tracked ticker (posts carry a `tickers` array)."""
    names = F.array(*[F.lit(t) for t in tracked])
    return posts.withColumn("ticker", F.explode(F.array_intersect("tickers", names))).drop("tickers")


def tick_series(posts: DataFrame, tick_ms: int = 5_000, window_ms: int = 300_000,
                value: str | None = None) -> DataFrame:
    """Per (ticker, tick): posts in [tick - window, tick], their per-minute rate and mean sentiment.

    A post belongs to the first tick at or after it, so a window is the ticks
    inside it plus the posts that sit exactly on its opening edge. Ticks run from
    a ticker's first post until one window after its last.
    """
    if window_ms % tick_ms:
        raise ValueError("window_ms must be a multiple of tick_ms")
    v = F.col(value) if value else F.lit(0.0)
    edge = F.pmod(F.col("ts_ms"), F.lit(tick_ms)) == 0
    slots = posts.groupBy(
        *KEYS, (F.ceil(F.col("ts_ms") / tick_ms) * tick_ms).cast("bigint").alias("slot_ms")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"),
        F.count_if(edge).alias("edge_n"), F.sum(F.when(edge, v).otherwise(0.0)).alias("edge_s"),
    )
    nxt = F.coalesce(F.lead("slot_ms").over(Window.partitionBy(*KEYS).orderBy("slot_ms")),
                     F.col("slot_ms") + window_ms + tick_ms)
    real = F.col("tick_ms") == F.col("slot_ms")
    dense = slots.withColumn("__last", nxt - tick_ms).withColumn(
        "tick_ms", F.explode(F.sequence("slot_ms", "__last", F.lit(tick_ms)))
    )
    for c in ("n", "edge_n"):
        dense = dense.withColumn(c, F.when(real, F.col(c)).otherwise(F.lit(0)))
    for c in ("s", "edge_s"):
        dense = dense.withColumn(c, F.when(real, F.col(c)).otherwise(0.0))
    for c in ("lo", "hi"):
        dense = dense.withColumn(c, F.when(real, F.col(c)))
    ordered = Window.partitionBy(*KEYS).orderBy("tick_ms")
    inside = ordered.rangeBetween(-(window_ms - tick_ms), 0)
    opening = ordered.rangeBetween(-window_ms, -window_ms)
    at_edge = F.coalesce(F.sum("edge_n").over(opening), F.lit(0))
    dense = (
        dense.withColumn("__e", at_edge)
        .withColumn("posts_in_window", F.sum("n").over(inside) + F.col("__e"))
        .withColumn("__s", F.sum("s").over(inside) + F.coalesce(F.sum("edge_s").over(opening), F.lit(0.0)))
        .withColumn("__lo", F.when(F.col("__e") > 0, F.col("tick_ms") - window_ms).otherwise(F.min("lo").over(inside)))
        .withColumn("__hi", F.coalesce(F.max("hi").over(inside), F.when(F.col("__e") > 0, F.col("tick_ms") - window_ms)))
        .withColumn("posts_total", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    )
    n, span = F.col("posts_in_window"), F.col("__hi") - F.col("__lo")
    return dense.select(
        *KEYS, "tick_ms", "posts_in_window", "posts_total",
        F.when((n < 2) | (span <= 0), n.cast("double")).otherwise(n * 60_000.0 / span).alias("rate"),
        F.when(n > 0, F.col("__s") / n).otherwise(0.0).alias("sentiment"),
    )


def acceleration(ticks: DataFrame) -> DataFrame:
    """Change of the rate per minute over the latest six ticks; 0 before three."""
    frame = Window.partitionBy(*KEYS).orderBy("tick_ms").rowsBetween(-5, 0)
    minutes = (F.col("tick_ms") - F.first("tick_ms").over(frame)) / 60_000.0
    change = F.col("rate") - F.first("rate").over(frame)
    ready = (F.count(F.lit(1)).over(frame) >= 3) & (minutes > 1e-6)
    return ticks.withColumn("acceleration", F.when(ready, change / minutes).otherwise(0.0))


def mention_scores(ticks: DataFrame, window_ms: int = 300_000, tick_ms: int = 5_000) -> DataFrame:
    """mention_z with its trigger level and spike flag, sentiment_z, label and confidence."""
    block = 100_000 * tick_ms
    scored = dynamic_z(ticks, KEYS, ["tick_ms"], "rate", half_life_s=window_ms / 2000.0, window=240, warmup=15,
                       base_threshold=3.0, zero_is_normal=True, log_space=True, ts="tick_ms", out="mention_z",
                       threshold="mention_threshold", block_ms=block)
    scored = dynamic_z(scored, KEYS, ["tick_ms"], "sentiment", half_life_s=window_ms / 1000.0, window=240,
                       warmup=15, base_threshold=2.5, ts="tick_ms", out="sentiment_z", threshold=None,
                       block_ms=block)
    return (
        scored.withColumn("spike", F.coalesce(F.col("mention_z") > F.col("mention_threshold"), F.lit(False)))
        .withColumn("label", sentiment_label(F.col("sentiment")))
        .withColumn("confidence", clamp(F.col("posts_in_window") / 30.0, 0.1, 1.0))
    )


# --- coordinated accounts -----------------------------------------------------


def post_windows(posts: DataFrame, window_ms: int = 600_000, every_ms: int | None = None,
                 max_posts: int | None = None) -> DataFrame:
    """Copy each post to the evaluation times whose window [eval - window, eval] holds it."""
    step = every_ms or window_ms
    first = (F.ceil(F.col("ts_ms") / step) * step).cast("bigint")
    last = (F.floor((F.col("ts_ms") + window_ms) / step) * step).cast("bigint")
    out = posts.withColumn("eval_ms", F.explode(F.sequence(first, F.greatest(first, last), F.lit(step))))
    if max_posts is None:
        return out
    newest = Window.partitionBy(*GROUP).orderBy(F.desc("ts_ms"), F.desc("post_id"))
    return out.withColumn("__rk", F.row_number().over(newest)).where(F.col("__rk") <= max_posts).drop("__rk")


def _cv(mean: Column, sd: Column) -> Column:
    return F.when(mean <= 0, 0.0).otherwise(sd / mean)


def age_variation(windowed: DataFrame) -> DataFrame:
    """Population CV of account ages over posts; NULL below four."""
    age = F.col("author_age_days")
    cv = F.when(F.count(age) >= 4, _cv(F.avg(age), F.stddev_pop(age)))
    return windowed.groupBy(*GROUP).agg(cv.alias("age_cv"))


def young_authors(windowed: DataFrame) -> DataFrame:
    """Per author: posts, and the first known age at or below the young-account limit."""
    young = F.col("author_age_days") <= F.col("__limit")
    return windowed.groupBy(*GROUP, "author_id").agg(
        F.count(F.lit(1)).alias("author_posts"),
        F.min_by("author_age_days", F.when(young, F.struct("ts_ms", "post_id"))).alias("age"),
    )


def age_cohorts(windowed: DataFrame, max_age_days: float = 30.0, need: int = 4,
                chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Largest cluster of young accounts of similar age per (ticker, evaluation).

    A cluster opens at an account's age and spans max(3 days, 35 % of that age);
    ties go to the youngest. Ages are counted per distinct value first. The sweep is one
    running count over the ages and, put in order among them, the ends of their clusters; it
    is cut by rows, so no group is held by one task.
    """
    authors = young_authors(windowed.withColumn("__limit", F.lit(float(max_age_days))))
    ages = settle(authors.where(F.col("age").isNotNull()).groupBy(*GROUP, "age").agg(F.count(F.lit(1)).alias("n")))
    age, reach = F.col("age"), F.greatest(F.lit(3.0), F.col("age") * 0.35)
    # The greatest number that is not further from the age than its reach: rounding may move the sum by one unit.
    near, unit = age + reach, F.abs(age + reach) * 2.0**-53
    end = F.when(near + unit - age <= reach, near + unit).when(near - age <= reach, near).otherwise(near - unit)
    events = ages.select(*GROUP, "age", "n", F.explode(F.array(F.struct(age.alias("at"), F.lit(False).alias("ends")), F.struct(end.alias("at"), F.lit(True).alias("ends")))).alias("e"))
    events = events.select(*GROUP, "age", "e.*", F.when(F.col("e.ends"), 0).otherwise(F.col("n")).alias("n"))
    swept = running_by_rows(events, GROUP, ["at", "ends", "age"], {"upto": F.col("n")}, chunk_rows)
    size = F.sum(F.when(F.col("ends"), F.col("upto")).otherwise(F.col("n") - F.col("upto")))
    clusters = swept.groupBy(*GROUP, "age").agg(size.alias("size"), F.max("at").alias("end"))
    best = clusters.groupBy(*GROUP).agg(F.max_by(F.struct("age", "size", "end"), F.struct("size", -F.col("age"))).alias("c")).where(F.col("c.size") >= need)
    member = on_keys(ages, best, GROUP, extra=F.col("age").between(F.col("c.age"), F.col("c.end")))
    # Deviations from the youngest member, so that equal ages give exactly 0.
    n, d = F.col("n"), F.col("age") - F.col("c.age")
    sums = member.groupBy(*GROUP).agg(
        F.sum("n").alias("cohort_size"), F.min("age").alias("age_lo"), F.max("age").alias("age_hi"),
        (F.sum(n * d) / F.sum("n")).alias("__d"), (F.sum(n * d * d) / F.sum("n")).alias("__dd"),
    )
    sd = F.sqrt(F.greatest(F.col("__dd") - F.col("__d") * F.col("__d"), F.lit(0.0)))
    return sums.withColumn("cohort_cv", _cv(F.col("age_lo") + F.col("__d"), sd)).drop("__d", "__dd")


def prefix_index(counted: DataFrame, min_jaccard: float) -> DataFrame:
    """Where different fingerprints of a group may meet: (cls, size, token), a token being a shingle of one group.

    Tokens are ordered by the number of fingerprints that hold them, the rarest first. Two
    fingerprints of the wanted similarity share one of the first
    size - ceil(min_jaccard * size) + 1 tokens of each, so only these are indexed, and only
    where another fingerprint has them. Rows hold no shingles besides their own, so that the
    index stays small where many shingles are shared.
    """
    rows = counted.select(*GROUP, "cls", F.size("prints").alias("size"), F.explode("prints").alias("token"))
    rows = rows.select("cls", "size", F.xxhash64(*GROUP, "token").alias("token"))
    often = F.count(F.lit(1)).over(Window.partitionBy("token"))
    held = rows.withColumn("df", often).where("df >= 2").groupBy("cls", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    # Tokens of one fingerprint only come first in the order and can't be shared.
    first = F.col("size") - F.ceil(F.col("size") * min_jaccard - 1e-9) + 1 - (F.col("size") - F.size("held"))
    prefix = F.slice("held", 1, F.greatest(first, F.lit(0)).cast("int"))["token"]
    index = held.select("cls", "size", F.explode(prefix).alias("token"))
    return index.withColumn("df", often).where("df >= 2").drop("df")


def blocks_of(counted: DataFrame) -> DataFrame:
    """(cls, own): a block of bounded size for each fingerprint of a group; those with the same smallest shingle mostly share one."""
    rough = blocked(counted.select(*GROUP, "cls", F.xxhash64("anchor").alias("anchor")), GROUP)
    rough = settle(rough.select(*GROUP, "cls", F.pmod("anchor", F.col("blocks")).alias("bucket")))
    part = F.pmod(F.xxhash64(F.lit(11), "cls"), F.col("blocks"))
    return blocked(rough, [*GROUP, "bucket"]).select("cls", (F.col("bucket") * 2**31 + part).alias("own"))


def meetings(index: DataFrame, min_jaccard: float) -> DataFrame:
    """(cls, own, a, b): the cells, of blocks a <= b, where a fingerprint may be near another; index is a written table.

    A fingerprint meets a block if one of its tokens is held there, by a fingerprint of fitting
    size and not by itself alone. A pair is in the cell of its two blocks only, however many
    tokens it shares.
    """
    spots = index.groupBy("token", F.col("own").alias("other")).agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    size = F.col("size") + 1e-6
    fits = (size >= F.col("lo") * min_jaccard) & (F.col("hi") + 1e-6 >= F.col("size") * min_jaccard) & ((F.col("own") != F.col("other")) | (F.col("n") >= 2))
    found = index.join(spots, "token").where(fits)
    return found.select("cls", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()


def duplicate_ratio(posts: DataFrame, sample: int | None = None, min_jaccard: float = 0.6) -> DataFrame:
    """Share of near-duplicate pairs among all posts per (ticker, evaluation), or the newest `sample` of each.

    Equal fingerprints are counted first. Different ones meet in the index of their rarest
    shingles; the blocks of those that share one are compared in cells of bounded size, each
    pair in one cell. Fingerprints are read once for each cell they are in and not for each
    shingle they share; cells put out sums and no pairs.
    """
    seen = posts.select(*GROUP).distinct()
    if sample is not None:
        newest = Window.partitionBy(*GROUP).orderBy(F.desc("ts_ms"), F.desc("post_id"))
        posts = posts.withColumn("__rk", F.row_number().over(newest)).where(F.col("__rk") <= sample)
    prints = posts.select(*GROUP, F.sort_array(F.transform(fingerprint(F.col("text")), lambda s: F.xxhash64(s))).alias("prints"))
    counted = prints.groupBy(*GROUP, "prints").agg(F.count(F.lit(1)).alias("n"))
    counted = settle(counted.withColumns({"cls": F.monotonically_increasing_id(), "anchor": F.get("prints", F.lit(0))}))
    # Texts without shingles go only now: a condition on fingerprints, pushed down, would compute them twice.
    counted = counted.where(F.col("anchor").isNotNull())

    def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, (*GROUP, "a", "b")):
            held = [np.asarray(x.values, np.int64) for x in cell["prints"].combine_chunks()]
            own, n = np.asarray(cell["own"]), np.asarray(cell["n"]).astype(float)
            near = similar(held, min_jaccard)
            if cell["a"][0] != cell["b"][0]:
                near &= own[:, None] != own[None, :]
            if near.any():
                pairs = pa.array([float(n @ near @ n) / 2])
                yield pa.RecordBatch.from_arrays([cell[k].combine_chunks()[:1] for k in GROUP] + [pairs], names=[*GROUP, "pairs"])

    places = [*GROUP, "a", "b"]
    index = settle(prefix_index(counted, min_jaccard).join(blocks_of(counted), "cls"))
    met = meetings(index, min_jaccard).join(counted.select(*GROUP, "cls", "n", "prints"), "cls")
    dealt = met.repartition(*places).sortWithinPartitions(*places)
    near = dealt.mapInArrow(near_pairs, "ticker string, eval_ms bigint, pairs double").groupBy(*GROUP).agg(F.sum("pairs").alias("near"))
    n = F.col("n")
    sizes = counted.groupBy(*GROUP).agg(F.sum("n").alias("posts"), F.sum(n * (n - 1) / 2).alias("same"))
    share = (F.col("same") + F.coalesce("near", F.lit(0.0))) / (F.col("posts") * (F.col("posts") - 1) / 2)
    return on_keys(on_keys(seen, sizes, GROUP, "left"), near, GROUP, "left").select(
        *GROUP, F.coalesce(F.when(F.col("posts") >= 3, share), F.lit(0.0)).alias("duplicate_ratio")
    )


def cadence(posts: DataFrame) -> DataFrame:
    """1 - CV of the positive gaps between posts, clamped; 0 below six posts or four gaps."""
    counted = posts.groupBy(*GROUP, "ts_ms").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy(*GROUP).orderBy("ts_ms")
    gaps = counted.withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(ordered))
    mean, sd = F.avg("gap"), F.stddev_pop("gap")
    ready = (F.sum("n") >= 6) & (F.count("gap") >= 4) & (mean > 0)
    return gaps.groupBy(*GROUP).agg(
        F.when(ready, clamp(1.0 - sd / mean, 0.0, 1.0)).otherwise(0.0).alias("cadence_regularity")
    )


def follower_uniformity(posts: DataFrame) -> DataFrame:
    """Half evenness of follower counts, half the share below 200; 0 below five, 1 if none has any."""
    c = F.col("author_followers").cast("double")
    even = 1.0 - clamp(F.stddev_pop(c) / F.avg(c), 0.0, 1.0)
    low = F.count_if(c < 200) / F.count(c)
    score = F.when(F.count(c) < 5, 0.0).when(F.avg(c) <= 0, 1.0).otherwise(
        clamp(even * 0.5 + low * 0.5, 0.0, 1.0)
    )
    return posts.groupBy(*GROUP).agg(score.alias("follower_uniformity"))


def farm_score(measures: DataFrame, min_posts: int = 12, max_age_days: float = 30.0,
               age_cv_threshold: float = 0.35, duplicate_threshold: float = 0.4) -> DataFrame:
    """Weigh the measures into a 0-1 verdict with reasons.

    Needs posts, authors, cohort_posts, cohort_size, on_cohort, age_cv,
    duplicate_ratio, cadence_regularity, follower_uniformity, mention_z.
    """
    cv, dup, cad = F.col("age_cv"), F.col("duplicate_ratio"), F.col("cadence_regularity")
    fol, mz, on = F.col("follower_uniformity"), F.col("mention_z"), F.col("on_cohort")
    share = F.col("cohort_posts") / F.col("posts")
    accounts = F.when(on, F.col("cohort_size")).otherwise(F.col("authors"))
    per_author = F.when(on, F.col("cohort_posts") / F.greatest("cohort_size", F.lit(1))).otherwise(
        F.col("posts") / F.greatest("authors", F.lit(1))
    )
    uniform = F.coalesce(cv < age_cv_threshold, F.lit(False))
    presence = F.when(on, clamp(share * 2.5, 0.0, 1.0)).otherwise(0.6)
    floor = 0.08
    moving = F.coalesce(mz > 3.0, F.lit(False))
    enough = F.col("posts") >= min_posts
    points = (
        F.when(uniform, 0.35 * (1.0 - cv / age_cv_threshold) * presence).otherwise(0.0)
        + F.when(dup > floor, 0.25 * clamp((dup - floor) / max(duplicate_threshold - floor, 1e-6), 0.0, 1.0)).otherwise(0.0)
        + F.when(cad > 0.55, 0.15 * cad).otherwise(0.0)
        + F.when(fol > 0.6, 0.10 * fol).otherwise(0.0)
        + F.when(per_author > 3.0, clamp(0.10 * F.log1p(per_author - 3.0), 0.0, 0.10)).otherwise(0.0)
        + F.when(moving, clamp(0.15 * (mz - 3.0) / 5.0, 0.0, 0.15)).otherwise(0.0)
    )
    said = F.array_compact(F.array(
        F.when(uniform, text(
            f"%d accounts with uniform age (CV=%.2f, <{max_age_days:.0f}d) driving %.0f%% of posts",
            accounts, cv, share * 100)),
        F.when(dup > floor, F.concat(text("%.0f%% near-duplicate posts", dup * 100),
                                     F.when(on, " in cohort").otherwise(""))),
        F.when(cad > 0.55, text("mechanical posting cadence (%.2f)", cad)),
        F.when(fol > 0.6, text("uniform low-follower authors (%.2f)", fol)),
        F.when(per_author > 3.0, text("%.1f posts/author", per_author)),
        F.when(moving, text("mention spike z=%.1f", mz)),
    ))
    said = F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("no coordination signals")))
    zero = F.lit(0.0)
    score = F.when(enough, clamp(points, 0.0, 1.0)).otherwise(zero)
    return measures.select(
        *GROUP,
        (score >= 0.5).alias("is_bot_farm"),
        score.alias("score"),
        F.when(enough, cv).alias("age_cv"),
        *[F.when(enough, F.col(c)).otherwise(zero).alias(c)
          for c in ("duplicate_ratio", "cadence_regularity", "follower_uniformity")],
        F.when(enough, F.col("authors")).otherwise(F.lit(0)).cast("bigint").alias("unique_authors"),
        F.col("posts").cast("bigint").alias("posts"),
        F.when(enough, said).otherwise(F.array(F.lit("insufficient posts"))).alias("reasons"),
        F.when(enough, on).otherwise(F.lit(False)).alias("on_cohort"),
    )


def bot_farm_verdicts(windowed: DataFrame, mention_z: DataFrame | None = None, min_posts: int = 12,
                      max_age_days: float = 30.0, age_cv_threshold: float = 0.35,
                      duplicate_threshold: float = 0.4) -> DataFrame:
    """Coordinated-account verdict per (ticker, evaluation time) of post_windows rows.

    mention_z: optional (ticker, eval_ms, mention_z). The cohort's posts are judged
    when there are enough of them, else all posts of the window.
    """
    windowed = settle(windowed)
    cohorts = age_cohorts(windowed, max_age_days)
    authors = young_authors(windowed.withColumn("__limit", F.lit(float(max_age_days))))
    member = F.coalesce(F.col("age").between(F.col("age_lo"), F.col("age_hi")), F.lit(False))
    flagged = settle(on_keys(authors, cohorts, GROUP, "left").withColumn("member", member))
    totals = flagged.groupBy(*GROUP).agg(
        F.sum("author_posts").alias("posts"),
        F.count(F.lit(1)).alias("authors"),
        F.sum(F.when(F.col("member"), F.col("author_posts")).otherwise(F.lit(0))).alias("cohort_posts"),
        F.count_if("member").alias("cohort_size"),
        F.max("cohort_cv").alias("cohort_cv"),
    ).withColumn("on_cohort", F.col("cohort_posts") >= max(6, min_posts // 2))
    totals = settle(totals)
    judged = settle(
        on_keys(
            on_keys(windowed, totals.select(*GROUP, "on_cohort"), GROUP),
            flagged.where("member").select(*GROUP, "author_id", "member"), [*GROUP, "author_id"], "left",
        ).where(~F.col("on_cohort") | F.col("member").isNotNull())
    )
    measures = totals
    for found in (age_variation(windowed).withColumnRenamed("age_cv", "__all_cv"), duplicate_ratio(judged),
                  cadence(judged), follower_uniformity(judged)):
        measures = on_keys(measures, found, GROUP, "left")
    measures = measures.withColumn("age_cv", F.when(
        F.col("on_cohort") & F.col("cohort_cv").isNotNull(), F.col("cohort_cv")).otherwise(F.col("__all_cv")))
    if mention_z is None:
        measures = measures.withColumn("mention_z", F.lit(None).cast("double"))
    else:
        measures = on_keys(measures, mention_z, GROUP, "left")
    return farm_score(measures, min_posts, max_age_days, age_cv_threshold, duplicate_threshold)


def social_events(scored_ticks: DataFrame, verdicts: DataFrame | None = None, window_ms: int = 300_000,
                  min_posts: int = 12, backend: str = "lexicon") -> DataFrame:
    """Mention, sentiment and (from min_posts on) bot-farm events, one row each per tick."""
    from tapevigil.sources.events import as_events

    def shape(df, prefix, metric, ts, raw, z, confidence, meta) -> DataFrame:
        return as_events(df.select(
            F.concat_ws("-", F.lit(prefix), "ticker", F.col(ts).cast("string")).alias("event_id"),
            F.col(ts).alias("ts_ms"), F.lit("social").alias("source_type"), F.lit("aggregate").alias("venue"),
            F.col("ticker").alias("asset_pair"), F.lit(metric).alias("metric_type"), raw.alias("raw_value"),
            z.alias("normalized_z_score"), F.lit(None).cast("double").alias("usd_value"),
            confidence.alias("confidence"), meta.alias("meta"),
        ))

    mentions = shape(scored_ticks, "sm", "social_mentions", "tick_ms", F.col("rate"), F.col("mention_z"), F.lit(1.0),
                     F.struct(F.round("acceleration", 4).alias("acceleration")))
    mood = shape(scored_ticks, "ss", "social_sentiment", "tick_ms", F.col("sentiment"), F.col("sentiment_z"),
                 F.col("confidence"), F.struct(F.lit(backend).alias("backend"), "label"))
    out = mentions.unionByName(mood)
    if verdicts is None:
        return out
    z = F.col("mention_z") if "mention_z" in verdicts.columns else F.lit(None).cast("double")
    farms = shape(verdicts.where(F.col("posts") >= min_posts), "bf", "bot_farm", "eval_ms", F.col("score"), z,
                  clamp(F.col("posts") / 50.0, 0.2, 1.0), F.struct("is_bot_farm", "reasons"))
    return out.unionByName(farms)


def social_report(scored_ticks: DataFrame, verdicts: DataFrame, mention_z_threshold: float = 3.0) -> DataFrame:
    """Latest mention and sentiment state per ticker with its latest verdict."""
    zero = F.lit(0.0)
    last = scored_ticks.groupBy("ticker").agg(F.max_by(
        F.struct("sentiment", "rate", "mention_z", "acceleration", "posts_total"), "tick_ms").alias("t"))
    farm = verdicts.groupBy("ticker").agg(F.max_by(
        F.struct("is_bot_farm", "score", "unique_authors", "posts", "age_cv", "duplicate_ratio", "reasons"),
        "eval_ms").alias("v"))
    return last.join(farm, "ticker", "left").select(
        "ticker", F.col("t.sentiment").alias("sentiment"), sentiment_label(F.col("t.sentiment")).alias("mood"),
        F.col("t.rate").alias("mention_rate"), F.coalesce("t.mention_z", zero).alias("mention_z"),
        F.coalesce(F.col("t.mention_z") > mention_z_threshold, F.lit(False)).alias("mention_spike"),
        F.col("t.acceleration").alias("acceleration"), F.col("t.posts_total").alias("posts_seen"),
        F.col("v.is_bot_farm").alias("is_bot_farm"), F.col("v.score").alias("farm_score"),
        F.col("v.unique_authors").alias("authors"), F.col("v.posts").alias("posts_in_window"),
        F.col("v.age_cv").alias("age_cv"), F.col("v.duplicate_ratio").alias("duplicate_ratio"),
        F.slice("v.reasons", 1, 4).alias("reasons"),
    )
