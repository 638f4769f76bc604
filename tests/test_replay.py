"""Replay on sweeps that events call for: against a plain loop, against the full grid, and at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapevigil.operators import features, forest
from tapevigil.plans import replay
from tapevigil.plans import views as v
from tapevigil.schemas import FEATURES
from tapevigil.sources import events as ev

BASE = 1_700_000_000_000
HOUR = 3_600_000


def lines(spark, rows):
    """Recorded lines: (ms after BASE, asset, metric, raw value, usd, direction)."""
    made = [
        f'{{"event_id": "e{i:04d}", "timestamp": {BASE + ms}, "source_type": "{"exchange" if metric == "volume" else "onchain"}", "venue": "v", '
        f'"asset_pair": "{asset}/USDT", "metric_type": "{metric}", "raw_value": {raw}, "normalized_z_score": 3.5, "usd_value": {usd}, '
        f'"confidence": 1.0, "meta": {{"direction": "{side}"}}}}'
        for i, (ms, asset, metric, raw, usd, side) in enumerate(rows)]
    return spark.createDataFrame([(x,) for x in made], "value string")


def plain_totals(rows, tick_ms, factor):
    """(asset, sweep end) -> inflow less outflow, by a loop over the sweeps."""
    by_tick = {}
    for ms, asset, metric, _, usd, side in rows:
        by_tick.setdefault(-(-(BASE + ms) // tick_ms), []).append((asset, metric, usd, side))
    net, out = {}, {}
    for tick in sorted(by_tick):
        for asset, metric, usd, side in by_tick[tick]:
            if metric == "wallet_transfer":
                net[asset] = net.get(asset, 0.0) + (usd if side == "inflow" else -usd)
        out |= {(asset, tick * tick_ms): x for asset, x in net.items()}
        net = {asset: x * factor for asset, x in net.items()}
    return out


def test_sweeps_follow_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    gaps = rng.choice([0, 0, 40, 900, 5_000, 70_000], 300)
    rows = [(int(ms), "AB"[int(rng.integers(2))], ["wallet_transfer", "volume"][int(rng.integers(2))], 1.0,
             float(rng.integers(1, 9)) * 1e5, ["inflow", "outflow"][int(rng.integers(2))]) for ms in np.cumsum(gaps)]
    events = ev.usable(ev.parse_lines(lines(spark, rows)))
    grid = features.feature_grid(events, 1_000, 600_000, 0.9, on_events=True)
    got = {(r.asset, r.ts_ms): r.net_flow_norm for r in grid.collect()}
    want = plain_totals(rows, 1_000, 0.9)
    swept = {at for _, at in want} | {at for _, at in got}
    assert swept == {-(-(BASE + ms) // 1_000) * 1_000 for ms, *_ in rows}
    last = {}  # what is live: the newest event of each asset
    for ms, asset, *_ in rows:
        last.setdefault(asset, []).append(BASE + ms)
    live = {(a, at) for a, times in last.items() for at in swept if any(at - 600_000 <= t <= at for t in times)}
    assert set(got) == live and len(got) > 200
    for key, x in got.items():
        assert x == pytest.approx(np.tanh(want.get(key, 0.0) / 5e6), abs=1e-9)


def test_equal_to_the_full_grid_where_every_tick_has_an_event(spark):
    rows = [(i * 1_000 + 1, "AB"[i % 3 == 0], ["volume", "wallet_transfer"][i % 2], 1.0 + i % 7, 2e5 * (i % 5), "inflow") for i in range(200)]
    events = ev.usable(ev.parse_lines(lines(spark, rows)))
    args = {"tick_ms": 1_000, "ttl_ms": 30_000, "factor": 0.9}
    end = BASE + 200_000
    every = features.feature_grid(events, **args).where(F.col("ts_ms") <= end)
    swept = features.feature_grid(events, **args, on_events=True)
    a, b = ({(r.asset, r.ts_ms): [r[f] for f in FEATURES] for r in d.collect()} for d in (every, swept))
    assert a.keys() == b.keys() and len(a) > 300
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=1e-9)


def test_an_order_of_rows_or_a_repeated_event_changes_nothing(spark, sf):
    events = v.market_events(spark, sf)
    args = {"tick_ms": 1_000, "ttl_ms": 6 * HOUR, "factor": 0.9}
    one = replay.replay(events, **args).select("asset_pair", "ts_ms", F.round("score", 9).alias("score"))
    two = replay.replay(events.orderBy(F.desc("event_id")).repartition(7), **args).select(
        "asset_pair", "ts_ms", F.round("score", 9).alias("score"))
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0 and one.count() > 1_000


def test_no_events_and_no_times(spark, sf):
    none = v.market_events(spark, sf).limit(0)
    assert replay.replay(none).count() == 0 and replay.replay(none, fit=True).count() == 0
    timeless = v.market_events(spark, sf).limit(50).withColumn("ts_ms", F.lit(None).cast("bigint"))
    assert replay.replay(timeless).count() == 0


def test_summary_counts_broken_lines(spark):
    rows = [(i * 1_000, "A", "volume", 100.0 + i, 0.0, "inflow") for i in range(120)]
    text = lines(spark, rows).unionByName(spark.createDataFrame([("{broken",), ("",), ('{"event_id": "x"}',)], "value string"))
    parsed = ev.parse_lines(text)
    sigs = replay.replay(ev.usable(parsed))
    got = replay.replay_summary(parsed, sigs).first()
    assert (got.events, got.skipped, got.assets, got.alerts) == (120, 2, 1, 0) and got.signals == sigs.count() == 120
    assert got.minutes == pytest.approx(119 / 60)
    empty = ev.parse_lines(text.limit(0))
    got = replay.replay_summary(empty, replay.replay(ev.usable(empty))).first()
    assert (got.events, got.skipped, got.minutes, got.signals) == (0, 0, None, 0)


def test_trees_split_neighbouring_doubles(spark):
    tiny = spark.range(400).select("id", *[
        (F.lit(5e-324) * (F.col("id") % 2) if i == 0 else F.lit(1.0) + F.lit(2.0 ** -52) * (F.col("id") % 2) if i == 1 else F.lit(0.0)).alias(f)
        for i, f in enumerate(FEATURES)])
    model = forest.fit(tiny, trees=20, identity=["id"])
    assert forest.ml_scores(tiny, model).where("ml_score between 0 and 100").count() == 400
