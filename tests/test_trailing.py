"""Trailing ranks, divergences and windows: each row is read a fixed number of times, and moved once."""

import math
import random

import numpy as np
import pytest

from tapevigil.functions import kernels
from tapevigil.operators import orderbook, rolling, trades

NAN = float("nan")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def at_most(a, b):
    return b != b or a <= b


def test_percentile_of_latest_books(spark):
    rng = random.Random(5)
    rows = [("v", "A", i // 2 * 1000, i, rng.choice([None, NAN, 0.0, -0.0, rng.random(), rng.randrange(4) / 4])) for i in range(120)]
    rows += [(None, "A", i, None if i == 3 else i, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "venue string, symbol string, ts_ms long, snapshot_id long, obi double")
    out = orderbook.obi_percentile(df, keep=10, need=4)
    assert "collect_list" not in plan(out)
    found = {(r.venue, r.ts_ms, r.snapshot_id): r.obi_percentile for r in out.collect()}
    assert len(found) == len(rows)
    for key in ("v", None):
        own = [r for r in rows if r[0] == key]
        for i, (_, _, ts, id_, x) in enumerate(own):
            seen = [r[4] for r in own[max(0, i - 9):i + 1] if r[4] is not None]
            want = 0.5 if len(seen) < 4 else sum(at_most(s, x) for s in seen if x is not None) / len(seen)
            assert found[key, ts, id_] == pytest.approx(want)


def test_trailing_rank_starts_behind_a_halo():
    x = np.random.default_rng(1).integers(0, 9, 50).astype(float)
    known = np.arange(50) % 7 != 0
    whole, part = kernels.trailing_rank(x, known, 0, 12), kernels.trailing_rank(x[9:], known[9:], 11, 12)
    assert all((a[20:] == b).all() for a, b in zip(whole, part))


def test_divergence_reads_no_whole_frame_per_row(spark):
    rng = random.Random(3)
    rows = [("v", "A", i, i, rng.choice([None, 0.0, 100 + rng.random()]), rng.choice([None, rng.gauss(0, 500)]), i + 1) for i in range(90)]
    df = spark.createDataFrame(rows, "venue string, symbol string, ts_ms long, trade_id long, price double, cvd double, __n long")
    assert "-199, currentrow" not in plan(trades.price_divergence(df)).replace("$()", "")
    clamp = lambda v: max(-1.0, min(1.0, v))
    for keep, need in ((1, 1), (2, 2), (30, 5)):
        found = {r.trade_id: r.divergence for r in trades.price_divergence(df, keep, need).collect()}
        for i, (*_, price, cvd, _) in enumerate(rows):
            frame = rows[max(0, i + 1 - keep):i + 1]
            p0, c0 = frame[0][4], frame[0][5]
            want = 0.0
            if len(frame) >= need and p0:
                scale = max((abs(r[5]) for r in frame if r[5] is not None), default=0.0) or 1.0
                known = None not in (price, cvd, c0)
                want = clamp((clamp((cvd - c0) / scale) - clamp((price - p0) / p0 * 100)) / 2) if known else None
            assert found[i] == (None if want is None else pytest.approx(want)), (keep, i)


def test_window_sums_move_each_row_once(spark):
    rows = [("a" if i % 3 else None, 100 * (i // 2), i, None if i % 5 == 4 else float(i % 11), 2**60 + i) for i in range(80)]
    df = spark.createDataFrame(rows + [("a", None, 99, 1.0, 0)], "k string, ts_ms long, id long, x double, big long")
    out = rolling.rolling_window(df, ["k"], ["ts_ms", "id"], "x", 900)
    assert "window [" not in plan(out) and plan(out).count("explode(") == 1
    found = {r.id: r for r in out.collect()}
    assert len(found) == 80 and all(found[r[2]].big == r[4] for r in rows)
    for k in ("a", None):
        own = [r for r in rows if r[0] == k]
        for i, (_, t, id_, x, _) in enumerate(own):
            frame = [r for r in own[:i + 1] if r[1] >= t - 900]
            r = found[id_]
            assert (r.w_count, r.w_first_ts) == (len(frame), frame[0][1])
            if all(f[3] is not None for f in frame):
                assert r.w_sum == pytest.approx(sum(f[3] for f in frame)) and not math.isnan(r.w_std)
