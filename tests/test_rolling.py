import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapevigil.operators import rolling, series


def make(spark, rows):
    return spark.createDataFrame(rows, "k string, ts_ms bigint, id bigint, x double")


def sample(seed, n, step=4000, keys=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for k in keys:
        t = 1_700_000_000_000
        for i in range(n):
            t += rng.choice([0, 1, rng.randrange(step), rng.randrange(step * 3)])
            rows.append((k, t, i, round(rng.lognormvariate(0, 1), 3)))
    return rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def ewma_walk(items, half_life, warmup):
    mean = var = 0.0
    out, last = [], None
    for n, (_, t, _, x) in enumerate(items):
        if n < warmup:
            z = None
        else:
            sd = math.sqrt(var)
            z = 0.0 if sd <= 1e-12 else (x - mean) / sd
        out.append(z)
        if n == 0:
            mean, var = x, 0.0
        else:
            a = min(1.0, max(1e-4, 1 - 0.5 ** (max((t - last) / 1000, 1e-6) / half_life)))
            d = x - mean
            mean += a * d
            var = (1 - a) * (var + d * a * d)
        last = t
    return out


def robust_walk(items, window, warmup, zero_is_normal):
    out = []
    for i, (_, _, _, x) in enumerate(items):
        buf = sorted(r[3] for r in items[max(0, i - window):i])
        n = len(buf)
        if n < warmup:
            out.append(None)
            continue
        med = statistics.median(buf)
        scale = statistics.median(abs(v - med) for v in buf) * 1.4826
        if scale <= 1e-12:
            scale = (buf[3 * n // 4] - buf[n // 4]) / 1.349
        if scale <= 1e-12:
            if zero_is_normal:
                out.append(None)
            elif abs(x - med) <= 1e-12:
                out.append(0.0)
            else:
                out.append(max(-50.0, min(50.0, (x - med) / max(abs(med) * 1e-4, 1e-9))))
            continue
        out.append((x - med) / scale)
    return out


def close(a, b, tol=1e-8):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def test_running_index_previous_and_fill(spark):
    rows = sample(1, 300)
    df = make(spark, rows)
    got = series.running(df, ["k"], ["ts_ms", "id"], {"s": F.col("x")}, block_ms=20_000)
    got = series.row_index(got, ["k"], ["ts_ms", "id"], block_ms=20_000, total="tot")
    got = series.with_previous(got, ["k"], ["ts_ms", "id"], {"px": "x"}, block_ms=20_000)
    got = got.withColumn("sparse", F.when(F.col("id") % 7 == 3, F.col("x")))
    got = series.fill_forward(got, ["k"], ["ts_ms", "id"], "sparse", "ff", block_ms=20_000)
    found = {(r.k, r.id): r for r in got.collect()}
    assert len(found) == len(rows)
    for k, items in by_key(rows).items():
        total, prev, ff = 0.0, None, None
        for n, (_, _, i, x) in enumerate(items, 1):
            total += x
            if i % 7 == 3:
                ff = x
            r = found[(k, i)]
            assert r["__n"] == n and r.tot == len(items)
            assert close(r.s, total) and r.px == prev and r.ff == ff
            prev = x


@pytest.mark.parametrize("cap", [20_000, 7])
def test_rolling_window_matches_direct(spark, cap):
    rows = sample(2, 250)
    w = 15_000
    got = rolling.rolling_window(make(spark, rows), ["k"], ["ts_ms", "id"], "x", w, max_samples=cap)
    got = got.withColumn("z", rolling.window_z("x", min_samples=5)).withColumn(
        "rate", rolling.rate_per_minute()
    )
    found = {(r.k, r.id): r for r in got.collect()}
    assert len(found) == len(rows)
    for k, items in by_key(rows).items():
        for i, (_, t, idx, x) in enumerate(items):
            frame = [r for r in items[: i + 1] if r[1] >= t - w][-cap:]
            vals = [r[3] for r in frame]
            r = found[(k, idx)]
            assert r.w_count == len(vals)
            assert close(r.w_sum, sum(vals))
            sd = statistics.stdev(vals) if len(vals) > 1 else 0.0
            assert close(r.w_std, sd, 1e-7)
            assert r.w_first_ts == frame[0][1]
            span = t - frame[0][1]
            rate = sum(vals) if len(vals) < 2 or span <= 0 else sum(vals) * 60_000 / span
            assert close(r.rate, rate)
            if len(vals) < 5:
                assert r.z is None


def test_known_window_numbers(spark):
    rows = [("a", 1000 * i, i, float(v)) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])]
    last = rolling.rolling_window(make(spark, rows), ["k"], ["ts_ms"], "x", 60_000).orderBy(
        F.desc("ts_ms")
    ).first()
    assert last.w_mean == pytest.approx(5.0) and last.w_std == pytest.approx(2.138, abs=1e-3)


@pytest.mark.parametrize("zero_is_normal", [False, True])
def test_dynamic_z_across_chunks(spark, zero_is_normal):
    rows = sample(3, 400)
    rows += [("flat", 1_700_000_000_000 + 1000 * i, i, 0.0 if i < 90 else 5.0) for i in range(100)]
    got = rolling.dynamic_z(
        make(spark, rows), ["k"], ["ts_ms", "id"], "x", half_life_s=20, window=40, warmup=10,
        zero_is_normal=zero_is_normal, block_ms=30_000, chunk_rows=64, parts=True,
    )
    found = {(r.k, r.id): r for r in got.collect()}
    assert len(found) == len(rows)
    for k, items in by_key(rows).items():
        ez = ewma_walk(items, 20, 10)
        rz = robust_walk(items, 40, 10, zero_is_normal)
        recent, level = [], 3.0
        for (_, _, i, _), e, r in zip(items, ez, rz):
            if r is None:
                z = None if zero_is_normal else e
            elif e is None:
                z = max(-25.0, min(25.0, r))
            else:
                z = max(-25.0, min(25.0, 0.6 * r + 0.4 * e))
            row = found[(k, i)]
            assert close(row.z_ewma, e, 1e-6) and close(row.z_robust, r, 1e-9)
            assert close(row.z, z, 1e-6), (k, i, row.z, z)
            if z is not None:
                recent = (recent + [abs(z)])[-200:]
                if len(recent) >= 50:
                    p95 = sorted(recent)[int(0.95 * (len(recent) - 1))]
                    level = max(3.0, min(p95 * 1.15, 7.5))
            assert close(row.threshold, level, 1e-6)


def test_reference_series_cases(spark):
    quiet = [("q", 1000 * i, i, 0.0 if i < 40 else 5.0) for i in range(41)]
    peg = [("p", 1000 * i, i, 100.0 if i < 40 else 105.0) for i in range(41)]
    burst = [("v", 1000 * i, i, 100.0 + i % 5 if i < 120 else 400.0) for i in range(121)]
    silent = rolling.dynamic_z(make(spark, quiet), ["k"], ["ts_ms"], "x", zero_is_normal=True)
    assert silent.where("id = 40").first().z is None
    moved = rolling.robust_z(make(spark, peg), ["k"], ["ts_ms"], "x")
    assert abs(moved.where("id = 40").first().robust_z) > 10
    loud = rolling.dynamic_z(make(spark, burst), ["k"], ["ts_ms"], "x")
    assert loud.where("id = 120").first().z > 3


def test_latency_summary(spark):
    rows = make(spark, [("a", i, i, float(i % 300)) for i in range(3000)])
    for keep, values in ((None, [float(i % 300) for i in range(3000)]), (2048, [float(i % 300) for i in range(3000 - 2048, 3000)])):
        r = rolling.latency_summary(rows, ["k"], "x", ["ts_ms"], keep=keep).first()
        assert r["count"] == len(values) and r.p95 == sorted(values)[math.ceil(0.95 * len(values)) - 1]
        assert r.breaches == sum(v > 200 for v in values)


def test_previous_row_moves_rows_once(spark):
    """One shuffle of the rows and no join; NULL keys, times and values as the plain window has them."""
    rows = [(["a", "b", None][i % 3], None if i % 17 == 0 else (i * 7_919) % 90_000, i, None if i % 5 == 0 else f"x{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts_ms bigint, id bigint, x string")
    got = series.with_previous(df, ["k"], ["ts_ms", "id"], {"px": "x", "pid": "id"}, block_ms=9_000)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    w = Window.partitionBy("k").orderBy("ts_ms", "id")
    want = df.withColumn("px", F.lag("x").over(w)).withColumn("pid", F.lag("id").over(w))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
