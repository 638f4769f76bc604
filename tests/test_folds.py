import random

import numpy as np
import pytest

from tapevigil.operators import folds
from tapevigil.operators import series as series_helpers
from tapevigil.operators.series import row_chunks


def series(seed, n, keys=("a", "b"), gap=900):
    rng = random.Random(seed)
    rows = []
    for k in keys:
        t = 0
        for i in range(n):
            t += rng.choice([0, 50, rng.randrange(gap), rng.randrange(gap * 6)])
            drift = 1.2 if (i // 40) % 3 == 1 else -1.0 if (i // 40) % 3 == 2 else 0.0
            z = None if rng.random() < 0.1 else rng.gauss(drift, 1)
            rows.append((k, t, i, z, rng.choice([1, 1, 1, 2, 3, 4]), rng.random() < 0.05))
    return rows


SCHEMA = "k string, ts_ms bigint, id bigint, z double, rank int, forced boolean"


@pytest.mark.parametrize("chunk,fan_in", [(7, 3), (64, 32), (4096, 32)])
def test_cusum_any_chunking(spark, chunk, fan_in):
    rows = series(5, 300)
    rows += [("steady", i * 10, i, 2.0, 1, False) for i in range(60)]
    got = folds.cusum(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts_ms", "id"],
                      chunk_rows=chunk, fan_in=fan_in)
    found = {(r.k, r.id): r.alarm for r in got.collect()}
    assert len(found) == len(rows)
    for k in {r[0] for r in rows}:
        pos = neg = 0.0
        for _, _, i, z, _, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            alarm = 0
            if z is not None:
                z = max(-10.0, min(10.0, z))
                pos, neg = max(0.0, pos + z - 0.5), min(0.0, neg + z + 0.5)
                if pos > 5:
                    pos, alarm = 0.0, 1
                elif neg < -5:
                    neg, alarm = 0.0, -1
            assert found[(k, i)] == alarm, (k, i)
    assert 1 in found.values() and -1 in found.values()


def gated(rows, cooldown):
    """(sent, time since the last one sent, number sent) of each (key, id), row by row."""
    out = {}
    for k in {r[0] for r in rows}:
        last, count = None, 0
        for _, t, i, _, rank, force in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            ok = last is None or force or rank > last[1] or t - last[0] >= cooldown
            since = None if last is None else t - last[0]
            if ok:
                last, count = (t, rank), count + 1
            out[k, i] = (ok, since, count)
    return out


@pytest.mark.parametrize("chunk,fan_in", [(5, 2), (40, 3), (4096, 32)])
@pytest.mark.parametrize("cooldown", [0, 500, 3000])
def test_cooldown_gate_any_chunking(spark, cooldown, chunk, fan_in):
    rows = series(6, 300, keys=("a", "b", None))
    got = folds.cooldown_gate(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts_ms", "id"],
                              cooldown, rank="rank", forced="forced", chunk_rows=chunk, fan_in=fan_in)
    found = {(r.k, r.id): (r.gate_sent, r.gate_since_ms, r.gate_count) for r in got.collect()}
    assert found == gated(rows, cooldown)


def test_one_key_in_one_moment_is_cut_by_rows(spark, monkeypatch):
    rng = random.Random(9)
    hot = [("hot", rng.randrange(40), i, None, rng.choice([1, 1, 1, 1, 2]), rng.random() < 0.001) for i in range(9_000)]
    rows = hot + [(f"k{i % 50}", rng.randrange(10**6), i, None, 1, False) for i in range(1_000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    indexed, longest = series_helpers.positions(table, ["k"], ["ts_ms", "id"])
    assert longest == 9_000
    numbers = sorted((r.ts_ms, r.id, r["__n"]) for r in indexed.where("k = 'hot'").collect())
    assert [n for _, _, n in numbers] == list(range(1, 9_001))
    seen = []
    monkeypatch.setattr(folds, "row_chunks", lambda *a: seen.append(row_chunks(*a)) or seen[-1])
    got = folds.cooldown_gate(table, ["k"], ["ts_ms", "id"], 7, rank="rank", forced="forced", chunk_rows=128, fan_in=4)
    assert {(r.k, r.id): (r.gate_sent, r.gate_since_ms, r.gate_count) for r in got.collect()} == gated(rows, 7)
    assert seen[0].groupBy("k", "__chunk").count().agg({"count": "max"}).first()[0] == 128


def test_maps_of_neighbours_compose():
    """A stretch's map equals that of its halves joined, for starts on, below and above all limits."""
    rng = random.Random(2)
    for _ in range(300):
        y = [rng.choice([-0.5, 0.25, 0.5, 2.0]) for _ in range(rng.randrange(2, 30))]
        cut = rng.randrange(1, len(y))
        whole, first, then = (folds._one_sided_map(np.array(part), 3.0) for part in (y, y[:cut], y[cut:]))
        joined = folds._joined(first, then)
        for start in np.arange(0, 3.25, 0.25):
            assert folds._follow(start, *joined) == folds._follow(start, *whole) == folds._one_sided(np.array(y), start, 3.0)[0]
