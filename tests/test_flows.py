"""Bridge flows and deposits: the match against a plain search, all rows in one cell, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapevigil.functions.kernels import last_in_band, ratio_band
from tapevigil.operators import flows as fl


def plain(deposits, flows, window, ratio):
    """The latest flow's id of each deposit's row number."""
    out = {}
    ordered = sorted((f for f in flows if f[0] is not None and f[1] > 0), key=lambda f: (f[0], f[3]))
    for row, (t, usd, direction) in enumerate(deposits):
        fit = [f for f in ordered if direction == "inflow" and t is not None and usd > 0 and t - window <= f[0] <= t and min(f[1], usd) / max(f[1], usd) >= ratio]
        out[row] = fit[-1][3] if fit else None
    return out


def matched(spark, deposits, flows, **args):
    whales = spark.createDataFrame([(row, *d) for row, d in enumerate(deposits)], "row int, ts_ms long, usd_value double, direction string")
    whales = whales.withColumns({"order": F.lit(None).cast("long"), "f_ts": F.lit(1)}).repartition(3)
    bridges = spark.createDataFrame(flows, "ts_ms long, usd_value double, bridge string, flow_id long").repartition(3)
    got = fl.match_bridges(whales, bridges, ["ts_ms", "order"], "flow_id", **args).collect()
    assert len(got) == len(deposits)
    return {r["row"]: r["precursor"] and r["precursor"]["flow_id"] for r in got}


@pytest.mark.parametrize("chunk", [8, 1 << 15])
def test_match_equals_plain_search(spark, chunk):
    rng = random.Random(3)
    size = lambda: rng.choice([0.75, 1.0, 4 / 3, rng.uniform(0.3, 4.0), 10 ** rng.uniform(0, 6), 0.0, -5.0])
    flows = [(rng.choice([rng.randrange(4_000), None]) if i % 40 == 0 else rng.randrange(4_000), size(), f"b{i % 3}", i) for i in range(300)]
    deposits = [(rng.choice([rng.randrange(4_500), None]) if i % 50 == 0 else rng.randrange(4_500), size(), rng.choice(["inflow"] * 3 + ["outflow"])) for i in range(300)]
    deposits += deposits[:10]  # repeated rows
    assert matched(spark, deposits, flows, window_ms=500, min_ratio=0.75, chunk_rows=chunk) == plain(deposits, flows, 500, 0.75)


def test_all_rows_in_one_cell_are_cut_by_rows(spark, monkeypatch):
    rng = random.Random(8)
    flows = [(rng.randrange(300), rng.choice([1.0, 1.2, 1.35]), "b", i) for i in range(1_500)]
    deposits = [(rng.randrange(300), rng.choice([0.8, 0.91, 1.0, 1.7]), "inflow") for _ in range(1_500)]
    sizes = []
    real = fl.row_chunks
    monkeypatch.setattr(fl, "row_chunks", lambda *a: sizes.append(real(*a)) or sizes[-1])
    got = matched(spark, deposits, flows, window_ms=40, min_ratio=0.75, chunk_rows=200)
    assert got == plain(deposits, flows, 40, 0.75)
    assert [c.groupBy("__cell", "__chunk").count().agg(F.max("count")).first()[0] for c in sizes] == [200, 200]


def test_empty_sides(spark):
    assert matched(spark, [(5, 1.0, "inflow")], []) == {0: None}
    assert matched(spark, [], [(5, 1.0, "b", 1)]) == {}


def test_tree_finds_the_last_index_of_a_band():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 64, 100):
        values, q = rng.integers(0, 30, n).astype(float), 200
        low = rng.integers(0, 30, q).astype(float)
        high, upto = low + rng.integers(-1, 6, q), rng.integers(0, n + 1, q)
        want = [max((i for i in range(u) if a <= values[i] <= b), default=-1) for a, b, u in zip(low, high, upto)]
        assert last_in_band(values, low, high, upto).tolist() == want


def test_band_edges_are_exact():
    size = np.random.default_rng(5).uniform(1e-3, 1e9, 20_000)
    for ratio in (0.75, 0.9, 1.0, 1 / 3):
        low, high = ratio_band(size, ratio)
        assert (low / size >= ratio).all() and (np.nextafter(low, 0) / size < ratio).all()
        assert (size / high >= ratio).all() and (size / np.nextafter(high, np.inf) < ratio).all()
