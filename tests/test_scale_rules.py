"""No row lost to caps, NULL keys or NULL scores; exact ranks; near duplicates of whole groups."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tapevigil.operators import alerts, ranks, rolling, series, social, trades


def test_a_window_holds_all_its_rows(spark):
    n = 30_000
    t = spark.range(n).select(
        F.lit("v").alias("venue"), F.lit("A/USDT").alias("symbol"), F.col("id").alias("trade_id"),
        (F.col("id") / 1000).cast("long").alias("ts_ms"), F.lit(1.0).alias("price"), F.lit(1.0).alias("size"), F.lit("buy").alias("side"))
    assert trades.window_delta(t, 300_000).agg(F.max("window_delta")).first()[0] == n
    capped = rolling.rolling_window(t, ["symbol"], ["ts_ms", "trade_id"], "size", 300_000, max_samples=100)
    assert capped.agg(F.max("w_sum")).first()[0] == 100


def with_null_keys(spark):
    rows = [(None if i % 2 else "v", i * 7 % 100 * 1000, i, float(i), None if i % 3 else i) for i in range(60)]
    return spark.createDataFrame(rows, "k string, ts_ms long, i long, x double, y long")


def test_null_keys_are_one_key(spark):
    df, keys, order = with_null_keys(spark), ["k"], ["ts_ms", "i"]
    plain = df.toPandas().sort_values(["ts_ms", "i"])
    plain["k"] = plain["k"].fillna("none")
    got = {
        "sum": series.running(df, keys, order, {"o": F.col("x")}, block_ms=10_000),
        "row": series.row_index(df, keys, order, "o", block_ms=10_000),
        "prev": series.with_previous(df, keys, order, {"o": "x"}, block_ms=10_000),
        "fill": series.fill_forward(df, keys, order, "y", "o", block_ms=10_000),
    }
    want = {
        "sum": plain.groupby("k")["x"].cumsum(), "row": plain.groupby("k").cumcount() + 1,
        "prev": plain.groupby("k")["x"].shift(), "fill": plain.groupby("k")["y"].ffill(),
    }
    for name, frame in got.items():
        rows = {r["i"]: r["o"] for r in frame.collect()}
        assert len(rows) == 60
        for i, value in zip(plain["i"], want[name]):
            assert (rows[i] is None and value != value) or rows[i] == value, (name, i)
    z = rolling.dynamic_z(df, keys, order, "x", warmup=5, window=10, block_ms=10_000)
    assert z.count() == 60 and z.filter("k IS NULL AND z IS NOT NULL").count() > 10


def test_null_scores_are_below_the_threshold(spark):
    rows = [("A", "v", 1, 1, 90.0), ("A", "v", 2, 2, None), (None, "v", 3, 3, 95.0), ("A", "v", 4, 4, 10.0)]
    routed = alerts.route_alerts(spark.createDataFrame(rows, "asset_pair string, venue string, ts_ms long, signal_id long, score double"))
    assert {r.signal_id: r.reason_code for r in routed.collect()} == {1: "first", 2: "below", 3: "first", 4: "below"}


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = {
        "even": rng.normal(size=20_000), "heavy": np.exp(rng.normal(size=9_000) * 8), "ties": rng.integers(0, 3, 9_000).astype(float),
        None: rng.normal(size=5_001), "one": np.array([4.0]), "flat": np.zeros(6_000),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("void", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], "x", {"a": 0.01, "b": 0.5, "c": 0.9, "d": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        np.testing.assert_allclose([got[k][c] for c in "abcd"], np.quantile(values, [0.01, 0.5, 0.9, 1.0]), rtol=1e-12)
    everything = ranks.quantiles(df, [], "x", {"m": 0.5}).first()
    assert abs(everything["m"] - np.quantile(np.concatenate(list(groups.values())), 0.5)) < 1e-12
    assert ranks.quantiles(df.limit(0), ["k"], "x", {"m": 0.5}).count() == 0


def test_latency_of_all_samples_or_the_newest(spark):
    df = spark.range(5_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("ms"), "id")
    r = rolling.latency_summary(df, ["k"], "ms", ["id"], 4_000.0).first()
    assert (r["count"], r["p50"], r["p99"], r["max"], r["breaches"]) == (5_000, 2_499.0, 4_949.0, 4_999.0, 999)
    r = rolling.latency_summary(df, ["k"], "ms", ["id"], 4_000.0, keep=10).first()
    assert (r["count"], r["p50"], r["breaches"]) == (10, 4_994.0, 10)


def test_near_duplicates_of_a_large_group(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(280):
        words = list(base)
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(0, 40))] = f"x{rng.integers(0, 5)}"
        texts.append(" ".join(words))
    texts += ["", "one two", "one two", "a b c d"]
    posts = spark.createDataFrame([(None if i % 2 else "T", 5, i, i, t) for i, t in enumerate(texts)], "ticker string, eval_ms long, post_id long, ts_ms long, text string")
    got = {r["ticker"]: r["duplicate_ratio"] for r in social.duplicate_ratio(posts).collect()}

    def prints(text):
        w = text.split()
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else set(w)

    for ticker, part in (("T", texts[0::2]), (None, texts[1::2])):
        sets = [p for p in map(prints, part) if p]
        near = sum(len(a & b) >= 0.6 * len(a | b) - 1e-9 for a, b in itertools.combinations(sets, 2))
        assert abs(got[ticker] - near / (len(sets) * (len(sets) - 1) / 2)) < 1e-12


def test_a_failing_scorer_is_seen(spark):
    from tapevigil.functions.text import model_sentiment

    def scorer(texts):
        raise MemoryError("no room")

    r = model_sentiment(spark.createDataFrame([("moon",), (None,)], "text string"), "text", scorer).select("text", "sentiment.*").collect()
    assert {x["backend"] for x in r} == {"lexicon"} and {x["error"] for x in r} == {"MemoryError: no room"}
    assert next(x for x in r if x["text"])["score"] > 0


def test_layers_are_computed_below_their_generator(spark):
    """Spark interprets a generator's own expressions, so it gets a finished struct."""
    from tapevigil.functions.scalars import layer

    got = layer(spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double"), c=F.col("a") + F.col("b"), d=F.col("b") * 2)
    assert sorted(map(tuple, got.collect()), key=str) == [(1.0, 2.0, 3.0, 4.0), (None, 3.0, None, 6.0)]
    generator = got._jdf.queryExecution().analyzed().toString().split("Generate inline(array(")[1]
    assert generator.startswith("__made#")


def test_feature_inputs_are_hashed(spark):
    """The strongest values come of plain extremes: a maximum of structs would sort all cells."""
    from tapevigil.operators import features

    row = "asset string, at_ms bigint, metric string, venue string, ts_ms bigint, value double, z double, spike double, spread double, walls bigint, divergence double, acceleration double"
    rows = [("A", 0, "cvd", v, 0, None, z, 1.0, 0.0, 0, d, 0.0) for v, z, d in (("x", 2.0, -3.0), ("y", -2.0, 3.0), ("z", None, 1.0), ("w", 1.0, -3.0))]
    rows += [("B", 0, "cvd", "x", 0, None, -5.0, 1.0, 0.0, 0, -1.0, 0.0), ("B", 0, "cvd", "y", 0, None, 4.0, 1.0, 0.0, 0, None, 0.0)]
    got = features._assemble(spark.createDataFrame(rows, row), 1000, 60.0, 1000).select("asset", "cvd_z", "div", "vol_z")
    assert {tuple(r) for r in got.collect()} == {("A", 2.0, 3.0, None), ("B", -5.0, -1.0, None)}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
