import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapevigil.operators import alerts, features, rolling, trades
from tapevigil.plans import views as v
from tapevigil.sources import events as ev
from tapevigil.streaming import scoring, state, windows

HOUR = 3_600_000


@pytest.fixture(scope="module")
def feed(spark, sf):
    """The event table as a file stream of four time-ordered files."""
    state.enable_state_store(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    def make(df, files=4):
        path = tempfile.mkdtemp(prefix="run-stream-", dir="/tmp")
        cut = df.withColumn("__p", F.ntile(files).over(Window.orderBy("ts_ms")))
        for i in range(1, files + 1):
            cut.where(F.col("__p") == i).drop("__p").coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)

    return make


def drain(stream, name, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp")).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_series_scores_match_batch(spark, sf, feed):
    t = v.trades(spark, sf).select("venue", "symbol", "ts_ms", "trade_id", "size")
    keys, order = ["symbol"], ["ts_ms", "trade_id"]
    t = t.drop("venue")
    got = drain(state.series_scores(feed(t), keys, order, "size", 21600.0, 50, 20), "z_stream")
    want = rolling.dynamic_z(t, keys, order, "size", half_life_s=21600.0, window=50, warmup=20, block_ms=24 * HOUR)
    pair = got.select("trade_id", F.col("z").alias("gz"), F.col("threshold").alias("gt")).join(want, "trade_id").collect()
    assert len(pair) == t.count()
    for r in pair:
        assert (r.gz is None) == (r.z is None)
        assert r.z is None or abs(r.gz - r.z) < 1e-6
        assert abs(r.gt - r.threshold) < 1e-6


def test_streaming_cooldown_matches_batch(spark, sf, feed):
    s = v.signals(spark, sf)
    got = drain(state.route_alerts(feed(s), min_score=60.0, cooldown_ms=24 * HOUR), "routes")
    want = alerts.route_alerts(s, 60.0, 24 * HOUR).where("reason_code <> 'below'")
    a = {r.signal_id: (r.sent, r.reason_code, r.alert_count) for r in got.collect()}
    b = {r.signal_id: (r.sent, r.reason_code, r.alert_count) for r in want.collect()}
    assert a == b and a


def test_flushed_buckets_match_batch(spark, sf, feed):
    t = v.trades(spark, sf)
    got = {(r.venue, r.symbol, r.bucket_ms): round(r.volume, 6)
           for r in drain(state.flushed_buckets(feed(t), HOUR, 24 * HOUR, HOUR), "flushed").collect()}
    want = {(r.venue, r.symbol, r.bucket_ms): round(r.volume, 6)
            for r in trades.fill_gaps(trades.volume_buckets(t, HOUR), HOUR, 24 * HOUR).where("next_bucket_ms is not null").collect()}
    assert want and all(got.get(k) == x for k, x in want.items())


def test_window_dedup_and_join(spark, sf, feed):
    t = v.trades(spark, sf)
    got = drain(windows.volume_buckets(feed(t, 2), "1 hour", "1 minute"), "tumbling").count()
    assert 0 < got <= trades.volume_buckets(t, HOUR).count()
    assert drain(windows.first_seen(feed(t.select("symbol", "ts_ms"), 2), ["symbol"], "60 days"), "firsts").count() == 5
    posts = t.select(F.col("symbol").alias("ticker"), "ts_ms", F.col("size").alias("sentiment"))
    assert drain(windows.sliding_mentions(feed(posts, 2), "6 hours", "1 hour", "1 minute"), "slides").count() > 0
    money = t.select("trade_id", "ts_ms", (F.col("size") * 1000).alias("usd_value"), F.lit("inflow").alias("direction"))
    flows = t.where("trade_id % 3 = 0").select("ts_ms", (F.col("size") * 1000).alias("usd_value"), F.lit("b").alias("bridge"))
    joined = drain(windows.bridge_candidates(feed(money, 1), feed(flows, 1), 86_400), "joined")
    assert joined.where("flow_ms > ts_ms or size_ratio < 0.75").count() == 0 and joined.count() > 0


def test_latest_bridge_keeps_no_pair_list(spark, feed):
    """Newest fits equal brute force over four batches; equal sizes at one time cost rows, not pairs."""
    rows = [(i if i % 50 else None, 1_000_000_000 + (i * 7_919 % 900) * 60_000, float(1 + i * i % 37), "inflow") for i in range(400)]
    rows += rows[:40] + [(9_000, None, 5.0, "inflow"), (9_001, 1_000_000_000, None, "inflow"), (9_002, 1_020_000_000, 5.0, "outflow")]
    coins = [(1_000_000_000 + (i * 104_729 % 900) * 60_000, float(1 + i * 13 % 41), None if i % 9 == 0 else f"b{i % 4}") for i in range(150)]
    coins += [(None, 3.0, "b"), (1_000_000_000, None, "b")]
    d = spark.createDataFrame(rows, "id bigint, ts_ms bigint, usd_value double, direction string")
    f = spark.createDataFrame(coins, "ts_ms bigint, usd_value double, bridge string")
    stream = state.latest_bridge(feed(d), feed(f), "id", 3600)
    assert "Join" not in stream._jdf.queryExecution().analyzed().toString()
    got = sorted(map(str, map(tuple, drain(stream, "newest").select("id", "ts_ms", "usd_value", "flow_ms", "flow_usd", "bridge").collect())))
    passed = min(max(r[1] or 0 for r in rows if r[2] and r[3] == "inflow"), max(r[0] or 0 for r in coins if r[1])) - 60_000
    want = set()
    for i, ts, usd, way in rows:
        if way == "inflow" and usd and ts and ts <= passed:
            fits = [(t, u, b or "", b) for t, u, b in coins if t and u and ts - 3_600_000 <= t <= ts and min(u, usd) / max(u, usd) >= 0.75]
            if fits:
                t, u, _, b = max(fits, key=lambda x: x[:3])
                want.add(str((i, ts, usd, t, u, b)))
    assert want and got == sorted(want)


def test_score_stream_matches_batch_state(spark, sf, feed):
    e = v.market_events(spark, sf)
    out, ckpt = (tempfile.mkdtemp(prefix="run-score-", dir="/tmp") for _ in range(2))
    scoring.score_stream(feed(e, 2), out, ckpt).awaitTermination()
    rows = spark.read.parquet(out)
    assert "score" in rows.columns and rows.where("score < 0 or score > 100").count() == 0
    latest = drain(state.latest_observations(feed(e, 2)), "latest")
    last = latest.groupBy("asset").agg(F.max("at_ms").alias("at_ms"))
    for asset, at in [(r.asset, r.at_ms) for r in last.orderBy("asset").limit(2).collect()]:
        vec = features.vectors_from_state(latest.where((F.col("asset") == asset) & (F.col("at_ms") == at)))
        want = features.features_at(e, at).where(F.col("asset") == asset)
        a, b = vec.first(), want.first()
        for f in features.FEATURES:
            assert abs(a[f] - b[f]) < 1e-9, (asset, f)


def folder():
    return tempfile.mkdtemp(prefix="run-stream-", dir="/tmp")


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, out, checkpoint):
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_late_rows_are_dropped_and_a_restart_goes_on(spark):
    schema = "venue string, symbol string, ts_ms bigint, trade_id bigint, price double, size double"
    path, out, checkpoint = folder(), folder(), folder()
    stream = lambda: windows.volume_buckets(spark.readStream.schema(schema).parquet(path), "1 minute", "30 seconds")
    put(spark, path, [("v", "S", 10_000, 1, 1.0, 1.0), ("v", "S", 200_000, 2, 1.0, 2.0)], schema)
    first = run(stream(), out, checkpoint).collect()
    assert [(r.bucket_ms, r.volume) for r in first] == [(0, 1.0)]
    put(spark, path, [("v", "S", 20_000, 3, 1.0, 50.0), ("v", "S", 215_000, 4, 1.0, 4.0), ("v", "S", 400_000, 5, 1.0, 8.0)], schema)
    second = run(stream(), out, checkpoint).collect()
    assert sorted((r.bucket_ms, r.volume) for r in second) == [(0, 1.0), (180_000, 6.0)]


def test_cooldown_state_survives_a_restart(spark):
    state.enable_state_store(spark)
    schema = "asset_pair string, venue string, ts_ms bigint, signal_id bigint, score double"
    path, out, checkpoint = folder(), folder(), folder()
    stream = lambda: state.route_alerts(spark.readStream.schema(schema).parquet(path))
    put(spark, path, [("A", "v", 1_000, 1, 85.0), ("A", "v", 2_000, 2, 86.0)], schema)
    run(stream(), out, checkpoint)
    put(spark, path, [("A", "v", 3_000, 3, 95.0), ("A", "v", 400_000, 4, 85.0)], schema)
    got = {r.signal_id: (r.reason_code, r.alert_count) for r in run(stream(), out, checkpoint).collect()}
    assert got == {1: ("first", 1), 2: ("cooldown", 1), 3: ("escalation", 2), 4: ("elapsed", 3)}


def test_idle_keys_are_forgotten(spark):
    """State rows fall when keys fall silent, for both processors; a key that comes back starts anew."""
    state.enable_state_store(spark)
    alert = "asset_pair string, venue string, ts_ms bigint, signal_id bigint, score double"
    series = "k string, ts_ms bigint, id bigint, x double"

    def kept(make, path, schema, rows, out, checkpoint):
        put(spark, path, rows, schema)
        stream = make(spark.readStream.schema(schema).parquet(path))
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    path, out, checkpoint = folder(), folder(), folder()
    make = lambda rows: state.route_alerts(rows, idle_ms=1_000_000, delay="1 second")
    full = kept(make, path, alert, [(f"A{i}", "v", 1_000 + i, i, 85.0) for i in range(50)], out, checkpoint)
    kept(make, path, alert, [("B", "v", 5_000_000, 100, 85.0)], out, checkpoint)
    left = kept(make, path, alert, [("A1", "v", 5_100_000, 101, 85.0)], out, checkpoint)
    assert full >= 50 and left < 10
    back = spark.read.parquet(out).where("signal_id = 101").first()
    assert (back.reason_code, back.alert_count) == ("first", 1)

    path, out, checkpoint = folder(), folder(), folder()
    make = lambda rows: state.series_scores(rows, ["k"], ["ts_ms", "id"], "x", idle_ms=1_000_000, delay="1 second")
    full = kept(make, path, series, [(f"A{i % 50}", 1_000 + i, i, float(i)) for i in range(500)], out, checkpoint)
    kept(make, path, series, [("B", 5_000_000, 1_000, 1.0)], out, checkpoint)
    left = kept(make, path, series, [("B", 5_100_000, 1_001, 2.0)], out, checkpoint)
    assert full >= 50 and left < 10


def test_rows_of_closed_windows_are_counted_as_dropped(spark, sf):
    from tapevigil.plans.streams import feed_in_turn

    t = v.trades(spark, sf)
    turn = F.when(F.col("trade_id") % 5 == 0, 2).when(F.col("ts_ms") < 1_705_276_800_000, 0).otherwise(1)
    stream = windows.volume_buckets(feed_in_turn(t, turn), "1 hour", "1 minute")
    q = (stream.writeStream.format("parquet").option("path", folder()).option("checkpointLocation", folder()).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"]) > 0


def test_quiet_asset_is_swept_then_forgotten(spark, sf):
    state.enable_state_store(spark)
    schema = v.market_events(spark, sf).schema
    base = v.market_events(spark, sf).where("metric_type = 'wallet_transfer'").limit(1)

    def event(pair, ts, usd, metric="wallet_transfer"):
        row = base.withColumn("asset_pair", F.lit(pair)).withColumn("ts_ms", F.lit(ts).cast("bigint"))
        row = row.withColumn("usd_value", F.lit(usd)).withColumn("normalized_z_score", F.lit(0.0)).withColumn("metric_type", F.lit(metric))
        return row.withColumn("event_id", F.lit(f"{pair}{ts}")).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    path, out, checkpoint = folder(), folder(), folder()
    stream = lambda: state.latest_observations(
        spark.readStream.schema(schema).parquet(path), tick_ms=5_000, ttl_ms=100_000, sweep_ms=60_000, delay="1 second")
    event("Q/USDT", 1_000, 9e6).unionByName(event("Q/USDT", 1_001, 5.0)).write.mode("append").parquet(path)
    rows = run(stream(), out, checkpoint).where("asset = 'Q'").collect()
    assert len(rows) == 1 and rows[0].urgent and rows[0].at_ms == 1_001
    for at in (70_000, 150_000, 400_000, 600_000):
        event("P/USDT", at, 1.0).write.mode("append").parquet(path)
        run(stream(), out, checkpoint)
    rows = spark.read.parquet(out).where("asset = 'Q'").orderBy("at_ms").collect()
    assert [r.at_ms for r in rows] == [1_001, 61_001] and not rows[1].urgent
    assert rows[1].in_usd <= rows[0].in_usd
    event("Q/USDT", 700_000, 7.0).write.mode("append").parquet(path)
    last = run(stream(), out, checkpoint).where("asset = 'Q' and at_ms = 700000").first()
    assert max(last.in_usd, last.out_usd) <= 7.0 and not last.urgent


def test_scoring_goes_on_after_a_stop_between_write_and_ledger(spark, sf, monkeypatch):
    schema = v.market_events(spark, sf).schema
    cut = v.market_events(spark, sf).withColumn("__p", F.ntile(3).over(Window.orderBy("ts_ms", "event_id")))
    path = folder()
    stream = lambda: (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                      .option("latestFirst", "false").parquet(path))
    for i in (1, 2, 3):
        cut.where(F.col("__p") == i).drop("__p").coalesce(1).write.mode("append").parquet(path)
    state.enable_state_store(spark)
    whole, broken = folder(), folder()
    scoring.score_stream(stream(), whole, folder(), floor=0.0).awaitTermination()

    def stop(written, out_path, batch_id):
        if batch_id == 1:
            raise RuntimeError("stopped before the ledger")
        return entered(written, out_path, batch_id)

    entered, checkpoint = scoring.record, folder()
    monkeypatch.setattr(scoring, "record", stop)
    with pytest.raises(Exception, match="stopped before the ledger"):
        scoring.score_stream(stream(), broken, checkpoint, floor=0.0).awaitTermination()
    rows = lambda out: sorted((r.batch, r.signal_id, round(r.score, 9)) for r in scoring.published(spark, out).collect())
    assert {b for b, _, _ in rows(broken)} == {0} and spark.read.parquet(broken).where("batch = 1").count() > 0
    monkeypatch.setattr(scoring, "record", entered)
    scoring.score_stream(stream(), broken, checkpoint, floor=0.0).awaitTermination()
    assert rows(broken) == rows(whole) and {b for b, _, _ in rows(whole)} >= {0, 1, 2}
    # A batch in the ledger that the engine runs again is not published twice.
    assert scoring.ledger(spark, broken).groupBy("batch").count().where("count > 1").count() == 0


def test_urgency_does_not_lift_a_later_sweep(spark):
    columns = f"asset string, at_ms bigint, {state.LATEST_COLUMNS}, in_usd double, out_usd double, bridge_usd double, hits bigint, urgent boolean"
    row = lambda at, urgent: ("A", at, "volume", "v", 1_000, 1.0, 4.5, 1.2, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, urgent)
    got = scoring.score_batch(spark.createDataFrame([row(1_000, True), row(61_000, False)], columns), None, floor=99.0)
    assert [r.ts_ms for r in got.collect()] == [1_000]
