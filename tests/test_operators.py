import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tapevigil.functions import text as t
from tapevigil.operators import alerts, discovery, features, flows, forest, orderbook, rules, scoring, social
from tapevigil.operators import trades as tr
from tapevigil.plans import replay
from tapevigil.schemas import FEATURES, NEUTRAL
from tapevigil.sources import chain, events, payloads, posts, registry

LEVELS = "array<struct<price:double,size:double>>"
NOW = 1_700_000_000_000


def book(spark, *snaps):
    rows = [("v", "A/USDT", NOW + i * 1000, i, b, a) for i, (b, a) in enumerate(snaps)]
    return spark.createDataFrame(rows, f"venue string, symbol string, ts_ms bigint, snapshot_id bigint, bids {LEVELS}, asks {LEVELS}")


def vector(spark, *cases, coverage=1.0):
    rows = [[f"A{i}", NOW, coverage] + [float({**NEUTRAL, **c}[f]) for f in FEATURES] for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, "asset string, ts_ms bigint, coverage double, " + ", ".join(f"{f} double" for f in FEATURES))


def test_order_book_cases(spark):
    lop = ([(100 - 0.1 * i, 10.0) for i in range(1, 6)] + [(90.0, 0.0)], [(100 + 0.1 * i, 1.0) for i in range(1, 6)])
    tight = ([(99.9, 1.0)], [(100.1, 1.0)])
    empty = ([], [(101.0, 2.0)])
    m = {r.snapshot_id: r for r in orderbook.book_metrics(orderbook.normalise_books(book(spark, lop, tight, empty))).collect()}
    assert m[0].obi > 0.7 and m[0].direction == "bid_heavy" and len(m[0].bids) == 5
    assert m[1].spread_bps == pytest.approx(20.0) and m[1].mid_price == pytest.approx(100.0)
    assert m[2].mid_price == 101.0 and m[2].spread_bps == 0.0 and m[2].obi == -1.0
    assert all(-1 <= r.obi <= 1 and -1 <= r.weighted_obi <= 1 for r in m.values())
    walls = orderbook.wall_changes(orderbook.book_metrics(orderbook.normalise_books(book(
        spark, ([(99.0, 1000.0), (98.0, 5.0)], [(101.0, 5.0)]), ([(99.5, 1.0), (99.0, 1.0)], [(101.0, 5.0)])))))
    w = orderbook.wall_events(walls).collect()
    assert len(w) == 1 and w[0].side == "buy" and w[0].absorbed_pct == pytest.approx(-0.999)


def test_trade_flow_cases(spark):
    ddl = "venue string, symbol string, ts_ms bigint, trade_id bigint, price double, size double, side string"
    flat = [("v", "A", NOW + i * 100, i, 100.0, 1.0, "buy") for i in range(200)]
    two = [("v", "B", NOW, 0, 100.0, 1.0, "buy"), ("v", "B", NOW + 1, 1, 100.0, 0.5, "sell")]
    d = tr.cumulative_delta(spark.createDataFrame(flat + two, ddl))
    out = {(r.symbol, r.trade_id): r for r in tr.price_divergence(d).collect()}
    assert out["B", 1].cvd == pytest.approx(50.0) and out["B", 1].buy_ratio == pytest.approx(2 / 3)
    assert out["A", 199].divergence > 0.2 and out["A", 10].divergence == 0.0


def test_discovery_cases(spark):
    rows = [
        ("v", "BTC/USDT", 1, 0, 450e6, -2.2, None, None), ("v", "QUIET/USDT", 1, 0, 5e5, 1.1, None, None),
        ("v", "DUST/USDT", 1, 0, 900.0, 320.0, None, None), ("v", "PUMPER/USDT", 1, 0, 8e5, 190.0, None, None),
        ("v", "DUMPER/USDT", 1, 0, 7e5, -55.0, None, None), ("v", "WOW/USDT", 1, 0, 9e5, 30.0, None, None),
        ("v", "WOW/USDC", 1, 0, 3e5, 30.0, None, None), ("v", "EURO/EUR", 1, 0, 9e5, 60.0, None, None),
        ("v", "FAKE/USDT", 1, 0, 9e5, -74.3, 1.0, 0.99), ("v", "REAL/USDT", 1, 0, 9e5, -74.3, 1.0, 0.257),
    ]
    ddl = "venue string, symbol string, scan bigint, scan_ms bigint, quote_volume double, percentage double, open_px double, last_px double"
    found = {r.symbol: r for r in discovery.discover(spark.createDataFrame(rows, ddl)).collect()}
    assert set(found) == {"PUMPER/USDT", "DUMPER/USDT", "WOW/USDT", "REAL/USDT"}
    assert found["DUMPER/USDT"].reason == "dump -55%" and found["PUMPER/USDT"].reason == "pump +190%"
    sel = spark.createDataFrame([("a", 1, "X/USDT", -73.4), ("a", 1, "Y/USDT", -68.0), ("a", 1, "Z/USDT", -60.0), ("a", 1, "W/USDT", -30.0)],
                                "venue string, scan bigint, symbol string, change_pct double")
    moves = spark.createDataFrame([("b", 1, "X", 2.68), ("b", 1, "Y", -71.0), ("b", 1, "W", 1.0)], "venue string, scan bigint, base string, move double")
    assert {r.symbol for r in discovery.corroborate(sel, moves).collect()} == {"Y/USDT", "Z/USDT", "W/USDT"}


def test_chain_cases(spark):
    wallet = "0x28C6c06298d514Db089934071355E5743bf21d60"
    pad = lambda a: "0x" + a[2:].rjust(64, "0")
    other = "0x" + "11" * 20
    usdt = "0xdAC17F958D2ee523a2206206994597C13D831ec7"
    rows = [
        ("ethereum", NOW, usdt, [chain.TRANSFER_TOPIC, pad(other), pad(wallet)], hex(1_500_000 * 10**6), "0x10", "0xaa", "0x1"),
        ("ethereum", NOW, usdt, ["0xdead", pad(other), pad(wallet)], "0x1", "0x10", "0xbb", "0x2"),
        ("ethereum", NOW, usdt, [], "0x1", "0x10", "0xcc", "0x3"),
    ]
    logs = spark.createDataFrame(rows, "chain string, ts_ms bigint, address string, topics array<string>, data string, blockNumber string, transactionHash string, logIndex string")
    got = flows.whale_transfers(chain.token_amounts(chain.transfer_logs(logs), registry.tokens(spark)), registry.cex_wallets(spark)).collect()
    assert len(got) == 1 and got[0].direction == "inflow" and got[0].counterparty == "binance_14"
    assert got[0].amount == pytest.approx(1_500_000.0) and got[0].block == 16
    wide = spark.createDataFrame([("f" * 64,), ("",)], "h string").select(chain.hex_double(F.col("h")).alias("x")).collect()
    assert wide[0].x == pytest.approx(float(2**256 - 1)) and wide[1].x == 0.0


def test_sentiment_and_fingerprints(spark):
    texts = ["$PEPE to the moon 🚀 bullish", "not bullish", "very bullish", "bullish", "scam rug", "the cat sat", "", "isn't weak ⚠️", "a b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = df.select("i", t.lexicon_sentiment(F.col("x")).alias("s"), t.extract_tickers(F.col("x")).alias("k"),
                    t.fingerprint(F.col("x")).alias("f")).orderBy("i").collect()
    s = [r.s.score for r in got]
    assert s[0] > 0.5 and s[1] < 0 and s[2] > s[3] > 0 and s[4] < -0.5 and s[5] == s[6] == 0.0 and s[7] > 0
    assert got[5].s.label == "neutral" and got[5].s.confidence == 0.25 and got[0].k == ["PEPE"]
    assert got[5].f == ["the cat sat"] and got[8].f == ["a", "b"] and got[6].f == []


def test_bot_farm_separates_farm_from_crowd(spark):
    rng = random.Random(4)
    ddl = "post_id bigint, ticker string, author_id string, text string, ts_ms bigint, author_age_days double, author_followers int"
    base = NOW // 600_000 * 600_000
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        for tick in ("FARM", "CROWD"):
            rows.append((i, tick, f"o{i}", " ".join(rng.sample(words, 12)), base + rng.randrange(1, 599_000), rng.uniform(40, 2500), rng.randrange(50, 9000)))
    for i in range(70):
        a = i % 23
        rows.append((1000 + i, "FARM", f"f{a}", f"buy the gem now to the moon before it is too late friends {i % 2}",
                     base + 5000 + i * 8000, 5 + 0.7 * (a % 3 - 1), 15 + a * 7))
    rows += [(i, "FEW", "x", "hello there world", base + 10 + i, 5.0, 10) for i in range(3)]
    got = {r.ticker: r for r in social.bot_farm_verdicts(social.post_windows(spark.createDataFrame(rows, ddl))).collect()}
    assert got["FARM"].is_bot_farm and got["FARM"].on_cohort and got["FARM"].score > 0.5
    assert not got["CROWD"].is_bot_farm and got["CROWD"].score < 0.4
    assert got["FEW"].score == 0.0 and got["FEW"].reasons == ["insufficient posts"]


def test_rules_and_composite(spark):
    cases = [
        {},
        {"volume_z": 8, "volume_spike_ratio": 9, "obi": -0.8, "obi_abs": 0.8, "obi_z": -5, "cvd_z": -6},
        {"volume_z": 6, "mention_z": 5, "sentiment": 0.8, "sentiment_abs": 0.8},
        {"volume_z": 6, "volume_spike_ratio": 10, "mention_z": 6, "bot_farm_score": 0.9, "sentiment": 0.8, "sentiment_abs": 0.8},
        {"volume_z": 5, "volume_spike_ratio": 8, "spread_bps": 0.5, "obi": 0.05, "obi_abs": 0.05, "cvd_z": 0.3},
    ]
    got = {r.asset: r for r in scoring.score_vectors(vector(spark, *cases)).collect()}
    assert got["A0"].score == 0.0 and got["A0"].severity == "info"
    assert got["A1"].score >= 80 and got["A1"].reasons[0].startswith("⚑ SELL-OFF: volume 8.0σ, book 80% one-sided, CVD -6.0σ")
    assert got["A2"].score < got["A3"].score - 25 and got["A3"].score >= 80
    assert got["A4"].wash > 0 and any("wash-trading" in r for r in got["A4"].reasons)
    assert all(0 <= r.score <= 100 and len(r.reasons) <= 8 for r in got.values())
    thin = scoring.score_vectors(vector(spark, cases[3], coverage=1 / 3)).first()
    assert thin.score == pytest.approx(thin.rule_score * 0.82)


def test_forest_finds_outliers_and_survives_saving(spark):
    rng = random.Random(1)
    cases = [{f: rng.gauss(0, 1) for f in FEATURES} for _ in range(400)] + [{f: 12.0 for f in FEATURES}]
    vec = vector(spark, *cases)
    model = forest.fit(vec, trees=40, identity=["asset"])
    path = tempfile.mkdtemp(prefix="run-model-", dir="/tmp")
    model.save(spark, path)
    again = forest.load(spark, path)
    a = {r.asset: r.ml_score for r in forest.ml_scores(vec, model).collect()}
    b = {r.asset: r.ml_score for r in forest.ml_scores(vec, again).collect()}
    assert a == b and a["A400"] == 100.0
    assert sorted(a.values())[200] < 5 and all(0 <= x <= 100 for x in a.values())
    assert forest.fit(vec.limit(10), trees=5, identity=["asset"]) is None


def test_alert_routing_and_rendering(spark):
    ddl = "signal_id bigint, asset_pair string, venue string, ts_ms bigint, score double"
    rows = [(1, "A", "x", NOW, 85.0), (2, "A", "x", NOW + 1000, 84.0), (3, "A", "x", NOW + 2000, 86.0), (4, "A", "x", NOW + 3000, 95.0),
            (5, "B", "x", NOW, 85.0), (6, "B", "x", NOW + 400_000, 85.0), (7, "B", "x", NOW + 401_000, 20.0)]
    got = {r.signal_id: r for r in alerts.route_alerts(spark.createDataFrame(rows, ddl)).collect()}
    assert [got[i].sent for i in range(1, 8)] == [True, False, False, True, True, True, False]
    assert got[2].reason == "cooldown (299s left)" and got[4].reason == "severity escalation" and got[7].reason == "below threshold"
    sig = scoring.signals(scoring.score_vectors(vector(spark, {"volume_z": 8, "obi": -0.8, "obi_abs": 0.8, "cvd_z": -6})))
    sig = sig.withColumn("asset_pair", F.lit("A<B"))
    r = payloads.render_plain(payloads.render_embed(payloads.render_html(sig))).first()
    assert "A&lt;B" in r.html and "<code>Order Flow </code>" in r.html and "volume_z=+8.00" in r.html
    assert r.embed.embeds[0].fields[0].name == "Composite Score" and len(r.plain.split("\n")) >= 5


def test_events_round_trip_and_replay(spark):
    ddl = "event_id string, ts_ms bigint, source_type string, venue string, asset_pair string, metric_type string, raw_value double, normalized_z_score double, usd_value double, confidence double"
    rows = [(f"e{i:03d}", NOW + i * 1000, "exchange", "v", "BTC/USDT", "volume", 100.0 + i, 0.5, 1.0, 1.0) for i in range(120)]
    e = events.as_events(spark.createDataFrame(rows, ddl).withColumn("meta", F.struct(F.lit(8.0).alias("spike_ratio"))))
    path = tempfile.mkdtemp(prefix="run-events-", dir="/tmp") + "/log"
    events.write_events(e, path)
    spark.createDataFrame([("",), ("{bad",), ('{"event_id":"x","surprise":1}',)], "value string").coalesce(1).write.mode("append").text(path + "/metric_folder=junk")
    parsed = events.read_events(spark, path)
    back = events.usable(parsed)
    assert back.count() == 120 and events.rejected(parsed).count() == 2
    assert back.agg(F.max("meta.spike_ratio")).first()[0] == 8.0
    sig = replay.replay(back)
    assert sig.count() >= 120 and sig.where("score < 0 or score > 100").count() == 0
    assert replay.peak_scores(sig).first().asset_pair == "BTC"
    at = features.features_at(back, NOW + 119_000).first()
    assert at.volume_z == pytest.approx(0.5) and at.volume_spike_ratio == 8.0 and at.exchange_fresh and not at.social_fresh


def test_training_rows(spark):
    lines = spark.createDataFrame([("[" + ",".join(["1"] * 20) + "]",), ('{"values": [' + ",".join(["NaN"] * 20) + "]}",), ("[1,2]",)], "value string")
    got = [r["values"] for r in posts.training_vectors(lines).collect()]
    assert sorted(v[0] for v in got) == [0.0, 1.0]


def test_rule_score_is_bounded(spark):
    rng = random.Random(9)
    cases = [{f: rng.uniform(-25, 25) for f in FEATURES} for _ in range(200)]
    assert rules.rule_scores(vector(spark, *cases)).where("rule_score < 0 or rule_score > 100 or rule_score is null").count() == 0
