"""Rolling statistics, scalars and text over the test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapevigil.functions import scalars as s
from tapevigil.functions import text as t
from tapevigil.operators import folds, rolling, series
from tapevigil.plans import views as v
from tapevigil.plans.registry import query
from tapevigil.plans.views import DAY, HOUR, with_views

PAIR = ["venue", "symbol"]
TRADE_ORDER = ["ts_ms", "trade_id"]


@query("scalar_expressions", with_views("signals", body="""
select signal_id,
       greatest(0, least(80, score)) as clamped,
       case when score >= 90 then 'critical' when score >= 80 then 'high' when score >= 60 then 'medium'
            when score >= 40 then 'low' else 'info' end as severity,
       cast(case when score >= 90 then 4 when score >= 80 then 3 when score >= 60 then 2
            when score >= 40 then 1 else 0 end as int) as severity_rank,
       round(list_count(list_filter([50e0, 55e0, 60e0, 70e0, 90e0], lambda x: x <= score)) / 5e0, 6) as rank_share,
       case when (score - 75) / 25 > 0.05 then 'bid_heavy' when (score - 75) / 25 < -0.05 then 'ask_heavy'
            else 'balanced' end as book_direction,
       case when (score - 75) / 25 > 0.15 then 'bullish' when (score - 75) / 25 < -0.15 then 'bearish'
            else 'neutral' end as mood,
       round(tanh((score - 75) * 1e5 / 5e6), 6) as net_index,
       round(tanh(score * 1e5 / 2e7), 6) as bridge_index,
       round(tanh((score - 75) / 50), 6) as accel_index,
       round(greatest(0, least(10, ln(1 + score))), 6) as spread_index,
       round(greatest(0, least(5, ln(1 + signal_id % 9))), 6) as wall_index,
       round(greatest(0, least(1, (signal_id % 5) / 3e0)), 6) as hit_index
from signals"""))
def scalar_expressions(spark, sf):
    df = v.signals(spark, sf)
    tilt = (F.col("score") - 75) / 25
    marks = F.array(*[F.lit(float(x)) for x in (50, 55, 60, 70, 90)])
    return df.select(
        "signal_id",
        s.clamp(F.col("score"), 0, 80).alias("clamped"),
        s.severity(F.col("score")).alias("severity"),
        s.score_rank(F.col("score")).alias("severity_rank"),
        s.percentile_rank(marks, F.col("score")).alias("rank_share"),
        s.obi_direction(tilt).alias("book_direction"),
        s.sentiment_label(tilt).alias("mood"),
        s.net_flow_index((F.col("score") - 75) * 1e5).alias("net_index"),
        s.bridge_index(F.col("score") * 1e5).alias("bridge_index"),
        s.accel_index(F.col("score") - 75).alias("accel_index"),
        s.spread_index(F.col("score")).alias("spread_index"),
        s.wall_index(F.col("signal_id") % 9).alias("wall_index"),
        s.hit_index(F.col("signal_id") % 5).alias("hit_index"),
    )


@query("normalized_texts", with_views("texts", body=r"""
select post_id,
       trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g'),
            '@\w+', ' ', 'g'), '\s+', ' ', 'g')) as clean_text,
       array_to_string(list_distinct(list_transform(regexp_extract_all(text, '[$#]([A-Za-z]{2,10})\b', 1),
            lambda x: upper(x))), ',') as tickers,
       array_to_string(regexp_extract_all(lower(text), '[\w''#$]+'), '|') as tokens
from texts"""))
def normalized_texts(spark, sf):
    x = F.col("text")
    return v.texts(spark, sf).select(
        "post_id", t.normalize_text(x).alias("clean_text"),
        F.array_join(t.extract_tickers(x), ",").alias("tickers"),
        F.array_join(t.tokenize(x), "|").alias("tokens"),
    )


def _map_sql(table: dict) -> str:
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    return "map {" + ", ".join(f"{quote(k)}: {val}" for k, val in table.items()) + "}"


def _lexicon_sql(source: str, key: str, keep: str) -> str:
    return rf"""
, toks as (
  select {key}, {keep}, regexp_extract_all(lower(trim(regexp_replace(regexp_replace(regexp_replace(
           text, 'https?://\S+|www\.\S+', ' ', 'g'), '@\w+', ' ', 'g'), '\s+', ' ', 'g'))), '[\w''#$]+') as tk
  from {source}),
pos as (select {key}, {keep}, tk, unnest(range(1, len(tk) + 1)) as i from toks),
hit as (
  select {key}, i, {_map_sql(t.POSITIVE | t.NEGATIVE)}[tk[i]] as w,
         list_transform(tk[greatest(i - 2, 1):i - 1], lambda p:
           coalesce({_map_sql(t.INTENSIFIERS)}[p], 1e0)
           * case when list_contains([{", ".join("'" + n.replace("'", "''") + "'" for n in t.NEGATIONS)}], p)
             then {t.NEGATION_FACTOR} else 1e0 end) as fs
  from pos),
agg as (
  select {key}, count(*) as n, sum(w * case when len(fs) = 0 then 1e0 else list_product(fs) end) as total
  from hit where w is not null group by {key})
select {source}.{key}, {source}.{keep},
       coalesce(round(tanh(total / sqrt(n) / 1.6), 4), 0e0) as score,
       case when n is null then 'neutral' when tanh(total / sqrt(n) / 1.6) > 0.15 then 'positive'
            when tanh(total / sqrt(n) / 1.6) < -0.15 then 'negative' else 'neutral' end as label,
       case when n is null then 0.25e0 else round(least(1e0, 0.35 + 0.12 * n), 3) end as confidence
from {source} left join agg using ({key})"""


@query("lexicon_sentiment", with_views("texts", body=_lexicon_sql("texts", "post_id", "ticker")))
def lexicon_sentiment(spark, sf):
    return v.texts(spark, sf).withColumn("m", t.lexicon_sentiment(F.col("text"))).select(
        "post_id", "ticker", "m.*")


@query("document_sentiment", with_views("texts", body=_lexicon_sql("documents", "doc_id", "source")))
def document_sentiment(spark, sf):
    """Lexicon sentiment of every document, in full."""
    scored = v.table(spark, sf, "documents").withColumn("m", t.lexicon_sentiment(F.col("text")))
    return scored.select("doc_id", "source", "m.*")


def _stub_model(texts: list[str]) -> list[dict[str, float]]:
    """Stands in for a language model: probabilities from two word tests."""
    out = []
    for x in texts:
        up, down = 0.7 if "bullish" in x else 0.1, 0.6 if "scam" in x else 0.1
        out.append({"positive": up, "negative": down, "neutral": round(1.0 - min(1.0, up + down), 3)})
    return out


@query("model_sentiment", with_views("texts", body="""
, p as (select post_id, case when contains(text, 'bullish') then 0.7e0 else 0.1e0 end as up,
               case when contains(text, 'scam') then 0.6e0 else 0.1e0 end as down from texts)
select post_id, round(up - down, 4) as score, round(least(1e0, up + down), 3) as confidence,
       case when up >= down and up >= 1 - least(1e0, up + down) then 'positive'
            when down > up and down >= 1 - least(1e0, up + down) then 'negative' else 'neutral' end as label, 'model' as backend
from p"""))
def model_sentiment(spark, sf):
    return t.model_sentiment(v.texts(spark, sf), "text", _stub_model).select("post_id", "sentiment.*").drop("error")


@query("shingle_similarity", with_views("posts", body="""
, w as (select post_id, ticker, ts_ms, regexp_extract_all(lower(text), '[a-z0-9$#]+') as ws from posts),
p as (
  select post_id, ticker, ts_ms,
         case when len(ws) < 3 then list_distinct(ws)
              else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end as f
  from w),
q as (select *, lag(f) over (partition by ticker order by ts_ms, post_id) as g from p)
select post_id, len(f) as shingles,
       round(case when g is null then null when len(list_distinct(list_concat(f, g))) = 0 then 0e0
             else len(list_intersect(f, g)) / len(list_distinct(list_concat(f, g))) end, 6) as similarity
from q"""))
def shingle_similarity(spark, sf):
    p = v.posts(spark, sf).select("post_id", "ticker", "ts_ms", "text", F.lit(True).alias("posted"))
    # Texts take less room than their shingles: they are moved, and cut into shingles where they meet.
    p = series.with_previous(p, ["ticker"], ["ts_ms", "post_id"], {"before": "text", "follows": "posted"}, block_ms=DAY)
    p = p.withColumn("f", t.fingerprint(F.col("text"))).withColumn("g", F.when(F.col("follows"), t.fingerprint(F.col("before"))))
    return p.select(
        "post_id", F.size("f").cast("bigint").alias("shingles"),
        F.when(F.col("g").isNotNull(), t.jaccard(F.col("f"), F.col("g"))).alias("similarity"),
    )


# Frames over (ts_ms, trade_id) as one integer, so that ties in ts_ms keep their order.
_FRAME = """over (partition by venue, symbol order by ts_ms::hugeint * 10000000 + trade_id
    range between {w}::hugeint * 10000000 + trade_id preceding and current row)"""


@query("rolling_window_stats", with_views("trades", body=f"""
, f as (
  select venue, symbol, trade_id, ts_ms, size, count(*) {_FRAME.format(w=DAY)} as n,
         sum(size) {_FRAME.format(w=DAY)} as total, avg(size) {_FRAME.format(w=DAY)} as mean,
         coalesce(var_samp(size) {_FRAME.format(w=DAY)}, 0) as var, min(ts_ms) {_FRAME.format(w=DAY)} as lo
  from trades)
select trade_id, n as w_count, round(total, 6) as w_sum,
       round(sqrt(var), 6) as w_std,
       round(case when n < 20 then null when sqrt(var) <= 1e-12 then 0e0 else (size - mean) / sqrt(var) end, 6) as z,
       round(case when n < 2 or ts_ms - lo <= 0 then total else total * 60000e0 / (ts_ms - lo) end, 6) as per_minute
from f"""))
def rolling_window_stats(spark, sf):
    w = rolling.rolling_window(v.trades(spark, sf), PAIR, TRADE_ORDER, "size", DAY)
    return w.select(
        "trade_id", "w_count", "w_sum", "w_std", rolling.window_z("size").alias("z"),
        rolling.rate_per_minute().alias("per_minute"))


def _ewma_sql(source: str, keys: str, order: str, ts: str, value: str, half_life_s: float, warmup: int) -> str:
    """Expressions num and ew: the recursion of the weighted mean and variance, row by row."""
    return f"""
num as (
  select *, row_number() over (partition by {keys} order by {order}) as rn,
         {value} as x, {ts} as t from {source}),
ew as (
  select *, x as mean, 0e0 as var, null::double as ewma_z from num where rn = 1
  union all
  select num.*, ew.mean + a * (num.x - ew.mean),
         (1 - a) * (ew.var + (num.x - ew.mean) * a * (num.x - ew.mean)),
         case when num.rn - 1 < {warmup} then null when sqrt(ew.var) <= 1e-12 then 0e0
              else (num.x - ew.mean) / sqrt(ew.var) end
  from ew join num on {" and ".join(f"num.{k.strip()} = ew.{k.strip()}" for k in keys.split(","))}
       and num.rn = ew.rn + 1,
       lateral (select greatest(1e-4, least(1e0, 1 - power(0.5, greatest((num.t - ew.t) / 1000e0, 1e-6)
                / {half_life_s}))) as a) al)"""


def _robust_sql(source: str, keys: str, order: str, value: str, window: int, warmup: int,
                zero_is_normal: bool, name: str = "rob") -> str:
    """Expression: median/MAD z against the previous rows."""
    flat = "null" if zero_is_normal else (
        "case when abs(x - med) <= 1e-12 then 0e0 else greatest(-50e0, least(50e0, "
        "(x - med) / greatest(abs(med) * 1e-4, 1e-9))) end"
    )
    return f"""
{name}_b as (
  select *, {value} as x, list_sort(array_agg({value}) over (partition by {keys} order by {order}
         rows between {window} preceding and 1 preceding)) as buf from {source}),
{name}_m as (select *, len(buf) as n_buf, list_median(buf) as med from {name}_b),
{name}_s as (
  select *, 1.4826 * list_median(list_transform(buf, lambda b: abs(b - med))) as mad,
         (buf[cast(3 * n_buf // 4 as int) + 1] - buf[cast(n_buf // 4 as int) + 1]) / 1.349 as iqr from {name}_m),
{name} as (
  select * exclude (buf, mad, iqr, med, n_buf, x),
         case when n_buf is null or n_buf < {warmup} then null when mad > 1e-12 then (x - med) / mad
              when iqr > 1e-12 then (x - med) / iqr else {flat} end as robust_z
  from {name}_s)"""


_BUCKETS = f"""
, hourly as (
  select venue, symbol, ts_ms // {HOUR} * {HOUR} as bucket_ms, sum(size) as volume
  from trades group by 1, 2, 3)"""


def _hourly(spark, sf):
    from tapevigil.operators.trades import volume_buckets

    return volume_buckets(v.trades(spark, sf), HOUR).select(*PAIR, "bucket_ms", "volume")


@query("ewma_zscore", with_views("trades", body=f"""
, {_ewma_sql("trades", "venue, symbol", "ts_ms, trade_id", "ts_ms", "size", 21600.0, 20)}
select trade_id, round(ewma_z, 6) as ewma_z from ew"""))
def ewma_zscore(spark, sf):
    z = rolling.ewma_z(v.trades(spark, sf), PAIR, TRADE_ORDER, "size", half_life_s=21600.0, warmup=20, block_ms=DAY)
    return z.select("trade_id", "ewma_z")


@query("robust_zscore", with_views("trades", body=f"""
, {_robust_sql("trades", "venue, symbol", "ts_ms, trade_id", "size", 300, 30, False)}
select trade_id, round(robust_z, 6) as robust_z from rob"""))
def robust_zscore(spark, sf):
    z = rolling.robust_z(v.trades(spark, sf), PAIR, TRADE_ORDER, "size", block_ms=DAY)
    return z.select("trade_id", "robust_z")


def _dynamic_sql(source, keys, order, ts, value, half_life_s, window, warmup, base, zero_is_normal, out="dyn"):
    """Expressions ending in `dyn`: the blended z and the adaptive trigger level."""
    abstain = "null" if zero_is_normal else "ewma_z"
    clip = lambda e: f"greatest(-25e0, least(25e0, {e}))"
    part = f"partition by {keys} order by {order}"
    return f"""
{_ewma_sql(source, keys, order, ts, value, half_life_s, warmup)},
{_robust_sql("ew", keys, order, value, window, warmup, zero_is_normal)},
bl as (
  select *, case when robust_z is null then {abstain} when ewma_z is null then {clip("robust_z")}
              else {clip("0.6 * robust_z + 0.4 * ewma_z")} end as z from rob),
zr as (
  select * exclude (zs), list_sort(zs) as zs, len(zs) as zn from (
    select *, array_agg(abs(z)) over ({part} rows between 199 preceding and current row) as zs
    from bl where z is not null)),
levels_ as (
  select {keys}, rn, case when zn < 50 then {base} else greatest({base}, least(
         zs[cast(floor(0.95 * (zn - 1)) as int) + 1] * 1.15, {base} * 2.5)) end as level from zr),
{out} as (
  select bl.*, coalesce(last_value(level ignore nulls) over (partition by {", ".join("bl." + k.strip() for k in keys.split(","))}
         order by bl.rn rows between unbounded preceding and current row), {base}) as threshold
  from bl left join levels_ using ({keys}, rn))"""


@query("dynamic_zscore", with_views("trades", body=f"""
, {_dynamic_sql("trades", "venue, symbol", "ts_ms, trade_id", "ts_ms", "size", 21600.0, 300, 25, 3.0, False)}
select trade_id, round(z, 6) as z, round(threshold, 6) as threshold from dyn"""))
def dynamic_zscore(spark, sf):
    z = rolling.dynamic_z(v.trades(spark, sf), PAIR, TRADE_ORDER, "size", half_life_s=21600.0, block_ms=DAY)
    return z.select("trade_id", "z", "threshold")


@query("adaptive_threshold", with_views("vectors", body="""
, zs as (select event_id, asset, ts_ms, case when event_id % 4 = 0 then null else cvd_z end as z from vectors),
known as (
  select *, list_sort(l) as s, len(l) as n from (
    select *, array_agg(abs(z)) over (partition by asset order by ts_ms, event_id
           rows between 199 preceding and current row) as l from zs where z is not null)),
lv as (select event_id, case when n < 50 then 2.5e0 else greatest(2.5e0, least(
       s[cast(floor(0.95 * (n - 1)) as int) + 1] * 1.15, 6.25e0)) end as level from known)
select event_id, round(coalesce(last_value(level ignore nulls) over (partition by asset order by ts_ms, event_id
       rows between unbounded preceding and current row), 2.5e0), 6) as threshold
from zs left join lv using (event_id)"""))
def adaptive_threshold(spark, sf):
    z = v.vectors(spark, sf).select("event_id", "asset", "ts_ms", F.when(F.col("event_id") % 4 != 0, F.col("cvd_z")).alias("z"))
    return rolling.adaptive_threshold(z, ["asset"], ["ts_ms", "event_id"], base=2.5, block_ms=DAY).select(
        "event_id", "threshold")


@query("change_points", with_views("vectors", body="""
, num as (select event_id, asset, cvd_z / 2 + 0.4 * sin(event_id / 300e0) as z,
                 row_number() over (partition by asset order by ts_ms, event_id) as rn from vectors),
walk as (
  select event_id, asset, rn, 0e0 as pos, 0e0 as neg, 0 as alarm from (
    select -1 as event_id, asset, 0 as rn from num group by asset)
  union all
  select num.event_id, num.asset, num.rn, case when p > 5 then 0e0 else p end,
         case when p <= 5 and q < -5 then 0e0 else q end,
         case when p > 5 then 1 when q < -5 then -1 else 0 end
  from walk join num on num.asset = walk.asset and num.rn = walk.rn + 1,
       lateral (select greatest(0e0, pos + num.z - 0.5) as p, least(0e0, neg + num.z + 0.5) as q) l)
select event_id, cast(alarm as int) as alarm from walk where rn > 0"""))
def change_points(spark, sf):
    z = v.vectors(spark, sf).select("event_id", "asset", "ts_ms", (
        F.col("cvd_z") / 2 + 0.4 * F.sin(F.col("event_id") / 300.0)).alias("z"))
    return folds.cusum(z, ["asset"], ["ts_ms", "event_id"]).select("event_id", "alarm")


@query("latency_percentiles", """
with recent as (
  select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) as rk
  from events),
s as (select event_type, list_sort(array_agg(value)) as l, count(*) as n from recent group by 1)
select event_type, n as count, round(l[cast(greatest(1, ceil(0.5 * n)) as int)], 2) as p50,
       round(l[cast(greatest(1, ceil(0.95 * n)) as int)], 2) as p95,
       round(l[cast(greatest(1, ceil(0.99 * n)) as int)], 2) as p99, round(l[n], 2) as max,
       (select count(*) from events e where e.event_type = s.event_type and e.value > 20) as breaches
from s""")
def latency_percentiles(spark, sf):
    return rolling.latency_summary(v.table(spark, sf, "events"), ["event_type"], "value", ["ts", "event_id"], 20.0)
