"""Mentions, sentiment and coordinated accounts over the test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapevigil.functions import text as t
from tapevigil.operators import social as so
from tapevigil.plans import views as v
from tapevigil.plans.registry import query
from tapevigil.plans.series_queries import _dynamic_sql
from tapevigil.plans.views import DAY, HOUR, with_views
from tapevigil.sources import posts as ps

TRACKED = ("CLICK", "VIEW", "PURCHASE")


@query("tweet_posts", with_views("texts", body="""
select cast(post_id as varchar) as post_id, ts_ms, event_id % 4 = 0 as is_reply, case when user_id % 3 <> 0 then round(user_id + 0.5e0, 6) end as age_days,
       case when user_id % 3 <> 0 then user_id * 2 end as author_followers,
       case when ticker in ('CLICK', 'VIEW', 'PURCHASE') then ticker when contains(lower(text), 'rally') then 'RALLY' else '' end as tickers
from texts join events on event_id = post_id"""))
def tweet_posts(spark, sf):
    """Texts and users as API payload tables, joined back into posts."""
    e = v.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    x = v.texts(spark, sf).join(e, F.col("event_id") == F.col("post_id"))
    stamp = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    tweets = x.select(F.col("post_id").alias("id"), F.col("user_id").alias("author_id"), "text", stamp("ts_ms").alias("created_at"),
                      F.when(F.col("event_id") % 4 == 0, F.array(F.lit("quoted"), F.lit("replied_to"))).alias("reference_types"))
    users = e.select("user_id").distinct().where("user_id % 3 <> 0").select(
        F.col("user_id").alias("id"),
        stamp(F.lit(1_704_067_200_000).cast("bigint") - F.col("user_id") * DAY - DAY // 2).alias("created_at"),
        (F.col("user_id") * 2).alias("followers_count"), F.lit(10).alias("tweet_count"))
    posts = ps.posts_from_tweets(tweets, users, (*TRACKED, "RALLY"), as_of_ms=F.lit(1_704_067_200_000))
    return posts.select("post_id", "ts_ms", "is_reply", F.col("author_age_days").alias("age_days"), "author_followers",
                        F.array_join("tickers", ",").alias("tickers"))


@query("channel_posts", with_views("texts", body="""
select cast(post_id as varchar) as post_id, case when post_id % 2 = 0 then 'channel' else '7' end as author_id, ticker as tickers
from texts where ticker in ('CLICK', 'VIEW', 'PURCHASE')"""))
def channel_posts(spark, sf):
    m = v.texts(spark, sf).select(F.col("post_id").alias("id"), F.when(F.col("post_id") % 2 == 1, 7).alias("sender_id"), "text", "ts_ms",
                                  F.lit(5).alias("participants"))
    return ps.posts_from_channel(m, TRACKED).select("post_id", "author_id", F.array_join("tickers", ",").alias("tickers"))


@query("training_rows", """
select round(value, 6) as first_value, 20 as width, round(value, 6) as total from events where event_id % 5 <> 0""")
def training_rows(spark, sf):
    """Vectors written as JSON rows in both accepted forms, some too short, read back."""
    e = v.table(spark, sf, "events")
    full = F.concat(F.array(F.col("value")), F.array_repeat(F.lit(0.0), 19))
    short = F.array_repeat(F.lit(1.0), 7)
    line = F.when(F.col("event_id") % 5 == 0, F.to_json(short)).when(
        F.col("event_id") % 5 == 1, F.to_json(full)).otherwise(F.to_json(F.struct(full.alias("values"))))
    vectors = ps.training_vectors(e.select(line.alias("value")))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return vectors.select(F.element_at("values", 1).alias("first_value"), F.size("values").alias("width"), total.alias("total"))


@query("tracked_mentions", with_views("texts", body="""
select post_id, ticker from texts where ticker in ('CLICK', 'VIEW', 'PURCHASE')"""))
def tracked_mentions(spark, sf):
    tagged = v.texts(spark, sf).drop("ticker").withColumn("tickers", t.extract_tickers(F.col("text")))
    return so.fan_out(tagged, TRACKED).select("post_id", "ticker")


_TICKS = f"""
, mood as (select t.post_id, ticker, ts_ms, (user_id % 21 - 10) / 11e0 as s from texts t join events on event_id = post_id),
slots as (select *, (ts_ms + {HOUR - 1}) // {HOUR} * {HOUR} as slot from mood),
sl as (select ticker, slot, coalesce(lead(slot) over (partition by ticker order by slot), slot + {DAY + HOUR}) as nx from (select distinct ticker, slot from slots)),
grid as (select ticker, unnest(range(slot, nx, {HOUR})) as tick_ms from sl),
tk as (
  select g.ticker, g.tick_ms, count(s.s) as n, sum(s.s) as total, min(s.ts_ms) as lo, max(s.ts_ms) as hi
  from grid g left join slots s on s.ticker = g.ticker and s.ts_ms between g.tick_ms - {DAY} and g.tick_ms group by 1, 2),
ticks as (
  select ticker, tick_ms, n as posts_in_window, case when n < 2 or hi - lo <= 0 then n::double else n * 60000e0 / (hi - lo) end as rate,
         case when n > 0 then total / n else 0e0 end as sentiment from tk),
acc as (
  select *, case when count(*) over w >= 3 then (rate - first_value(rate) over w) / ((tick_ms - first_value(tick_ms) over w) / 60000e0) else 0e0 end as acceleration
  from ticks window w as (partition by ticker order by tick_ms rows between 5 preceding and current row))"""


def _ticks(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("event_id"), ((F.col("user_id") % 21 - 10) / 11.0).alias("mood"))
    x = v.texts(spark, sf).join(e, F.col("event_id") == F.col("post_id"))
    return so.tick_series(x, HOUR, DAY, "mood")


@query("mention_rates", with_views("texts", body=_TICKS + """
select ticker, tick_ms, posts_in_window, round(rate, 6) as rate, round(sentiment, 6) as sentiment, round(acceleration, 6) as acceleration from acc"""))
def mention_rates(spark, sf):
    return so.acceleration(_ticks(spark, sf)).drop("posts_total")


def _scores(spark, sf):
    from tapevigil.plans.storage import settle

    return so.mention_scores(so.acceleration(settle(_ticks(spark, sf))), DAY, HOUR)


_MENTION_Z = _dynamic_sql("acc", "ticker", "tick_ms", "tick_ms", "ln(1 + rate)", 43200.0, 240, 15, 3.0, True)
_MOOD_Z = _dynamic_sql("acc", "ticker", "tick_ms", "tick_ms", "sentiment", 86400.0, 240, 15, 2.5, False)


@query("mention_scores", with_views("texts", body=_TICKS + f"""
, {_MENTION_Z}
select ticker, tick_ms, round(z, 5) as mention_z, round(threshold, 5) as mention_threshold, coalesce(z > threshold, false) as spike from dyn""", ), digits=5)
def mention_scores(spark, sf):
    return _scores(spark, sf).select("ticker", "tick_ms", "mention_z", "mention_threshold", "spike")


@query("sentiment_scores", with_views("texts", body=_TICKS + f"""
, {_MOOD_Z}
select ticker, tick_ms, round(z, 5) as sentiment_z, case when sentiment > 0.15 then 'bullish' when sentiment < -0.15 then 'bearish' else 'neutral' end as label,
       round(greatest(0.1e0, least(1e0, posts_in_window / 30e0)), 5) as confidence from dyn"""), digits=5)
def sentiment_scores(spark, sf):
    return _scores(spark, sf).select("ticker", "tick_ms", "sentiment_z", "label", "confidence")


# --- coordinated accounts -------------------------------------------------------

_WINDOWS = f"""
, wp as (select *, (ts_ms + {DAY - 1}) // {DAY} * {DAY} as eval_ms from posts
         union all select *, ts_ms + {DAY} from posts where ts_ms % {DAY} = 0)"""


def _windowed(spark, sf):
    return so.post_windows(v.posts(spark, sf), DAY)


@query("age_variation", with_views("posts", body=_WINDOWS + """
select ticker, eval_ms, round(case when count(author_age_days) < 4 then null when avg(author_age_days) <= 0 then 0e0
       else stddev_pop(author_age_days) / avg(author_age_days) end, 6) as age_cv from wp group by 1, 2"""))
def age_variation(spark, sf):
    return so.age_variation(_windowed(spark, sf))


_COHORT = """
, au as (select ticker, eval_ms, author_id, count(*) as n_posts, arg_min(author_age_days, ts_ms::hugeint * 10000000 + post_id) filter (author_age_days <= 30) as age
         from wp group by 1, 2, 3),
yo as (select * from au where age is not null),
st as (select a.ticker, a.eval_ms, a.age as lo, count(*) as size, max(b.age) as hi
       from (select distinct ticker, eval_ms, age from yo) a join yo b using (ticker, eval_ms)
       where b.age >= a.age and b.age - a.age <= greatest(3e0, 0.35 * a.age) group by 1, 2, 3),
bs as (select * from (select *, row_number() over (partition by ticker, eval_ms order by size desc, lo) as rk from st) where rk = 1 and size >= 4),
co as (select bs.ticker, bs.eval_ms, size, lo, hi, case when avg(age) <= 0 then 0e0 else stddev_pop(age) / avg(age) end as ccv
       from bs join yo using (ticker, eval_ms) where age between lo and hi group by 1, 2, 3, 4, 5)"""


@query("age_cohorts", with_views("posts", body=_WINDOWS + _COHORT + """
select ticker, eval_ms, size as cohort_size, round(lo, 6) as age_lo, round(hi, 6) as age_hi, round(ccv, 6) as cohort_cv from co"""))
def age_cohorts(spark, sf):
    return so.age_cohorts(_windowed(spark, sf))


def _dup_sql(src: str) -> str:
    return f"""
dr as (select *, row_number() over (partition by ticker, eval_ms order by ts_ms desc, post_id desc) as rk from {src}),
dw as (select ticker, eval_ms, post_id, regexp_extract_all(lower(text), '[a-z0-9$#]+') as ws from dr),
dp as (select ticker, eval_ms, post_id, case when len(ws) < 3 then list_distinct(ws)
         else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end as f from dw),
dd as (select a.ticker, a.eval_ms, count(*) as pairs, count(*) filter (len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f))) >= 0.6) as dup
       from dp a join dp b on a.ticker = b.ticker and a.eval_ms = b.eval_ms and a.post_id < b.post_id where len(a.f) > 0 and len(b.f) > 0 group by 1, 2),
du as (select ticker, eval_ms, case when coalesce(pairs, 0) < 3 then 0e0 else dup / pairs end as duplicate_ratio
       from (select distinct ticker, eval_ms from {src}) g left join dd using (ticker, eval_ms))"""


def _rest_sql(src: str) -> str:
    return f"""
cg as (select ticker, eval_ms, ts_ms, count(*) as n, ts_ms - lag(ts_ms) over (partition by ticker, eval_ms order by ts_ms) as gap from {src} group by 1, 2, 3),
cd as (select ticker, eval_ms, case when sum(n) >= 6 and count(gap) >= 4 and avg(gap) > 0 then greatest(0e0, least(1e0, 1 - stddev_pop(gap) / avg(gap))) else 0e0 end as cadence
       from cg group by 1, 2),
fu as (select ticker, eval_ms, case when count(author_followers) < 5 then 0e0 when avg(author_followers) <= 0 then 1e0
         else greatest(0e0, least(1e0, (1 - greatest(0e0, least(1e0, stddev_pop(author_followers) / avg(author_followers)))) * 0.5
              + 0.5 * (count(*) filter (author_followers < 200)) / count(author_followers))) end as followers from {src} group by 1, 2)"""


@query("duplicate_ratios", with_views("posts", body=_WINDOWS + f"""
, {_dup_sql("wp")} select ticker, eval_ms, round(duplicate_ratio, 6) as duplicate_ratio from du"""))
def duplicate_ratios(spark, sf):
    return so.duplicate_ratio(_windowed(spark, sf))


@query("cadence_regularity", with_views("posts", body=_WINDOWS + f"""
, {_rest_sql("wp")} select ticker, eval_ms, round(cadence, 6) as cadence_regularity from cd"""))
def cadence_regularity(spark, sf):
    return so.cadence(_windowed(spark, sf))


@query("follower_uniformity", with_views("posts", body=_WINDOWS + f"""
, {_rest_sql("wp")} select ticker, eval_ms, round(followers, 6) as follower_uniformity from fu"""))
def follower_uniformity(spark, sf):
    return so.follower_uniformity(_windowed(spark, sf))


_VERDICT = _WINDOWS + _COHORT + f"""
, fg as (select au.*, co.size, ccv, coalesce(age between lo and hi, false) as member from au left join co using (ticker, eval_ms)),
tt as (select ticker, eval_ms, sum(n_posts) as posts, count(*) as authors, sum(case when member then n_posts else 0 end) as cposts,
              count(*) filter (member) as csize, max(ccv) as ccv from fg group by 1, 2),
jd as (select wp.* from wp join tt using (ticker, eval_ms) left join (select * from fg where member) m using (ticker, eval_ms, author_id)
       where cposts < 6 or m.member is not null),
{_dup_sql("jd")}, {_rest_sql("jd")},
ga as (select ticker, eval_ms, case when count(author_age_days) < 4 then null when avg(author_age_days) <= 0 then 0e0 else stddev_pop(author_age_days) / avg(author_age_days) end as gcv
       from wp group by 1, 2),
ms as (
  select tt.*, duplicate_ratio as dup, cadence as cad, followers as fol, cposts >= 6 as onc, case when cposts >= 6 and ccv is not null then ccv else gcv end as cv,
         (eval_ms // {DAY} % 7)::double as mz,
         case when cposts >= 6 then cposts / greatest(csize, 1) else posts / greatest(authors, 1) end as ppa
  from tt join du using (ticker, eval_ms) join cd using (ticker, eval_ms) join fu using (ticker, eval_ms) join ga using (ticker, eval_ms)),
vd as (
  select *, case when posts < 12 then 0e0 else greatest(0e0, least(1e0,
      case when cv < 0.35 then 0.35 * (1 - cv / 0.35) * case when onc then greatest(0e0, least(1e0, 2.5 * cposts / posts)) else 0.6 end else 0 end
      + case when dup > 0.08 then 0.25 * greatest(0e0, least(1e0, (dup - 0.08) / (0.4 - 0.08))) else 0 end
      + case when cad > 0.55 then 0.15 * cad else 0 end + case when fol > 0.6 then 0.1 * fol else 0 end
      + case when ppa > 3 then greatest(0e0, least(0.1e0, 0.1 * ln(1 + ppa - 3))) else 0 end
      + case when mz > 3 then greatest(0e0, least(0.15e0, 0.15 * (mz - 3) / 5)) else 0 end)) end as score
  from ms)"""


def _verdicts(spark, sf):
    from tapevigil.plans.storage import settle

    posts = settle(_windowed(spark, sf))
    mz = posts.select(*so.GROUP).distinct().withColumn("mention_z", (F.floor(F.col("eval_ms") / DAY) % 7).cast("double"))
    return so.bot_farm_verdicts(posts, mz)


@query("bot_farm_verdicts", with_views("posts", body=_VERDICT + """
select ticker, eval_ms, score >= 0.5 as is_bot_farm, round(score, 6) as score, cast(posts as bigint) as posts,
       case when posts >= 12 then authors else 0 end as unique_authors, round(case when posts >= 12 then cv end, 6) as age_cv from vd"""))
def bot_farm_verdicts(spark, sf):
    return _verdicts(spark, sf).select("ticker", "eval_ms", "is_bot_farm", "score", "posts", "unique_authors", "age_cv")


@query("social_events", with_views("texts", "posts", body=_TICKS + _VERDICT + f"""
, mention_dyn as (with recursive {_MENTION_Z} select * from dyn),
mood_dyn as (with recursive {_MOOD_Z} select * from dyn)
select concat('sm-', ticker, '-', tick_ms) as event_id, tick_ms as ts_ms, ticker as asset_pair, 'social_mentions' as metric_type,
       round(rate, 7) as raw_value, round(z, 7) as normalized_z_score, 1e0 as confidence, round(acceleration, 4) as acceleration from mention_dyn
union all
select concat('ss-', ticker, '-', tick_ms), tick_ms, ticker, 'social_sentiment', round(sentiment, 7), round(z, 7),
       round(greatest(0.1e0, least(1e0, posts_in_window / 30e0)), 7), null from mood_dyn
union all
select concat('bf-', ticker, '-', eval_ms), eval_ms, ticker, 'bot_farm', round(score, 7), null,
       round(greatest(0.2e0, least(1e0, posts / 50e0)), 7), null from vd where posts >= 12"""), digits=7)
def social_events(spark, sf):
    """Mention, sentiment and bot-farm events, with their z-scores and verdicts."""
    events = so.social_events(_scores(spark, sf), _verdicts(spark, sf))
    return events.select("event_id", "ts_ms", "asset_pair", "metric_type", "raw_value", "normalized_z_score", "confidence", "meta.acceleration")


@query("social_report", with_views("texts", "posts", body=_TICKS + _VERDICT + """
, lt as (select *, row_number() over (partition by ticker order by tick_ms desc) as rk from acc),
lv as (select *, row_number() over (partition by ticker order by eval_ms desc) as rk from vd)
select ticker, round(sentiment, 6) as sentiment, round(rate, 6) as mention_rate, round(acceleration, 6) as acceleration,
       round(score, 6) as farm_score, cast(posts as bigint) as posts_in_window
from (select * from lt where rk = 1) a left join (select * from lv where rk = 1) b using (ticker)"""))
def social_report(spark, sf):
    ticks = so.acceleration(_ticks(spark, sf)).withColumn("mention_z", F.lit(None).cast("double"))
    return so.social_report(ticks, _verdicts(spark, sf)).select(
        "ticker", "sentiment", "mention_rate", "acceleration", "farm_score", "posts_in_window")
