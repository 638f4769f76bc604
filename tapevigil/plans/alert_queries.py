"""Alert routing, rendering and detection quality over the test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapevigil.operators import alerts as al
from tapevigil.operators import scoring
from tapevigil.plans import views as v
from tapevigil.plans.feature_queries import _ML, _SEV, _with_ml, composite_sql, rules_sql
from tapevigil.operators import rules
from tapevigil.plans.registry import query
from tapevigil.plans.views import DAY, with_views
from tapevigil.sources import payloads

_RANK = "case when score >= 90 then 4 when score >= 80 then 3 when score >= 60 then 2 when score >= 40 then 1 else 0 end"

_ROUTE = f"""
, el as (select *, {_RANK} as rk, row_number() over (partition by asset_pair, venue order by ts_ms, signal_id) as rn from signals where score >= 60),
rt as (
  select asset_pair, venue, signal_id, rn, ts_ms as last, rk as last_rk, true as sent, 'first' as code, cast(1 as bigint) as cnt from el where rn = 1
  union all
  select e.asset_pair, e.venue, e.signal_id, e.rn, case when ok then e.ts_ms else r.last end, case when ok then e.rk else r.last_rk end, ok,
         case when e.rk > r.last_rk then 'escalation' when ok then 'elapsed' else 'cooldown' end, r.cnt + cast(ok as bigint)
  from rt r join el e on e.asset_pair = r.asset_pair and e.venue = r.venue and e.rn = r.rn + 1,
       lateral (select e.rk > r.last_rk or e.ts_ms - r.last >= {DAY} as ok) l),
routed as (select asset_pair, venue, signal_id, sent, code as reason_code, cnt as alert_count from rt
           union all select asset_pair, venue, signal_id, false, 'below', null from signals where not coalesce(score >= 60, false))"""


def _routed(spark, sf):
    return al.route_alerts(v.signals(spark, sf), 60.0, DAY)


@query("alert_gate", with_views("signals", body="select signal_id, round(score, 6) as score from signals where score >= 80"))
def alert_gate(spark, sf):
    return al.above_threshold(v.signals(spark, sf)).select("signal_id", "score")


@query("routed_alerts", with_views("signals", body=_ROUTE + """
select signal_id, sent, reason_code, alert_count from routed"""))
def routed_alerts(spark, sf):
    return _routed(spark, sf).select("signal_id", "sent", "reason_code", "alert_count")


@query("dispatch_summary", with_views("signals", body=_ROUTE + """
select asset_pair, venue, reason_code, count(*) filter (sent) as sent, count(*) filter (not sent) as suppressed from routed group by 1, 2, 3"""))
def dispatch_summary(spark, sf):
    return al.dispatch_summary(_routed(spark, sf))


@query("alert_history", with_views("signals", body=_ROUTE + """
select signal_id, asset_pair from (select s.* from routed join signals s using (signal_id) where sent)
where asset_pair = 'CLICK' order by ts_ms desc, signal_id desc limit 12"""))
def alert_history(spark, sf):
    return al.alert_history(_routed(spark, sf).where("sent"), "CLICK").select("signal_id", "asset_pair")


_SCORED = f", {_ML}, {rules_sql('vm')}, {composite_sql(True)}"


def _scored(spark, sf):
    return scoring.composite(rules.rule_scores(_with_ml(spark, sf)))


def _confusion_sql(tests: str, key: str) -> str:
    return f"""
, q as (select k, count(*) filter (hit and label = 1) as tp, count(*) filter (hit and label <> 1) as fp, count(*) filter (not hit and label = 1) as fn
        from (select label, unnest([{tests}], recursive := true) from cp) group by k),
pr as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as r from q)
select k as {key}, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0e0 end, 6) as f1 from pr"""


@query("threshold_table", with_views("vectors", body=_SCORED + _confusion_sql(
    ", ".join(f"struct_pack(k := {t}, hit := score >= {t})" for t in al.THRESHOLDS), "threshold")))
def threshold_table(spark, sf):
    return al.threshold_table(_scored(spark, sf))


@query("baseline_table", with_views("vectors", body=_SCORED + _confusion_sql(
    "struct_pack(k := 'volume_z > 3', hit := volume_z > 3), struct_pack(k := '|obi| > 0.35', hit := abs(obi) > 0.35), "
    "struct_pack(k := 'four thresholds', hit := volume_z > 2.5 or abs(obi) > 0.3 or bot_farm_score > 0.5 or liquidity_drop > 0.3), "
    "struct_pack(k := 'full score >= 80', hit := score >= 80)", "detector")))
def baseline_table(spark, sf):
    return al.baseline_table(_scored(spark, sf))


@query("scenario_table", with_views("vectors", body=_SCORED + """
select scenario, round(avg(score), 6) as mean_score, round(quantile_cont(score, 0.1), 6) as p10, round(quantile_cont(score, 0.9), 6) as p90,
       round(avg(case when score >= 80 then 1e0 else 0e0 end), 6) as share_80, count(*) as n from cp group by 1"""))
def scenario_table(spark, sf):
    return al.scenario_table(_scored(spark, sf))


@query("plain_alerts", with_views("vectors", body=_SCORED + f"""
, b as (select *, cast(round_even(least(100e0, score) / 100 * 10, 0) as int) as f, {_SEV} as severity from cp)
select event_id, split_part(t, chr(10), 1) as line1, split_part(t, chr(10), 2) as line2 from (
  select event_id, concat(case severity when 'critical' then '🔴' when 'high' then '🟠' when 'medium' then '🟡' when 'low' then '🔵' else '⚪' end,
         ' MANIPULATION ALERT — ', asset, ' @ <aggregate>', chr(10), '   Score ', printf('%.1f', score), '/100 [', repeat('█', f), repeat('░', 10 - f), '] ', upper(severity)) as t from b)"""))
def plain_alerts(spark, sf):
    s = scoring.signals(_scored(spark, sf).withColumn("venue", F.concat(F.lit("<aggregate>#"), "event_id")))
    s = s.withColumn("event_id", F.element_at(F.split("venue", "#"), 2).cast("bigint")).withColumn("venue", F.lit("<aggregate>"))
    lines = F.split(F.col("plain"), "\n")
    return payloads.render_plain(s).select("event_id", F.element_at(lines, 1).alias("line1"), F.element_at(lines, 2).alias("line2"))


_COLOURS = " ".join(f"when '{k}' then {c}" for k, c in payloads.SEVERITY_COLOURS.items())


@query("rendered_alerts", with_views("vectors", body=_SCORED + f"""
, b as (select *, cast(round_even(least(100e0, score) / 100 * 10, 0) as int) as f, {_SEV} as severity from cp where score >= 80),
m as (select *, case severity when 'critical' then '🔴' when 'high' then '🟠' when 'medium' then '🟡' when 'low' then '🔵' else '⚪' end as mark from b)
select event_id, concat(mark, ' <b>MANIPULATION ALERT — ', asset, '</b>') as html_title,
       concat('<b>Score:</b> <code>', printf('%.1f', score), '/100</code>  ', repeat('█', f), repeat('░', 10 - f)) as html_score,
       concat('<b>Severity:</b> ', upper(severity)) as html_severity, '<b>Venue:</b> &lt;aggregate&gt;' as html_venue,
       concat('<i>', strftime(epoch_ms(ts_ms), '%Y-%m-%d %H:%M:%S'), ' UTC</i>') as html_time,
       concat(mark, ' Manipulation Alert — ', asset) as embed_title, case severity {_COLOURS} end as embed_color,
       concat('**', printf('%.1f', score), '** / 100', chr(10), '`', repeat('█', f), repeat('░', 10 - f), '`') as embed_score from m"""))
def rendered_alerts(spark, sf):
    """HTML message and embed of every alert-worthy signal, taken apart."""
    s = scoring.signals(_scored(spark, sf).where("score >= 80").withColumn("venue", F.concat(F.lit("<aggregate>#"), "event_id")))
    s = s.withColumn("event_id", F.element_at(F.split("venue", "#"), 2).cast("bigint")).withColumn("venue", F.lit("<aggregate>"))
    full = payloads.render_embed(payloads.render_html(s))
    line, embed = F.split("html", "\n"), F.col("embed.embeds")[0]
    return full.select(
        "event_id", line[0].alias("html_title"), line[2].alias("html_score"), line[3].alias("html_severity"), line[4].alias("html_venue"),
        F.element_at(line, -1).alias("html_time"), embed["title"].alias("embed_title"), embed["color"].alias("embed_color"),
        embed["fields"][0]["value"].alias("embed_score"))
