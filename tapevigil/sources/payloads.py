"""Rendering alerts as text columns for a sink table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.functions.scalars import text as printf

# Marks, colours and module names used in rendered alerts.
SEVERITY_MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
SEVERITY_COLOURS = {
    "critical": 0xC0392B, "high": 0xE67E22, "medium": 0xF1C40F, "low": 0x3498DB, "info": 0x95A5A6,
}
MODULE_NAMES = {"exchange": "Order Flow", "onchain": "On-Chain", "social": "Social"}
FULL, EMPTY = "█", "░"


def _lookup(table: dict, key: Column, default) -> Column:
    flat = [F.lit(v) for pair in table.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), key), default)


def mark() -> Column:
    return _lookup(SEVERITY_MARKS, F.col("severity"), F.lit("⚪"))


def bar(value: Column, width: int = 10) -> Column:
    filled = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)) / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit(FULL), filled), F.repeat(F.lit(EMPTY), F.lit(width) - filled))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _ranked(m: Column, by_size: bool) -> Column:
    """Map entries as structs, largest first (by magnitude if by_size)."""
    entries = F.transform(F.map_entries(m), lambda e, i: F.struct(
        (-F.abs(e["value"]) if by_size else -e["value"]).alias("o"), i.alias("i"),
        e["key"].alias("k"), e["value"].alias("v")))
    return F.sort_array(entries)


def _stamp(pattern: str) -> Column:
    return F.date_format(F.timestamp_millis("ts_ms"), pattern)


def _joined(parts: Column, sep: str) -> Column:
    return F.array_join(parts, sep)


def _lines(*parts: Column) -> Column:
    """Join text lines and line arrays; NULL parts are left out."""
    return F.array_join(F.array_compact(F.concat(*parts)), "\n")


def _one(*texts) -> Column:
    return F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])


_NONE = "array<string>"


def render_html(signals: DataFrame, out: str = "html") -> DataFrame:
    """Chat message in HTML."""
    empty = F.array().cast(_NONE)
    modules = F.transform(_ranked(F.col("contributions"), False), lambda e: F.concat(
        F.lit("  <code>"), F.rpad(_lookup(MODULE_NAMES, e["k"], F.initcap(e["k"])), 11, " "), F.lit("</code> "),
        bar(e["v"], 8), printf(" %5.1f", e["v"])))
    evidence = F.transform(F.slice("reasons", 1, 6), lambda r: F.concat(F.lit("  • "), escape_html(r)))
    features = _joined(F.transform(F.slice(_ranked(F.col("features"), True), 1, 5),
                                   lambda e: printf("%s=%+.2f", e["k"], e["v"])), " | ")
    text = _lines(
        _one(
            F.concat(mark(), F.lit(" <b>MANIPULATION ALERT — "), escape_html(F.col("asset_pair")), F.lit("</b>")),
            "",
            F.concat(printf("<b>Score:</b> <code>%.1f/100</code>  ", F.col("score")), bar(F.col("score"))),
            F.concat(F.lit("<b>Severity:</b> "), F.upper("severity")),
            F.concat(F.lit("<b>Venue:</b> "), escape_html(F.col("venue"))),
            "",
            "<b>Signal breakdown</b>",
        ),
        modules,
        F.when(F.size("reasons") > 0, F.concat(_one("", "<b>Evidence</b>"), evidence)).otherwise(empty),
        F.when(F.size("features") > 0, _one("", "<b>Key features</b>", F.concat(
            F.lit("  <code>"), features, F.lit("</code>")))).otherwise(empty),
        _one(
            "",
            printf("<i>ML %.0f · Rules %.0f · %.0fms</i>", "ml_score", "rule_score", "latency_ms"),
            F.concat(F.lit("<i>"), _stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC</i>")),
        ),
    )
    return signals.withColumn(out, text)


def render_embed(signals: DataFrame, out: str = "embed", sender: str = "Market Surveillance") -> DataFrame:
    """Webhook payload with a rich embed, as a struct (to_json gives the wire form)."""
    modules = _joined(F.transform(_ranked(F.col("contributions"), False), lambda e: F.concat(
        F.lit("`"), F.rpad(_lookup(MODULE_NAMES, e["k"], e["k"]), 11, " "), F.lit("` "), bar(e["v"], 8),
        printf(" %5.1f", e["v"]))), "\n")
    evidence = F.left(_joined(F.transform(F.slice("reasons", 1, 6), lambda r: F.concat(F.lit("• "), r)), "\n"), F.lit(1024))
    features = F.concat(F.lit("```"), _joined(F.transform(
        F.slice(_ranked(F.col("features"), True), 1, 6),
        lambda e: printf("%-20s %+.3f", e["k"], e["v"])), "\n"), F.lit("```"))

    def field(name: str, value: Column, inline: bool, when: Column | None = None) -> Column:
        f = F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))
        return f if when is None else F.when(when, f)

    fields = F.array_compact(F.array(
        field("Composite Score", F.concat(printf("**%.1f** / 100\n`", F.col("score")), bar(F.col("score")), F.lit("`")), True),
        field("Severity", F.upper("severity"), True),
        field("Venue", F.col("venue"), True),
        field("Module Contributions", modules, False, F.size("contributions") > 0),
        field("Evidence", evidence, False, F.size("reasons") > 0),
        field("Key Features", features, False, F.size("features") > 0),
    ))
    footer = F.concat(
        printf("ML %.0f · Rules %.0f · %.0fms · id ", "ml_score", "rule_score", "latency_ms"),
        F.col("signal_id").cast("string"))
    embed = F.struct(
        F.concat(mark(), F.lit(" Manipulation Alert — "), F.col("asset_pair")).alias("title"),
        _lookup(SEVERITY_COLOURS, F.col("severity"), F.lit(SEVERITY_COLOURS["info"])).alias("color"),
        fields.alias("fields"),
        F.struct(footer.alias("text")).alias("footer"),
        F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z")).alias("timestamp"),
    )
    return signals.withColumn(out, F.struct(F.lit(sender).alias("username"), F.array(embed).alias("embeds")))


def render_plain(signals: DataFrame, out: str = "plain") -> DataFrame:
    """Console / log text."""
    empty = F.array().cast(_NONE)
    modules = _joined(F.transform(_ranked(F.col("contributions"), False),
                                  lambda e: printf("%s=%.0f", e["k"], e["v"])), ", ")
    text = _lines(
        _one(
            F.concat(mark(), F.lit(" MANIPULATION ALERT — "), F.col("asset_pair"), F.lit(" @ "), F.col("venue")),
            F.concat(printf("   Score %.1f/100 [", F.col("score")), bar(F.col("score")), F.lit("] "), F.upper("severity")),
            F.concat(printf("   ML %.0f | Rules %.0f | %.1fms | ", "ml_score", "rule_score", "latency_ms"),
                     _stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")),
        ),
        F.when(F.size("contributions") > 0, _one(F.concat(F.lit("   Modules: "), modules))).otherwise(empty),
        F.transform(F.slice("reasons", 1, 6), lambda r: F.concat(F.lit("     • "), r)),
    )
    return signals.withColumn(out, text)
