"""Scalar column expressions shared by every operator (all JVM side)."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity ladder (label, lowest score, rank).
SEVERITY_LADDER = (
    ("critical", 90.0, 4),
    ("high", 80.0, 3),
    ("medium", 60.0, 2),
    ("low", 40.0, 1),
    ("info", None, 0),
)


def clamp(x: Column, lo, hi) -> Column:
    """max(lo, min(hi, x)); NULL stays NULL (greatest/least alone would drop it)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.greatest(lo_c, F.least(hi_c, x)))


def percentile_rank(values: Column, x: Column) -> Column:
    """Share of array `values` that is <= x; 0.5 for an empty or NULL array."""
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, lambda v: v <= x)) / n).otherwise(F.lit(0.5))


def severity(score: Column) -> Column:
    out = None
    for label, floor, _ in SEVERITY_LADDER:
        if floor is None:
            return out.otherwise(F.lit(label))
        out = F.when(score >= floor, label) if out is None else out.when(score >= floor, label)
    return out


def severity_rank(label: Column) -> Column:
    ranks = []
    for name, _, rank in SEVERITY_LADDER:
        ranks += [F.lit(name), F.lit(rank)]
    return F.element_at(F.create_map(*ranks), label)


def score_rank(score: Column) -> Column:
    return severity_rank(severity(score))


def obi_direction(obi: Column) -> Column:
    return (
        F.when(obi > 0.05, "bid_heavy").when(obi < -0.05, "ask_heavy").otherwise("balanced")
    )


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.15, "bullish").when(score < -0.15, "bearish").otherwise("neutral")


def log1p_pos(x: Column) -> Column:
    """log1p of the positive part; used to score heavy-tailed series."""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def net_flow_index(net_usd: Column) -> Column:
    return F.tanh(net_usd / 5_000_000.0)


def bridge_index(bridge_usd: Column) -> Column:
    return F.tanh(bridge_usd / 20_000_000.0)


def accel_index(accel: Column) -> Column:
    return F.tanh(accel / 50.0)


def spread_index(spread_bps: Column) -> Column:
    return clamp(log1p_pos(spread_bps), 0.0, 10.0)


def wall_index(walls: Column) -> Column:
    return clamp(F.log1p(walls), 0.0, 5.0)


def hit_index(hits: Column) -> Column:
    return clamp(hits / 3.0, 0.0, 1.0)


def base_asset(pair: Column) -> Column:
    """Text before the first '/', then before the first ':'."""
    return F.substring_index(F.substring_index(pair, "/", 1), ":", 1)


_SPEC = re.compile(r"%(?:(%)|([+-]?)(\d*)(?:\.(\d+))?([fsd]))")


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value (printf in Java is not)."""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def text(template: str, *args) -> Column:
    """printf-like text: %s, %d, %.2f, %+.1f, %5.1f, %-20s and %%."""
    values = iter([F.col(a) if isinstance(a, str) else a for a in args])
    parts, at = [], 0
    for m in _SPEC.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        percent, flag, width, digits, kind = m.groups()
        if percent:
            parts.append(F.lit("%"))
            continue
        value = next(values)
        shown = fixed(value, int(digits or 0)) if kind == "f" else value.cast("string")
        if flag == "+":
            shown = F.when(F.startswith(shown, F.lit("-")), shown).otherwise(F.concat(F.lit("+"), shown))
        if width:
            size = F.greatest(F.lit(int(width)), F.length(shown))
            pad = F.repeat(F.lit(" "), size - F.length(shown))
            shown = F.concat(shown, pad) if flag == "-" else F.concat(pad, shown)
        parts.append(shown)
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def bind(value: Column, f) -> Column:
    """f(value) with `value` computed once; a lambda body would repeat it per element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(build: Callable[[], dict[str, Column]]) -> Callable[[], dict[str, Column]]:
    """Build a set of columns once per Spark application; thousands of calls into the JVM are then not repeated per plan."""
    kept: WeakKeyDictionary = WeakKeyDictionary()

    @functools.wraps(build)
    def get() -> dict[str, Column]:
        context = SparkSession.active().sparkContext
        if context not in kept:
            kept[context] = build()
        return kept[context]

    return get


def layer(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters and projections above are then not rewritten in terms of the inputs,
    which would multiply long expressions that several later columns refer to.
    """
    # Computed below the generator, whose own expressions Spark only interprets.
    made = df.select("*", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("__made"))
    return made.select("*", F.inline(F.array("__made"))).drop("__made")
