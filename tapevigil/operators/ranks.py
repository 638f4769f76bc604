"""Exact order statistics per group without collecting a group.

Ranks are found by counting: a group's value range is cut into `GRID` buckets,
the bucket that holds the rank is kept with its true smallest and largest value,
and the next pass counts inside it only. A bucket of at most `SMALL` rows is
sorted. There is one way of computing at every size; a task holds `GRID` counts
or `SMALL` values of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapevigil.operators.series import on_keys
from tapevigil.plans.storage import settle

GRID = 4096
SMALL = 4096
_SPAN = ["__lo", "__hi"]


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and one column per rank: `ranks` maps a name to the 1-based rank given the row count.

    NULL values do not count; groups without a value are absent.
    """
    keys = list(keys)
    rows = settle(df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull()))
    n = F.col("__n")
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank(n).cast("bigint").alias("rank")) for name, rank in ranks.items()])
    targets = settle(
        ends.where(n > 0).withColumn("__a", F.explode(asked))
        .select(*keys, "__n", "__lo", "__hi", F.col("__a.name").alias("__name"), F.col("__a.rank").alias("__rank"), n.alias("__size"))
    )
    wide = (F.col("__lo") < F.col("__hi")) & (F.col("__size") > SMALL)
    while targets.where(wide).limit(1).count():
        inside = _inside(rows, targets.where(wide), keys)
        cell = F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * GRID), F.lit(GRID - 1))
        counts = inside.groupBy(*keys, *_SPAN, cell.alias("__cell")).agg(
            F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        upto = F.sum("__c").over(Window.partitionBy(*keys, *_SPAN).orderBy("__cell"))
        narrowed = on_keys(targets.where(wide), counts.withColumn("__upto", upto), [*keys, *_SPAN]).where(
            (F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__c")))
        narrowed = narrowed.select(
            *keys, "__n", F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), "__name",
            (F.col("__rank") - F.col("__upto") + F.col("__c")).alias("__rank"), F.col("__c").alias("__size"))
        targets = settle(targets.where(~wide).unionByName(narrowed))
    narrow = targets.where(F.col("__lo") < F.col("__hi"))
    lists = _inside(rows, narrow, keys).groupBy(*keys, *_SPAN).agg(F.sort_array(F.collect_list("__v")).alias("__s"))
    picked = on_keys(narrow, lists, [*keys, *_SPAN]).select(
        *keys, "__n", "__name", F.element_at("__s", F.col("__rank").cast("int")).alias("__x"))
    settled = targets.where(F.col("__lo") >= F.col("__hi")).select(*keys, "__n", "__name", F.col("__lo").alias("__x"))
    return settled.unionByName(picked).groupBy(*keys).agg(
        F.max("__n").alias("n"), *[F.max(F.when(F.col("__name") == name, F.col("__x"))).alias(name) for name in ranks])


def _inside(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """rows in the ranges of targets, once for each different range."""
    spans = targets.select(*keys, *_SPAN).distinct()
    return on_keys(rows, spans, keys, extra=F.col("__v").between(F.col("__lo"), F.col("__hi")))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and linearly interpolated quantiles: `shares` maps a name to its share."""
    def at(q: float, up: bool) -> Callable[[Column], Column]:
        place = lambda n: (n - 1) * F.lit(float(q))
        return (lambda n: F.ceil(place(n)) + 1) if up else (lambda n: F.floor(place(n)) + 1)

    ranks = {}
    for name, q in shares.items():
        ranks |= {f"__l_{name}": at(q, False), f"__u_{name}": at(q, True)}
    found = order_statistics(df, keys, value, ranks)

    def between(name: str, q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.col(f"__l_{name}"), F.col(f"__u_{name}")
        return low + (high - low) * (place - F.floor(place))

    return found.select(*keys, "n", *[between(name, q).alias(name) for name, q in shares.items()])
