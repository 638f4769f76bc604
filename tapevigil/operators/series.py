"""Skew-safe building blocks for ordered series.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task, which
fails once a single symbol holds a third of the table. The helpers here cut a
key into blocks and move only per-block summaries between them:

* time blocks  - ``floor(ts / block_ms)``; carries (sum, last row, count) are
  aggregated map-side first, so the cross-block window sees one row per block;
* row chunks   - fixed numbers of consecutive rows plus a halo of the rows that
  precede the chunk, for "previous k rows" frames;
* time chunks  - spans of time plus a halo, for "previous w milliseconds" frames;
* positions    - row numbers by one range partition of keys and order, so that rows are
  dealt evenly even if one key has most of them in one moment.

Every helper but `positions` is lazy, and all return exactly what the unblocked window would, rows with
NULL keys included: they are one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapevigil.plans.storage import settle

HOUR_MS = 3_600_000
DEFAULT_BLOCK_MS = HOUR_MS
DEFAULT_CHUNK_ROWS = 16_384

BLK = "__blk"
CHUNK = "__chunk"
HALO = "__halo"
POS = "__n"


def block_of(ts: Column | str, width: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / F.lit(width)).cast("bigint")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows to the configured number of shuffle partitions ahead of a Python stage.

    Python work is heavy per byte, so a stage sized by bytes alone would be merged
    into too few tasks; an explicit count is kept as it is.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys])


def per_chunk(chunked: DataFrame, keys: Sequence[str], order: Sequence[str],
              fn: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """fn on the rows of each (key, CHUNK), in the given order; Arrow tables keep the types of all columns."""
    place = [*keys, CHUNK]
    return spread(chunked, *place).sortWithinPartitions(*place, *order).groupBy(*place).applyInArrow(fn, schema)


def _cols(names: Iterable[str]) -> list[Column]:
    return [F.col(n) for n in names]


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
            extra: Column | None = None) -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the result has left's keys once."""
    named = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True) if extra is None else extra
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(named, same, how).drop(*[f"__k_{k}" for k in keys])


def plan_block_ms(df: DataFrame, keys: Sequence[str], ts: str, target_rows: int = 1_000_000) -> int:
    """Measure the hottest key and pick a block width holding about target_rows of it."""
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), (F.max(ts) - F.min(ts)).alias("span"))
        .agg(F.max_by(F.struct("n", "span"), "n").alias("h"))
        .select("h.n", "h.span")
        .first()
    )
    if hot is None or not hot.n or hot.n <= target_rows or not hot.span:
        return max(int(hot.span or 0) + 1, DEFAULT_BLOCK_MS) if hot and hot.n else DEFAULT_BLOCK_MS
    return max(1_000, int(hot.span * target_rows / hot.n))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    ts: str = "ts_ms",
    block_ms: int = DEFAULT_BLOCK_MS,
    total: str | None = None,
) -> DataFrame:
    """Running totals per key (first row up to the current row, inclusive).

    A sum of lit(1) named POS doubles as the row index; `total` then receives the
    key's row count, so later stages need not index the rows again.
    """
    blocked = df.withColumn(BLK, block_of(ts, block_ms))
    for out, expr in sums.items():
        blocked = blocked.withColumn(f"__v_{out}", expr)
    per_block = blocked.groupBy(*keys, BLK).agg(
        *[F.sum(f"__v_{o}").alias(f"__t_{o}") for o in sums]
    )
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum(f"__t_{POS}").over(Window.partitionBy(*keys)).alias(total)] if total else []
    carry = per_block.select(
        *keys,
        BLK,
        *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__c_{o}") for o in sums],
        *extra,
    )
    inside = (
        Window.partitionBy(*keys, BLK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = blocked
    for out in sums:
        rows = rows.withColumn(out, F.sum(f"__v_{out}").over(inside))
    rows = on_keys(rows, carry, [*keys, BLK])
    for out in sums:
        rows = rows.withColumn(out, F.col(out) + F.col(f"__c_{out}"))
    return rows.drop(BLK, *[f"__v_{o}" for o in sums], *[f"__c_{o}" for o in sums])


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = POS,
    ts: str = "ts_ms",
    block_ms: int = DEFAULT_BLOCK_MS,
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row inside its key; `order` must be a total order led by ts.

    `total` optionally names a column that receives the key's row count.
    """
    blocked = df.withColumn(BLK, block_of(ts, block_ms))
    sizes = blocked.groupBy(*keys, BLK).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("__size").over(Window.partitionBy(*keys)).alias(total)] if total else []
    base = sizes.select(
        *keys, BLK, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"), *extra
    )
    inside = Window.partitionBy(*keys, BLK).orderBy(*order)
    return (
        on_keys(blocked.withColumn(out, F.row_number().over(inside)), base, [*keys, BLK])
        .withColumn(out, (F.col(out) + F.col("__base")).cast("bigint"))
        .drop(BLK, "__base")
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = POS) -> tuple[DataFrame, int]:
    """df with the 1-based position of each row inside its key, and the largest position.

    No time width is needed: rows are range-partitioned by keys and order, whatever their
    density, and only (key, range) counts move. Written once, as ranges come from a sample.
    """
    whole = [*keys, *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(
        df.repartitionByRange(n, *_cols(whole)).sortWithinPartitions(*whole).withColumn("__at", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__at", 33))
    sizes = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__size"), F.min("__at").alias("__first"))
    upto = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = settle(sizes.withColumn("__end", F.sum("__size").over(upto)))
    base = ends.select(*keys, "__part", (F.col("__end") - F.col("__size") - F.col("__first") + 1).alias("__base"))
    numbered = on_keys(ranged, base, [*keys, "__part"]).withColumn(out, F.col("__at") + F.col("__base"))
    return numbered.drop("__at", "__part", "__base"), ends.agg(F.max("__end")).first()[0] or 0


def running_by_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                    chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Running totals per key like `running`, cut by rows instead of time: `order` may lead with any type."""
    names = df.columns
    valued = df.withColumns({f"__v_{o}": e for o, e in sums.items()})
    rows = row_chunks(positions(valued, keys, order)[0], 0, chunk_rows)
    place = [*keys, CHUNK]
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*place).agg(*[F.sum(f"__v_{o}").alias(f"__t_{o}") for o in sums]).select(
        *place, *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__c_{o}") for o in sums]
    )
    inside = Window.partitionBy(*place).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = on_keys(rows.withColumns({o: F.sum(f"__v_{o}").over(inside) for o in sums}), carry, place)
    return rows.select(*names, *[(F.col(o) + F.col(f"__c_{o}")).alias(o) for o in sums])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: dict[str, str],
    ts: str = "ts_ms",
    block_ms: int = DEFAULT_BLOCK_MS,
) -> DataFrame:
    """Add the previous row's columns: fields maps output name -> source column."""
    blocked = df.withColumn(BLK, block_of(ts, block_ms)).withColumn(HALO, F.lit(False))
    sources = list(dict.fromkeys([*order, *fields.values()]))
    tails = blocked.groupBy(*keys, BLK).agg(
        F.max_by(F.struct(*_cols(sources)), F.struct(*_cols(order))).alias("__tail")
    )
    # A block's last row opens the next block, so that rows are moved once and meet no join.
    across = Window.partitionBy(*keys).orderBy(BLK)
    halo = tails.withColumn(BLK, F.lead(BLK).over(across)).where(F.col(BLK).isNotNull()).select(
        *keys, BLK, F.lit(True).alias(HALO), *[F.col(f"__tail.{c}").alias(c) for c in sources if c not in keys])
    rows = blocked.unionByName(halo, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, BLK).orderBy(F.desc(HALO), *order)
    row = F.struct(*[F.col(src).alias(out) for out, src in fields.items()])
    out = rows.withColumn("__prev", F.lag(row).over(inside)).where(~F.col(HALO))
    for name in fields:
        out = out.withColumn(name, F.col(f"__prev.{name}"))
    return out.drop(BLK, HALO, "__prev")


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    out: str,
    ts: str = "ts_ms",
    block_ms: int = DEFAULT_BLOCK_MS,
) -> DataFrame:
    """Last non-NULL value of `column` up to the current row."""
    blocked = df.withColumn(BLK, block_of(ts, block_ms))
    tails = blocked.groupBy(*keys, BLK).agg(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*_cols(order)))).alias("__tail")
    )
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *keys, BLK, F.last("__tail", ignorenulls=True).over(before).alias("__carry")
    )
    inside = (
        Window.partitionBy(*keys, BLK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        on_keys(blocked.withColumn(out, F.last(column, ignorenulls=True).over(inside)), carry, [*keys, BLK])
        .withColumn(out, F.coalesce(F.col(out), F.col("__carry")))
        .drop(BLK, "__carry")
    )


def row_chunks(df: DataFrame, halo: int, chunk_rows: int = DEFAULT_CHUNK_ROWS, pos: str = POS) -> DataFrame:
    """Assign CHUNK; the last `halo` rows of a chunk are also copied to the next one (HALO)."""
    chunk_rows = max(chunk_rows, halo, 1)
    zero_based = F.col(pos) - 1
    own = F.floor(zero_based / chunk_rows).cast("bigint")
    offset = zero_based % chunk_rows
    copies = F.when(offset >= chunk_rows - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn(CHUNK, F.explode(copies)).withColumn(HALO, F.col(CHUNK) != own)


def time_chunks(df: DataFrame, halo_ms: int, chunk_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Like row_chunks, but by time; a row is copied to the next chunk when within halo_ms of it."""
    chunk_ms = max(chunk_ms, halo_ms, 1)
    own = block_of(ts, chunk_ms)
    late = F.pmod(F.col(ts), F.lit(chunk_ms)) >= chunk_ms - halo_ms
    copies = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn(CHUNK, F.explode(copies)).withColumn(HALO, F.col(CHUNK) != own)


def row_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    exprs: Callable[[Window], dict[str, Column]],
    ts: str = "ts_ms",
    block_ms: int = DEFAULT_BLOCK_MS,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    pos: str | None = None,
) -> DataFrame:
    """Window expressions whose frame never reaches back more than `lookback` rows.

    `exprs` receives the ordered window spec (no frame) and returns name -> Column.
    """
    indexed = df if pos else row_index(df, keys, order, POS, ts, block_ms)
    p = pos or POS
    chunked = row_chunks(indexed, lookback, chunk_rows, p)
    spec = Window.partitionBy(*keys, CHUNK).orderBy(p)
    out = chunked
    for name, expr in exprs(spec).items():
        out = out.withColumn(name, expr)
    out = out.where(~F.col(HALO)).drop(CHUNK, HALO)
    return out if pos else out.drop(POS)
