"""Rolling statistics over ordered series (windows, z-scores, thresholds, percentiles)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapevigil.functions import kernels
from tapevigil.functions.scalars import log1p_pos
from tapevigil.operators.ranks import order_statistics
from tapevigil.operators.series import (
    CHUNK,
    DEFAULT_BLOCK_MS,
    DEFAULT_CHUNK_ROWS,
    HALO,
    POS,
    fill_forward,
    on_keys,
    per_chunk,
    row_chunks,
    row_index,
    spread,
    time_chunks,
)
from tapevigil.plans.storage import settle

TOTAL = "__total"


def rolling_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    window_ms: int = 300_000,
    max_samples: int | None = None,
    ts: str = "ts_ms",
    prefix: str = "w_",
    chunk_ms: int | None = None,
) -> DataFrame:
    """Count, sum, mean, sample variance, std and first time of the trailing window.

    The frame holds rows no later in `order` than the current one, at most
    `window_ms` older, and only the newest `max_samples` of those where that is given. Each row enters the
    frame once and leaves it once, so the cost is a sort per chunk instead of a
    rescan of the frame per row. Values are read as doubles and taken relative to the
    chunk's first value to keep the variance stable. A task holds its rows once, and
    one chunk of them as an Arrow table.
    """
    names = df.columns
    x = F.col(value)
    chunked = time_chunks(df, window_ms, chunk_ms or 4 * window_ms, ts).where(F.col(CHUNK).isNotNull())
    swept_fields = [
        T.StructField(f"{prefix}count", T.LongType()), T.StructField("__s1", T.DoubleType()),
        T.StructField("__s2", T.DoubleType()), T.StructField(f"{prefix}first_ts", df.schema[ts].dataType),
        T.StructField("__c", T.DoubleType()),
    ]

    def sweep(rows: pa.Table) -> pa.Table:
        values = rows[value].cast(pa.float64()).combine_chunks()
        some = ~np.asarray(values.is_null())
        v = values.to_numpy(zero_copy_only=False)
        known = some & some[0]
        stamps = rows[ts].combine_chunks()
        count, s1, s2, any_known, first = kernels.window_sums(
            stamps.to_numpy(zero_copy_only=False), v - v[0], known, window_ms, max_samples)
        swept = [
            pa.array(count, pa.int64()), pa.array(s1, pa.float64(), mask=~any_known),
            pa.array(s2, pa.float64(), mask=~any_known), stamps.take(pa.array(first)),
            pa.array(np.full(len(v), v[0]), pa.float64(), mask=np.full(len(v), not some[0])),
        ]
        out = rows.select(names)
        for field, column in zip(swept_fields, swept, strict=True):
            out = out.append_column(field.name, column)
        return out.filter(pc.invert(rows[HALO]))

    out = per_chunk(chunked, keys, order, sweep, T.StructType([*df.schema.fields, *swept_fields]))
    n, s1, s2 = F.col(f"{prefix}count"), F.col("__s1"), F.col("__s2")
    raw_var = s2 - s1 * s1 / n
    var = F.when((n < 2) | (raw_var <= s2 * 1e-13), 0.0).otherwise(raw_var / (n - 1))
    return out.select(
        *names, n, F.col(f"{prefix}first_ts"),
        F.when(n == 1, x).otherwise(s1 + n * F.col("__c")).alias(f"{prefix}sum"),
        F.when(n == 1, x).otherwise(s1 / n + F.col("__c")).alias(f"{prefix}mean"),
        var.alias(f"{prefix}var"),
    ).withColumn(f"{prefix}std", F.sqrt(f"{prefix}var"))


def window_z(value: str, prefix: str = "w_", min_samples: int = 20) -> Column:
    """(x - mean) / std of a rolling_window result; NULL while warming up, 0 when flat."""
    return F.when(
        F.col(f"{prefix}count") >= min_samples,
        F.when(F.col(f"{prefix}std") <= 1e-12, 0.0).otherwise(
            (F.col(value) - F.col(f"{prefix}mean")) / F.col(f"{prefix}std")
        ),
    )


def rate_per_minute(ts: str = "ts_ms", prefix: str = "w_") -> Column:
    span = F.col(ts) - F.col(f"{prefix}first_ts")
    total = F.col(f"{prefix}sum")
    return F.when((F.col(f"{prefix}count") < 2) | (span <= 0), total).otherwise(
        total * 60_000.0 / span
    )


def bucket_frame(keys: Sequence[str], window_ms: int, ts: str = "ts_ms") -> Window:
    """Trailing time frame for series that are already thinned to one row per bucket."""
    return Window.partitionBy(*keys).orderBy(ts).rangeBetween(-window_ms, 0)


def _chunked(df, keys, order, value, ts, halo, log_space, block_ms, chunk_rows) -> DataFrame:
    x = log1p_pos(F.col(value)) if log_space else F.col(value)
    prepared = df.withColumn("__x", x.cast("double"))
    if POS in df.columns and TOTAL in df.columns:
        indexed = prepared
    else:
        indexed = row_index(prepared, keys, order, POS, ts, block_ms, total=TOTAL)
    return row_chunks(indexed, halo, max(chunk_rows, halo))


def _ewma_carry(chunked: DataFrame, keys, ts, half_life_s, chunk_rows) -> DataFrame:
    """(mean, var) entering each chunk, from one summary row per full chunk."""
    key_fields = [chunked.schema[k] for k in keys]
    doubles = ["c", "a", "b", "p", "q", "r"]
    summary_schema = T.StructType(
        [*key_fields, T.StructField(CHUNK, T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in doubles]
    )
    carry_schema = T.StructType(
        [*key_fields, T.StructField(CHUNK, T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in ("__m", "__v")]
    )
    keys = list(keys)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, kind="stable")
        halo = pdf[HALO].to_numpy()
        own = pdf[~halo]
        if own.empty:
            return pd.DataFrame(columns=[*keys, CHUNK, *doubles])
        first = int(own[POS].iloc[0]) == 1
        stamps = own[ts].to_numpy()
        prev = float(pdf[ts].to_numpy()[halo.sum() - 1]) if halo.any() else float(stamps[0])
        alpha = kernels.ewma_weights(stamps, prev, first, half_life_s)
        row = own[[*keys, CHUNK]].iloc[[0]].copy()
        row[doubles] = [kernels.ewma_summary(own["__x"].to_numpy(), alpha)]
        return row

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        mean = var = 0.0
        means, variances = [], []
        for summary in pdf[doubles].itertuples(index=False, name=None):
            mean, var = kernels.ewma_apply(mean, var, summary)
            means.append(mean)
            variances.append(var)
        out = pdf[[*keys, CHUNK]].copy()
        out[CHUNK] = out[CHUNK] + 1
        out["__m"], out["__v"] = means, variances
        return out

    needed = chunked.where((F.col(CHUNK) + 1) * chunk_rows < F.col(TOTAL)).select(
        *keys, CHUNK, HALO, POS, ts, "__x"
    )
    summaries = needed.groupBy(*keys, CHUNK).applyInPandas(summarise, summary_schema)
    return summaries.groupBy(*keys).applyInPandas(carry, carry_schema)


def ewma_z(df, keys, order, value, half_life_s=60.0, warmup=20, log_space=False, ts="ts_ms",
           out="ewma_z", block_ms=DEFAULT_BLOCK_MS, chunk_rows=DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Exponentially weighted z, scored before the sample joins the baseline."""
    return _score(df, keys, order, value, ts, half_life_s, 1, warmup, log_space, False, 0.0, 25.0,
                  block_ms, chunk_rows, {out: "ewma"})


def robust_z(df, keys, order, value, window=300, warmup=30, zero_is_normal=False, log_space=False,
             ts="ts_ms", out="robust_z", block_ms=DEFAULT_BLOCK_MS,
             chunk_rows=DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Median/MAD z against the previous `window` values."""
    return _score(df, keys, order, value, ts, None, window, warmup, log_space, zero_is_normal, 1.0,
                  25.0, block_ms, chunk_rows, {out: "robust"})


def dynamic_z(df, keys, order, value, half_life_s=60.0, window=300, warmup=25, base_threshold=3.0,
              robust_weight=0.6, adaptive=True, zero_is_normal=False, log_space=False,
              max_abs_z=25.0, ts="ts_ms", out="z", threshold: str | None = "threshold",
              block_ms=DEFAULT_BLOCK_MS, chunk_rows=DEFAULT_CHUNK_ROWS,
              parts: bool = False) -> DataFrame:
    """Blend of the robust and the EWMA z, with the volatility-adaptive trigger level."""
    outputs = {out: "blend"}
    if parts:
        outputs |= {f"{out}_robust": "robust", f"{out}_ewma": "ewma"}
    weight = min(max(robust_weight, 0.0), 1.0)
    scored = _score(df, keys, order, value, ts, half_life_s, window, warmup, log_space,
                    zero_is_normal, weight, max_abs_z, block_ms, chunk_rows, outputs)
    if not threshold:
        return scored
    if not adaptive:
        return scored.withColumn(threshold, F.lit(float(base_threshold)))
    # The level needs a numbering pass and the rows: keep the Python stage from running again.
    return adaptive_threshold(settle(scored), keys, order, out, base_threshold, threshold, ts=ts,
                              block_ms=block_ms, chunk_rows=chunk_rows)


def _score(df, keys, order, value, ts, half_life_s, window, warmup, log_space, zero_is_normal,
           weight, limit, block_ms, chunk_rows, outputs: dict[str, str]) -> DataFrame:
    chunk_rows = max(chunk_rows, window)
    chunked = spread(
        _chunked(df, keys, order, value, ts, window, log_space, block_ms, chunk_rows), *keys, CHUNK
    )
    schema = T.StructType(
        [*df.schema.fields] + [T.StructField(o, T.DoubleType()) for o in outputs]
    )
    names = df.columns
    kinds = set(outputs.values())
    use_ewma, use_robust = bool(kinds & {"ewma", "blend"}), bool(kinds & {"robust", "blend"})
    if use_ewma:
        state = _ewma_carry(chunked, keys, ts, half_life_s, chunk_rows)
        chunked = on_keys(chunked, state, [*keys, CHUNK], "left")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, kind="stable")
        halo = pdf[HALO].to_numpy()
        start = int(halo.sum())
        own = pdf.iloc[start:]
        result = own[names].copy()
        if own.empty:
            for name in outputs:
                result[name] = pd.Series(dtype="float64")
            return result
        x = pdf["__x"].to_numpy(dtype=float)
        stamps = pdf[ts].to_numpy()
        seen = own[POS].to_numpy() - 1
        found = {}
        if use_robust:
            found["robust"] = kernels.robust_z(x, start, window, warmup, zero_is_normal)
        if use_ewma:
            first = seen[0] == 0
            prev = float(stamps[start - 1]) if start else float(stamps[0])
            alpha = kernels.ewma_weights(stamps[start:], prev, first, half_life_s)
            carried = own[["__m", "__v"]].iloc[0].fillna(0.0).to_numpy(dtype=float)
            found["ewma"] = kernels.ewma_z(x[start:], alpha, *carried, seen, warmup)
        if "blend" in kinds:
            found["blend"] = kernels.blend_z(
                found["robust"], found["ewma"], weight, limit, zero_is_normal
            )
        for name, kind in outputs.items():
            result[name] = found[kind]
        return result

    scored = chunked.groupBy(*keys, CHUNK).applyInPandas(score, schema)
    return scored.select(
        *names, *[F.when(~F.isnan(o), F.col(o)).alias(o) for o in outputs]
    )


def adaptive_threshold(df, keys, order, z="z", base=3.0, out="threshold", keep=200, need=50,
                       ts="ts_ms", block_ms=DEFAULT_BLOCK_MS,
                       chunk_rows=DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Trigger level from the latest `keep` known |z|; rows without a z keep the last level."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    known = row_index(df.where(F.col(z).isNotNull()), keys, order, POS, ts, block_ms)

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, kind="stable")
        start = int(pdf[HALO].sum())
        own = pdf.iloc[start:][names].copy()
        own[out] = kernels.tail_threshold(np.abs(pdf[z].to_numpy()), start, base, keep, need)
        return own

    scored = (
        spread(row_chunks(known, keep - 1, max(chunk_rows, keep)), *keys, CHUNK)
        .groupBy(*keys, CHUNK)
        .applyInPandas(level, schema)
    )
    unknown = df.where(F.col(z).isNull()).withColumn(out, F.lit(None).cast("double"))
    return fill_forward(
        scored.unionByName(unknown), keys, order, out, out, ts, block_ms
    ).withColumn(out, F.coalesce(F.col(out), F.lit(float(base)))).select(*names, out)


def latency_summary(df: DataFrame, keys: Sequence[str], ms: str, order: Sequence[str],
                    budget_ms: float = 200.0, keep: int | None = None) -> DataFrame:
    """Nearest-rank percentiles and breaches of all samples, or of the newest `keep` of each key."""
    if keep is not None:
        newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        # The rank filter prunes map-side first, so a hot key never ships more than `keep` rows.
        df = df.withColumn("__rk", F.row_number().over(newest)).where(F.col("__rk") <= keep)

    def nearest(q: float):
        return lambda n: F.greatest(F.lit(1), F.ceil(F.lit(q) * n))

    found = order_statistics(df, keys, ms, {"p50": nearest(0.50), "p95": nearest(0.95), "p99": nearest(0.99), "max": lambda n: n})
    breaches = df.groupBy(*keys).agg(F.count_if(F.col(ms) > budget_ms).alias("breaches"))
    return on_keys(found, breaches, keys).select(
        *keys, F.col("n").alias("count"), *[F.round(c, 2).alias(c) for c in ("p50", "p95", "p99", "max")], "breaches")
