"""Keyed state: streaming twins of the order-dependent operators.

Each processor keeps a few numbers (and at most one bounded buffer) per key in
the state store; sessions need the RocksDB state store provider.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapevigil.functions import kernels
from tapevigil.streaming.windows import with_event_time

#: Event time after which a key without rows is forgotten.
IDLE_MS = 7 * 86_400_000

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _batch(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


class Idle:
    """A timer that drops a key's state when nothing has come for `idle_ms` of event time; None keeps it."""

    def __init__(self, idle_ms: int | None, columns: list[str]):
        self.idle_ms, self.columns = idle_ms, columns

    def seen(self, handle: StatefulProcessorHandle, ts: int) -> None:
        if self.idle_ms is not None:
            for timer in list(handle.listTimers()):
                handle.deleteTimer(timer)
            handle.registerTimer(int(ts) + self.idle_ms)

    def nothing(self) -> pd.DataFrame:
        return pd.DataFrame(columns=self.columns)


def _timed(rows: DataFrame, idle_ms: int | None, delay: str, ts: str) -> tuple[DataFrame, str]:
    """rows with a watermark and the time mode that idle timers need."""
    return (rows, "None") if idle_ms is None else (with_event_time(rows, delay, ts), "EventTime")


class SeriesScores(StatefulProcessor):
    """Blended z, trigger level and CUSUM alarm of one series per key."""

    def __init__(self, keys, order, value, half_life_s, window, warmup, base, zero_is_normal, log_space, idle_ms):
        self.keys, self.order, self.value = list(keys), list(order), value
        self.idle = Idle(idle_ms, [*keys, *order, value, "z", "threshold", "alarm"])
        self.half_life_s, self.window, self.warmup = half_life_s, window, warmup
        self.base, self.zero_is_normal, self.log_space = base, zero_is_normal, log_space

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "series", "mean double, var double, seen bigint, last_ts bigint, buffer array<double>, "
            "recent array<double>, level double, up double, down double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, self.order)
        mean, var, seen, last_ts, buffer, recent, level, up, down = (
            self.state.get() if self.state.exists() else (0.0, 0.0, 0, 0, [], [], self.base, 0.0, 0.0))
        x = pdf[self.value].to_numpy(dtype=float)
        if self.log_space:
            x = np.log1p(np.maximum(x, 0.0))
        ts = pdf[self.order[0]].to_numpy(dtype="int64")
        alpha = kernels.ewma_weights(ts, float(last_ts if seen else ts[0]), seen == 0, self.half_life_s)
        count = seen + np.arange(len(x))
        ewma = kernels.ewma_z(x, alpha, mean, var, count, self.warmup)
        history = np.concatenate((np.asarray(buffer, dtype=float), x))
        robust = kernels.robust_z(history, len(buffer), self.window, self.warmup, self.zero_is_normal)
        z = kernels.blend_z(robust, ewma, 0.6, 25.0, self.zero_is_normal)
        recent, levels, alarms = list(recent), [], []
        for value in z.tolist():
            alarm = 0
            if value == value:
                recent = (recent + [abs(value)])[-200:]
                level = float(kernels.tail_threshold(np.asarray(recent), len(recent) - 1, self.base, 200, 50)[-1])
                clipped = max(-10.0, min(10.0, value))
                up, down = max(0.0, up + clipped - 0.5), min(0.0, down + clipped + 0.5)
                if up > 5.0:
                    up, alarm = 0.0, 1
                elif down < -5.0:
                    down, alarm = 0.0, -1
            levels.append(level)
            alarms.append(alarm)
        summary = kernels.ewma_summary(x, alpha)
        mean, var = kernels.ewma_apply(mean, var, summary)
        self.state.update((mean, var, int(seen + len(x)), int(ts[-1]), history[-self.window:].tolist(), recent,
                           level, up, down))
        out = pdf[[*self.keys, *self.order, self.value]].copy()
        out["z"], out["threshold"], out["alarm"] = [None if v != v else v for v in z.tolist()], levels, alarms
        self.idle.seen(self.handle, ts[-1])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self.idle.nothing()

    def close(self) -> None:
        pass


def series_scores(rows: DataFrame, keys, order, value, half_life_s=60.0, window=300, warmup=25, base=3.0,
                  zero_is_normal=False, log_space=False, idle_ms: int | None = IDLE_MS, delay: str = "10 minutes") -> DataFrame:
    """Streaming dynamic z: state per key is the EWMA pair, the last `window` values and 200 |z|.

    A key without rows for `idle_ms` is forgotten and warms up anew. Rows later than
    `delay` are dropped by the watermark; `idle_ms=None` keeps all keys and all rows.
    """
    kept = rows.select(*keys, *order, value)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    processor = SeriesScores(keys, order, value, half_life_s, window, warmup, base, zero_is_normal, log_space, idle_ms)
    timed, mode = _timed(kept, idle_ms, delay, order[0])
    return timed.groupBy(*keys).transformWithStateInPandas(
        processor, f"{ddl}, z double, threshold double, alarm int", outputMode="Append", timeMode=mode)


class Cooldown(StatefulProcessor):
    """Last sent time and rank per key."""

    def __init__(self, columns, order, cooldown_ms, idle_ms):
        self.columns, self.order, self.cooldown_ms = list(columns), list(order), cooldown_ms
        self.idle = Idle(idle_ms, [*columns, "sent", "reason_code", "alert_count"])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sent", "ts bigint, rank int, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, self.order)
        last = self.state.get() if self.state.exists() else None
        sent, reasons, counts = [], [], []
        for ts, rank in zip(pdf[self.order[0]].tolist(), pdf["rank"].tolist()):
            if last is None:
                why = "first"
            elif rank > last[1]:
                why = "escalation"
            else:
                why = "elapsed" if ts - last[0] >= self.cooldown_ms else "cooldown"
            if why != "cooldown":
                last = (int(ts), int(rank), (last[2] if last else 0) + 1)
            sent.append(why != "cooldown")
            reasons.append(why)
            counts.append(int(last[2]))
        self.state.update(last)
        out = pdf[self.columns].copy()
        out["sent"], out["reason_code"], out["alert_count"] = sent, reasons, counts
        self.idle.seen(self.handle, pdf[self.order[0]].iloc[-1])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self.idle.nothing()

    def close(self) -> None:
        pass


def route_alerts(signals: DataFrame, keys=("asset_pair", "venue"), order=("ts_ms", "signal_id"),
                 min_score: float = 80.0, cooldown_ms: int = 300_000, idle_ms: int | None = IDLE_MS,
                 delay: str = "10 minutes") -> DataFrame:
    """Streaming cooldown and escalation over signal rows.

    A key without alerts for `idle_ms` is forgotten: its next alert counts as the first.
    Rows later than `delay` are dropped by the watermark; `idle_ms=None` keeps all.
    """
    from tapevigil.functions.scalars import score_rank

    kept = signals.where(F.col("score") >= min_score).select(*keys, *order, "score")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    timed, mode = _timed(kept.withColumn("rank", score_rank(F.col("score"))), idle_ms, delay, order[0])
    return timed.groupBy(*keys).transformWithStateInPandas(
        Cooldown(kept.columns, order, cooldown_ms, idle_ms), f"{ddl}, sent boolean, reason_code string, alert_count bigint",
        outputMode="Append", timeMode=mode)


class OpenBucket(StatefulProcessor):
    """The open volume bucket of a key, closed by the next bucket's trade or by a timer."""

    def __init__(self, keys, bucket_ms, idle_ms, max_gap):
        self.keys, self.bucket_ms, self.idle_ms, self.max_gap = list(keys), bucket_ms, idle_ms, max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "start bigint, volume double, notional double, trades bigint")

    def _row(self, key, start, volume, notional, trades, by):
        return (*key, int(start), volume, notional, int(trades), by)

    def _frame(self, out) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.keys, "bucket_ms", "volume", "notional", "trades", "closed_by"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, ["ts_ms", "trade_id"])
        state = list(self.state.get()) if self.state.exists() else None
        out = []
        for ts, size, price in zip(pdf["ts_ms"].tolist(), pdf["size"].tolist(), pdf["price"].tolist()):
            start = ts // self.bucket_ms * self.bucket_ms
            if state is not None and start > state[0]:
                if state[3] > 0:
                    out.append(self._row(key, *state, "trade"))
                gap = (start - state[0]) // self.bucket_ms - 1
                out += [self._row(key, state[0] + self.bucket_ms * (i + 1), 0.0, 0.0, 0, "gap")
                        for i in range(min(gap, self.max_gap))]
                state = None
            if state is None:
                state = [start, 0.0, 0.0, 0]
            state[1] += size
            state[2] += size * price
            state[3] += 1
        self.state.update(tuple(state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(state[0]) + self.bucket_ms + self.idle_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            state = self.state.get()
            if state[3] > 0:
                out.append(self._row(key, *state, "timer"))
            # The bucket is reported; a later trade starts from here and only fills gaps.
            self.state.update((int(state[0]), 0.0, 0.0, 0))
        yield self._frame(out)

    def close(self) -> None:
        pass


def flushed_buckets(trades: DataFrame, bucket_ms: int = 5_000, window_ms: int = 300_000, idle_ms: int = 5_000,
                    delay: str = "1 second", keys=("venue", "symbol")) -> DataFrame:
    """Closed volume buckets with zero rows for gaps; silence closes a bucket by an event-time timer."""
    kept = with_event_time(trades.select(*keys, "ts_ms", "trade_id", "size", "price"), delay)
    ddl = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.groupBy(*keys).transformWithStateInPandas(
        OpenBucket(keys, bucket_ms, idle_ms, window_ms // bucket_ms),
        f"{ddl}, bucket_ms bigint, volume double, notional double, trades bigint, closed_by string",
        outputMode="Append", timeMode="EventTime")


LATEST_COLUMNS = (
    "metric string, venue string, ts_ms bigint, value double, z double, spike double, spread double, walls bigint, "
    "divergence double, acceleration double"
)


class LatestPerAsset(StatefulProcessor):
    """Newest observation of every series of an asset, and its decayed flow totals.

    A timer puts out a quiet asset again every `sweep_ms`, decayed and without
    expired observations; when none is left, its state is removed.
    """

    def __init__(self, tick_ms, factor, ttl_ms, sweep_ms):
        self.tick_ms, self.factor, self.ttl_ms, self.sweep_ms = tick_ms, factor, ttl_ms, sweep_ms
        self.fields = [f.split()[0] for f in LATEST_COLUMNS.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One small JSON object per asset: a handful of series, read and written once per batch.
        self.latest = handle.getValueState("latest", "series string")
        self.totals = handle.getValueState("totals", "epoch bigint, inflow double, outflow double, bridge double, hits bigint")

    def _load(self) -> tuple[list, dict]:
        totals = list(self.totals.get()) if self.totals.exists() else [None, 0.0, 0.0, 0.0, 0]
        return totals, json.loads(self.latest.get()[0]) if self.latest.exists() else {}

    def _decay(self, totals: list, ts: int) -> None:
        now = -(-int(ts) // self.tick_ms) - 1
        epoch = totals[0]
        if epoch is not None and now > epoch:
            shrink = self.factor ** (now - epoch)
            totals[1:4] = [x * shrink for x in totals[1:4]]
            totals[4] = max(0, totals[4] - (now - epoch))
        totals[0] = now if epoch is None else max(epoch, now)

    def _put(self, key, at: int, totals: list, fresh: dict, urgent: bool) -> pd.DataFrame:
        """Keep what is still fresh at time `at`, and its next timer; the rows to put out."""
        fresh = {series: row for series, row in fresh.items() if at - row[2] <= self.ttl_ms}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if fresh:
            self.totals.update((int(totals[0]), *totals[1:4], int(totals[4])))
            self.latest.update((json.dumps(fresh),))
            self.handle.registerTimer(at + self.sweep_ms)
        else:
            self.totals.clear()
            self.latest.clear()
        rows = [(key[0], at, *row, *totals[1:4], int(totals[4]), urgent) for row in fresh.values()]
        return pd.DataFrame(rows, columns=["asset", "at_ms", *self.fields, "in_usd", "out_usd", "bridge_usd", "hits", "urgent"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, ["ts_ms", "event_id"])
        totals, fresh = self._load()
        for r in pdf.to_dict("records"):
            self._decay(totals, r["ts_ms"])
            if r["metric"] == "wallet_transfer":
                totals[1] += r["usd"] if r["direction"] == "inflow" else 0.0
                totals[2] += r["usd"] if r["direction"] == "outflow" else 0.0
                totals[4] += int(r["hit"])
            elif r["metric"] == "bridge_flow":
                totals[3] += r["usd"]
            if r["metric"]:
                fresh[f"{r['metric']}|{r['venue']}"] = tuple(
                    None if v is None or v != v else v for v in (r[f] for f in self.fields))
        yield self._put(key, int(pdf["ts_ms"].iloc[-1]), totals, fresh, bool(pdf["urgent"].any()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = int(expiredTimerInfo.getExpiryTimeInMs())
        totals, fresh = self._load()
        self._decay(totals, at)
        yield self._put(key, at, totals, fresh, False)

    def close(self) -> None:
        pass


def latest_observations(events: DataFrame, tick_ms: int = 5_000, factor: float = 0.85, ttl_ms: int = 600_000,
                        sweep_ms: int = 60_000, delay: str = "10 seconds") -> DataFrame:
    """The live observations and flow totals of every asset that had an event, or whose sweep is due.

    `urgent` marks the rows of an asset that had an urgent event in the batch, of
    whatever metric. Rows later than `delay` are dropped by the watermark.
    """
    from tapevigil.operators.features import observations

    rows = with_event_time(observations(events, with_urgent=True), delay)
    return rows.groupBy("asset").transformWithStateInPandas(
        LatestPerAsset(tick_ms, factor, ttl_ms, sweep_ms),
        f"asset string, at_ms bigint, {LATEST_COLUMNS}, in_usd double, out_usd double, bridge_usd double, hits bigint, urgent boolean",
        outputMode="Append", timeMode="EventTime")


class LatestBridge(StatefulProcessor):
    """Deposits of one size cell and one window of time that wait for the watermark, and the flows they can fit.

    Rows are kept as one packed value per batch. When the watermark has passed deposits, a tree
    finds each one's newest fitting flow in logarithmic time; after the window the state is removed.
    """

    COLUMNS = ("flow", "ts_ms", "usd", "name")

    def __init__(self, window_ms, min_ratio):
        self.window_ms, self.min_ratio = window_ms, min_ratio

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")

    def _wake(self, key, waiting: pd.Series) -> None:
        """One timer: when the first waiting deposit is due, or the window is over."""
        at = min((int(key[1]) + 1) * self.window_ms, *([int(waiting.min())] if len(waiting) else []), 1 << 62)
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)[list(self.COLUMNS)]
        self.rows.appendValue((pickle.dumps([pdf[c].to_numpy() for c in self.COLUMNS]),))
        self._wake(key, pdf.loc[~pdf["flow"].astype(bool), "ts_ms"])
        yield self._found(pdf.iloc[:0], pdf.iloc[:0])

    def _found(self, deposits: pd.DataFrame, flows: pd.DataFrame) -> pd.DataFrame:
        """Each deposit that fits a flow, with the newest one (ties: larger flow, later name)."""
        flows = flows.sort_values(["ts_ms", "usd", "name"], kind="stable", na_position="first", ignore_index=True)
        f_ts, ts, usd = flows["ts_ms"].to_numpy("int64"), deposits["ts_ms"].to_numpy("int64"), deposits["usd"].to_numpy(float)
        at = kernels.last_in_band(flows["usd"].to_numpy(float), *kernels.ratio_band(usd, self.min_ratio), np.searchsorted(f_ts, ts, "right"))
        fits = np.flatnonzero((at >= 0) & (f_ts[at] >= ts - self.window_ms)) if len(f_ts) else []
        out, chosen = deposits.iloc[fits], flows.iloc[at[fits]]
        return pd.DataFrame({
            "id": out["name"].to_numpy(), "ts_ms": out["ts_ms"].to_numpy(), "usd_value": out["usd"].to_numpy(),
            "flow_ms": chosen["ts_ms"].to_numpy(), "flow_usd": chosen["usd"].to_numpy(), "bridge": chosen["name"].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        kept = [pickle.loads(bytes(packed)) for (packed,) in self.rows.get()]
        pdf = pd.DataFrame({c: np.concatenate([part[i] for part in kept]) for i, c in enumerate(self.COLUMNS)})
        flow = pdf["flow"].to_numpy(bool)
        due = ~flow & (pdf["ts_ms"].to_numpy("int64") <= passed)
        found = self._found(pdf[due].drop_duplicates(["name", "ts_ms", "usd"]), pdf[flow])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if passed >= (int(key[1]) + 1) * self.window_ms:
            self.rows.clear()
        else:
            self.rows.put([(pickle.dumps([pdf.loc[~due, c].to_numpy() for c in self.COLUMNS]),)])
            self._wake(key, pdf.loc[~flow & ~due, "ts_ms"])
        yield found

    def close(self) -> None:
        pass


def latest_bridge(deposits: DataFrame, flows: DataFrame, deposit_id: str, window_s: int = 1800, min_ratio: float = 0.75,
                  delay: str = "1 minute") -> DataFrame:
    """The newest fitting bridge flow of every deposit that has one (ties: larger flow, later bridge name).

    A deposit is put out when the watermark has passed it, so no earlier flow of it can still arrive.
    Both sides meet by log-size cell and window of time; a flow is copied to the neighbouring cell
    that it can fit and to the next window, so that work and state grow with the rows and not with
    the fitting pairs. Rows without time or finite size match nothing.
    """
    window_ms = window_s * 1000
    reach = math.log(1.0 / min_ratio) * (1.0 + 1e-9)
    width = 4.0 * reach
    usd, block = F.col("usd_value").cast("double"), F.floor(F.col("ts_ms") / window_ms).cast("bigint")
    cell = lambda d: F.floor((F.log(usd) + d) / width).cast("bigint")
    known = (usd > 0) & (usd < float("inf")) & F.col("ts_ms").isNotNull()
    columns = [F.col("ts_ms").cast("bigint").alias("ts_ms"), usd.alias("usd")]
    left = with_event_time(deposits.where((F.col("direction") == "inflow") & known), delay).select(
        cell(0.0).alias("cell"), block.alias("block"), F.lit(False).alias("flow"), *columns,
        F.col(deposit_id).cast("string").alias("name"), "ts")
    right = with_event_time(flows.where(known), delay).select(
        F.explode(F.array_distinct(F.array(cell(-reach), cell(reach)))).alias("cell"), block.alias("first"), F.lit(True).alias("flow"),
        *columns, F.col("bridge").cast("string").alias("name"), "ts")
    right = right.select("cell", F.explode(F.array(F.col("first"), F.col("first") + 1)).alias("block"), "flow", "ts_ms", "usd", "name", "ts")
    found = left.unionByName(right).groupBy("cell", "block").transformWithStateInPandas(
        LatestBridge(window_ms, min_ratio), "id string, ts_ms bigint, usd_value double, flow_ms bigint, flow_usd double, bridge string",
        outputMode="Append", timeMode="EventTime")
    ratio = F.least("usd_value", "flow_usd") / F.greatest("usd_value", "flow_usd")
    return found.select(
        F.col("id").cast(deposits.schema[deposit_id].dataType).alias(deposit_id), "ts_ms", "usd_value", "flow_ms", "flow_usd", "bridge",
        F.round(ratio, 3).alias("size_ratio"))
