"""Order-dependent folds that stay parallel inside a hot key.

Rows are cut into chunks of a bounded number by their position inside the key. A
fold summarises every chunk as a map from incoming to outgoing state; maps compose,
so the chunks of a long key are joined level by level, `FAN_IN` neighbours at a
time, into a tree of logarithmic depth. States then go down the tree, and every
chunk is replayed from its now known incoming state. No task holds more than one
chunk's rows, or the maps of `FAN_IN` neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapevigil.operators.series import CHUNK, POS, on_keys, positions, row_chunks, spread
from tapevigil.plans.storage import settle

STATE, NODE = "__state", "__node"
NEVER = float("inf")

#: Rows of a chunk, and maps that are joined at a time.
CHUNK_ROWS, FAN_IN = 4096, 32


def chunk_fold(
    chunked: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunks: int,
    summarise: Callable[[pd.DataFrame], dict],
    summary_fields: str,
    step: Callable[[list[float], dict], list[float]],
    compose: Callable[[dict, dict], dict],
    initial: list[float],
    replay: Callable[[pd.DataFrame, list[float]], dict],
    out_fields: list[T.StructField],
    columns: Sequence[str],
    summary_columns: Sequence[str],
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Fold rows with a CHUNK; `chunks` is the number of chunks of the longest key."""
    keys, order = list(keys), list(order)
    chunked = spread(chunked, *keys, CHUNK)
    key_ddl = ", ".join(f"`{k}` {chunked.schema[k].dataType.simpleString()}" for k in [*keys, CHUNK])

    def one_row(pdf: pd.DataFrame, values: dict) -> pd.DataFrame:
        row = pdf[[*keys, CHUNK]].iloc[[0]].reset_index(drop=True)
        for name, value in values.items():
            row[name] = pd.Series([value], dtype=object) if isinstance(value, list) else value
        return row

    def to_summary(pdf: pd.DataFrame) -> pd.DataFrame:
        return one_row(pdf, summarise(pdf.sort_values(order, kind="stable")))

    def to_node(pdf: pd.DataFrame) -> pd.DataFrame:
        joined = reduce(compose, pdf.sort_values(CHUNK).to_dict("records"))
        row = one_row(pdf, {k: list(v) if isinstance(v, np.ndarray) else v for k, v in joined.items() if k not in (*keys, CHUNK, NODE)})
        row[CHUNK] = pdf[NODE].iloc[0]
        return row

    def to_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        state, states = list(pdf[STATE].iloc[0]) if STATE in pdf else list(initial), []
        for row in pdf.to_dict("records"):
            states.append(state)
            state = step(state, row)
        out = pdf[[*keys, CHUNK]].copy()
        out[STATE] = pd.Series(states, index=out.index, dtype=object)
        return out

    def noded(maps: DataFrame) -> DataFrame:
        return maps.withColumn(NODE, F.floor(F.col(CHUNK) / fan_in).cast("bigint"))

    maps_ddl, states_ddl = f"{key_ddl}, {summary_fields}", f"{key_ddl}, {STATE} array<double>"
    levels = [
        chunked.select(*dict.fromkeys([*keys, CHUNK, *summary_columns])).groupBy(*keys, CHUNK).applyInPandas(to_summary, maps_ddl)
    ]
    while chunks > fan_in:
        levels[-1] = settle(levels[-1])
        levels.append(noded(levels[-1]).groupBy(*keys, NODE).applyInPandas(to_node, maps_ddl))
        chunks = -(-chunks // fan_in)
    states = levels[-1].groupBy(*keys).applyInPandas(to_states, states_ddl)
    for maps in reversed(levels[:-1]):
        above = states.withColumnRenamed(CHUNK, NODE)
        states = on_keys(noded(maps), above, [*keys, NODE]).groupBy(*keys, NODE).applyInPandas(to_states, states_ddl)
    schema = T.StructType([chunked.schema[c] for c in columns] + out_fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out = pdf[list(columns)].copy()
        for name, values in replay(pdf, list(pdf[STATE].iloc[0])).items():
            out[name] = values
        return out

    return on_keys(chunked, states, [*keys, CHUNK]).groupBy(*keys, CHUNK).applyInPandas(run, schema)


# --- change points -----------------------------------------------------------


def _one_sided(y: np.ndarray, start: float, limit: float) -> tuple[float, np.ndarray]:
    """Reflected walk that restarts at 0 after passing `limit`; returns (end, alarms)."""
    level, alarms = start, np.zeros(len(y), dtype=bool)
    for i, v in enumerate(y.tolist()):
        level = max(0.0, level + v)
        if level > limit:
            level = 0.0
            alarms[i] = True
    return level, alarms


def _one_sided_map(y: np.ndarray, limit: float) -> tuple[list[float], list[float], float, float]:
    """The walk's end as a function of its start.

    A start above cuts[k] (first such k) alarms first at that cut's row and ends
    at ends[k]; otherwise it ends at max(start + shift, floor).
    """
    cuts, ends = [], []
    total, floor, best = 0.0, 0.0, -NEVER
    for i, v in enumerate(y.tolist()):
        total += v
        floor = max(0.0, floor + v)
        if floor > limit:
            end, _ = _one_sided(y[i + 1 :], 0.0, limit)
            return [*cuts, -NEVER], [*ends, end], 0.0, 0.0
        if total > best:
            best = total
            if limit - total <= limit:
                end, _ = _one_sided(y[i + 1 :], 0.0, limit)
                cuts.append(limit - total)
                ends.append(end)
    return cuts, ends, total, floor


def _follow(start: float, cuts, ends, shift: float, floor: float) -> float:
    for cut, end in zip(cuts, ends):
        if start > cut:
            return float(end)
    return max(start + shift, floor)


def _joined(first: list, then: list) -> list:
    """The map of two neighbouring stretches from the map of each."""
    cuts, ends, shift, floor = list(first[0]), [_follow(e, *then) for e in first[1]], first[2], first[3]
    if cuts and cuts[-1] == -NEVER:
        return [cuts, ends, 0.0, 0.0]
    # A start that passes the first stretch without an alarm enters the second at max(start + shift, floor).
    for cut, end in zip(then[0], then[1]):
        if floor > cut:
            return [[*cuts, -NEVER], [*ends, float(end)], 0.0, 0.0]
        if not cuts or cut - shift < cuts[-1]:
            cuts.append(cut - shift)
            ends.append(float(end))
    return [cuts, ends, shift + then[2], max(floor + then[2], then[3])]


def cusum(df: DataFrame, keys, order, z: str = "z", drift: float = 0.5, threshold: float = 5.0,
          limit: float | None = 10.0, out: str = "alarm", chunk_rows: int = CHUNK_ROWS,
          fan_in: int = FAN_IN) -> DataFrame:
    """Two-sided CUSUM on a z series: 1 / -1 where the mean shifts up / down, else 0.

    `limit` clips z first; rows without a z leave the state alone. The two sides
    cannot alarm on the same row, so they are folded independently.
    """
    names = df.columns
    indexed, longest = positions(df, keys, order)
    chunked = row_chunks(indexed, 0, chunk_rows)

    def steps(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = pdf[z].to_numpy(dtype=float)
        known = ~np.isnan(values)
        used = values[known] if limit is None else np.clip(values[known], -limit, limit)
        return known, used - drift, -used - drift

    def summarise(pdf: pd.DataFrame) -> dict:
        _, up, down = steps(pdf)
        row = {}
        for side, y in (("u", up), ("d", down)):
            cuts, ends, shift, floor = _one_sided_map(y, threshold)
            row |= {f"{side}_cuts": cuts, f"{side}_ends": ends, f"{side}_shift": shift,
                    f"{side}_floor": floor}
        return row

    def step(state, row):
        return [
            _follow(level, row[f"{s}_cuts"], row[f"{s}_ends"], row[f"{s}_shift"], row[f"{s}_floor"])
            for level, s in zip(state, ("u", "d"))
        ]

    def compose(first, then):
        row = {}
        for s in ("u", "d"):
            names = [f"{s}_{part}" for part in ("cuts", "ends", "shift", "floor")]
            row |= dict(zip(names, _joined([first[n] for n in names], [then[n] for n in names])))
        return row

    def replay(pdf: pd.DataFrame, state) -> dict:
        known, up, down = steps(pdf)
        alarm = np.zeros(len(pdf), dtype="int32")
        alarm[np.flatnonzero(known)[_one_sided(up, state[0], threshold)[1]]] = 1
        alarm[np.flatnonzero(known)[_one_sided(down, state[1], threshold)[1]]] = -1
        return {out: alarm}

    fields = ", ".join(
        f"{s}_cuts array<double>, {s}_ends array<double>, {s}_shift double, {s}_floor double"
        for s in ("u", "d")
    )
    return chunk_fold(chunked, keys, [POS], -(-longest // chunk_rows), summarise, fields, step, compose, [0.0, 0.0],
                      replay, [T.StructField(out, T.IntegerType())], names, [POS, z], fan_in)


# --- cooldown ----------------------------------------------------------------

RANKS = range(-1, 5)


def _chain(ts, rank, forced, cooldown) -> tuple[list[tuple], dict[int, int]]:
    """For each row, (last time, last rank, sends) at the end if that row is sent."""
    n = len(ts)
    expiry = np.maximum(np.searchsorted(ts, ts + cooldown, "left"), np.arange(n) + 1)
    near = dict.fromkeys(RANKS, n)
    ends: list[tuple] = [()] * n
    for i in range(n - 1, -1, -1):
        nxt = min(int(expiry[i]), near[int(rank[i])])
        if nxt < n:
            t, r, c = ends[nxt]
            ends[i] = (t, r, c + 1.0)
        else:
            ends[i] = (float(ts[i]), float(rank[i]), 1.0)
        for r in RANKS:
            if forced[i] or rank[i] > r:
                near[r] = i
    return ends, near


def _after(states: np.ndarray, row: dict, cooldown: float) -> np.ndarray:
    """States (last time, last rank, sends) after a stretch, given those before it, one in each row."""
    jumps, runs = (np.asarray(row[n], float).reshape(-1, 4) for n in ("jumps", "runs"))
    due = states[:, 0] + cooldown
    jump = jumps[states[:, 1].astype(int) - RANKS.start]
    at = np.searchsorted(runs[:, 0], due, "left")
    inside = (jump[:, 0] >= due) & (at < len(runs))
    sent = np.where(inside[:, None], runs[np.minimum(at, len(runs) - 1)], jump)
    out = np.column_stack([sent[:, 1:3], states[:, 2] + sent[:, 3]])
    return np.where((inside | (jump[:, 0] < NEVER))[:, None], out, states)


def _compact(runs: np.ndarray) -> np.ndarray:
    """Runs with equal ends as one."""
    last = np.append((runs[1:, 1:] != runs[:-1, 1:]).any(axis=1), True)
    return runs[last]


def cooldown_gate(df: DataFrame, keys, order, cooldown_ms: int, rank: str | None = None,
                  forced: str | None = None, ts: str = "ts_ms", chunk_rows: int = CHUNK_ROWS,
                  prefix: str = "gate_", fan_in: int = FAN_IN) -> DataFrame:
    """Let a row through if it is the key's first, forced, of higher rank than the last row
    let through, or at least `cooldown_ms` after it. `order` starts with `ts`.

    Adds <prefix>sent, <prefix>reason (first/escalation/elapsed/cooldown/forced),
    <prefix>since_ms (time since the last row let through) and <prefix>count.

    A chunk's map: `jumps` has, for each rank of the last row let through, the first row
    that passes it whatever the time; `runs` has the rows that an elapsed cooldown may
    let through first, in time order; each with the state at the chunk's end. `opening`
    is the state at the end if nothing was let through before.
    """
    names = df.columns
    indexed, longest = positions(df, keys, order)
    chunked = row_chunks(
        indexed.withColumn("__rank", F.col(rank).cast("int") if rank else F.lit(0))
        .withColumn("__forced", F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)),
        0, chunk_rows,
    )

    def parts(pdf: pd.DataFrame):
        return pdf[ts].to_numpy(dtype="int64"), pdf["__rank"].to_numpy(), pdf["__forced"].to_numpy()

    def summarise(pdf: pd.DataFrame) -> dict:
        stamps, ranks, force = parts(pdf)
        ends, near = _chain(stamps, ranks, force, cooldown_ms)
        n = len(stamps)
        # The last row let through is not after the first row here, so its cooldown ends within one of that row.
        reach = min(int(np.searchsorted(stamps, stamps[0] + cooldown_ms, "left")) + 1, n)
        runs = _compact(np.column_stack([stamps[:reach], np.array(ends[:reach])]).astype(float))
        jumps = [[float(stamps[near[r]]), *ends[near[r]]] if near[r] < n else [NEVER, 0.0, 0.0, 0.0]
                 for r in RANKS]
        return {
            "since": float(stamps[0]),
            "runs": runs.ravel().tolist(),
            "jumps": [v for jump in jumps for v in jump],
            "opening": [float(v) for v in ends[0]],
        }

    def step(state, row):
        if not state:
            return [float(v) for v in row["opening"]]
        return _after(np.array([state], float), row, cooldown_ms)[0].tolist()

    def compose(first, then):
        jumps, runs = (np.asarray(first[n], float).reshape(-1, 4) for n in ("jumps", "runs"))
        reached = jumps[:, 0] < NEVER
        jumps = np.where(reached[:, None], jumps, np.asarray(then["jumps"], float).reshape(-1, 4))
        jumps[reached, 1:] = _after(jumps[reached, 1:], then, cooldown_ms)
        runs = np.column_stack([runs[:, 0], _after(runs[:, 1:], then, cooldown_ms)])
        if runs[-1, 0] < first["since"] + cooldown_ms:
            later = np.asarray(then["runs"], float).reshape(-1, 4)
            later = later[:int(np.searchsorted(later[:, 0], first["since"] + cooldown_ms, "left")) + 1]
            runs = np.concatenate([runs, later])
        return {"since": first["since"], "runs": _compact(runs).ravel().tolist(), "jumps": jumps.ravel().tolist(),
                "opening": step(list(first["opening"]), then)}

    def replay(pdf: pd.DataFrame, state) -> dict:
        stamps, ranks, force = parts(pdf)
        sent, reason, since, counts = [], [], [], []
        last_ts, last_rank, count = state if state else (None, -1.0, 0.0)
        for t, r, f in zip(stamps.tolist(), ranks.tolist(), force.tolist()):
            elapsed = None if last_ts is None else t - last_ts
            if last_ts is None:
                why = "first"
            elif f:
                why = "forced"
            elif r > last_rank:
                why = "escalation"
            elif elapsed >= cooldown_ms:
                why = "elapsed"
            else:
                why = "cooldown"
            since.append(elapsed)
            if why != "cooldown":
                last_ts, last_rank, count = t, r, count + 1
            sent.append(why != "cooldown")
            reason.append(why)
            counts.append(int(count))
        return {f"{prefix}sent": sent, f"{prefix}reason": reason,
                f"{prefix}since_ms": pd.array(since, dtype="Int64"), f"{prefix}count": counts}

    out_fields = [
        T.StructField(f"{prefix}sent", T.BooleanType()),
        T.StructField(f"{prefix}reason", T.StringType()),
        T.StructField(f"{prefix}since_ms", T.LongType()),
        T.StructField(f"{prefix}count", T.LongType()),
    ]
    return chunk_fold(
        chunked, keys, [POS], -(-longest // chunk_rows), summarise,
        "since double, runs array<double>, jumps array<double>, opening array<double>",
        step, compose, [], replay, out_fields, names, [POS, ts, "__rank", "__forced"], fan_in,
    )
