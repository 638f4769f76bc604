"""Small numpy helpers that run inside Spark tasks on one bounded chunk of rows."""

from __future__ import annotations

import numpy as np

MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 1.349
FLAT = 1e-12
SLAB = 2048


def affine_scan(d: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix composition of y -> d*y + b; returns (A, B) with y_i = A_i*y_0 + B_i."""
    a, y = d.copy(), b.copy()
    step, n = 1, len(d)
    while step < n:
        y[step:] = y[step:] + a[step:] * y[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, y


def ewma_weights(ts_ms: np.ndarray, prev_ts: float, first: bool, half_life_s: float) -> np.ndarray:
    """Update weight per row from elapsed time; the first row of a key takes weight 1."""
    before = np.concatenate(([prev_ts], ts_ms[:-1].astype(float)))
    dt = np.maximum((ts_ms - before) / 1000.0, 1e-6)
    if half_life_s <= 0:
        alpha = np.ones(len(ts_ms))
    else:
        alpha = np.clip(1.0 - np.power(0.5, dt / half_life_s), 1e-4, 1.0)
    if first and len(alpha):
        alpha[0] = 1.0
    return alpha


def ewma_summary(x: np.ndarray, alpha: np.ndarray) -> tuple[float, ...]:
    """Coefficients taking (mean, var) before a chunk to (mean, var) after it.

    With m the incoming mean minus c: mean_out - c = a*m + b and
    var_out = a*var_in + p*m^2 + q*m + r.
    """
    c = float(x[0])
    xc, d = x - c, 1.0 - alpha
    pre_a, pre_b = affine_scan(d, alpha * xc)
    before_a = np.concatenate(([1.0], pre_a[:-1]))
    before_b = np.concatenate(([0.0], pre_b[:-1]))
    after = np.concatenate((np.cumprod(d[::-1])[::-1][1:], [1.0]))
    gain = after * d * alpha
    gap = xc - before_b
    return (
        c,
        float(pre_a[-1]),
        float(pre_b[-1]),
        float(np.sum(gain * before_a * before_a)),
        float(-2.0 * np.sum(gain * before_a * gap)),
        float(np.sum(gain * gap * gap)),
    )


def ewma_apply(mean: float, var: float, summary: tuple[float, ...]) -> tuple[float, float]:
    c, a, b, p, q, r = summary
    m = mean - c
    return c + a * m + b, max(a * var + p * m * m + q * m + r, 0.0)


def ewma_before(x, alpha, mean_in: float, var_in: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean, var) as they stood before each row of the chunk."""
    c = float(x[0])
    xc, d = x - c, 1.0 - alpha
    a, b = affine_scan(d, alpha * xc)
    mean = a * (mean_in - c) + b
    mean_before = np.concatenate(([mean_in - c], mean[:-1]))
    diff = xc - mean_before
    va, vb = affine_scan(d, d * alpha * diff * diff)
    var = va * var_in + vb
    return mean_before + c, np.maximum(np.concatenate(([var_in], var[:-1])), 0.0)


def ewma_z(x, alpha, mean_in, var_in, seen_before, warmup) -> np.ndarray:
    mean, var = ewma_before(x, alpha, mean_in, var_in)
    sd = np.sqrt(var)
    flat = sd <= FLAT
    z = np.where(flat, 0.0, (x - mean) / np.where(flat, 1.0, sd))
    return np.where(seen_before >= warmup, z, np.nan)


def _at(sorted_rows: np.ndarray, idx: np.ndarray) -> np.ndarray:
    return np.take_along_axis(sorted_rows, idx[:, None], axis=1)[:, 0]


def _median(sorted_rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 0.5 * (_at(sorted_rows, (n - 1) // 2) + _at(sorted_rows, n // 2))


def robust_z(x: np.ndarray, start: int, window: int, warmup: int, zero_is_normal: bool) -> np.ndarray:
    """Median/MAD z of x[start:] against the up to `window` values before each row."""
    padded = np.concatenate((np.full(window, np.nan), x))
    views = np.lib.stride_tricks.sliding_window_view(padded, window)
    out = np.full(len(x) - start, np.nan)
    for lo in range(start, len(x), SLAB):
        hi = min(lo + SLAB, len(x))
        here = np.arange(lo, hi)
        n = np.minimum(here, window)
        ordered = np.sort(views[lo:hi], axis=1)
        value = x[lo:hi]
        usable = n >= max(warmup, 1)
        count = np.maximum(n, 1)
        med = _median(ordered, count)
        dev = np.sort(np.abs(ordered - med[:, None]), axis=1)
        scale = _median(dev, count) * MAD_TO_SIGMA
        spread = (_at(ordered, (3 * count) // 4) - _at(ordered, count // 4)) / IQR_TO_SIGMA
        scale = np.where(scale <= FLAT, spread, scale)
        flat = ~(scale > FLAT)
        z = (value - med) / np.where(flat, 1.0, scale)
        if zero_is_normal:
            z = np.where(flat, np.nan, z)
        else:
            pegged = np.clip((value - med) / np.maximum(np.abs(med) * 1e-4, 1e-9), -50.0, 50.0)
            z = np.where(flat, np.where(np.abs(value - med) <= FLAT, 0.0, pegged), z)
        out[lo - start : hi - start] = np.where(usable, z, np.nan)
    return out


def blend_z(robust, ewma, weight, limit, zero_is_normal) -> np.ndarray:
    no_r, no_e = np.isnan(robust), np.isnan(ewma)
    mixed = np.clip(weight * robust + (1.0 - weight) * ewma, -limit, limit)
    only_robust = np.clip(robust, -limit, limit)
    without_robust = np.full(len(robust), np.nan) if zero_is_normal else ewma
    return np.where(no_r, without_robust, np.where(no_e, only_robust, mixed))


def tail_threshold(abs_z: np.ndarray, start: int, base: float, keep: int, need: int) -> np.ndarray:
    """max(base, min(1.15*p95, 2.5*base)) over the latest `keep` values, current one included."""
    padded = np.concatenate((np.full(keep - 1, np.nan), abs_z))
    views = np.lib.stride_tricks.sliding_window_view(padded, keep)
    out = np.full(len(abs_z) - start, base)
    for lo in range(start, len(abs_z), SLAB):
        hi = min(lo + SLAB, len(abs_z))
        n = np.minimum(np.arange(lo, hi) + 1, keep)
        p95 = _at(np.sort(views[lo:hi], axis=1), (0.95 * (n - 1)).astype(int))
        wide = np.maximum(base, np.minimum(p95 * 1.15, base * 2.5))
        out[lo - start : hi - start] = np.where(n < need, base, wide)
    return out


def ratio_band(size: np.ndarray, min_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest double whose ratio to size, smaller over larger, is at least min_ratio."""
    low, high = size * min_ratio, size / min_ratio
    for _ in range(3):
        below, above = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)
        low, high = np.where(below / size >= min_ratio, below, low), np.where(size / above >= min_ratio, above, high)
    for _ in range(3):
        low, high = np.where(low / size < min_ratio, np.nextafter(low, np.inf), low), np.where(size / high < min_ratio, np.nextafter(high, -np.inf), high)
    return low, high


def last_in_band(values: np.ndarray, low: np.ndarray, high: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each query the last index below `upto` whose value lies in [low, high], or -1.

    A merge-sort tree: each level keeps the ranks of aligned stretches of twice the length in
    order, so that one binary search tells whether a stretch holds a value of the band. A query
    tries the stretches of its prefix from the right, then goes down the first that does.
    """
    n = len(values)
    if n == 0 or len(upto) == 0:
        return np.full(len(upto), -1, np.int64)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    first, last = np.searchsorted(values[order], low, "left"), np.searchsorted(values[order], high, "right")
    depth = int(n).bit_length()
    levels = [np.sort((np.arange(n) >> level) * n + rank) for level in range(depth)]

    def holds(level: int, block: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.searchsorted(levels[level], block * n + first[of]) < np.searchsorted(levels[level], block * n + last[of])

    end, found, size = np.asarray(upto, np.int64).copy(), np.full(len(upto), -1, np.int64), np.zeros(len(upto), np.int64)
    open_ = np.flatnonzero((end > 0) & (first < last))
    for level in range(depth):
        # The prefix [0, end) ends with a stretch of 2**level rows where that bit of `end` is set.
        here = open_[(end[open_] >> level & 1) == 1]
        hit = here[holds(level, (end[here] >> level) - 1, here)]
        found[hit], size[hit] = (end[hit] >> level) - 1, level
        end[here] -= 1 << level
        open_ = open_[(found[open_] < 0) & (end[open_] > 0)]
    for level in range(depth - 2, -1, -1):
        down = np.flatnonzero((found >= 0) & (size > level))
        right = found[down] * 2 + 1
        found[down] = np.where(holds(level, right, down), right, right - 1)
        size[down] = level
    return found


def trailing_rank(x: np.ndarray, known: np.ndarray, start: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row from `start` on, among the latest `keep` rows: known values <= its own, and known values.

    NaN is the largest value. One pass per step back, over small integers instead of values.
    """
    n = len(x)
    values, codes = np.unique(x, return_inverse=True)
    codes = codes.astype(np.int16 if max(len(values), keep) < 2**15 - 1 else np.int32)
    own = np.where(known, codes, codes.dtype.type(-1))[start:]
    past = np.full(keep - 1 + n, len(values), codes.dtype)
    past[keep - 1:][known] = codes[known]
    below = np.zeros(n - start, codes.dtype)
    for back in range(keep):
        below += past[keep - 1 + start - back:keep - 1 + n - back] <= own
    upto = np.concatenate(([0], np.cumsum(known)))
    ends = np.arange(start, n) + 1
    return below, upto[ends] - upto[np.maximum(ends - keep, 0)]


def window_sums(ts: np.ndarray, dev: np.ndarray, known: np.ndarray, window: int,
                cap: int | None = None) -> tuple[np.ndarray, ...]:
    """Per row, ordered by time: rows of its trailing window, sums of dev and dev^2, whether any dev was known, first row.

    Each row enters the frame once, in order, and leaves it after `window`, or when `cap` newer rows have come.
    """
    n = len(ts)
    rows = np.arange(n)
    gone, place = ts + window, np.full(n, 1e18)
    if cap is not None and cap < n:
        full = ts[cap:] <= gone[:n - cap]
        gone[:n - cap] = np.where(full, ts[cap:], gone[:n - cap])
        place[:n - cap] = np.where(full, rows[:n - cap] + (cap - 0.5), 1e18)
    at = np.lexsort((np.concatenate((rows, place)), np.concatenate((ts, gone))))
    leaves, row = at >= n, at % max(n, 1)
    signed = np.where(leaves, -dev[row], dev[row])
    seen = known[row]
    ours = np.flatnonzero(~leaves)
    first = np.maximum.accumulate(np.where(leaves & (row < n - 1), np.arange(2 * n), -1))
    return (
        np.cumsum(np.where(leaves, -1, 1))[ours],
        np.cumsum(np.where(seen, signed, 0.0))[ours],
        np.cumsum(np.where(seen, signed * dev[row], 0.0))[ours],
        (np.cumsum(seen) > 0)[ours],
        np.where(first >= 0, row[first] + 1, 0)[ours],
    )
