"""Numerics on blocks of series: arrays of series x steps, NaN where a value is missing.

Window sums are differences of running sums of values less the series mean, in units of its deviation, so a window costs
the same whatever its length. Whether a window is constant is counted, not computed, so its deviation is 0 and not noise.
"""

from __future__ import annotations

import numpy as np

INDICATORS = ("std", "ac1", "skew", "kurt", "fd")


def _runs(a: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((len(a), 1)), np.cumsum(a, axis=1)), axis=1)


def indicators(y: np.ndarray, half: int, strict: bool) -> dict[str, np.ndarray]:
    """Std, ac1, skew, kurt, fd of the window of 2 * half + 1 points around each point, NaN where it is not whole.

    `strict`: windows without a gap, moments divided by their number. Else windows of three values or more: the variance is
    the sample's, lagged products are divided by the window's length less one, and differences by the pairs a full window has.
    """
    rows, n = y.shape
    w = 2 * half + 1
    out = {k: np.full((rows, n), np.nan) for k in INDICATORS}
    if n < w or w < 3:
        return out
    ok = ~np.isnan(y)
    count = ok.sum(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        mean = np.where(ok, y, 0).sum(axis=1, keepdims=True) / np.maximum(count, 1)
        c = np.where(ok, y - mean, 0)
        unit = np.sqrt((c * c).sum(axis=1, keepdims=True) / np.maximum(count, 1))
        unit[unit == 0] = 1
        c = c / unit
        moved = lambda a: (lambda s: s[:, w:] - s[:, :-w])(_runs(a))
        lagged = lambda a, lag: (lambda s: s[:, w - lag :] - s[:, : n - w + 1])(_runs(a))  # noqa: E731  pairs inside the window
        k, s1, s2, s3, s4 = (moved(a) for a in (ok, c, c**2, c**3, c**4))
        both = ok[:, 1:] & ok[:, :-1]
        x1, x0 = c[:, 1:], c[:, :-1]
        pairs, products, sums = lagged(both, 1), lagged(x1 * x0, 1), lagged(np.where(both, x1 + x0, 0), 1)
        step1 = lagged(np.where(both, np.abs(x1 - x0), 0), 1)
        step2 = lagged(np.where(ok[:, 2:] & ok[:, :-2], np.abs(c[:, 2:] - c[:, :-2]), 0), 2)
        # a window is constant if no value differs from the one before it, but for its first
        at = np.maximum.accumulate(np.where(ok, np.arange(n), -1), axis=1)
        before = np.concatenate((np.full((rows, 1), -1), at[:, :-1]), axis=1)
        change = ok & ((before < 0) | (y != np.take_along_axis(y, np.maximum(before, 0), axis=1)))
        seen = _runs(ok)
        latest = np.maximum.accumulate(np.where(change, seen[:, 1:], 0), axis=1)[:, w - 1 :]
        changes = moved(change)
        constant = (changes == 0) | ((changes == 1) & (latest == seen[:, : n - w + 1] + 1))
        m = s1 / k
        v2 = np.where(constant, 0, np.maximum(s2 / k - m * m, 0))
        v3 = s3 / k - 3 * m * s2 / k + 2 * m**3
        v4 = s4 / k - 4 * m * s3 / k + 6 * m * m * s2 / k - 3 * m**4
        valid = k == w if strict else k > 2
        var = v2 if strict else v2 * k / (k - 1)
        spread = valid & (var > 0)
        found = {
            "std": np.where(valid, np.sqrt(var) * unit, np.nan),
            "ac1": np.where(spread, (products - m * sums + pairs * m * m) / (var * (w if strict else w - 1)), np.nan),
            "skew": np.where(spread, v3 / var**1.5, np.nan),
            "kurt": np.where(spread, v4 / (var * var), np.nan),
            "fd": np.where(valid & (step1 > 0) & (step2 > 0), np.clip(2 - np.log2((step2 / (w - 2)) / (step1 / (w - 1))), 1, 2), np.nan),
        }
    for name, a in found.items():
        out[name][:, half : n - half] = a
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    """Largest less smallest of each series, negative if the first smallest comes after the first largest."""
    known = ~np.isnan(a)
    any_ = known.any(axis=1)
    high, low = np.where(known, a, -np.inf), np.where(known, a, np.inf)
    size = np.where(any_, high.max(axis=1), 0) - np.where(any_, low.min(axis=1), 0)
    return np.where(any_, np.where(low.argmin(axis=1) > high.argmax(axis=1), -size, size), np.nan)


def count_inversions(rank: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Pairs of each group, in the order given, whose first has the larger rank. `group` does not fall; O(n log n), bit by bit."""
    out = np.zeros(groups)
    if not len(rank):
        return out.astype(np.int64)
    new = np.r_[True, group[1:] != group[:-1]]
    r, g, places = rank, group, np.arange(len(rank))
    for bit in reversed(range(int(rank.max()).bit_length())):
        one = (r >> bit) & 1
        ones = np.cumsum(one) - one
        start = np.maximum.accumulate(np.where(new, places, 0))
        inside = ones - ones[start]
        out += np.bincount(g, weights=np.where(one == 0, inside, 0), minlength=groups)
        r, g, new = _parted(one, inside, start, new, places, r, g)
    return out.astype(np.int64)


def _parted(one, inside, start, new, places, r, g, *more):
    """Arrays with each run's zeros before its ones, and where the runs then begin."""
    ends = np.append(np.flatnonzero(new)[1:], len(one))
    run = np.cumsum(new) - 1
    zeros = (places - start) - inside
    total = (ends - np.flatnonzero(new))[run] - np.add.reduceat(one, np.flatnonzero(new))[run]
    to = start + np.where(one == 1, total + inside, zeros)
    moved = [np.empty_like(a) for a in (r, g, one, *more)]
    for a, b in zip(moved, (r, g, one, *more), strict=True):
        a[to] = b
    begins = new.copy()
    begins[1:] |= moved[2][1:] != moved[2][:-1]
    return (moved[0], moved[1], begins, *moved[3:])


def kendall(y: np.ndarray) -> dict[str, np.ndarray]:
    """`kendall_of` the rows of a matrix."""
    row, column = np.nonzero(~np.isnan(y))
    return kendall_of(y[row, column], row, len(y))


def kendall_of(v: np.ndarray, row: np.ndarray, groups: int) -> dict[str, np.ndarray]:
    """E1 of the values `v` of series `row` (which does not fall) against their order: n, s, tau-b and z (NaN without pairs that differ), and whether values tie."""
    order = np.lexsort((v, row))
    sorted_, owner = v[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (sorted_[1:] != sorted_[:-1])
    dense = np.cumsum(new) - 1
    first = np.zeros(groups, np.int64)
    first[owner[::-1]] = dense[::-1]
    rank = np.empty(len(v), np.int64)
    rank[order] = dense - first[owner]
    ties = np.diff(np.append(np.flatnonzero(new), len(v))).astype(float)
    of = owner[new]
    n = np.bincount(row, minlength=groups).astype(float)
    tied = np.bincount(of, weights=ties * (ties - 1) / 2, minlength=groups)
    pairs = n * (n - 1) / 2
    s = pairs - tied - 2 * count_inversions(rank, row, groups)
    var = (n * (n - 1) * (2 * n + 5) - np.bincount(of, weights=ties * (ties - 1) * (2 * ties + 5), minlength=groups)) / 18
    with np.errstate(all="ignore"):
        tau = np.where(pairs > tied, s / np.sqrt(pairs * (pairs - tied)), np.nan)
        z = np.where(pairs > tied, s / np.sqrt(var), np.nan)
    return {"n": n.astype(np.int32), "s": s, "tau": tau, "z": z, "tied": tied > 0}


def _inverted(rank: np.ndarray, wanted: np.ndarray | None = None):
    """Number of pairs, in the order given, whose first has the larger rank; with `wanted` (rising numbers below it), places of those pairs."""
    total, places, at = 0, np.arange(len(rank)), np.arange(len(rank))
    new = np.zeros(len(rank), bool)
    new[0] = True
    r, first, second = rank, [], []
    for bit in reversed(range(int(rank.max()).bit_length())):
        one = (r >> bit) & 1
        ones = np.cumsum(one) - one
        start = np.maximum.accumulate(np.where(new, places, 0))
        inside = ones - ones[start]
        zero = np.flatnonzero(one == 0)
        sums = np.cumsum(inside[zero])
        level = int(sums[-1]) if len(sums) else 0
        if wanted is not None and level:
            local = wanted[np.searchsorted(wanted, total) : np.searchsorted(wanted, total + level)] - total
            z = np.searchsorted(sums, local, "right")
            k = local - (sums[z] - inside[zero[z]])
            first.append(at[np.flatnonzero(one)[ones[start[zero[z]]] + k]])
            second.append(at[zero[z]])
        total += level
        r, _, new, at = _parted(one, inside, start, new, places, r, places, at)
    if wanted is None:
        return total
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _dense(a: np.ndarray) -> np.ndarray:
    return np.unique(a, return_inverse=True)[1]


def slope_at(x: np.ndarray, y: np.ndarray, k: int, held: int = 100_000, sample: int = 20_000) -> float:
    """The slope of rank `k` (from 0) among all pairs of points, x rising: O(n log n) time for each of a few rounds, O(n) memory.

    Two points stand in another order by y - m x than by x exactly if their slope is below m, so slopes below a bound are
    inversions and slopes between two bounds are inversions of one order against the other. A random sample of those left
    gives bounds around the rank, until few enough are left to be computed.
    """
    n = len(x)
    rng = np.random.default_rng(n)
    order_of = lambda m: np.arange(n) if m == -np.inf else np.argsort(y - m * x, kind="stable")
    rank_of = lambda m: np.arange(n)[::-1] if m == np.inf else _dense(y - m * x)
    low, high, below, left, stuck = -np.inf, np.inf, 0, n * (n - 1) // 2, 0
    while True:
        order = order_of(low)
        rank = rank_of(high)[order]
        wanted = np.arange(left) if left <= held else np.unique(rng.integers(0, left, sample))
        i, j = _inverted(rank, wanted)
        i, j = order[i], order[j]
        slopes = np.sort((y[j] - y[i]) / (x[j] - x[i]))
        if left <= held:
            return float(slopes[min(k - below, len(slopes) - 1)])
        share = (k - below) / left
        place, reach = share * len(slopes), 3 * np.sqrt(len(slopes) * share * (1 - share)) + 3
        a, b = slopes[max(0, int(place - reach))], slopes[min(len(slopes) - 1, int(place + reach))]
        before = left
        for bound in dict.fromkeys((a, b)):
            if not low < bound < high:
                continue
            fewer = _inverted(rank_of(bound))
            if fewer > k:
                high, left = bound, fewer - below
            elif k < n * (n - 1) // 2 - _inverted(_dense(bound * x - y)):
                return float(bound)  # many slopes are equal to it
            else:
                low, left, below = bound, left - (fewer - below), fewer
        stuck = stuck + 1 if left > before / 2 else 0
        if stuck > 3:  # what is left are pairs with few different slopes, in long ties: count them part by part
            order = order_of(low)
            rank = rank_of(high)[order]
            values, counts = np.zeros(0), np.zeros(0, np.int64)
            for at in range(0, left, held):
                i, j = _inverted(rank, np.arange(at, min(at + held, left)))
                i, j = order[i], order[j]
                values, back = np.unique(np.concatenate((values, (y[j] - y[i]) / (x[j] - x[i]))), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate((counts, np.ones(len(i)))), minlength=len(values))
            return float(values[min(int(np.searchsorted(np.cumsum(counts), k - below, "right")), len(values) - 1)])


def loess(y: np.ndarray, window: int, at: np.ndarray, robust: np.ndarray | None = None) -> np.ndarray:
    """Local lines with tricube weights at the places `at`, through rows of `y` at 0..n-1 (rows are smoothed apart)."""
    n = y.shape[1]
    x = np.arange(n)
    q = min(window, n)
    left = np.clip(np.round(at).astype(int) - q // 2, 0, n - q)
    index = left[:, None] + np.arange(q)
    distance = np.abs(x[index] - at[:, None])
    reach = distance.max(axis=1, keepdims=True) * (1 if window <= n else window / n)
    weight = np.clip(1 - (distance / np.maximum(reach, 1e-12)) ** 3, 0, None) ** 3
    weight = weight[None] if robust is None else weight[None] * robust[:, index] + 1e-12
    values = y[:, index]
    dx = (x[index] - at[:, None])[None]
    total = weight.sum(axis=2)
    mx, my = (weight * dx).sum(axis=2) / total, (weight * values).sum(axis=2) / total
    sxx = (weight * dx * dx).sum(axis=2) / total - mx * mx
    sxy = (weight * dx * values).sum(axis=2) / total - mx * my
    slope = np.where(sxx > 1e-12, sxy / np.where(sxx > 1e-12, sxx, 1), 0)
    return my - slope * mx


def loess_everywhere(y: np.ndarray, window: int, robust: np.ndarray | None = None) -> np.ndarray:
    """`loess` at all places 0..n-1. Away from the ends all windows have the same weights, so their sums are convolutions;
    places near the ends, and those whose robust weights nearly vanish or hold too few points for a line, are done one by one."""
    rows, n = y.shape
    q = window
    if n < 4 * q or q < 8:
        return loess(y, window, np.arange(n), robust)
    half = q // 2
    dx = np.arange(q) - half
    kernel = np.clip(1 - np.abs(dx / max(half, q - 1 - half)) ** 3, 0, None) ** 3
    size = 1 << (n + q - 1).bit_length()
    mean = y.mean(axis=1, keepdims=True)
    weights = np.ones((1, n)) if robust is None else robust + 0.0
    f_w, f_y = np.fft.rfft(weights, size), np.fft.rfft(weights * (y - mean), size)
    kernels = [np.fft.rfft((kernel * dx**p)[::-1], size) for p in range(3)]
    inner = slice(q - 1, n)
    sums = lambda f, p: np.fft.irfft(f * kernels[p], size)[:, inner]
    total, t1, t2, v0, v1 = sums(f_w, 0), sums(f_w, 1), sums(f_w, 2), sums(f_y, 0), sums(f_y, 1)
    with np.errstate(all="ignore"):
        mx, my = t1 / total, v0 / total
        sxx, sxy = t2 / total - mx * mx, v1 / total - mx * my
        inside = my - np.where(sxx > 1e-12, sxy / np.where(sxx > 1e-12, sxx, 1), 0) * mx + mean
    out = np.empty((rows, n))
    out[:, half : half + n - q + 1] = inside
    ends = np.r_[0:half, half + n - q + 1 : n]
    out[:, ends] = loess(y, window, ends, robust)
    if robust is not None:
        weak = ~((total > 1e-3 * kernel.sum()) & (sxx > 1e-2 * (kernel * dx**2).sum() / kernel.sum()))
        for row in np.flatnonzero(weak.any(axis=1)):
            places = np.flatnonzero(weak[row]) + half
            out[row, places] = loess(y[row : row + 1], window, places, robust[row : row + 1])[0]
    return out


def stl(y: np.ndarray, period: int, seasonal: int, trend: int, robust: bool) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend part of each row, without gaps (Cleveland et al. 1990); all phases of all rows are smoothed together."""
    rows, n = y.shape
    inner, outer = (2, 15) if robust else (5, 0)
    low = period + 1 if period % 2 == 0 else period
    season, level, weights = np.zeros_like(y), np.zeros_like(y), None
    lengths = [(phase, len(range(phase, n, period))) for phase in range(period)]
    mean = lambda v, w: (lambda s: (s[:, w:] - s[:, :-w]) / w)(_runs(v))
    running, done = np.arange(rows), 0
    for done in range(outer + 1):
        part, lev = y[running], level[running]
        rw = None if weights is None else weights[running]
        for _ in range(inner):
            detrended = part - lev
            cycle = np.zeros((len(part), n + 2 * period))
            for m in {m for _, m in lengths}:
                phases = np.array([p for p, k in lengths if k == m])
                index = phases[:, None] + period * np.arange(m)
                sub = detrended[:, index].reshape(-1, m)
                sw = None if rw is None else rw[:, index].reshape(-1, m)
                smooth = loess(sub, seasonal, np.arange(-1, m + 1), sw).reshape(len(part), len(phases), m + 2)
                cycle[:, phases[:, None] + period * np.arange(m + 2)] = smooth
            smooth = loess_everywhere(mean(mean(mean(cycle, period), period), 3), low)
            sea = cycle[:, period : period + n] - smooth[:, :n]
            lev = loess_everywhere(part - sea, trend, rw)
        season[running], level[running] = sea, lev
        if done == outer:
            break
        rest = np.abs(part - sea - lev)
        h = 6 * np.median(rest, axis=1, keepdims=True)
        go = h[:, 0] > 0
        if weights is None:
            weights = np.ones_like(y)
        with np.errstate(all="ignore"):
            share = rest / h
        weights[running] = np.where(share <= 0.001, 1, np.where(share >= 0.999, 0, (1 - share**2) ** 2))
        running = running[go]
        if not len(running):
            break
    return season, level


def residual(y: np.ndarray, period: int, robust: bool, fill: str = "mean", most: int = 1 << 22) -> np.ndarray:
    """What STL leaves of each row. Gaps take the row's mean (or lie on lines between their neighbours, and the mean beyond
    the ends) and are gaps again afterwards; rows without values, or shorter than two periods, are NaN. Rows are done in parts of about `most` numbers."""
    out = np.full(y.shape, np.nan)
    n = y.shape[1]
    known = ~np.isnan(y)
    rows = np.flatnonzero(known.any(axis=1))
    if n < 2 * period or not len(rows):
        return out
    seasonal = int(max(7, min(round(period / 4), 61)))
    seasonal += 1 - seasonal % 2
    trend = max(2 * period - 1, 101)
    step = max(1, most // (n * seasonal))
    for i in range(0, len(rows), step):
        part = y[rows[i : i + step]]
        there = known[rows[i : i + step]]
        mean = np.nanmean(part, axis=1, keepdims=True)
        filled = np.where(there, part, mean)
        if fill == "linear":
            x = np.arange(n)
            for k in range(len(part)):
                filled[k] = np.interp(x, x[there[k]], part[k][there[k]], left=mean[k, 0], right=mean[k, 0])
        season, level = stl(filled, period, seasonal, trend, robust)
        out[rows[i : i + step]] = np.where(there, filled - season - level, np.nan)
    return out
