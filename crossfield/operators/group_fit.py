"""Numpy helpers for one bounded group of points inside a task."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa

from crossfield.plans.windows import block_mads

DEGREE = 3
# Rows up to which a window slides as a sorted list.
LIST_ROWS = 2_000
MAD_TO_SIGMA = 1.4826
SCORE_NAMES = ["gp_mean", "gp_std", "z_score", "point_outlier", "experiment_outlier"]


def robust_cubic(x, y, weights=None, clip=3.0, rounds=5, tolerance=1e-4):
    """Weighted least-squares cubic, refitted with distant points weighted down.

    Returns a function of x. With under four distinct x it is the mean of the averages
    per x. Weights enter the criterion squared.
    """
    ux, where, count = np.unique(x, return_inverse=True, return_counts=True)
    uy = np.bincount(where, y) / count
    if len(ux) < DEGREE + 1 or ux[-1] - ux[0] < 1e-12:
        mean = uy.mean()
        return lambda q: np.full(len(q), mean)
    user = np.ones(len(ux)) if weights is None else np.bincount(where, weights) / count

    def scaled(q):
        return (2.0 * q - ux[0] - ux[-1]) / (ux[-1] - ux[0])

    basis = np.polynomial.legendre.legvander(scaled(ux), DEGREE)

    def fit(w):
        w = w / w.mean()
        return np.linalg.lstsq(basis * w[:, None], uy * w, rcond=None)[0]

    coefficients = fit(user)
    for _ in range(rounds):
        before = basis @ coefficients
        residual = uy - before
        mad = np.median(np.abs(residual - np.median(residual)))
        if mad < 1e-12:
            break
        distance = np.abs(residual) / (mad * MAD_TO_SIGMA)
        coefficients = fit(user * np.where(distance <= clip, 1.0, clip / np.maximum(distance, clip)))
        if np.max(np.abs(basis @ coefficients - before)) < tolerance:
            break
    return lambda q: np.polynomial.legendre.legval(scaled(q), coefficients)


def sorted_median(values):
    n = len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2.0


def sorted_mad(values):
    """Median absolute deviation of a sorted list, by searching its nearest ranks.

    The k values nearest the median are neighbours in the list, so the k-th smallest
    deviation needs a binary search rather than a second sort.
    """
    centre, n = sorted_median(values), len(values)

    def kth(k):
        low, high = 0, n - k
        while low < high:
            mid = (low + high) // 2
            if centre - values[mid] > values[mid + k] - centre:
                low = mid + 1
            else:
                high = mid
        return max(centre - values[low], values[low + k - 1] - centre)

    return kth(n // 2 + 1) if n % 2 else (kth(n // 2) + kth(n // 2 + 1)) / 2.0


def rolling_mad(x, r, fraction=0.1, min_points=15, half=None, rows=None):
    """Scaled MAD of r in [x - h, x + h] per point of x in ascending order.

    A window with too few points takes the nearest ones instead (ties by x, then r). In a small
    group the window slides as a sorted list, so a step costs a few binary searches; in a larger
    one, where its inserts would move half the window, windows are solved in blocks. ``rows``
    limits the output to a stretch of the points, ``half`` fixes the window's half width.
    """
    n = len(x)
    half = max((x[-1] - x[0]) * fraction, 0.1) if half is None else half
    begin, stop = rows or (0, n)
    if stop - begin > LIST_ROWS:
        return _rolling_mad_in_blocks(x, r, half, min_points, begin, stop)
    starts = np.searchsorted(x, x[begin:stop] - half, side="left").tolist()
    ends = np.searchsorted(x, x[begin:stop] + half, side="right").tolist()
    xs, rs = x.tolist(), r.tolist()
    everything = sorted_mad(sorted(rs)) if n <= min_points else None
    lo, hi = starts[0], ends[0]
    window, out = sorted(rs[lo:hi]), np.empty(stop - begin)
    for k, (start, end) in enumerate(zip(starts, ends)):
        i = begin + k
        for value in rs[hi:end]:
            insort(window, value)
        for value in rs[lo:start]:
            del window[bisect_left(window, value)]
        lo, hi = start, end
        if end - start >= min_points:
            out[k] = sorted_mad(window)
        elif everything is not None:
            out[k] = everything
        else:
            first, last = nearest_span(xs, i, min_points)
            near = sorted((abs(xs[j] - xs[i]), xs[j], rs[j]) for j in range(first, last))[:min_points]
            out[k] = sorted_mad(sorted(v for _, _, v in near))
    return out * MAD_TO_SIGMA


def _rolling_mad_in_blocks(x, r, half, min_points, begin, stop):
    """``rolling_mad`` of a large group: points of equal x have one window, solved once."""
    first = begin + np.flatnonzero(np.concatenate([[True], x[begin + 1:stop] != x[begin:stop - 1]]))
    starts = np.searchsorted(x, x[first] - half, side="left")
    ends = np.searchsorted(x, x[first] + half, side="right")
    few = ends - starts < min_points
    out = np.empty(len(first))
    if not few.all():
        out[~few] = block_mads(r, starts[~few], ends[~few])
    for k in np.flatnonzero(few):
        i = first[k]
        # A window of this width around the point holds the nearest ones, whole ties included.
        a, b = np.searchsorted(x, x[max(0, i - min_points + 1)]), np.searchsorted(x, x[min(len(x), i + min_points) - 1], side="right")
        near = np.lexsort((r[a:b], x[a:b], np.abs(x[a:b] - x[i])))[:min_points]
        out[k] = sorted_mad(np.sort(r[a:b][near]))
    return np.repeat(out, np.diff(np.append(first, stop))) * MAD_TO_SIGMA


def nearest_span(xs, i, k):
    """Index range that certainly holds the k nearest of xs[i], whole ties included."""
    first, last = max(0, i - k + 1), min(len(xs), i + k)
    return bisect_left(xs, xs[first]), bisect_right(xs, xs[last - 1])


def median_filter(values, size):
    """Running median of an odd size with the end values repeated beyond the ends."""
    half = size // 2
    return running_median(np.concatenate([np.full(half, values[0]), values, np.full(half, values[-1])]), size)


def running_median(values, size):
    """Medians of all stretches of an odd size."""
    if len(values) > LIST_ROWS:
        return pd.Series(values).rolling(size).median().to_numpy()[size - 1:]
    values, half = values.tolist(), size // 2
    window, out = sorted(values[:size]), np.empty(len(values) - size + 1)
    for i in range(len(out)):
        out[i] = window[half]
        if i + size < len(values):
            del window[bisect_left(window, values[i])]
            insort(window, values[i + size])
    return out


def local_sigma(x, residual, fraction=0.1, min_points=15, floor=0.02):
    """Floored and smoothed rolling MAD at every point, one value per distinct x."""
    order = np.lexsort((residual, x))
    mad = np.maximum(rolling_mad(x[order], residual[order], fraction, min_points), floor)
    size = max(5, len(x) // 20)
    smooth = np.maximum(median_filter(mad, size + (size % 2 == 0)), floor)
    _, where, count = np.unique(x[order], return_inverse=True, return_counts=True)
    out = np.empty(len(x))
    out[order] = (np.bincount(where, smooth) / count)[where]
    return np.maximum(out, floor)


def fit_weights(value, unc):
    """Inverse-variance weights in log space, or None with under 10 % uncertainties."""
    known = np.isfinite(unc) & (unc > 0) & (value > 0)
    if known.mean() < 0.10:
        return None
    relative = np.divide(unc, value, out=np.ones(len(unc)), where=known)
    weights = np.where(known, 1.0 / np.clip(0.434 * relative, 0.005, 0.5) ** 2, 1.0)
    middle = np.median(weights)
    return np.clip(weights, middle / 100, middle * 100)


def median_scale(y):
    """Centre and scale of a small group."""
    centre = np.median(y)
    scale = np.median(np.abs(y - centre)) * MAD_TO_SIGMA
    return centre, (1e-6 if scale < 1e-10 else scale)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    if name not in table.column_names:
        return np.full(table.num_rows, np.nan)
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def score_group(table: pa.Table, c: dict) -> pa.Table:
    x, y = _numbers(table, "log_E"), _numbers(table, "log_sigma")
    usable = np.isfinite(x) & np.isfinite(y)
    n = table.num_rows
    centre, sigma = np.full(n, np.nan), np.full(n, np.nan)
    discrepant = np.zeros(n, dtype=bool)
    small = n < c["min_group"] or usable.sum() < c["min_group"]
    if small and usable.any():
        centre[:], sigma[:] = median_scale(y[usable])
    elif not small:
        weights = None
        if c["use_uncertainties"]:
            weights = fit_weights(_numbers(table, "CrossSection"), _numbers(table, "Uncertainty"))
        trend = robust_cubic(x[usable], y[usable], None if weights is None else weights[usable])
        centre[usable] = trend(x[usable])
        sigma[usable] = local_sigma(
            x[usable], (y - centre)[usable], c["window_fraction"], c["window_points"], c["sigma_floor"])
    z = np.abs(y - centre) / sigma
    if not small:
        codes = table.column("experiment_id").combine_chunks().dictionary_encode()
        ids, kinds = codes.indices.to_numpy(zero_copy_only=False), len(codes.dictionary)
        share = np.bincount(ids, z > c["experiment_z"], kinds) / np.bincount(ids, minlength=kinds)
        discrepant = (share > c["experiment_share"])[ids] & (kinds > 1)
    columns = [
        pa.array(centre, from_pandas=True), pa.array(sigma, from_pandas=True), pa.array(z, from_pandas=True),
        pa.array(z > c["point_z"]), pa.array(discrepant),
    ]
    for name, column in zip(SCORE_NAMES, columns):
        table = table.append_column(name, column)
    return table
