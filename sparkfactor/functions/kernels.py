"""The operators on NumPy vectors: the search's inner loop, and what the Columns are tested against."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

EPS = 1e-6


def _pow(x, y):
    with np.errstate(all="ignore"):
        return np.power(np.abs(x), np.clip(y, -5.0, 5.0))


UNARY = {
    "safe_sqrt": lambda x: np.sqrt(np.abs(x) + EPS),
    "safe_log": lambda x: np.log(np.abs(x) + EPS),
    "safe_inv": lambda x: 1.0 / (np.abs(x) + EPS),
    "safe_neg": lambda x: -x,
    "safe_sin": lambda x: np.sin(np.clip(x, -1e4, 1e4)),
    "safe_cos": lambda x: np.cos(np.clip(x, -1e4, 1e4)),
    "safe_tan": lambda x: np.tan(np.clip(x, -1.5, 1.5)),
    "safe_tanh": np.tanh,
    "abs": np.abs,
}


def _signed(x, y):
    with np.errstate(all="ignore"):
        return np.sign(x) * _pow(x, y)


BINARY = {
    "safe_add": lambda x, y: x + y,
    "safe_sub": lambda x, y: x - y,
    "safe_mul": lambda x, y: x * y,
    "safe_div": lambda x, y: x / (np.abs(y) + EPS),
    "safe_pow": _pow,
    "signed_power": _signed,
}


#: Values of windows that are laid out at once.
LAID_OUT = 1 << 22


def _in_runs(f):
    """``f`` over runs of windows, so that what it lays out stays bounded whatever the window."""

    def op(w):
        step = max(1, LAID_OUT // w.shape[1])
        return np.concatenate([f(w[k : k + step]) for k in range(0, len(w), step)])

    return op


def _weighted(v, d):
    """The linearly weighted mean by one convolution."""
    out = np.zeros(len(v))
    if d <= len(v):
        with np.errstate(all="ignore"):
            out[d - 1 :] = np.convolve(np.asarray(v, float), np.arange(d, 0, -1.0), "valid") / (d * (d + 1) / 2)
    return out


def _extreme(f):
    """Running maxima or minima of windows in a few passes over the rows: each window is the end of one block of ``d`` rows and the beginning of the next."""

    def op(v, d):
        out = np.zeros(len(v))
        if d <= len(v):
            x = np.asarray(v, float)
            x = np.concatenate([x, np.repeat(x[-1:], -len(x) % d)]).reshape(-1, d)
            ahead, behind = f.accumulate(x, axis=1).ravel(), f.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
            out[d - 1 :] = f(behind[: len(v) - d + 1], ahead[d - 1 : len(v)])
        return out

    return op


def _rolled(f):
    """``f`` of the windows' matrix, behind zeros for the rows without a full window."""

    def op(*args):
        *vs, d = args
        out = np.zeros(len(vs[0]))
        if d <= len(out):
            out[d - 1 :] = f(*(sliding_window_view(np.asarray(v, float), d) for v in vs))
        return out

    return op


def _delta(v, d):
    out = np.zeros(len(v))
    if d < len(v):
        out[d:] = v[d:] - v[:-d]
    return out


def _std(w):
    var = w.var(1, ddof=1) if w.shape[1] > 1 else np.zeros(len(w))
    return np.where(var < 1e-12, 0.0, np.sqrt(np.maximum(var, 0.0)))


def _corr(a, b):
    if a.shape[1] < 2:
        return np.zeros(len(a))
    da, db = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    norm = np.sqrt((da**2).sum(1) * (db**2).sum(1))
    return np.where(norm < 1e-8, 0.0, (da * db).sum(1) / np.where(norm < 1e-8, 1.0, norm))


def _cov(a, b):
    d = a.shape[1]
    return np.zeros(len(a)) if d < 2 else ((a - a.mean(1, keepdims=True)) * (b - b.mean(1, keepdims=True))).sum(1) / (d - 1)


TS_UNARY = {
    "ts_delta": _delta,
    "ts_mean": _rolled(lambda w: w.mean(1)),
    "ts_stddev": _rolled(_std),
    "ts_rank": _rolled(_in_runs(lambda w: (w <= w[:, -1:]).mean(1))),
    "ts_max": _extreme(np.maximum),
    "ts_min": _extreme(np.minimum),
    "ts_sum": _rolled(lambda w: w.sum(1)),
    "decay": _weighted,
}
TS_BINARY = {"ts_corr": _rolled(_corr), "ts_cov": _rolled(_cov)}


def _rank(v):
    out = np.empty(len(v))
    out[np.argsort(v, kind="stable")] = np.arange(1, len(v) + 1) / max(len(v), 1)
    return out


def _spread(v):
    return float(np.sqrt(((v - v.mean()) ** 2).sum() / max(len(v) - 1, 1))) if len(v) else 0.0


CROSS = {
    "cs_rank": _rank,
    "cs_zscore": lambda v: np.zeros(len(v)) if _spread(v) < 1e-8 else (v - v.mean()) / _spread(v),
    "cs_scale": lambda v: v if np.abs(v).sum() < 1e-8 else v / np.abs(v).sum(),
    "cs_winsorize": lambda v: v if _spread(v) < 1e-8 else np.clip(v, v.mean() - 3 * _spread(v), v.mean() + 3 * _spread(v)),
}


def tied_rank(v: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    order = np.argsort(v, kind="stable")
    _, first, inverse, count = np.unique(np.asarray(v)[order], return_index=True, return_inverse=True, return_counts=True)
    out = np.empty(len(v))
    out[order] = (first + (count + 1) / 2.0)[inverse]
    return out
