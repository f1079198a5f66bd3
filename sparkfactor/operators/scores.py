"""The metrics on NumPy vectors, for the search's inner loop."""

from __future__ import annotations

from collections.abc import Generator

import numpy as np

from ..functions.kernels import CROSS, tied_rank
from ..plans.compiler import evaluate
from ..plans.ir import Node


def corr(f: np.ndarray, y: np.ndarray) -> float:
    """Pearson correlation; 0 where a side hardly varies or holds what isn't finite."""
    if len(f) != len(y):
        raise ValueError("lengths differ")
    if len(f) < 2 or not np.isfinite(f).all():
        return 0.0
    sf, sy = f.std(ddof=1), y.std(ddof=1)
    if not (np.isfinite(sf) and np.isfinite(sy)) or sf < 1e-8 or sy < 1e-8:
        return 0.0
    return float(((f - f.mean()) * (y - y.mean())).sum() / (len(f) - 1) / (sf * sy))


def rank_corr(f: np.ndarray, y_rank: np.ndarray) -> float:
    return corr(tied_rank(f), y_rank) if len(f) else 0.0


def pps(f: np.ndarray, y: np.ndarray, y_rank: np.ndarray, beta: float = 0.3) -> float:
    return beta * corr(f, y) + (1 - beta) * rank_corr(f, y_rank)


def rre(f: np.ndarray, n_bins: int = 10) -> float:
    n = len(f)
    if n < n_bins:
        return 0.0
    counts = np.bincount(np.minimum(np.ceil(tied_rank(f) / n * n_bins), n_bins).astype(int))
    p = counts[counts > 0] / n
    return float(1 + (p * np.log(p)).sum() / np.log(n_bins))


def periods(n: int, n_periods: int, remainder: bool = False) -> list[slice]:
    """Equal blocks; with ``remainder`` the last one takes what is left."""
    size = n // n_periods if n_periods else 0
    if size < 1:
        return []
    return [slice(k * size, n if remainder and k == n_periods - 1 else (k + 1) * size) for k in range(n_periods)]


def rolling_rank_ic(f: np.ndarray, y: np.ndarray, n_periods: int) -> np.ndarray:
    if n_periods < 2 or len(f) // n_periods < 2:
        return np.empty(0)
    return np.array([rank_corr(f[s], tied_rank(y[s])) for s in periods(len(f), n_periods)])


def icir(f: np.ndarray, y: np.ndarray, n_periods: int) -> float:
    r = rolling_rank_ic(f, y, n_periods)
    return float(r.mean() / r.std(ddof=1)) if len(r) > 1 and r.std(ddof=1) >= 1e-8 else 0.0


def combined(trees: tuple[Node, ...], weights: tuple[float, ...], how: str, x: np.ndarray) -> np.ndarray:
    """The combined signal of several trees; zeros without trees."""
    signals = [evaluate(t, x) for t in trees]
    with np.errstate(all="ignore"):
        if not signals:
            return np.zeros(len(x))
        if how == "weighted_sum":
            return np.sum([w * s for w, s in zip(weights, signals, strict=True)], axis=0)
        if how == "vote":
            return np.sign(np.sum([np.sign(s) for s in signals], axis=0))
        return np.mean([CROSS["cs_rank"](s) for s in signals], axis=0)


def pfs(signal, x: np.ndarray, n: int, noise: float, seed: int) -> float:
    """Mean rank correlation of ``signal(x)`` with ``signal`` of noisy copies of x."""
    base = signal(x)
    if not np.isfinite(base).all() or base.std(ddof=1) < 1e-8:
        return 0.0
    rng, spread, ranks = np.random.default_rng(seed), np.maximum(x.std(axis=0, ddof=1), 1e-8), tied_rank(base)
    return float(np.mean([rank_corr(signal(x + rng.standard_normal(x.shape) * noise * spread), ranks) for _ in range(n)]))


def novelty_weight(weight: float, generation: int, n_generations: int) -> float:
    """Constant up to three quarters of the run, then linear to 0."""
    start = int(0.75 * n_generations)
    if generation <= start:
        return weight
    return weight * max(0.0, 1 - (generation - start) / max(1, n_generations - start))


def simplex(start: np.ndarray, most: int = 200, x_tol: float = 1e-5, f_tol: float = 1e-6) -> Generator[list[np.ndarray], list[float], tuple[np.ndarray, float]]:
    """The simplex method of Nelder and Mead (1965): yields points, is sent their values, and returns the best point and its value."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + (0.05 * (abs(start[k]) or 0.05) + 0.1) * np.eye(n)[k] for k in range(n)]
    values = yield points
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) < x_tol and abs(values[-1] - values[0]) <= f_tol * (abs(values[0]) + f_tol):
            break
        centre = np.mean(points[:-1], axis=0)
        step = centre - points[-1]
        (reflected,) = yield [centre + step]
        if reflected < values[0]:
            (further,) = yield [centre + 2 * step]
            points[-1], values[-1] = (centre + 2 * step, further) if further < reflected else (centre + step, reflected)
        elif reflected < values[-2]:
            points[-1], values[-1] = centre + step, reflected
        else:
            inner = centre + 0.5 * step if reflected < values[-1] else centre - 0.5 * step
            (held,) = yield [inner]
            if held < min(reflected, values[-1]):
                points[-1], values[-1] = inner, held
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0], *(yield points[1:])]
    k = int(np.argmin(values))
    return points[k], values[k]


def nelder_mead(f, start: np.ndarray, most: int = 200, x_tol: float = 1e-5, f_tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """The least value of ``f`` that ``simplex`` finds from ``start``."""
    steps = simplex(start, most, x_tol, f_tol)
    points = next(steps)
    while True:
        try:
            points = steps.send([f(p) for p in points])
        except StopIteration as done:
            return done.value


def tuned(tree: Node, x: np.ndarray, y: np.ndarray, y_rank: np.ndarray, most: int = 200) -> Node:
    """The tree with the constants that Nelder-Mead finds best by pps; itself if there are none or none are better."""
    start = tree.constants()
    if not start:
        return tree
    loss = lambda c: -pps(evaluate(tree, x, list(c)), y, y_rank)
    best, value = nelder_mead(loss, np.array(start), most)
    return tree.with_constants(best.tolist()) if np.isfinite(best).all() and value < loss(start) else tree
