"""Scores of a whole population on a panel of any size: individuals times blocks of rows.

The panel is cut into blocks of consecutive rows, each with a copy of the rows before it that the trees' windows reach back to (``blocks``). A task
evaluates trees on its blocks with the NumPy kernels; neither the panel nor a signal passes through the driver or a broadcast.

What a block can't know of the others comes in rounds, from the innermost cross-sectional operators outwards: blocks give moments, which are merged into
the few numbers that z-scores, scalings and winsorising need; or values, whose global ranks join the block's rows as further columns. A rank
average of trees is one more round.

The last pass gives each block's moments with the target, and to the task of a range of values how often each occurs with the sum of the target's ranks
there. That gives exact tied ranks, and so the rank correlation and the entropy, and nothing of a signal is written.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FitnessWeights
from ..functions.kernels import CROSS, tied_rank
from ..plans.compiler import evaluate
from ..plans.ir import Node, variable
from ..sources.shared import discard, written
from .blocks import Blocks, Rows, _loaded, over_blocks, panel_blocks, rank_products, rank_sums, rows_within, value_ranges, with_ranks
from .genetic import Individual
from .metrics import LEAST_SD, normal_draw
from .population import fitness
from .scores import simplex, tuned

BLOCK_ROWS = 100_000
BETA, BINS = 0.3, 10


@dataclass(frozen=True)
class Cross:
    """A cross-sectional operator over a tree; ``root``: of a rank average, not of a tree."""

    op: str
    child: Node
    root: bool = False


def cross_level(node: Node) -> int:
    """How many cross-sectional operators are nested below and at the node."""
    return max(map(cross_level, node.children), default=0) + (node.op in CROSS)


def cross_rounds(individuals: list[Individual]) -> list[list[Cross]]:
    """The cross-sectional operators of all trees, those that need no other one first."""
    rounds: dict[int, dict[Cross, None]] = {}
    for ind in individuals:
        for tree in ind.trees:
            for _, node, _ in tree.walk():
                if node.op in CROSS:
                    rounds.setdefault(cross_level(node), {})[Cross(node.op, node.children[0])] = None
            if ind.combination == "rank_average":
                rounds.setdefault(cross_level(tree) + 1, {})[Cross("cs_rank", tree, True)] = None
    return [list(rounds[k]) for k in sorted(rounds)]


def from_moments(op: str, v: np.ndarray, mean: float, sd: float, total: float) -> np.ndarray:
    """A cross-sectional operator by the moments of the whole cross-section."""
    if op == "cs_scale":
        return v if total < LEAST_SD else v / total
    if op == "cs_zscore":
        return np.zeros(len(v)) if sd < LEAST_SD else (v - mean) / sd
    return v if sd < LEAST_SD else np.clip(v, mean - 3 * sd, mean + 3 * sd)


class Known:
    """What has been found out about cross-sectional operators: places of rank columns, and moments."""

    def __init__(self):
        self.place: dict[Cross, int] = {}
        self.moments: dict[Cross, tuple[float, float, float]] = {}

    def signal(self, tree: Node, x: np.ndarray) -> np.ndarray:
        def cross(node: Node, child: Callable[[], np.ndarray]) -> np.ndarray:
            key = Cross(node.op, node.children[0])
            return x[:, self.place[key]] if key in self.place else from_moments(node.op, child(), *self.moments[key])

        return evaluate(tree, x, cross=cross)

    def combined(self, ind: Individual, x: np.ndarray, digits: int | None) -> np.ndarray:
        cut = (lambda v: v) if digits is None else (lambda v: np.round(v, digits))
        if not ind.trees:
            return np.zeros(len(x))
        with np.errstate(all="ignore"):
            if ind.combination == "rank_average":
                return cut(np.mean([x[:, self.place[Cross("cs_rank", t, True)]] for t in ind.trees], axis=0))
            signals = [cut(self.signal(t, x)) for t in ind.trees]
            if ind.combination == "vote":
                return np.sign(np.sum([np.sign(s) for s in signals], axis=0))
            return cut(np.sum([w * s for w, s in zip(ind.weights, signals, strict=True)], axis=0))


def reach_of(individuals: list[Individual]) -> int:
    return max((t.reach for ind in individuals for t in ind.trees), default=0)


def target_ranked(blocks: Blocks) -> Blocks:
    """With the target's tied ranks as the first rank column."""
    return with_ranks(blocks, [(lambda x, y: y, True)]) if blocks.n and not blocks.tied else blocks


def _measured(blocks: Blocks, crosses: list[Cross], known: Known) -> None:
    """Mean, standard deviation and sum of magnitudes of each operator's argument, merged from those of blocks."""

    def moments(jobs: range, rows: Rows) -> pa.Table:
        found = [known.signal(crosses[j].child, rows.x)[rows.halo :] for j in jobs]
        mean = [float(v.mean()) for v in found]
        squares = [float(((v - m) ** 2).sum()) for v, m in zip(found, mean, strict=True)]
        total = [float(np.abs(v).sum()) for v in found]
        return pa.table({"k": pa.array(jobs, pa.int32()), "m": pa.array([len(v) for v in found], pa.int64()), "mean": pa.array(mean, pa.float64()), "squares": pa.array(squares, pa.float64()), "total": pa.array(total, pa.float64())})

    parts = written(over_blocks(blocks, len(crosses), moments, "k int, m long, mean double, squares double, total double"), "moments")
    n = blocks.n
    means = parts.groupBy("k").agg((F.sum(F.col("m") * F.col("mean")) / n).alias("all"))
    both = parts.join(F.broadcast(means), "k")
    out = both.groupBy("k").agg(F.first("all").alias("mean"), F.sum(F.col("squares") + F.col("m") * (F.col("mean") - F.col("all")) ** 2).alias("squares"), F.sum("total").alias("total"))
    # one row for each operator of the population
    for r in out.collect():
        known.moments[crosses[r.k]] = (r["mean"], math.sqrt(r.squares / max(n - 1, 1)) if r.squares >= 0 else math.nan, r.total)
    discard(parts)


def _prepared(blocks: Blocks, individuals: list[Individual], digits: int | None = None) -> tuple[Blocks, Known]:
    """Blocks with the ranks that the individuals' cross-sectional operators need, and what is known."""
    known = Known()

    def argument(c: Cross):
        if digits is not None and c.root:
            return lambda x, y: np.round(known.signal(c.child, x), digits)
        return lambda x, y: known.signal(c.child, x)

    for crosses in cross_rounds(individuals) if blocks.n else []:
        ranks, others = [c for c in crosses if c.op == "cs_rank"], [c for c in crosses if c.op != "cs_rank"]
        if others:
            _measured(blocks, others, known)
        if ranks:
            place = blocks.width + len(blocks.tied)
            blocks = with_ranks(blocks, [(argument(c), False) for c in ranks])
            known.place |= {c: place + j for j, c in enumerate(ranks)}
    return blocks, known


def _merged(numbers: list[tuple], jobs: int) -> list[dict[str, float]]:
    """Moments of a signal f and a target t over all blocks: n, their means, ff, tt, ft, and the sums behind them."""
    out = []
    for k in range(jobs):
        own = np.array(sorted(v for j, v in numbers if j == k), float).reshape(-1, 8)
        m, f, t, n = own[:, 1], own[:, 2], own[:, 4], own[:, 1].sum()
        with np.errstate(all="ignore"):
            df, dt = f - (m * f).sum() / n, t - (m * t).sum() / n
            out.append({"ff": (own[:, 3] + m * df * df).sum(), "tt": (own[:, 5] + m * dt * dt).sum(), "ft": (own[:, 6] + m * df * dt).sum(), "qq": own[:, 7].sum()})
    return out


def _correlation(ab: float, aa: float, bb: float, n: int) -> float:
    with np.errstate(all="ignore"):
        sa, sb = np.sqrt(np.float64(aa) / (n - 1)), np.sqrt(np.float64(bb) / (n - 1))
        if not (np.isfinite(sa) and np.isfinite(sb)) or sa < LEAST_SD or sb < LEAST_SD:
            return 0.0
        value = float(ab / (n - 1) / (sa * sb))
    return 0.0 if math.isnan(value) else value


def _block_moments(target: int, n: int):
    """For ``value_ranges``: each job's moments on a block with the block's target, and the spread of the target's ranks."""

    def more(jobs: range, rows: Rows, own: dict[int, np.ndarray]) -> list[tuple]:
        t = rows.y[rows.halo :]
        dt = t - t.mean()
        q = rows.ranks[target][rows.halo :] / 2 - (n + 1) / 2
        out = []
        for k in jobs:
            df = own[k] - own[k].mean()
            out.append((k, [float(rows.row), float(len(t)), float(own[k].mean()), float((df * df).sum()), float(t.mean()), float((dt * dt).sum()), float((df * dt).sum()), float((q * q).sum())]))
        return out

    return more


def block_scores(blocks: Blocks, individuals: list[Individual], digits: int | None = None) -> list[tuple]:
    """(i, pps, ic, rank_ic, rre, complexity) of each individual on blocks; those made on the way are deleted, and ``blocks`` too unless shared."""
    n = blocks.n
    if n < 2:
        return [(i, 0.0, 0.0, 0.0, 0.0, ind.complexity) for i, ind in enumerate(individuals)]
    blocks, known = _prepared(target_ranked(blocks), individuals, digits)
    signals = [lambda x, y, ind=ind: known.combined(ind, x, digits) for ind in individuals]
    ranges, numbers = value_ranges(blocks, signals, _block_moments(0, n))
    moments, ranked = _merged(numbers, len(individuals)), rank_sums(blocks, signals, [0] * len(signals), ranges, BINS)
    blocks.drop()
    out = []
    for i, (ind, m) in enumerate(zip(individuals, moments, strict=True)):
        rr, rq, rows = ranked[i]
        p = np.array([c for c in rows if c]) / n
        rre = float(1 + (p * np.log(p)).sum() / math.log(BINS)) if n >= BINS else 0.0
        ic, rank_ic = _correlation(m["ft"], m["ff"], m["tt"], n), _correlation(rq, rr, m["qq"], n)
        out.append((i, BETA * ic + (1 - BETA) * rank_ic, ic, rank_ic, rre, ind.complexity))
    return out


def population_scores(panel: DataFrame, individuals: list[Individual], features: list[str], y: str = "y", order: str = "row_id", weights: FitnessWeights | None = None, parsimony: float = 0.001, block_rows: int = BLOCK_ROWS, digits: int | None = None) -> DataFrame:
    """(i, pps, ic, rank_ic, rre, complexity, fitness) of each individual, ``i`` its place in the list; fitness without novelty and PFS.

    ``order`` must tell rows apart. A target with nulls isn't allowed; NaN and infinite values of signals count as in the kernels: 0 for the
    correlation, the largest rank for NaN. A signal that hardly varies scores 0, and so does an empty panel. ``digits``: signals are rounded
    to so many, for comparisons with other engines.
    """
    spark = panel.sparkSession
    kinds = "i int, pps double, ic double, rank_ic double, rre double, complexity int"
    found = block_scores(panel_blocks(panel, features, y, order, reach_of(individuals), block_rows), individuals, digits) if individuals else []
    return _with_fitness(spark.createDataFrame(found, kinds), weights, parsimony)


def signal_scores(wide: DataFrame, names: list[str], y: str, order: str) -> DataFrame:
    """(name, ic, rank_ic, pps, rre) of signals that are columns of ``wide``; ``order`` is a whole number from 0 up."""
    blocks = panel_blocks(wide, names, y, order, 0, BLOCK_ROWS, 0)
    found = block_scores(blocks, [Individual((variable(k),), (1.0,), "weighted_sum") for k in range(1, len(names) + 1)])
    rows = [(names[i], ic, rank_ic, pps, rre) for i, pps, ic, rank_ic, rre, _ in found]
    return wide.sparkSession.createDataFrame(rows, "name string, ic double, rank_ic double, pps double, rre double")


def population_traits(panel: DataFrame, individuals: list[Individual], features: list[str], places: list[int], n_periods: int, y: str = "y", order: str = "row_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, behavior, errors) of each individual: its signal at the row numbers ``places`` (from 0, in their order), and the mean absolute error by period.

    Periods are equal runs of rows, the last one takes the rest; with fewer rows than periods each row is one. A place may come more than
    once; one that the panel doesn't have is left out. An empty panel gives empty arrays. Blocks emit a sum and a count for each period and the values
    asked for, so what is shuffled grows with individuals times (blocks + places), not with rows.
    """
    if not individuals:
        return panel.sparkSession.createDataFrame([], "i int, behavior array<float>, errors array<double>")
    return block_traits(panel_blocks(panel, features, y, order, reach_of(individuals), block_rows), individuals, places, n_periods)


def block_traits(blocks: Blocks, individuals: list[Individual], places: list[int], n_periods: int) -> DataFrame:
    """``population_traits`` on blocks; those made on the way are deleted, and ``blocks`` too unless shared."""
    spark, n = blocks.df.sparkSession, blocks.n
    blocks, known = _prepared(blocks, individuals)
    wanted = np.array(places, np.int64)
    by_row = np.argsort(wanted, kind="stable")
    periods_ = max(1, min(n_periods, n))
    size = max(1, n // periods_)

    def traits(jobs: range, held_: Rows) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("i", "place", "period", "v", "m")}
        target = held_.y[held_.halo :]
        rows = np.arange(held_.row, held_.row + len(target))
        period = np.minimum(rows // size, periods_ - 1)
        held, at = np.unique(period, return_inverse=True)
        low, high = np.searchsorted(wanted[by_row], (rows[0], rows[-1] + 1)) if len(rows) else (0, 0)
        here = by_row[low:high]
        for j in jobs:
            f = known.combined(individuals[j], held_.x, None)[held_.halo :]
            off = np.bincount(at, np.abs(f - target), len(held))
            out["i"] += [j] * (len(held) + len(here))
            out["place"] += [None] * len(held) + here.tolist()
            out["period"] += held.tolist() + [None] * len(here)
            out["v"] += off.tolist() + f[wanted[here] - rows[0]].tolist()
            out["m"] += np.bincount(at, minlength=len(held)).tolist() + [None] * len(here)
        return pa.table({c: pa.array(o, t) for (c, o), t in zip(out.items(), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)})

    found = written(over_blocks(blocks, len(individuals), traits, "i int, place int, period int, v double, m long"), "traits")
    means = found.where("period is not null").groupBy("i", "period").agg((F.sum("v") / F.sum("m")).alias("v"))
    in_order = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "v"))), lambda s: s["v"])
    errors = means.groupBy("i").agg(in_order("period").alias("errors"))
    prints = found.where("place is not null").groupBy("i").agg(in_order("place").cast("array<float>").alias("behavior"))
    everyone = spark.range(len(individuals)).select(F.col("id").cast("int").alias("i"))
    out = everyone.join(prints, "i", "left").join(errors, "i", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = written(out.select("i", F.coalesce("behavior", none("float")).alias("behavior"), F.coalesce("errors", none("double")).alias("errors")), "population-traits")
    discard(found)
    blocks.drop()
    return out


def population_steadiness(panel: DataFrame, individuals: list[Individual], features: list[str], order: str = "row_id", n_copies: int = 5, noise: float = 0.01, seed: int = 42, block_rows: int = BLOCK_ROWS, first: int | None = None) -> DataFrame:
    """(i, pfs) of each individual: the mean rank correlation of its signal with itself on noisy copies of the features.

    Noise hangs on seed, copy, feature and row alone and follows each feature's spread. A signal that hardly varies or holds what isn't
    finite scores 0, and so does a panel of fewer than two rows. ``first``: ``order`` is dense and starts there.
    """
    spark = panel.sparkSession
    if not individuals:
        return spark.createDataFrame([], "i int, pfs double")
    everyone = spark.range(len(individuals)).select(F.col("id").cast("int").alias("i"))
    used = sorted({k for ind in individuals for t in ind.trees for k in t.features()})
    spread = panel.agg(*(F.greatest(F.coalesce(F.stddev_samp(features[k - 1]), F.lit(0.0)), F.lit(LEAST_SD)).alias(f"s{k}") for k in used)).first() if used else {}
    names, columns, moved = list(features), [F.col(f) for f in features], []
    for copy in range(n_copies):
        places = {}
        for k in used:
            normal = normal_draw(F.concat_ws("-", F.lit(seed), F.lit(copy), F.lit(k), F.col(order)))
            columns.append((F.col(features[k - 1]) + normal * noise * spread[f"s{k}"]).alias(f"_x{k}_{copy}"))
            names.append(f"_x{k}_{copy}")
            places[k] = len(names)
        moved.append(places)

    def put(t: Node, places: dict[int, int]) -> Node:
        return Node(t.op, tuple(put(c, places) for c in t.children), t.window, places.get(t.feature), t.value)

    copies = [replace(ind, trees=tuple(put(t, places) for t in ind.trees)) for places in moved for ind in individuals]
    noisy = panel.select(order, *columns, F.lit(0.0).alias("_zero"))
    # a row of all copies is wide, so a block has fewer
    ranked = sum(c.op == "cs_rank" for crosses in cross_rounds([*individuals, *copies]) for c in crosses) + len(individuals)
    size = rows_within(len(names) + ranked, block_rows)
    blocks, known = _prepared(panel_blocks(noisy, names, "_zero", order, reach_of(individuals), size, first), [*individuals, *copies])
    n = blocks.n
    if n < 2:
        blocks.drop()
        return everyone.select("i", F.lit(0.0).alias("pfs"))
    signals = [lambda x, y, ind=ind: known.combined(ind, x, None) for ind in (*individuals, *copies)]
    base, moved_ = signals[: len(individuals)], signals[len(individuals) :]
    # the signals' own ranks become rank columns, and the copies are ranked against them
    own = len(blocks.tied)
    blocks = with_ranks(blocks, [(f, True) for f in base])

    def moments(jobs: range, rows: Rows, found: dict[int, np.ndarray]) -> list[tuple]:
        out = []
        for k in jobs:
            v, q = found[k], rows.ranks[own + k % len(base)][rows.halo :] / 2 - (n + 1) / 2
            out.append((k, [float(rows.row), float(len(v)), float(v.mean()), float(((v - v.mean()) ** 2).sum()), 0.0, 0.0, 0.0, float((q * q).sum())]))
        return out

    ranges, numbers = value_ranges(blocks, moved_, moments)
    _, plain = value_ranges(blocks, base, moments)
    sums = rank_sums(blocks, moved_, [own + k % len(base) for k in range(len(moved_))], ranges, 1)
    blocks.drop()
    spreads, out = _merged(plain, len(base)), []
    qq = [m["qq"] for m in _merged(numbers, len(moved_))]
    for i in range(len(individuals)):
        sd = math.sqrt(spreads[i]["ff"] / (n - 1)) if spreads[i]["ff"] >= 0 else math.nan
        steady = [_correlation(sums[k][1], sums[k][0], qq[k], n) for k in range(i, len(moved_), len(base))]
        out.append((i, sum(steady) / n_copies if math.isfinite(sd) and sd >= LEAST_SD else 0.0))
    return spark.createDataFrame(out, "i int, pfs double")


def _with_fitness(scores: DataFrame, weights: FitnessWeights | None, parsimony: float) -> DataFrame:
    own = scores.withColumns({"pfs": F.lit(0.0), "novelty": F.lit(0.0)})
    return own.withColumn("fitness", fitness(weights or FitnessWeights(), 0.0, parsimony)).drop("pfs", "novelty")


def tuned_constants(panel: DataFrame, trees: list[Node], features: list[str], y: str = "y", order: str = "row_id", most: int = 200, block_rows: int = BLOCK_ROWS) -> list[Node]:
    """The trees with the constants that Nelder-Mead finds best by pps on the whole panel; a tree without any, or where none are better, stays.

    All simplexes step together: one round asks for the points of all of them, and one evaluation of the population answers. Those that
    have ended ask for nothing more, so the rounds are those of the longest.
    """

    if not any(t.constants() for t in trees):
        return list(trees)
    # blocks and the target's ranks serve all rounds
    blocks = replace(target_ranked(panel_blocks(panel, features, y, order, max(t.reach for t in trees), block_rows)), shared=True)
    found = block_constants(blocks, trees, most)
    discard(blocks.df)
    return found


def block_pps(blocks: Blocks, trees: list[Node]) -> list[float]:
    """The pps of a few trees on shared blocks with the target's ranks."""
    n = blocks.n
    if n < 2:
        return [0.0] * len(trees)
    own, known = _prepared(blocks, [Individual((t,), (1.0,), "weighted_sum") for t in trees])
    ranked, numbers = rank_products(own, [lambda x, y, t=t: known.signal(t, x) for t in trees], 0, _block_moments(0, n))
    if own.df is not blocks.df:
        own.drop()
    return [BETA * _correlation(m["ft"], m["ff"], m["tt"], n) + (1 - BETA) * _correlation(rq, rr, m["qq"], n) for (rr, rq), m in zip(ranked, _merged(numbers, len(trees)), strict=True)]


def _tuned_in_tasks(blocks: Blocks, trees: list[Node], most: int) -> list[Node]:
    """``block_constants`` on no more rows than a block holds: a task takes them all and one tree."""
    held, kind = replace(blocks, df=None), "k int, constants array<double>"

    def tune(key, table):
        rows = sorted((r for r in map(lambda record: _loaded(held, record), table.to_pylist()) if r is not None), key=lambda r: r.row)
        x, y = np.concatenate([r.features[r.halo :] for r in rows]), np.concatenate([r.y[r.halo :] for r in rows])
        k = key[0].as_py()
        return pa.table({"k": pa.array([k], pa.int32()), "constants": pa.array([tuned(trees[k], x, y, tied_rank(y), most).constants()], pa.list_(pa.float64()))})

    todo = [k for k, t in enumerate(trees) if t.constants()]
    jobs = blocks.df.withColumn("k", F.explode(F.array(*(F.lit(k) for k in todo)))).repartition(len(todo), "k") if todo and blocks.n else None
    found = {r.k: r.constants for r in jobs.groupBy("k").applyInArrow(tune, kind).collect()} if jobs is not None else {}
    return [t.with_constants(found[k]) if k in found else t for k, t in enumerate(trees)]


def block_constants(blocks: Blocks, trees: list[Node], most: int) -> list[Node]:
    """``tuned_constants`` on shared blocks with the target's ranks."""
    if blocks.n <= blocks.block_rows:
        return _tuned_in_tasks(blocks, trees, most)

    def losses(own: list[Node]) -> list[float]:
        return [-pps for pps in block_pps(blocks, own)]

    running = {k: simplex(np.array(t.constants()), most) for k, t in enumerate(trees) if t.constants()}
    before = dict(zip(running, losses([trees[k] for k in running]) if running else [], strict=True))
    asked, best = {k: next(s) for k, s in running.items()}, dict(enumerate(trees))
    while asked:
        points = [(k, p) for k, own in asked.items() for p in own]
        values = losses([trees[k].with_constants(p.tolist()) for k, p in points])
        answers: dict[int, list[float]] = {}
        for (k, _), v in zip(points, values, strict=True):
            answers.setdefault(k, []).append(v)
        for k, own in answers.items():
            try:
                asked[k] = running[k].send(own)
            except StopIteration as done:
                del asked[k]
                point, value = done.value
                if np.isfinite(point).all() and value < before[k]:
                    best[k] = trees[k].with_constants(point.tolist())
    return [best[k] for k in range(len(trees))]
