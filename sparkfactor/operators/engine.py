"""The island search. Spark evaluates; the driver, which sees only individuals and their scores, selects and breeds.

Scores, fingerprints and period errors of a generation come from a table of any size, block by block (``run_gp_panel``), or from a matrix that the
caller holds and one broadcast carries (``run_gp``). All are scored anew, as each generation has its own range of rows.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GPConfig
from ..functions.kernels import tied_rank
from ..plans.ir import Node, parse
from ..sources.panel import with_row_id
from ..sources.shared import written
from . import scores
from .archive import NoveltyArchive
from .blocks import panel_blocks
from .evaluation import BLOCK_ROWS, block_constants, block_scores, block_traits, population_steadiness, population_traits, target_ranked
from .fronts import trimmed
from .genetic import Individual, crossover, init_population, mutate
from .neighbours import distances
from .population import migration_targets


def knn_mean(a: np.ndarray, others: np.ndarray, k: int) -> float:
    """Mean distance to the min(k, n) nearest; 0 without any."""
    return float(np.sort(distances(np.asarray(a, float), others.astype(float)))[:k].mean()) if len(others) else 0.0


def dominates(a: Individual, b: Individual) -> bool:
    return a.pps >= b.pps and a.rre >= b.rre and a.complexity <= b.complexity and (a.pps > b.pps or a.rre > b.rre or a.complexity < b.complexity)


class ParetoHoF:
    """A bounded front of (pps, rre, complexity); members are kept as they were when admitted."""

    def __init__(self, size: int):
        self.size, self.members = size, []

    def update(self, individuals: list[Individual]) -> None:
        """Admits all that none dominates, and then trims once: a newcomer that is trimmed has still removed what it dominates."""
        for ind in individuals:
            same = lambda m, i=ind: (m.pps, m.rre, m.complexity) == (i.pps, i.rre, i.complexity)
            if not np.isfinite(ind.fitness) or any(dominates(m, ind) or same(m) for m in self.members):
                continue
            self.members = [m for m in self.members if not dominates(ind, m)] + [ind]
        kept = trimmed([m.pps for m in self.members], [m.rre for m in self.members], [m.complexity for m in self.members], self.size)
        self.members = [self.members[i] for i in kept]

    def summary(self) -> dict:
        own = self.members
        return {"size": len(own), "best_pps": max((m.pps for m in own), default=0.0), "best_rre": max((m.rre for m in own), default=0.0), "least_complexity": min((m.complexity for m in own), default=0)}


def tournament_select(rng: np.random.Generator, fitness: np.ndarray, k: int) -> int:
    """The fittest of ``k`` draws, the first of equals; the best of all if k reaches their number."""
    drawn = rng.permutation(len(fitness)) if k >= len(fitness) else rng.integers(len(fitness), size=k)
    return int(drawn[int(np.argmax(fitness[drawn]))])


def lexicase_select(rng: np.random.Generator, errors: np.ndarray, epsilon: float) -> int:
    """Periods in random order leave those within epsilon of the least error; one of the survivors by chance."""
    left = np.arange(len(errors))
    for p in rng.permutation(errors.shape[1]):
        e = errors[left, p]
        kept = left[e <= np.nanmin(e) + epsilon] if np.isfinite(e).any() else left
        left = kept if len(kept) else left
    return int(rng.choice(left))


def score_individuals(spark: SparkSession, individuals: list[Individual], x: np.ndarray, y: np.ndarray, rows: slice, cfg: GPConfig, behavior_rows: np.ndarray, pfs_for: set[int], generation: int, slices: int | None = None) -> list[tuple]:
    """(pps, rre, pfs, behavior, errors) of each individual, made by the executors. x and y go out as one broadcast block."""
    block = spark.sparkContext.broadcast((x, y))
    todo = [(i, [str_exact(t) for t in ind.trees], list(ind.weights), ind.combination, i in pfs_for) for i, ind in enumerate(individuals)]
    df = spark.createDataFrame(todo, "i int, trees array<string>, weights array<double>, combination string, pfs boolean")
    df = df.repartition(slices or spark.sparkContext.defaultParallelism)

    def run(frames):
        import pandas as pd

        full_x, full_y = block.value
        sub_x, sub_y = full_x[rows], full_y[rows]
        sub_rank = tied_rank(sub_y)
        cuts = scores.periods(len(full_y), min(cfg.lexicase_n_periods, len(full_y)), remainder=True)
        for frame in frames:
            out = []
            for r in frame.itertuples():
                trees = tuple(parse(t) for t in r.trees)
                signal = lambda m, t=trees, w=tuple(r.weights), c=r.combination: scores.combined(t, w, c, m)
                f, whole = signal(sub_x), signal(full_x)
                seed = generation * 100_000 + r.i
                steady = scores.pfs(signal, sub_x, cfg.pfs_n_perturbations, cfg.pfs_noise_scale, seed) if r.pfs else 0.0
                prints = signal(full_x[behavior_rows]) if cfg.compat else whole[behavior_rows]
                errors = [float(np.abs(whole[c] - full_y[c]).mean()) for c in cuts]
                out.append((r.i, scores.pps(f, sub_y, sub_rank), scores.rre(f), steady, prints.astype(np.float32).tolist(), errors))
            yield pd.DataFrame(out, columns=["i", "pps", "rre", "pfs", "behavior", "errors"])

    done = df.mapInPandas(run, "i int, pps double, rre double, pfs double, behavior array<float>, errors array<double>").collect()
    block.unpersist()
    return [(r.pps, r.rre, r.pfs, tuple(r.behavior), r.errors) for r in sorted(done, key=lambda r: r.i)]


def str_exact(tree) -> str:
    """The text form with all digits of its constants."""
    if tree.value is not None:
        return repr(tree.value)
    if tree.is_leaf:
        return str(tree)
    return f"{tree.op}({', '.join([*map(str_exact, tree.children), *([f'd={tree.window}'] if tree.window is not None else [])])})"


def fitness_of(ind: Individual, cfg: GPConfig, novelty_weight: float) -> float:
    w = cfg.weights
    value = w.pps * ind.pps + w.rre * ind.rre + w.pfs * ind.pfs + novelty_weight * ind.novelty - cfg.parsimony * ind.complexity
    return value if np.isfinite(value) else float("-inf")


class MatrixScorer:
    """Scores on a block of rows that one broadcast carries; its size is the caller's choice."""

    def __init__(self, spark: SparkSession, x: np.ndarray, y: np.ndarray, cfg: GPConfig):
        self.spark, self.x, self.y, self.cfg = spark, x, y, cfg
        self.n_rows, self.n_features, self.y_rank = len(y), x.shape[1], tied_rank(y)

    def score(self, individuals: list[Individual], rows: slice, behavior_rows: np.ndarray, generation: int) -> list[tuple]:
        """(pps, rre, behavior, errors) of each individual."""
        return [(p, r, b, e) for p, r, _, b, e in score_individuals(self.spark, individuals, self.x, self.y, rows, self.cfg, behavior_rows, set(), generation)]

    def steadiness(self, individuals: list[Individual], rows: slice, behavior_rows: np.ndarray, generation: int) -> list[float]:
        return [s for _, _, s, *_ in score_individuals(self.spark, individuals, self.x, self.y, rows, self.cfg, behavior_rows, set(range(len(individuals))), generation)]

    def tuned(self, trees: list[Node]) -> list[Node]:
        """The trees with tuned constants, each one a job of an executor."""
        block, most = self.spark.sparkContext.broadcast((self.x, self.y, self.y_rank)), self.cfg.const_opt_steps

        def run(frames):
            for frame in frames:
                yield frame.assign(tree=[str_exact(scores.tuned(parse(t), *block.value, most)) for t in frame.tree])

        jobs = self.spark.createDataFrame([(k, str_exact(t)) for k, t in enumerate(trees)], "k int, tree string")
        done = jobs.repartition(self.spark.sparkContext.defaultParallelism).mapInPandas(run, "k int, tree string").collect()
        block.unpersist()
        return [parse(r.tree) for r in sorted(done, key=lambda r: r.k)]


class PanelScorer:
    """Scores on a panel of any size, in blocks of rows; of it only individuals' scores, fingerprints and period errors reach the driver."""

    def __init__(self, panel: DataFrame, features: list[str], y: str, cfg: GPConfig, order: str = "row_id", block_rows: int = BLOCK_ROWS):
        self.cfg, self.block_rows, self.n_features = cfg, block_rows, len(features)
        self.features = [f"x{k}" for k in range(1, len(features) + 1)]
        own = panel.select(order, *(F.col(f).cast("double").alias(n) for f, n in zip(features, self.features, strict=True)), F.col(y).cast("double").alias("y"))
        self.panel = written(with_row_id(own if order == "row_id" else own.withColumnRenamed(order, "_order"), [order if order == "row_id" else "_order"]), "search-panel")
        # blocks serve the whole search, so they reach as far back as any of its trees can
        self.blocks = replace(panel_blocks(self.panel, self.features, "y", "row_id", cfg.max_depth * max(cfg.ts_windows), block_rows, 0), shared=True)
        self.n_rows, self.known, self.ranked = self.blocks.n, {}, None

    def _rows(self, rows: slice) -> DataFrame:
        return self.panel.where((F.col("row_id") >= rows.start) & (F.col("row_id") < rows.stop))

    def score(self, individuals: list[Individual], rows: slice, behavior_rows: np.ndarray, generation: int) -> list[tuple]:
        found = block_scores(self.blocks.slice(rows.start, rows.stop), individuals)
        # the whole table's answers on an individual stay the same from generation to generation
        places = tuple(behavior_rows.tolist())
        keys = [(i.trees, i.weights, i.combination, places) for i in individuals]
        new = {k: i for k, i in zip(keys, individuals, strict=True) if k not in self.known}
        if new:
            seen = block_traits(self.blocks, list(new.values()), list(places), self.cfg.lexicase_n_periods)
            if self.cfg.compat:
                numbered = self.panel.sparkSession.createDataFrame(list(enumerate(places)), "_place long, row_id long")
                scattered = self.panel.join(F.broadcast(numbered), "row_id").drop("row_id").withColumnRenamed("_place", "row_id")
                prints = population_traits(scattered, list(new.values()), self.features, list(range(len(places))), 1, block_rows=self.block_rows)
                seen = seen.drop("behavior").join(prints.drop("errors"), "i")
            self.known = {k: self.known[k] for k in keys if k in self.known}
            self.known |= {k: (tuple(r.behavior), r.errors) for k, r in zip(new, sorted(seen.collect(), key=lambda r: r.i), strict=True)}
        return [(pps, rre, *self.known[k]) for k, (_, pps, _, _, rre, _) in zip(keys, found, strict=True)]

    def steadiness(self, individuals: list[Individual], rows: slice, behavior_rows: np.ndarray, generation: int) -> list[float]:
        c = self.cfg
        found = population_steadiness(self._rows(rows), individuals, self.features, n_copies=c.pfs_n_perturbations, noise=c.pfs_noise_scale, seed=c.seed * 100_000 + generation, block_rows=self.block_rows, first=rows.start)
        return [r.pfs for r in sorted(found.collect(), key=lambda r: r.i)]

    def tuned(self, trees: list[Node]) -> list[Node]:
        if not any(t.constants() for t in trees):
            return list(trees)
        if self.ranked is None:
            self.ranked = replace(target_ranked(self.blocks), shared=True)
        return block_constants(self.ranked, trees, self.cfg.const_opt_steps)


def run_gp(spark: SparkSession, x: np.ndarray, y: np.ndarray, cfg: GPConfig, log=None) -> ParetoHoF:
    """Searches factors on a matrix of rows in time order and a target; gives the front. The same seed gives the same front."""
    return search(MatrixScorer(spark, x, y, cfg), cfg, log)


def run_gp_panel(panel: DataFrame, features: list[str], y: str, cfg: GPConfig, order: str = "row_id", block_rows: int = BLOCK_ROWS, log=None) -> ParetoHoF:
    """The same search on a table of any size; ``order`` must tell rows apart, features count from 1 in the order of ``features``.

    It takes the steps of ``run_gp`` and gives its front, but for the noise of PFS, which is drawn row by row here.
    """
    return search(PanelScorer(panel, features, y, cfg, order, block_rows), cfg, log)


def search(scorer: MatrixScorer | PanelScorer, cfg: GPConfig, log=None) -> ParetoHoF:
    """The islands' generations; everything that reads rows is asked of ``scorer``."""
    n = scorer.n_rows
    if n == 0:
        raise ValueError("no rows to search on")
    master = np.random.default_rng(np.random.SeedSequence([cfg.seed]))
    rngs = [np.random.default_rng(np.random.SeedSequence([cfg.seed, k + 1])) for k in range(cfg.n_islands)]
    everyone = init_population(master, cfg, scorer.n_features)
    size = cfg.population_size // cfg.n_islands
    islands = [everyone[k * size : (k + 1) * size] for k in range(cfg.n_islands)]
    # drawn without a list of all rows
    behavior_rows = master.choice(n, min(cfg.behavior_sample_size, n), replace=False)
    archive, hof = NoveltyArchive(cfg.novelty_archive_size, cfg.novelty_k), ParetoHoF(cfg.hof_size)
    elites = min(cfg.elite_count, size - 1)
    for generation in range(1, cfg.n_generations + 1):
        n_rows = max(1, int(n * cfg.eval_subsample))
        start = int(master.integers(n - n_rows + 1))
        steady = generation % cfg.const_opt_every_n_gens == 0
        flat = [ind for own in islands for ind in own]
        rows = slice(start, start + n_rows)
        found = scorer.score(flat, rows, behavior_rows, generation)
        errors = [np.array([e for *_, e in found[k * size : (k + 1) * size]]) for k in range(cfg.n_islands)]
        weight = cfg.weights.novelty if cfg.compat else scores.novelty_weight(cfg.weights.novelty, generation, cfg.n_generations)
        for k in range(cfg.n_islands):
            part = found[k * size : (k + 1) * size]
            prints = np.array([b for *_, b, _ in part])
            seen = np.array(archive.entries).reshape(len(archive.entries), prints.shape[1])
            own = []
            for i, (ind, (p, r, b, _)) in enumerate(zip(islands[k], part, strict=True)):
                novelty = knn_mean(prints[i], np.concatenate([np.delete(prints, i, 0), seen]), cfg.novelty_k)
                ind = replace(ind, pps=p, rre=r, pfs=0.0, behavior=b, novelty=novelty if np.isfinite(novelty) else 0.0)
                own.append(replace(ind, fitness=fitness_of(ind, cfg, weight)))
            islands[k] = own
        if steady and cfg.weights.pfs > 0:
            islands = _with_steadiness(scorer, islands, cfg, rows, behavior_rows, generation, elites, weight)
        archive.update([np.array(ind.behavior) for own in islands for ind in own if np.isfinite(ind.behavior).all()])
        hof.update([ind for own in islands for ind in own])
        if log:
            best = max((ind for own in islands for ind in own), key=lambda i: i.fitness)
            log({"generation": generation, "best_fitness": best.fitness, "best_pps": max(i.pps for own in islands for i in own), "archive": len(archive.entries), "hof": len(hof.members)})
        if steady and cfg.optimize_constants and generation < cfg.n_generations:
            islands = _tuned_elites(scorer, islands, elites)
        islands = [_next_generation(rngs[k], own, errors[k], cfg, scorer.n_features, elites) for k, own in enumerate(islands)]
        if generation % cfg.migration_interval == 0:
            islands = migrated(islands, migration_targets(cfg.n_islands, cfg.migration_topology, master), max(1, int(np.ceil(size * cfg.migration_rate))))
    return hof


def _fittest(islands: list[list[Individual]], elites: int) -> list[tuple[int, int]]:
    return [(k, i) for k, own in enumerate(islands) for i in sorted(range(len(own)), key=lambda i: -own[i].fitness)[:elites]]


def _steadied(spark: SparkSession, islands: list[list[Individual]], x, y, rows: slice, cfg: GPConfig, behavior_rows: np.ndarray, generation: int, elites: int, weight: float) -> list[list[Individual]]:
    """``_with_steadiness`` on a matrix."""
    return _with_steadiness(MatrixScorer(spark, x, y, cfg), islands, cfg, rows, behavior_rows, generation, elites, weight)


def _with_steadiness(scorer, islands: list[list[Individual]], cfg: GPConfig, rows: slice, behavior_rows: np.ndarray, generation: int, elites: int, weight: float) -> list[list[Individual]]:
    """The fittest of each island, by their new scores, with PFS in their fitness."""
    chosen = _fittest(islands, elites)
    found = scorer.steadiness([islands[k][i] for k, i in chosen], rows, behavior_rows, generation)
    out = [list(own) for own in islands]
    for (k, i), steady in zip(chosen, found, strict=True):
        ind = replace(out[k][i], pfs=steady)
        out[k][i] = replace(ind, fitness=fitness_of(ind, cfg, weight))
    return out


def _tuned_elites(scorer, islands: list[list[Individual]], elites: int) -> list[list[Individual]]:
    """The fittest of each island with tuned constants, tree by tree."""
    places = [(k, i, t) for k, i in _fittest(islands, elites) for t, tree in enumerate(islands[k][i].trees) if tree.constants()]
    if not places:
        return islands
    new = dict(zip(places, scorer.tuned([islands[k][i].trees[t] for k, i, t in places]), strict=True))
    return [[replace(ind, trees=tuple(new.get((k, i, t), tree) for t, tree in enumerate(ind.trees))) for i, ind in enumerate(own)] for k, own in enumerate(islands)]


def _next_generation(rng: np.random.Generator, own: list[Individual], errors: np.ndarray, cfg: GPConfig, n_features: int, elites: int) -> list[Individual]:
    fitness = np.array([i.fitness for i in own])
    pick = lambda: own[tournament_select(rng, fitness, cfg.tournament_k) if cfg.selection == "tournament" else lexicase_select(rng, errors, cfg.lexicase_epsilon)]
    out = [own[i] for i in np.argsort(-fitness, kind="stable")[:elites]]
    while len(out) < len(own):
        children = crossover(rng, pick(), pick(), cfg) if rng.random() < cfg.crossover_prob else (mutate(rng, pick(), cfg, n_features),)
        out += [replace(c, age=0) for c in children][: len(own) - len(out)]
    return out


def migrated(islands: list[list[Individual]], targets: list[int], m: int) -> list[list[Individual]]:
    """The best of each island, as they were before any move, replace the worst of its target, source by source."""
    best = [sorted(own, key=lambda i: -i.fitness)[:m] for own in islands]
    out = [list(own) for own in islands]
    for k, target in enumerate(targets):
        if target - 1 != k:
            own = out[target - 1]
            for ind, place in zip(best[k], sorted(range(len(own)), key=lambda i: own[i].fitness)[:m], strict=False):
                own[place] = ind
    return out


def panel_matrix(panel: DataFrame, features: list[str], target: str, order: str = "row_id") -> tuple[np.ndarray, np.ndarray]:
    """The training block as arrays in row order, for the search, which subsamples rows; its size is the caller's choice."""
    rows = panel.select(order, *features, target).toPandas().sort_values(order)
    return rows[features].to_numpy(float), rows[target].to_numpy(float)
