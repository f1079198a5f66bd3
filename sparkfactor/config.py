"""Settings of the search."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.registry import names, validate_ops


@dataclass(frozen=True)
class MutationProbs:
    subtree: float = 0.4
    point: float = 0.35
    hoist: float = 0.15
    shrink: float = 0.1

    def __post_init__(self):
        values = (self.subtree, self.point, self.hoist, self.shrink)
        if min(values) < 0 or sum(values) > 1 + 1e-9:
            raise ValueError("mutation probabilities are negative or exceed 1 in sum")


@dataclass(frozen=True)
class FitnessWeights:
    pps: float = 0.3
    rre: float = 0.3
    pfs: float = 0.3
    novelty: float = 0.1

    def __post_init__(self):
        values = (self.pps, self.rre, self.pfs, self.novelty)
        if min(values) < 0 or sum(values) > 1 + 1e-9:
            raise ValueError("fitness weights are negative or exceed 1 in sum")


@dataclass(frozen=True)
class GPConfig:
    """All settings, checked on construction.

    ``compat`` reproduces an un-annealed novelty bonus and fingerprints made on scattered rows only.
    """

    population_size: int = 1000
    n_trees: int = 10
    combination: str = "rank_average"
    max_depth: int = 6
    min_depth: int = 2
    n_generations: int = 50
    elite_count: int = 20
    crossover_prob: float = 0.9
    mutation: MutationProbs = field(default_factory=MutationProbs)
    selection: str = "epsilon_lexicase"
    tournament_k: int = 5
    lexicase_n_periods: int = 20
    lexicase_epsilon: float = 0.1
    optimize_constants: bool = True
    const_opt_every_n_gens: int = 5
    const_opt_steps: int = 200
    parsimony: float = 0.001
    weights: FitnessWeights = field(default_factory=FitnessWeights)
    novelty_k: int = 10
    novelty_archive_size: int = 200
    behavior_sample_size: int = 500
    hof_size: int = 50
    pfs_noise_scale: float = 0.01
    pfs_n_perturbations: int = 5
    n_islands: int = 4
    migration_interval: int = 10
    migration_rate: float = 0.05
    migration_topology: str = "ring"
    unary_ops: tuple[str, ...] = field(default_factory=lambda: tuple(names("unary")))
    binary_ops: tuple[str, ...] = field(default_factory=lambda: tuple(names("binary")))
    ts_unary_ops: tuple[str, ...] = field(default_factory=lambda: tuple(names("ts_unary")))
    ts_binary_ops: tuple[str, ...] = field(default_factory=lambda: tuple(names("ts_binary")))
    cs_ops: tuple[str, ...] = field(default_factory=lambda: tuple(names("cs")))
    ts_windows: tuple[int, ...] = (3, 5, 10, 20)
    const_prob: float = 0.1
    fin_op_prob: float = 0.5
    seed: int = 42
    eval_subsample: float = 0.5
    compat: bool = False

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(0 <= self.min_depth <= self.max_depth, "depths are out of order")
        need(self.population_size > 0 and self.n_islands > 0 and self.population_size % self.n_islands == 0, "the population doesn't divide by the islands")
        need(0 <= self.elite_count < self.population_size, "more elites than individuals")
        need(self.lexicase_n_periods >= 2, "lexicase needs two periods")
        for p in (self.crossover_prob, self.const_prob, self.fin_op_prob, self.migration_rate):
            need(0 <= p <= 1, "a probability lies outside 0 to 1")
        need(0 < self.eval_subsample <= 1, "eval_subsample lies outside 0 to 1")
        need(self.pfs_noise_scale >= 0 and self.pfs_n_perturbations >= 1, "pfs settings")
        need(bool(self.ts_windows) and min(self.ts_windows) >= 2, "windows start at 2")
        need(self.combination in ("weighted_sum", "rank_average", "vote"), "unknown combination")
        need(self.selection in ("tournament", "epsilon_lexicase"), "unknown selection")
        need(self.migration_topology in ("ring", "star", "random"), "unknown topology")
        ints = (self.n_trees, self.n_generations, self.tournament_k, self.const_opt_every_n_gens, self.const_opt_steps, self.novelty_k, self.novelty_archive_size, self.behavior_sample_size, self.hof_size, self.migration_interval)
        need(min(ints) >= 1, "a count is below 1")
        for ops, tier in ((self.unary_ops, "unary"), (self.binary_ops, "binary"), (self.ts_unary_ops, "ts_unary"), (self.ts_binary_ops, "ts_binary"), (self.cs_ops, "cs")):
            validate_ops(list(ops), tier)
