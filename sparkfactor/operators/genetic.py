"""Making and varying trees. All draws come from a given NumPy generator, so a seed fixes the outcome."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from ..config import GPConfig
from ..functions.registry import lookup
from ..plans.ir import Node, call, constant, variable

Rng = np.random.Generator


@dataclass(frozen=True)
class Individual:
    """Several trees with weights, and their scores."""

    trees: tuple[Node, ...]
    weights: tuple[float, ...]
    combination: str
    fitness: float = float("-inf")
    pps: float = 0.0
    rre: float = 0.0
    pfs: float = 0.0
    novelty: float = 0.0
    behavior: tuple[float, ...] = ()
    age: int = 0

    @property
    def complexity(self) -> int:
        return sum(t.size for t in self.trees)

    @property
    def key(self) -> str:
        return " | ".join(map(str, self.trees))


def random_leaf(rng: Rng, cfg: GPConfig, n_features: int) -> Node:
    return constant(rng.standard_normal()) if rng.random() < cfg.const_prob else variable(int(rng.integers(n_features)) + 1)


def random_tree(rng: Rng, cfg: GPConfig, n_features: int, method: str, max_depth: int, depth: int = 0) -> Node:
    """``full`` branches to the depth limit; ``grow`` may stop early behind the least depth. The limit wins over the least depth."""
    if method not in ("grow", "full"):
        raise ValueError(f"unknown method {method}")
    if n_features < 1:
        raise ValueError("no features")
    if depth >= max_depth or (method == "grow" and depth >= cfg.min_depth and rng.random() < 0.5):
        return random_leaf(rng, cfg, n_features)
    financial = [*cfg.ts_unary_ops, *cfg.ts_binary_ops, *cfg.cs_ops]
    pool = financial if financial and rng.random() < cfg.fin_op_prob else [*cfg.unary_ops, *cfg.binary_ops] or financial
    spec = lookup(pool[int(rng.integers(len(pool)))])
    window = int(rng.choice(cfg.ts_windows)) if spec.rolling else None
    return call(spec.name, *(random_tree(rng, cfg, n_features, method, max_depth, depth + 1) for _ in range(spec.arity)), window=window)


def init_individual(rng: Rng, cfg: GPConfig, n_features: int, depth: int) -> Individual:
    trees = tuple(random_tree(rng, cfg, n_features, "full" if k % 2 == 0 else "grow", depth) for k in range(cfg.n_trees))
    return Individual(trees, (1.0 / cfg.n_trees,) * cfg.n_trees, cfg.combination)


def init_population(rng: Rng, cfg: GPConfig, n_features: int) -> list[Individual]:
    """Equal bands of depths from least to most, the remainder to the deepest, shuffled."""
    depths = list(range(cfg.min_depth, cfg.max_depth + 1))
    each, rest = divmod(cfg.population_size, len(depths))
    sizes = [each + (k >= len(depths) - rest) for k in range(len(depths))]
    out = [init_individual(rng, cfg, n_features, d) for d, n in zip(depths, sizes, strict=True) for _ in range(n)]
    return [out[i] for i in rng.permutation(len(out))]


def _changed(ind: Individual, k: int, tree: Node) -> Individual:
    return replace(ind, trees=(*ind.trees[:k], tree, *ind.trees[k + 1 :]))


def crossover(rng: Rng, a: Individual, b: Individual, cfg: GPConfig, tries: int = 3) -> tuple[Individual, Individual]:
    """Swaps subtrees of the same tree of both; unchanged if no try keeps both within the depth limit."""
    k = int(rng.integers(len(a.trees)))
    for _ in range(tries):
        i, j = int(rng.integers(a.trees[k].size)), int(rng.integers(b.trees[k].size))
        x, y = a.trees[k].replaced(i, b.trees[k].at(j)), b.trees[k].replaced(j, a.trees[k].at(i))
        if x.depth <= cfg.max_depth and y.depth <= cfg.max_depth:
            return _changed(a, k, x), _changed(b, k, y)
    return a, b


def _operators(tree: Node) -> list[int]:
    return [i for i, n, _ in tree.walk() if not n.is_leaf]


def subtree_mutate(rng: Rng, ind: Individual, cfg: GPConfig, n_features: int) -> Individual:
    k = int(rng.integers(len(ind.trees)))
    tree = ind.trees[k]
    i = int(rng.integers(tree.size))
    return _changed(ind, k, tree.replaced(i, random_tree(rng, cfg, n_features, "grow", max(0, cfg.max_depth - tree.level(i)))))


def point_mutate(rng: Rng, ind: Individual, cfg: GPConfig, n_features: int) -> Individual:
    """Another operator of the same kind (unary and cross-sectional ones share a pool), a moved constant, or another feature."""
    k = int(rng.integers(len(ind.trees)))
    tree = ind.trees[k]
    i = int(rng.integers(tree.size))
    node = tree.at(i)
    if node.value is not None:
        new = constant(node.value + 0.1 * rng.standard_normal())
    elif node.feature is not None:
        others = [f for f in range(1, n_features + 1) if f != node.feature]
        new = variable(int(rng.choice(others))) if others else node
    else:
        tier = lookup(node.op).tier
        pool = [*cfg.unary_ops, *cfg.cs_ops] if tier in ("unary", "cs") else list({"binary": cfg.binary_ops, "ts_unary": cfg.ts_unary_ops, "ts_binary": cfg.ts_binary_ops}[tier])
        others = [o for o in pool if o != node.op]
        new = replace(node, op=str(rng.choice(others))) if others else node
    return _changed(ind, k, tree.replaced(i, new))


def hoist_mutate(rng: Rng, ind: Individual) -> Individual:
    k = int(rng.integers(len(ind.trees)))
    inner = _operators(ind.trees[k])
    if not inner:
        return ind
    i = int(rng.choice(inner))
    children = ind.trees[k].at(i).children
    return _changed(ind, k, ind.trees[k].replaced(i, children[int(rng.integers(len(children)))]))


def shrink_mutate(rng: Rng, ind: Individual, cfg: GPConfig, n_features: int) -> Individual:
    k = int(rng.integers(len(ind.trees)))
    inner = _operators(ind.trees[k])
    return _changed(ind, k, ind.trees[k].replaced(int(rng.choice(inner)), random_leaf(rng, cfg, n_features))) if inner else ind


def mutate(rng: Rng, ind: Individual, cfg: GPConfig, n_features: int) -> Individual:
    p, u = cfg.mutation, rng.random()
    for share, f in ((p.subtree, lambda: subtree_mutate(rng, ind, cfg, n_features)), (p.point, lambda: point_mutate(rng, ind, cfg, n_features)), (p.hoist, lambda: hoist_mutate(rng, ind)), (p.shrink, lambda: shrink_mutate(rng, ind, cfg, n_features))):
        if u < share:
            return f()
        u -= share
    return ind
