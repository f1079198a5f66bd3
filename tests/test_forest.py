"""Trees as rows against trees as values."""

from collections import defaultdict

import numpy as np
import pytest

from sparkfactor.config import GPConfig
from sparkfactor.operators import forest, genetic
from sparkfactor.plans.ir import Node

KIND = "tree long, path string, depth int, op string, window int, feature int, value double"
CFG = GPConfig(min_depth=1, max_depth=4)


@pytest.fixture(scope="module")
def trees():
    rng = np.random.default_rng(1)
    return {k: genetic.random_tree(rng, CFG, 3, "full" if k % 2 else "grow", k % 5) for k in range(40)}


@pytest.fixture(scope="module")
def nodes(spark, trees):
    return spark.createDataFrame([r for k, t in trees.items() for r in forest.as_rows(k, t)], KIND).repartition(4)


def back(df) -> dict[int, Node]:
    own = defaultdict(list)
    for r in df.collect():
        own[r["tree"]].append(r)
        assert r["depth"] == len(r["path"])
    return {k: forest.as_node(rows) for k, rows in own.items()}


def test_intervals(nodes, trees):
    got = {(r.tree, r.pos): r for r in forest.intervals(nodes).collect()}
    assert len(got) == sum(t.size for t in trees.values())
    for k, tree in trees.items():
        for pos, node, level in tree.walk():
            r = got[k, pos]
            assert (r["size"], r.height, r.depth) == (node.size, node.depth, level) and (r.op, r.window, r.feature, r.value) == (node.op, node.window, node.feature, node.value)


def test_subtrees_and_splices(spark, nodes, trees):
    rng = np.random.default_rng(2)
    at = {k: int(rng.integers(t.size)) for k, t in trees.items()}
    place = {(r.tree, r.pos): r.path for r in forest.intervals(nodes).collect()}
    roots = spark.createDataFrame([(k, place[k, i]) for k, i in at.items()], "tree long, at string")
    assert back(forest.subtrees(nodes, roots)) == {k: trees[k].at(i) for k, i in at.items()}
    splices = spark.createDataFrame([(k, place[k, at[k]], k + 1, place[k + 1, at[k + 1]]) for k in range(0, 38, 3)], "tree long, at string, donor long, donor_at string")
    got = back(forest.spliced(nodes, splices, nodes))
    assert got == {k: t.replaced(at[k], trees[k + 1].at(at[k + 1])) if k % 3 == 0 and k < 38 else t for k, t in trees.items()}


def test_crossover(spark, nodes, trees):
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(19)], "a long, b long")
    got = back(forest.crossover(nodes, pairs, 4, 9))
    assert got[38] == trees[38] and got[39] == trees[39]
    swapped = 0
    for k in range(19):
        a, b, x, y = trees[2 * k], trees[2 * k + 1], got[2 * k], got[2 * k + 1]
        assert x.depth <= 4 and y.depth <= 4 and x.size + y.size == a.size + b.size
        ways = [(a.replaced(i, b.at(j)), b.replaced(j, a.at(i))) for i in range(a.size) for j in range(b.size)]
        assert (x, y) == (a, b) or (x, y) in ways
        swapped += (x, y) != (a, b)
    assert swapped > 10
    assert back(forest.crossover(nodes, pairs, -1, 9)) == trees


def test_mutations(nodes, trees):
    got = back(forest.point_mutation(nodes, CFG, 3, 5))
    for k, tree in trees.items():
        changed = [(n, o) for (_, n, _), (_, o, _) in zip(tree.walk(), got[k].walk(), strict=True) if (n.op, n.feature, n.value) != (o.op, o.feature, o.value)]
        assert got[k].size == tree.size and len(changed) == 1
        (n, o), = changed
        assert (n.op is None) == (o.op is None) and len(n.children) == len(o.children) and n.window == o.window
    got = back(forest.hoist(nodes, 5))
    for k, tree in trees.items():
        ways = [tree.replaced(i, c) for i, n, _ in tree.walk() for c in n.children]
        assert got[k] in ways if ways else got[k] == tree


def test_random_trees(spark):
    roots = spark.createDataFrame([(k, k % 5, k % 2 == 0) for k in range(300)], "tree long, max_depth int, grow boolean")
    got = back(forest.random_trees(roots, CFG, 3, 7, 4))
    again = back(forest.random_trees(roots.repartition(7), CFG, 3, 7, 4))
    assert got == again and sorted(got) == list(range(300))
    for k, tree in got.items():
        most = k % 5
        assert tree.depth <= most and (k % 2 == 0 or tree.depth == most) and tree.depth >= min(most, CFG.min_depth)
        assert all(f in (1, 2, 3) for f in tree.features())
    leaves = [n for t in got.values() for _, n, _ in t.walk() if n.is_leaf]
    assert 0.03 < sum(n.value is not None for n in leaves) / len(leaves) < 0.2
    ops = [n for t in got.values() for _, n, _ in t.walk() if not n.is_leaf]
    assert len({n.op for n in ops}) == 29 and 0.4 < sum(n.op in {*CFG.ts_unary_ops, *CFG.ts_binary_ops, *CFG.cs_ops} for n in ops) / len(ops) < 0.6
    assert forest.random_trees(roots.limit(0), CFG, 3, 7, 4).count() == 0
