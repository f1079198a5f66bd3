"""Trees as rows, for forests of any size: a row for each node.

A node's ``path`` holds the places of its ancestors' children that lead to it ('' for the root, '01' for the second child of the first child). Paths
in order are the nodes in pre-order, a subtree is the interval of the paths that begin with its root's, and its size, height and
replacement are arithmetic on that interval. Trees are drawn level by level; every draw hangs on the seed, the tree and the path
alone, so it can be replayed, whatever the partitions are, and other engines can replay it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GPConfig
from ..functions.registry import OPS, lookup
from ..plans.ir import Node, call, constant, variable
from ..sources.shared import discard, written
from .metrics import normal_draw

#: What a node holds besides its place.
CONTENT = ("op", "window", "feature", "value")
NODES = ("tree", "path", "depth", *CONTENT)


def uniform_draw(*key: Column) -> Column:
    """A number between 0 and 1 from the first 52 bits of the key's MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("-", *key).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _one_of(values: list, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def random_trees(roots: DataFrame, cfg: GPConfig, n_features: int, seed: int, most: int) -> DataFrame:
    """(tree, path, depth, op, window, feature, value): a tree for each row of ``roots`` (tree, max_depth, grow).

    A tree that doesn't grow branches to its ``max_depth``, ``most`` at most; one that grows may end earlier behind the least depth. A leaf is a
    normal constant with ``const_prob``, else a feature; an operator is rolling or cross-sectional with ``fin_op_prob``.
    """
    elementary, financial = [*cfg.unary_ops, *cfg.binary_ops], [*cfg.ts_unary_ops, *cfg.ts_binary_ops, *cfg.cs_ops]
    if not elementary or not financial:
        elementary = financial = elementary or financial
    two = [o for o in {*elementary, *financial} if lookup(o).arity == 2]
    rolling = [o for o in {*elementary, *financial} if lookup(o).rolling]
    level, levels = roots.select("tree", F.least("max_depth", F.lit(most)).alias("max_depth"), "grow", F.lit("").alias("path")), []
    for depth in range(most + 1):
        u = lambda what: uniform_draw(F.lit(seed), F.col("tree"), F.col("path"), F.lit(what))
        early = F.col("grow") & (u("leaf") < 0.5) if depth >= cfg.min_depth else F.lit(False)
        leaf = (F.col("max_depth") <= depth) | early
        op = F.when(~leaf, F.when(u("kind") < cfg.fin_op_prob, _one_of(financial, u("op"))).otherwise(_one_of(elementary, u("op"))))
        drawn = level.select("tree", "max_depth", "grow", "path", F.lit(depth).alias("depth"), op.alias("op"), (u("constant") < cfg.const_prob).alias("is_constant"))
        none = F.col("op").isNull()
        drawn = drawn.select(
            "tree", "max_depth", "grow", "path", "depth", "op",
            F.when(F.col("op").isin(rolling), _one_of(list(cfg.ts_windows), u("window"))).alias("window"),
            F.when(none & ~F.col("is_constant"), (F.floor(u("feature") * n_features) + 1).cast("int")).alias("feature"),
            F.when(none & F.col("is_constant"), normal_draw(F.concat_ws("-", F.lit(seed), F.col("tree"), F.col("path"), F.lit("value")))).alias("value"),
        )
        levels.append(written(drawn, f"level-{depth}"))
        children = F.when(F.col("op").isin(two), F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("0")))
        level = levels[-1].where("op is not null").select("tree", "max_depth", "grow", F.explode(children).alias("c"), "path").select("tree", "max_depth", "grow", F.concat("path", "c").alias("path"))
    return reduce(DataFrame.union, (df.select(*NODES) for df in levels))


def intervals(nodes: DataFrame) -> DataFrame:
    """The nodes with ``pos``, the number in pre-order from 0, ``size`` and ``height`` of the subtree: it is the interval [pos, pos + size).

    A node counts for each of its ancestors, so sums grow with nodes times depth. The nodes before one are those of the trees' parts to its left,
    and its ancestors.
    """
    up = nodes.select("tree", "depth", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.substring("path", 1, k))).alias("at", "path"))
    sums = up.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("size"), (F.max("depth") - F.first("at")).alias("height"))
    held = written(nodes.select(*NODES).join(sums, ["tree", "path"]), "subtrees")
    # to the left of a node, but for its ancestors, are the first children beside which it stands
    first = held.where("path like '%0'").select("tree", F.concat(F.expr("substring(path, 1, depth - 1)"), F.lit("1")).alias("beside"), F.col("size").alias("left"))
    ways = held.select("tree", "path", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.substring("path", 1, k))).alias("beside"))
    before = ways.join(first, ["tree", "beside"]).groupBy("tree", "path").agg(F.sum("left").alias("before"))
    return held.join(before, ["tree", "path"], "left").select(*NODES, "size", "height", (F.coalesce("before", F.lit(0)) + F.col("depth")).alias("pos"))


def subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The subtrees at (tree, at) as trees of their own: their nodes with the path below the root."""
    own = nodes.join(roots.select("tree", "at"), "tree").where(F.col("path").startswith(F.col("at")))
    path = F.expr("substring(path, length(at) + 1)")
    return own.select("tree", path.alias("path"), F.length(path).alias("depth"), *CONTENT)


def spliced(nodes: DataFrame, splices: DataFrame, donors: DataFrame) -> DataFrame:
    """Trees in which the subtree at each (tree, at) of ``splices`` gives way to that at (donor, donor_at) of ``donors``; other trees stay."""
    cut = nodes.join(splices.select("tree", "at"), "tree", "left").where(F.col("at").isNull() | ~F.col("path").startswith(F.col("at"))).select(*NODES)
    own = splices.select(F.col("tree").alias("host"), "at", F.col("donor").alias("tree"), "donor_at")
    path = F.concat("at", F.expr("substring(path, length(donor_at) + 1)"))
    put = donors.join(own, "tree").where(F.col("path").startswith(F.col("donor_at"))).select(F.col("host").alias("tree"), path.alias("path"), F.length(path).alias("depth"), *CONTENT)
    return cut.union(put)


def crossover(nodes: DataFrame, pairs: DataFrame, max_depth: int, seed: int, tries: int = 3) -> DataFrame:
    """The trees after each pair (a, b) has swapped subtrees: those of the first of ``tries`` draws of nodes that keeps both within ``max_depth``.

    A pair without such a draw, and a tree of no pair, stays as it is. A tree may be in one pair at most.
    """
    places = written(intervals(nodes), "intervals")
    size = places.where("path = ''").select("tree", "size")
    sized = pairs.join(size.select(F.col("tree").alias("a"), F.col("size").alias("size_a")), "a").join(size.select(F.col("tree").alias("b"), F.col("size").alias("size_b")), "b")
    drawn = sized.select("*", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("nth"))
    u = lambda what: uniform_draw(F.lit(seed), F.col("a"), F.col("b"), F.col("nth"), F.lit(what))
    drawn = drawn.select("a", "b", "nth", F.floor(u("a") * F.col("size_a")).alias("pos_a"), F.floor(u("b") * F.col("size_b")).alias("pos_b"))
    for side in "ab":
        found = places.select(F.col("tree").alias(side), F.col("pos").alias(f"pos_{side}"), F.col("path").alias(f"at_{side}"), F.col("depth").alias(f"depth_{side}"), F.col("height").alias(f"height_{side}"))
        drawn = drawn.join(found, [side, f"pos_{side}"])
    fit = drawn.where((F.col("depth_a") + F.col("height_b") <= max_depth) & (F.col("depth_b") + F.col("height_a") <= max_depth))
    chosen = written(fit.groupBy("a", "b").agg(F.min(F.struct("nth", "at_a", "at_b")).alias("r")).select("a", "b", "r.at_a", "r.at_b"), "swaps")
    sides = [chosen.select(F.col(x).alias("tree"), F.col(f"at_{x}").alias("at"), F.col(y).alias("donor"), F.col(f"at_{y}").alias("donor_at")) for x, y in ("ab", "ba")]
    out = written(spliced(nodes, sides[0].union(sides[1]), nodes), "crossed")
    discard(places, chosen)
    return out


def point_mutation(nodes: DataFrame, cfg: GPConfig, n_features: int, seed: int) -> DataFrame:
    """The trees with one node of each changed: another operator of its kind (unary and cross-sectional ones share a pool), a moved constant or another feature."""
    places = intervals(nodes)
    size = places.where("path = ''").select("tree", F.floor(uniform_draw(F.lit(seed), F.col("tree"), F.lit("node")) * F.col("size")).alias("hit"))
    u = uniform_draw(F.lit(seed), F.col("tree"), F.lit("what"))
    new = F.col("op")
    for pool in ([*cfg.unary_ops, *cfg.cs_ops], list(cfg.binary_ops), list(cfg.ts_unary_ops), list(cfg.ts_binary_ops)):
        others = F.array_remove(F.array(*map(F.lit, pool)), F.col("op")) if pool else None
        if pool and len(pool) > 1:
            new = F.when(F.col("op").isin(pool), F.element_at(others, (F.floor(u * (len(pool) - 1)) + 1).cast("int"))).otherwise(new)
    other = (F.floor(u * max(n_features - 1, 1)) + 1).cast("int")
    feature = F.when(F.col("feature").isNull() | F.lit(n_features < 2), F.col("feature")).otherwise(other + (other >= F.col("feature")).cast("int"))
    value = F.col("value") + 0.1 * normal_draw(F.concat_ws("-", F.lit(seed), F.col("tree"), F.lit("step")))
    here = F.col("pos") == F.col("hit")
    changed = {"op": new, "feature": feature, "value": value}
    return places.join(size, "tree").select("tree", "path", "depth", *(F.when(here, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in CONTENT))


def hoist(nodes: DataFrame, seed: int) -> DataFrame:
    """The trees with one operator of each replaced by one of its children; a leaf alone stays."""
    inner = intervals(nodes).where("op is not null")
    nth = F.row_number().over(W.partitionBy("tree").orderBy("path")) - 1
    n = F.count(F.lit(1)).over(W.partitionBy("tree"))
    hit = inner.select("tree", "path", "op", nth.alias("nth"), F.floor(uniform_draw(F.lit(seed), F.col("tree"), F.lit("node")) * n).alias("hit")).where("nth = hit")
    arity = F.when(F.col("op").isin([o.name for o in OPS.values() if o.arity == 2]), 2).otherwise(1)
    child = F.floor(uniform_draw(F.lit(seed), F.col("tree"), F.lit("child")) * arity).cast("string")
    return spliced(nodes, hit.select("tree", F.col("path").alias("at"), F.col("tree").alias("donor"), F.concat("path", child).alias("donor_at")), nodes)


def as_node(rows: list) -> Node:
    """The tree of its rows, for looking at one."""
    by = {r["path"]: r for r in rows}

    def build(path: str) -> Node:
        r = by[path]
        if r["op"] is None:
            return variable(r["feature"]) if r["value"] is None else constant(r["value"])
        return call(r["op"], *(build(path + str(k)) for k in range(lookup(r["op"]).arity)), window=r["window"])

    return build("")


def as_rows(tree: int, node: Node, path: str = "") -> list[tuple]:
    """A tree's rows, in the order of ``NODES``."""
    out = [(tree, path, len(path), node.op, node.window, node.feature, node.value)]
    for k, child in enumerate(node.children):
        out += as_rows(tree, child, path + str(k))
    return out
