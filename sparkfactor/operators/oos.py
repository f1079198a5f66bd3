"""Out-of-sample scores of a front, member by member and tree by tree, and the run from CSV files to results.

A front is a bounded list of individuals. All their distinct trees are compiled into few wide plans, each written once; members are
combined from those columns, and every signal is ranked in one pass keyed by its name, so nothing grows with trees times scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GPConfig
from ..functions.scope import GLOBAL, Scope
from ..plans.compiler import MOST_TREES, compile_forest
from ..plans.ir import Node
from ..sources.panel import date_split, forward_target, read_csv_assets, with_row_id, write_csv, write_signals
from ..sources.shared import written
from .combine import combine
from .engine import ParetoHoF, panel_matrix, run_gp, run_gp_panel
from .evaluation import signal_scores
from .genetic import Individual


def by_train(members: list[Individual]) -> list[Individual]:
    """Members in the order of their training pps, best first; equal ones as they came."""
    return sorted(members, key=lambda m: -m.pps)


def _batches(members: list[Individual]) -> list[list[int]]:
    """Runs of members whose distinct trees fit one plan."""
    out, trees = [], set()
    for k, m in enumerate(members):
        more = trees | set(m.trees)
        if not out or (len(more) > MOST_TREES and out[-1]):
            out.append([])
            more = set(m.trees)
        out[-1].append(k)
        trees = more
    return out


def wide_signals(panel: DataFrame, members: list[Individual], features: list[str], keep: list[str], scope: Scope = GLOBAL, digits: int | None = None) -> list[tuple[DataFrame, dict[str, str]]]:
    """Written tables of ``keep``, member signals ``m<k>`` and tree signals, with the column of each ``t<k>_<i>`` (from 1).

    ``digits``: signals are rounded to so many, for comparisons with other engines.
    """
    out = []
    exact = (lambda c: F.col(c)) if digits is None else (lambda c: F.round(c, digits))
    for batch in _batches(members):
        trees: dict[Node, str] = {}
        places = {f"t{k + 1}_{i}": trees.setdefault(t, f"tree{len(trees)}") for k in batch for i, t in enumerate(members[k].trees, 1)}
        df = compile_forest(panel, {name: t for t, name in trees.items()}, features, scope)
        df = written(df.select(*dict.fromkeys([scope.order, *keep]), *(exact(c).alias(c) for c in trees.values())), "tree-signals")
        for k in batch:
            m = members[k]
            df = combine(df, [trees[t] for t in m.trees], m.combination, f"m{k + 1}", list(m.weights), scope)
        names = [f"m{k + 1}" for k in batch]
        df = df.select(*dict.fromkeys([scope.order, *keep]), *trees.values(), *(exact(c).alias(c) for c in names))
        out.append((written(df, "member-signals"), {n: n for n in names} | places))
    return out


def scored(wide: DataFrame, names: list[str], y: str = "y", order: str = "row_id") -> DataFrame:
    """(name, ic, rank_ic, pps, rre) of signals against a target, ranked by ranges of values over blocks of rows."""
    return signal_scores(wide, names, y, order)


def _rounded(columns: dict[str, str]) -> list[Column]:
    return [F.round(c, 4).alias(name) for name, c in columns.items()]


MEMBER_SCORES = {"oos_pps": "pps", "oos_ic": "ic", "oos_rankic": "rank_ic", "oos_rre": "rre"}
MEMBER_KIND = "rank int, oos_pps double, oos_ic double, oos_rankic double, oos_rre double, train_pps double, complexity int"
TREE_KIND = "individual_rank int, tree_idx int, oos_pps double, oos_ic double, oos_rankic double, oos_rre double, tree_size int, tree_depth int, tree_rank int"


def evaluate_oos(panel: DataFrame, members: list[Individual], features: list[str], y: str = "y", scope: Scope = GLOBAL, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The members' table, best first by out-of-sample pps, and the table of all their trees, ranked within each member.

    Signals are made on ``panel`` alone, so windows start with it. ``individual_rank`` is the place by training pps. Both are empty
    without members. Rows that tie to four digits keep the order of training pps and of trees.
    """
    spark, members = panel.sparkSession, by_train(members)
    if not members:
        return spark.createDataFrame([], MEMBER_KIND), spark.createDataFrame([], TREE_KIND)
    found = []
    for wide, places in wide_signals(panel, members, features, [y], scope, digits):
        rows = {r.name: r for r in scored(wide, sorted(set(places.values())), y, scope.order).select("name", *_rounded(MEMBER_SCORES)).collect()}
        found += [(place, *rows[column][1:]) for place, column in places.items()]
    values = {place: scores for place, *scores in found}
    own = [(k, *values[f"m{k}"], round(m.pps, 4), m.complexity) for k, m in enumerate(members, 1)]
    trees = [(k, i, *values[f"t{k}_{i}"], t.size, t.depth) for k, m in enumerate(members, 1) for i, t in enumerate(m.trees, 1)]
    own = spark.createDataFrame(own, MEMBER_KIND).withColumn("rank", F.row_number().over(W.orderBy(F.desc("oos_pps"), "rank")))
    ranked = F.row_number().over(W.partitionBy("individual_rank").orderBy(F.desc("oos_pps"), "tree_idx"))
    return own, spark.createDataFrame(trees, TREE_KIND.rpartition(",")[0]).withColumn("tree_rank", ranked)


def member_signals(panel: DataFrame, members: list[Individual], features: list[str], scope: Scope = GLOBAL) -> DataFrame:
    """The row order and one column for each member, named by its place by training pps and that pps."""
    members, out = by_train(members), None
    for wide, places in wide_signals(panel, members, features, [], scope):
        named = wide.select(scope.order, *(F.col(p).alias(signal_name(int(p[1:]), members[int(p[1:]) - 1])) for p in places if p[0] == "m"))
        out = named if out is None else out.join(named, scope.order)
    return panel.select(scope.order) if out is None else out


def signal_name(k: int, m: Individual) -> str:
    return f"member_{k:02d}_pps{round(m.pps, 3)}"


def overfit(member_rows: list) -> dict[str, float | None]:
    """Mean training and out-of-sample pps, and the loss in per cent; None where the training mean isn't above 0."""
    if not member_rows:
        return {"train_pps": 0.0, "oos_pps": 0.0, "degradation": None}
    train, test = (sum(r[c] for r in member_rows) / len(member_rows) for c in ("train_pps", "oos_pps"))
    return {"train_pps": train, "oos_pps": test, "degradation": (train - test) / train * 100 if train > 0 else None}


def overfit_table(members: DataFrame) -> DataFrame:
    """``overfit`` of a members' table as one row: train_pps, oos_pps, degradation (null where the training mean isn't above 0)."""
    train, test = (F.coalesce(F.avg(c), F.lit(0.0)) for c in ("train_pps", "oos_pps"))
    return members.agg(train.alias("train_pps"), test.alias("oos_pps")).withColumn("degradation", F.when(F.col("train_pps") > 0, (F.col("train_pps") - F.col("oos_pps")) / F.col("train_pps") * 100))


def table_text(rows: list, columns: list[str], most: int | None = None) -> str:
    """A plain table; ``most``: so many rows are shown."""
    shown = rows if most is None else rows[:most]
    cells = [columns, *([f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in shown)]
    widths = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in cells]
    lines.insert(1, "-" * sum(w + 2 for w in widths))
    return "\n".join(lines + [f"first {len(shown)} of {len(rows)} rows"] * (len(shown) < len(rows)))


def report_text(member_rows: list, tree_rows: list, most_trees: int = 20) -> str:
    """The members' table, the best member, the overfit check and the trees of each member."""
    if not member_rows:
        return "no members"
    check = overfit(member_rows)
    loss = "" if check["degradation"] is None else f" ({check['degradation']:.1f} % lost)"
    out = [table_text(member_rows, MEMBER_KIND.replace(" int", "").replace(" double", "").split(", ")), f"mean pps: training {check['train_pps']:.4f}, out of sample {check['oos_pps']:.4f}{loss}"]
    for k in sorted({r.individual_rank for r in tree_rows}):
        own = sorted((r for r in tree_rows if r.individual_rank == k), key=lambda r: r.tree_rank)
        out.append(table_text(own, TREE_KIND.replace(" int", "").replace(" double", "").split(", "), most_trees))
    return "\n\n".join(out)


@dataclass
class Discovery:
    """What a run gives: the front, both tables and the formulas of the best member by training pps."""

    front: ParetoHoF
    members: DataFrame
    trees: DataFrame
    best: list[str]
    text: str


def discover(spark: SparkSession, csv_dir: str, out_dir: str, cfg: GPConfig, horizon: int = 5, train_fraction: float = 0.7, close: str = "close", time: str = "open_time", target: str = "reference", least_train: int = 50, block_rows: int | None = None) -> Discovery:
    """From a folder of assets to results: read, target, split by date, search on the training rows, score on the others, write.

    Writes ``summary`` and ``trees`` as CSV and ``signals`` as Parquet, with a column for each member, to ``out_dir``. The training rows are a
    matrix that the search holds in memory, or with ``block_rows`` a table that it reads in blocks; the others may be of any size.
    """
    panel = with_row_id(read_csv_assets(spark, csv_dir, time, close), ["asset", "ts"])
    panel = written(forward_target(panel, horizon, close=close, target=target), "panel")
    features = [c for c in panel.columns if c not in ("asset", "ts", "row_id", "y")]
    train, test = date_split(panel, train_fraction, least_train=least_train)
    if block_rows is None:
        front = run_gp(spark, *panel_matrix(train, features, "y"), cfg)
    else:
        front = run_gp_panel(train, features, "y", cfg, block_rows=block_rows)
    test = written(with_row_id(test.drop("row_id"), ["asset", "ts"]), "test-panel")
    members, trees = (written(df, "report") for df in evaluate_oos(test, front.members, features))
    write_csv(members.orderBy("rank"), f"{out_dir}/summary")
    write_csv(trees.orderBy("individual_rank", "tree_rank"), f"{out_dir}/trees")
    write_signals(member_signals(test, front.members, features), f"{out_dir}/signals")
    text = report_text(members.orderBy("rank").collect(), trees.collect())
    return Discovery(front, members, trees, [str(t) for m in by_train(front.members)[:1] for t in m.trees], text)
