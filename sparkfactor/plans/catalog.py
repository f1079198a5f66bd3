"""Named queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elementwise import half_up
from ..functions.registry import OPS, register_op
from ..functions.ranking import tied_ranks
from ..functions.scope import GLOBAL, Scope
from ..config import GPConfig
from ..operators import archive, forest, fronts, metrics, neighbours, population
from ..operators.combine import combine
from ..sources.panel import date_cutoff, date_split, drop_missing, events_panel, forward_target, read_csv_assets, stack_assets, with_row_id, write_csv_assets
from ..sources.shared import fresh, written
from .compiler import compile_forest
from .ir import call, parse, variable

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FEATURES = ["x1", "x2", "x3", "x4"]
BY_DAY = Scope("panel", asset="asset", date="day")
WINDOW = 10

#: The events panel in SQL; used as a WITH list.
PANEL = """panel as (select event_id as row_id, cast(user_id as varchar) as asset, ts, cast(ts as date) as day, value as x1,
  cast(json_extract_string(props, '$.k') as double) as x2, cast(hour(ts) as double) as x3, cast(user_id as double) as x4 from events)"""


def add(name: str, run, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} exists")
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


# ---- operators, in SQL over x and y -------------------------------------------------------------------------------------------

_CLAMP = "greatest({lo}, least({x}, {hi}))"
ELEMENT_SQL = {
    "safe_sqrt": "sqrt(abs({x}) + 1e-6)",
    "safe_log": "ln(abs({x}) + 1e-6)",
    "safe_inv": "1.0 / (abs({x}) + 1e-6)",
    "safe_neg": "-{x}",
    "safe_sin": f"sin({_CLAMP.format(lo='-1e4', hi='1e4', x='{x}')})",
    "safe_cos": f"cos({_CLAMP.format(lo='-1e4', hi='1e4', x='{x}')})",
    "safe_tan": f"tan({_CLAMP.format(lo='-1.5', hi='1.5', x='{x}')})",
    "safe_tanh": "(1 - 2 / (exp(2 * least({x}, 300)) + 1))",
    "abs": "abs({x})",
    "safe_add": "{x} + {y}",
    "safe_sub": "{x} - {y}",
    "safe_mul": "{x} * {y}",
    "safe_div": "{x} / (abs({y}) + 1e-6)",
    "safe_pow": f"pow(abs({{x}}), {_CLAMP.format(lo='-5.0', hi='5.0', x='{y}')})",
    "signed_power": f"sign({{x}}) * pow(abs({{x}}), {_CLAMP.format(lo='-5.0', hi='5.0', x='{y}')})",
}


def rolling_sql(op: str, x: str, y: str, d: int, part: str) -> str:
    """A rolling operator over ``x`` (and ``y``); ``part`` is empty or a PARTITION BY clause."""
    order, frame = f"({part} order by row_id)", f"({part} order by row_id rows between {d - 1} preceding and current row)"
    full = lambda v: f"case when row_number() over {order} < {d} then 0.0 else {v} end"
    lag = lambda k: f"lag({x}, {k}) over {order}" if k else x
    norm = f"sqrt(var_pop({x}) over {frame} * {d} * var_pop({y}) over {frame} * {d})"
    return {
        "ts_delta": f"coalesce({x} - {lag(d)}, 0.0)",
        "ts_mean": full(f"avg({x}) over {frame}"),
        "ts_sum": full(f"sum({x}) over {frame}"),
        "ts_max": full(f"max({x}) over {frame}"),
        "ts_min": full(f"min({x}) over {frame}"),
        "ts_stddev": full(f"case when var_samp({x}) over {frame} < 1e-12 then 0.0 else sqrt(var_samp({x}) over {frame}) end"),
        "ts_rank": full(f"len(list_filter(list({x}) over {frame}, lambda e: e <= {x})) / {float(d)}"),
        "decay": f"coalesce(({' + '.join(f'{d - k} * {lag(k)}' for k in range(d))}) / {d * (d + 1) / 2}, 0.0)",
        "ts_corr": full(f"case when {norm} < 1e-8 then 0.0 else covar_pop({x}, {y}) over {frame} * {d} / {norm} end"),
        "ts_cov": full(f"covar_samp({x}, {y}) over {frame}"),
    }[op]


def cross_sql(op: str, x: str, part: str) -> str:
    over = f"over ({part})"
    mean, sd = f"avg({x}) {over}", f"coalesce(stddev_samp({x}) {over}, 0.0)"
    return {
        "cs_rank": f"row_number() over ({part} order by {x}, row_id) / cast(count(*) {over} as double)",
        "cs_zscore": f"case when {sd} < 1e-8 then 0.0 else ({x} - {mean}) / {sd} end",
        "cs_scale": f"case when sum(abs({x})) {over} < 1e-8 then {x} else {x} / sum(abs({x})) {over} end",
        "cs_winsorize": f"case when {sd} < 1e-8 then {x} else greatest({mean} - 3 * {sd}, least({x}, {mean} + 3 * {sd})) end",
    }[op]


def _tree_query(tree, scope: Scope):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compile_forest(events_panel(spark, sf_dir), {"f": tree}, FEATURES, scope)
        return out.select("row_id", half_up("f", 6).alias("f"))

    return run


def _sql(expr: str, with_: str = PANEL, source: str = "panel") -> str:
    return f"with {with_} select row_id, round({expr}, 6) as f from {source}"


for _op in OPS.values():
    _args = ("x1", "x2") if _op.arity == 2 else ("x1",)
    _x, _y = _args[0], _args[-1]
    if _op.elementwise:
        # powers stay in a range where all digits agree
        if _op.name in ("safe_pow", "signed_power"):
            _tree = parse(f"{_op.name}(safe_sub(x3, 11.5), safe_mul(x2, 0.02))")
            _expr = ELEMENT_SQL[_op.name].format(x="(x3 - 11.5)", y="(x2 * 0.02)")
        else:
            _tree = call(_op.name, *(variable(int(a[1:])) for a in _args))
            _expr = ELEMENT_SQL[_op.name].format(x=_x, y=_y)
        add(_op.name, _tree_query(_tree, GLOBAL), _sql(_expr))
    elif _op.rolling:
        _tree = call(_op.name, *(variable(int(a[1:])) for a in _args), window=WINDOW)
        add(_op.name, _tree_query(_tree, GLOBAL), _sql(rolling_sql(_op.name, _x, _y, WINDOW, "")))
        add(f"{_op.name}_panel", _tree_query(_tree, BY_DAY), _sql(rolling_sql(_op.name, _x, _y, WINDOW, "partition by asset")))
    else:
        _scale = "scale" in _op.name
        _tree = call("safe_mul", call(_op.name, variable(1)), parse("1000.0")) if _scale else call(_op.name, variable(1))
        for _suffix, _scope, _part in (("", GLOBAL, ""), ("_panel", BY_DAY, "partition by day")):
            _expr = cross_sql(_op.name, _x, _part)
            add(_op.name + _suffix, _tree_query(_tree, _scope), _sql(f"({_expr}) * 1000.0" if _scale else _expr))


# powers of 0, to negative exponents as well: infinite, and NaN with a sign
for _name in ("safe_pow", "signed_power"):
    _x, _y = "(x3 - 12)", "((x2 - 50) * 0.02)"
    add(f"{_name}_of_zero", _tree_query(parse(f"{_name}(safe_sub(x3, 12.0), safe_mul(safe_sub(x2, 50.0), 0.02))"), GLOBAL), _sql(ELEMENT_SQL[_name].format(x=_x, y=_y)))

#: A window as long as a year of trading days, in plans that don't grow with it.
WIDE = 250


def wide_sql(op: str, d: int, part: str) -> str:
    """``decay`` without a lag for each row of the window; the others as for any window."""
    if op != "decay":
        return rolling_sql(op, "x1", "x1", d, part)
    frame = f"({part} order by row_id rows between {d - 1} preceding and current row)"
    return f"case when row_number() over ({part} order by row_id) < {d} then 0.0 else list_sum(list_transform(list(x1) over {frame}, lambda v, i: v * i)) / {d * (d + 1) / 2} end"


for _name in ("ts_rank", "decay", "ts_max", "ts_min"):
    add(f"{_name}_{WIDE}", _tree_query(call(_name, variable(1), window=WIDE), GLOBAL), _sql(wide_sql(_name, WIDE, "")))
for _name in ("ts_rank", "decay"):
    add(f"{_name}_40_panel", _tree_query(call(_name, variable(1), window=40), BY_DAY), _sql(wide_sql(_name, 40, "partition by asset")))


def median_kernel(v: np.ndarray, d: int) -> np.ndarray:
    """An operator as a user adds one, with a kernel alone: the median of the last ``d`` rows, 0 before there are so many."""
    out = np.zeros(len(v))
    if d <= len(v):
        out[d - 1 :] = np.median(np.lib.stride_tricks.sliding_window_view(v, d), axis=1)
    return out


def _added_op(scope: Scope):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if "ts_median" not in OPS:
            register_op("ts_median", "ts_unary", median_kernel, searched=False)
        return _tree_query(parse("safe_sub(ts_mean(x1, d=3), ts_median(ts_delta(x1, d=2), d=15))"), scope)(spark, sf_dir)

    return run


def _median_sql(part: str) -> str:
    delta = f"(select *, {rolling_sql('ts_delta', 'x1', '', 2, part)} as m from panel)"
    middle = f"case when row_number() over ({part} order by row_id) < 15 then 0.0 else median(m) over ({part} order by row_id rows between 14 preceding and current row) end"
    return f"with {PANEL} select row_id, round({rolling_sql('ts_mean', 'x1', '', 3, part)} - {middle}, 6) as f from {delta}"


add("added_op", _added_op(GLOBAL), _median_sql(""))
add("added_op_panel", _added_op(BY_DAY), _median_sql("partition by asset"))


# ---- metrics over a signal and the five-step target ----------------------------------------------------------------------------

_MEAN = rolling_sql("ts_mean", "x1", "x1", WINDOW, "")
SIGNAL = f"""{PANEL},
sig as (select * from (select row_id, {_MEAN} as f, lead(x1, 5) over (partition by asset order by row_id) / nullif(x1, 0) - 1 as y0,
  lead(x1, 5) over (partition by asset order by row_id) as ahead from panel) where ahead is not null),
s as (select row_id, f, coalesce(y0, 0.0) as y from sig),
r as (select row_id, f, y, rank() over (order by f) + (count(*) over (partition by f) - 1) / 2.0 as rf,
  rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from s)"""


def corr_sql(f: str, y: str) -> str:
    sf, sy = f"coalesce(stddev_samp({f}), 0.0)", f"coalesce(stddev_samp({y}), 0.0)"
    return f"case when {sf} < 1e-8 or {sy} < 1e-8 then 0.0 else covar_samp({f}, {y}) / ({sf} * {sy}) end"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, f, y): the ten-row mean of x1 against the simple five-step return of each asset."""
    panel = compile_forest(events_panel(spark, sf_dir), {"f": call("ts_mean", variable(1), window=WINDOW)}, FEATURES)
    return forward_target(panel, 5, close="x1", target="simple_return").select("row_id", "f", "y")


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(half_up(c, 6).alias(c) for c in df.columns if c not in keep))


add("tiedrank", lambda s, d: tied_ranks(signal(s, d).select("row_id", "f"), "f", "rank").select("row_id", "rank"), f"with {SIGNAL} select row_id, cast(rf as double) as rank from r")
add("ic", lambda s, d: _rounded(metrics.ic(signal(s, d))), f"with {SIGNAL} select round({corr_sql('f', 'y')}, 6) as ic from s")
add("rank_ic", lambda s, d: _rounded(metrics.rank_ic(signal(s, d))), f"with {SIGNAL} select round({corr_sql('rf', 'ry')}, 6) as rank_ic from r")
add(
    "pps",
    lambda s, d: _rounded(metrics.pps(signal(s, d))),
    f"with {SIGNAL}, m as (select {corr_sql('f', 'y')} as ic, {corr_sql('rf', 'ry')} as rank_ic from r) select round(ic, 6) as ic, round(rank_ic, 6) as rank_ic, round(0.3 * ic + 0.7 * rank_ic, 6) as pps from m",
)


def rre_sql(source: str, rank: str, by: str = "") -> str:
    """(by, rre) from tied ranks."""
    group, comma = (f"group by {by}", f"{by}, ") if by else ("", "")
    part = f"partition by {by}" if by else ""
    return f"""select {comma}1 + sum(p * ln(p)) / ln(10) as rre from (select {comma}bin, count(*) / cast(sum(count(*)) over ({part}) as double) as p
  from (select {comma}least(ceil({rank} / count(*) over ({part}) * 10), 10) as bin from {source}) group by {comma}bin) {group}"""


add("rre", lambda s, d: _rounded(metrics.rre(signal(s, d))), f"with {SIGNAL} select round(rre, 6) as rre from ({rre_sql('r', 'rf')})")

_PERIODS = f"""{SIGNAL}, c as (select *, (row_number() over (order by row_id) - 1) // (count(*) over () // 20) as period from s),
pr as (select period, rank() over (partition by period order by f) + (count(*) over (partition by period, f) - 1) / 2.0 as rf,
  rank() over (partition by period order by y) + (count(*) over (partition by period, y) - 1) / 2.0 as ry from c where period < 20),
ics as (select cast(period as bigint) as period, {corr_sql("rf", "ry")} as rank_ic from pr group by period)"""
add("rolling_rank_ic", lambda s, d: _rounded(metrics.rolling_rank_ic(signal(s, d), 20), "period"), f"with {_PERIODS} select period, round(rank_ic, 6) as rank_ic from ics")
add(
    "icir",
    lambda s, d: _rounded(metrics.icir(signal(s, d), 20)),
    f"with {_PERIODS} select round(case when coalesce(stddev_samp(rank_ic), 0) < 1e-8 then 0.0 else avg(rank_ic) / stddev_samp(rank_ic) end, 6) as icir from ics",
)
add(
    "error_matrix",
    lambda s, d: _rounded(metrics.error_matrix(signal(s, d).withColumn("zero", F.lit(0.0)), ["f", "zero"], 20), "signal", "period"),
    f"""with {SIGNAL}, c as (select f, y, least((row_number() over (order by row_id) - 1) // (count(*) over () // 20), 19) as period from s)
select 'f' as signal, cast(period as bigint) as period, round(avg(abs(f - y)), 6) as err from c group by period
union all select 'zero', cast(period as bigint), round(avg(abs(0.0 - y)), 6) from c group by period""",
)


def _normal_sql(copy: int, k: int) -> str:
    """The draw of ``metrics.normal_draw`` for seed 42."""
    u = [f"((cast('0x' || substr(md5('42-{copy}-{k}-' || row_id), {at}, 13) as bigint) + 0.5) / {float(1 << 52)})" for at in (1, 14)]
    return f"sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]})"


_MOVED = ", ".join(f"x1 + {_normal_sql(c, 1)} * 0.01 * s1 as a{c}, x2 + {_normal_sql(c, 2)} * 0.01 * s2 as b{c}" for c in range(5))
_COPIES = ", ".join(f"{rolling_sql('ts_mean', f'(a{c} * b{c})', '', 5, '')} as f{c}" for c in range(5))
_RANKS = ", ".join(f"rank() over (order by {f}) + (count(*) over (partition by {f}) - 1) / 2.0 as r{f}" for f in ("f", *(f"f{c}" for c in range(5))))
add(
    "pfs",
    lambda s, d: _rounded(metrics.pfs(events_panel(s, d), parse("ts_mean(safe_mul(x1, x2), d=5)"), FEATURES, GLOBAL)),
    f"""with {PANEL}, sp as (select greatest(stddev_samp(x1), 1e-8) as s1, greatest(stddev_samp(x2), 1e-8) as s2 from panel),
moved as (select row_id, x1, x2, {_MOVED} from panel, sp),
sig as (select row_id, {rolling_sql("ts_mean", "(x1 * x2)", "", 5, "")} as f, {_COPIES} from moved), r as (select {_RANKS} from sig)
select round(({" + ".join(corr_sql("rf", f"rf{c}") for c in range(5))}) / 5, 6) as pfs from r""",
)


# ---- composed trees and combinations --------------------------------------------------------------------------------------------

_TREES = {
    "momentum": "ts_mean(ts_delta(x1, d=3), d=5)",
    "spread": "safe_div(safe_sub(x1, ts_mean(x1, d=10)), ts_stddev(x1, d=10))",
    "ranked": "cs_rank(ts_sum(x2, d=5))",
    "mixed": "safe_add(safe_log(x1), safe_mul(0.5, ts_corr(x1, x2, d=10)))",
    "scored": "safe_tanh(cs_zscore(ts_max(x1, d=5)))",
    "decayed": "decay(safe_sqrt(safe_mul(x1, x3)), d=5)",
}
_ZS = "case when coalesce(stddev_samp(m) over (), 0.0) < 1e-8 then 0.0 else (m - avg(m) over ()) / stddev_samp(m) over () end"
_TREE_STEPS = {
    "momentum": (f"{PANEL}, t as (select *, {rolling_sql('ts_delta', 'x1', '', 3, '')} as m from panel)", rolling_sql("ts_mean", "m", "", 5, "")),
    "spread": (PANEL, f"(x1 - {rolling_sql('ts_mean', 'x1', '', 10, '')}) / (abs({rolling_sql('ts_stddev', 'x1', '', 10, '')}) + 1e-6)"),
    "ranked": (f"{PANEL}, t as (select *, {rolling_sql('ts_sum', 'x2', '', 5, '')} as m from panel)", cross_sql("cs_rank", "m", "")),
    "mixed": (PANEL, f"ln(abs(x1) + 1e-6) + 0.5 * ({rolling_sql('ts_corr', 'x1', 'x2', 10, '')})"),
    "scored": (f"{PANEL}, u as (select *, {rolling_sql('ts_max', 'x1', '', 5, '')} as m from panel), t as (select *, {_ZS} as z from u)", ELEMENT_SQL["safe_tanh"].format(x="z")),
    "decayed": (f"{PANEL}, t as (select *, sqrt(abs(x1 * x3) + 1e-6) as m from panel)", rolling_sql("decay", "m", "", 5, "")),
}
for _name, _text in _TREES.items():
    _with, _expr = _TREE_STEPS[_name]
    add(f"tree_{_name}", _tree_query(parse(_text), GLOBAL), _sql(_expr, _with, "t" if " t as " in _with else "panel"))

_THREE = ("momentum", "spread", "decayed")


def _combined(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = compile_forest(events_panel(spark, sf_dir), {n: parse(_TREES[n]) for n in _THREE}, FEATURES)
        return _rounded(combine(df, list(_THREE), how, weights=[0.5, 0.3, 0.2]).select("row_id", "f"), "row_id")

    return run


_COMBINED = f"""{PANEL}, a as (select *, {rolling_sql("ts_delta", "x1", "", 3, "")} as m, sqrt(abs(x1 * x3) + 1e-6) as q from panel),
t as (select row_id, {rolling_sql("ts_mean", "m", "", 5, "")} as momentum, {_TREE_STEPS["spread"][1]} as spread, {rolling_sql("decay", "q", "", 5, "")} as decayed from a)"""
for _how, _expr in {
    "weighted_sum": "0.5 * momentum + 0.3 * spread + 0.2 * decayed",
    "rank_average": f"({' + '.join(cross_sql('cs_rank', f'round({n}, 9)', '') for n in _THREE)}) / 3",
    "vote": f"cast(sign({' + '.join(f'sign({n})' for n in _THREE)}) as double)",
}.items():
    if _how == "rank_average":
        # ranks of values equal but for the last digit would hang on the engine, so both sides rank to nine digits
        def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = compile_forest(events_panel(spark, sf_dir), {n: parse(_TREES[n]) for n in _THREE}, FEATURES)
            df = df.withColumns({n: half_up(n, 9) for n in _THREE})
            return _rounded(combine(df, list(_THREE), "rank_average").select("row_id", "f"), "row_id")

        add("combine_rank_average", _ranked, _sql(_expr, _COMBINED, "t"))
    else:
        add(f"combine_{_how}", _combined(_how), _sql(_expr, _COMBINED, "t"))


# ---- the panel pipeline ---------------------------------------------------------------------------------------------------------


def _cross_target(target: str):
    return lambda s, d: _rounded(forward_target(events_panel(s, d), 5, close="x1", target=target).select("row_id", "y"), "row_id")


_AHEAD = f"{PANEL}, t as (select row_id, x1, lead(x1, 5) over (partition by asset order by row_id) as ahead from panel)"
_OVER_ZERO = "case when ahead = 0 then 'nan'::double when ahead > 0 then 'inf'::double else '-inf'::double end"
add(
    "forward_target",
    _cross_target("reference"),
    f"with {_AHEAD} select row_id, case when x1 = 0 then {_OVER_ZERO} else round(ahead / x1 / x1, 6) end as y from t where ahead is not null",
)
add("forward_simple_return", _cross_target("simple_return"), f"with {_AHEAD} select row_id, round(coalesce(ahead / nullif(x1, 0) - 1, 0.0), 6) as y from t where ahead is not null")


def date_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = date_split(events_panel(spark, sf_dir), 0.7, "day")
    sums = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    return sums(train, "train").unionByName(sums(test, "test"))


def csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events written as CSV assets, with missing cells, and read again; rows that miss any are gone."""
    panel, k = events_panel(spark, sf_dir), F.col("row_id") % 50
    gaps = F.when(k == 0, "NA").when(k == 1, "").when(k == 2, "null").when(k == 3, "NaN").otherwise(F.col("x1").cast("string"))
    cells = panel.select("asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("open_time"), gaps.alias("close"), F.col("x2").cast("string").alias("x2"), F.col("row_id").cast("string").alias("row_id"))
    folder = fresh(spark, "csv-assets")
    write_csv_assets(cells, folder)
    out = read_csv_assets(spark, folder, by_folder=True)
    return out.select(F.col("row_id").cast("long").alias("row_id"), "asset", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "close", "x2")


add(
    "csv_assets",
    csv_query,
    f"with {PANEL} select row_id, asset, epoch_us(ts) as micros, x1 as close, x2 from panel where row_id % 50 > 3 and x1 is not null and not isnan(x1) and x2 is not null",
)
add(
    "date_split",
    date_split_query,
    f"""with {PANEL}, days as (select day, row_number() over (order by day) as k, count(*) over () as n from (select distinct day from panel)),
cut as (select day as c from days where k = greatest(1, cast(floor(n * 0.7) as bigint)))
select case when day <= c then 'train' else 'test' end as part, count(*) as n, min(row_id) as first, max(row_id) as last from panel, cut group by 1""",
)
add(
    "drop_missing",
    lambda s, d: drop_missing(
        events_panel(s, d).select("row_id", F.when(F.col("row_id") % 7 == 0, "NA").when(F.col("row_id") % 11 == 0, "").otherwise(F.col("asset")).alias("asset"), F.when(F.col("row_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("x1")).alias("x1"))
    ),
    f"with {PANEL} select row_id, asset, x1 from panel where row_id % 7 <> 0 and row_id % 11 <> 0 and row_id % 13 <> 0",
)


def stack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type as an asset, stacked one behind the other."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = sorted(r.event_type for r in e.select("event_type").distinct().collect() if r.event_type is not None)
    frames = [e.where(F.col("event_type") == t).select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("x1")) for t in kinds]
    return stack_assets(frames).select("row_id", "asset", "x1")


add(
    "stack_assets",
    stack_query,
    "select row_number() over (order by event_type, ts) - 1 as row_id, event_type as asset, value as x1 from events where event_type is not null",
)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every factor's scores on the rows behind the 70 % date; the ranks are made within the factor."""
    from ..operators.evaluation import signal_scores

    events = events_panel(spark, sf_dir)
    # the cutoff needs no factor, so it is taken from the rows alone
    cut = date_cutoff(forward_target(events, 5, close="x1", target="simple_return"), 0.7, "day")
    panel = compile_forest(events, {n: parse(t) for n, t in _TREES.items()}, FEATURES)
    panel = forward_target(panel, 5, close="x1", target="simple_return")
    test = panel.withColumn("_cut", cut).where(F.col("day") > F.col("_cut"))
    wide = written(test.select("row_id", "y", *(half_up(n, 9).alias(n) for n in _TREES)), "factors")
    scores = signal_scores(wide, list(_TREES), "y", "row_id").withColumnRenamed("name", "factor")
    sizes = spark.createDataFrame([(n, parse(t).size, parse(t).depth) for n, t in _TREES.items()], "factor string, size int, depth int")
    out = scores.join(F.broadcast(sizes), "factor")
    return out.select("factor", *(half_up(c, 4).alias(c) for c in ("pps", "ic", "rank_ic", "rre")), "size", "depth")


_FORESTS = f"""{PANEL}, a as (select *, {rolling_sql("ts_delta", "x1", "", 3, "")} as m1, sqrt(abs(x1 * x3) + 1e-6) as m2, {rolling_sql("ts_sum", "x2", "", 5, "")} as m3,
  {rolling_sql("ts_max", "x1", "", 5, "")} as m from panel), b as (select *, {_ZS} as z from a),
t as (select row_id, day, asset, x1, {rolling_sql("ts_mean", "m1", "", 5, "")} as momentum, {_TREE_STEPS["spread"][1]} as spread, {cross_sql("cs_rank", "m3", "")} as ranked,
  {_TREE_STEPS["mixed"][1]} as mixed, {ELEMENT_SQL["safe_tanh"].format(x="z")} as scored, {rolling_sql("decay", "m2", "", 5, "")} as decayed,
  lead(x1, 5) over (partition by asset order by row_id) as ahead from b)"""
_REPORT = f"""with {_FORESTS}, kept as (select *, coalesce(ahead / nullif(x1, 0) - 1, 0.0) as y from t where ahead is not null),
days as (select day, row_number() over (order by day) as k, count(*) over () as n from (select distinct day from kept)),
cut as (select day as c from days where k = greatest(1, cast(floor(n * 0.7) as bigint))), test as (select kept.* from kept, cut where day > c),
long as ({" union all ".join(f"select '{n}' as factor, round({n}, 9) as f, y from test" for n in _TREES)}),
r as (select factor, f, y, rank() over (partition by factor order by f) + (count(*) over (partition by factor, f) - 1) / 2.0 as rf,
  rank() over (partition by factor order by y) + (count(*) over (partition by factor, y) - 1) / 2.0 as ry from long),
m as (select factor, {corr_sql("f", "y")} as ic, {corr_sql("rf", "ry")} as rank_ic from r group by factor), e as ({rre_sql("r", "rf", "factor")}),
sizes(factor, size, depth) as (values {", ".join(f"('{n}', {parse(t).size}, {parse(t).depth})" for n, t in _TREES.items())})
select factor, round(0.3 * ic + 0.7 * rank_ic, 4) as pps, round(ic, 4) as ic, round(rank_ic, 4) as rank_ic, round(rre, 4) as rre, size, depth
from m join e using (factor) join sizes using (factor)"""
add("factor_report", report, _REPORT)


# ---- population analytics -------------------------------------------------------------------------------------------------------


def knn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ind_id"), F.col("embedding").alias("behavior"))
    return _rounded(neighbours.knn_novelty(own, 10), "ind_id")


add(
    "knn_novelty",
    knn_query,
    """with d as (select a.vec_id as ind_id, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(cast(a.embedding[i] as double) - cast(b.embedding[i] as double), 2)))) as d
  from embeddings a join embeddings b on a.vec_id <> b.vec_id)
select ind_id, round(avg(d), 6) as novelty from (select ind_id, d from d qualify row_number() over (partition by ind_id order by d) <= 10) group by ind_id""",
)
ARCHIVE_SIZE, ARCHIVE_K = 50, 5


def archive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an archive of 50 holds after all embeddings were offered in order."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ind_id"), F.col("embedding").alias("behavior"))
    return archive.novelty_archive(own, ARCHIVE_SIZE, ARCHIVE_K)


add("novelty_archive", archive_query)
_MEMBERS = "(select p_partkey as ind_id, p_retailprice as pps, cast(p_partkey % 97 as double) as rre, p_size as complexity from part)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("ind_id"), F.col("p_retailprice").alias("pps"), (F.col("p_partkey") % 97).cast("double").alias("rre"), F.col("p_size").alias("complexity"))


_DOMINATES = "{o}.pps >= {m}.pps and {o}.rre >= {m}.rre and {o}.complexity <= {m}.complexity and ({o}.pps > {m}.pps or {o}.rre > {m}.rre or {o}.complexity < {m}.complexity)"
add(
    "pareto_front",
    lambda s, d: fronts.pareto_front(_members(s, d)),
    f"""with m as (select * from {_MEMBERS} where isfinite(pps) and isfinite(rre) and complexity is not null qualify row_number() over (partition by pps, rre, complexity order by ind_id) = 1)
select * from m where not exists (select 1 from m o where {_DOMINATES.format(o="o", m="m")})""",
)

HALL_SIZE, ARRIVALS = 12, 5


def hall_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hall of fame after all parts have arrived in five batches; prices in thousands, so that all objectives weigh in the distances."""
    members = _members(spark, sf_dir).withColumns({"pps": F.col("pps") / 1000, "rre": F.col("rre") / 97, "batch": F.col("ind_id") % ARRIVALS})
    return fronts.hall_of_fame(members, HALL_SIZE).select("place", "ind_id", half_up("pps", 6).alias("pps"), half_up("rre", 6).alias("rre"), "complexity")


_GAP = "pow(h[i].pps - h[j].pps, 2) + pow(h[i].rre - h[j].rre, 2) + pow((h[i].complexity - h[j].complexity) / cast(greatest(h[i].complexity, h[j].complexity, 1) as double), 2)"
_CLOSEST = f"list_min(flatten(list_transform(range(1, len(h) + 1), lambda i: list_transform(range(i + 1, len(h) + 1), lambda j: {{'d': {_GAP}, 'i': i, 'j': j}}))))"
add(
    "hall_of_fame",
    hall_query,
    # one step lets a batch in, or trims one member of a hall that is too large
    f"""with recursive m as (select ind_id, pps / 1000 as pps, rre / 97 as rre, complexity, ind_id % {ARRIVALS} as batch from {_MEMBERS} where isfinite(pps) and isfinite(rre) and complexity is not null),
b as (select batch, list({{'ind_id': ind_id, 'pps': pps, 'rre': rre, 'complexity': complexity}} order by ind_id) as l from m group by batch),
s(k, h) as (select 0::bigint, [{{'ind_id': 0::bigint, 'pps': 0::double, 'rre': 0::double, 'complexity': 0::int}}][1:0]
  union all select case when len(h) > {HALL_SIZE} then k else k + 1 end, case when len(h) > {HALL_SIZE}
    then list_filter(h, lambda x, n: n <> case when h[c.i].pps <= h[c.j].pps then c.i else c.j end)
    else list_filter(list_concat(h, l), lambda x, n: len(list_filter(list_concat(h, l), lambda o, w: ({_DOMINATES.format(o="o", m="x")}) or (w < n and o.pps = x.pps and o.rre = x.rre and o.complexity = x.complexity))) = 0) end
  from (select k, h, case when len(h) > {HALL_SIZE} then {_CLOSEST} end as c from s) left join b on b.batch = k where k < {ARRIVALS} or len(h) > {HALL_SIZE})
select cast(n as bigint) as place, x.ind_id as ind_id, round(x.pps, 6) as pps, round(x.rre, 6) as rre, x.complexity as complexity
from (select unnest(range(1, len(h) + 1)) as n, unnest(h) as x from s where k = {ARRIVALS} and len(h) <= {HALL_SIZE})""",
)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ind_id"), F.col("s_acctbal").alias("fitness"))


def tournament_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many slots as the pool has members, as one generation asks for."""
    pool = _pool(spark, sf_dir)
    n = pool.agg(F.count(F.lit(1)), F.min("ind_id")).first()
    draws = spark.range(n[0] * 5).select((F.col("id") / 5).cast("long").alias("slot"), (F.col("id") % 5).alias("draw"))
    drawn = draws.withColumn("ind_id", (F.col("slot") * 7919 + F.col("draw") * 104729) % n[0] + n[1])
    return population.tournament(pool, drawn)


add(
    "tournament_select",
    tournament_query,
    """with n as (select count(*) as n, min(s_suppkey) as lo from supplier),
slots as (select row_number() over () - 1 as slot from supplier), dr as (select unnest(range(5)) as draw),
d as (select slot, draw, (slot * 7919 + draw * 104729) % n + lo as ind_id from slots, dr, n)
select slot, ind_id, s_acctbal as fitness from d join supplier on s_suppkey = ind_id qualify row_number() over (partition by slot order by s_acctbal desc, draw) = 1""",
)


def lexicase_errors(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("ind_id"), F.abs(F.col("p_size") - 25).cast("double").alias("e0"), (F.col("p_partkey") % 5).cast("double").alias("e1"), (F.col("p_retailprice") / 100).alias("e2"))


def lexicase_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors among all parts over three error columns, for each order of periods."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return population.lexicase(lexicase_errors(part), [["e0", "e1", "e2"], ["e1", "e0", "e2"], ["e2", "e1", "e0"]], 2.0)


def _lexicase_sql(order: tuple[int, ...], slot: int) -> str:
    steps, source = [], "e"
    for k in order:
        steps.append(f"select * from {source} where e{k} <= (select min(e{k}) from {source}) + 2.0")
        source = f"({steps[-1]})"
    return f"select {slot} as slot, ind_id from {source}"


add(
    "epsilon_lexicase",
    lexicase_query,
    "with e as (select p_partkey as ind_id, cast(abs(p_size - 25) as double) as e0, cast(p_partkey % 5 as double) as e1, p_retailprice / 100 as e2 from part) "
    + " union all ".join(_lexicase_sql(o, i) for i, o in enumerate(((0, 1, 2), (1, 0, 2), (2, 1, 0)))),
)


def islands_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.islands(_pool(spark, sf_dir), 5).select("ind_id", "island")


add("island_partition", islands_query, "select s_suppkey as ind_id, cast((row_number() over (order by s_suppkey) - 1) // (count(*) over () // 5) + 1 as integer) as island from supplier")


def _migrate(targets: list[int], m: int):
    return lambda s, d: population.migrate(population.islands(_pool(s, d), len(targets)), targets, m)


def _migrate_sql(targets: list[int], m: int) -> str:
    """Deliveries one after the other, each onto the then least fit of its target."""
    n = len(targets)
    steps = [
        f"""p0 as (select *, row_number() over (partition by island order by ind_id) as slot, island as origin from
  (select s_suppkey as ind_id, s_acctbal as fitness, cast((row_number() over (order by s_suppkey) - 1) // (count(*) over () // {n}) + 1 as integer) as island from supplier))""",
        "sent as (select island as source, ind_id, fitness, row_number() over (partition by island order by fitness desc, slot) as place from p0)",
    ]
    last = 0
    for source, target in enumerate(targets, 1):
        if source != target:
            steps.append(f"""p{last + 1} as (select w.island, w.slot, coalesce(s.ind_id, w.ind_id) as ind_id, coalesce(s.fitness, w.fitness) as fitness, coalesce(s.source, w.origin) as origin
  from (select *, row_number() over (partition by island order by fitness, slot) as worst from p{last}) w
  left join sent s on s.source = {source} and w.island = {target} and s.place = w.worst and s.place <= {m})""")
            last += 1
    return f"with {', '.join(steps)} select island, ind_id, fitness, origin from p{last}"


for _name, _targets in (("ring", population.migration_targets(5, "ring")), ("star", population.migration_targets(5, "star")), ("random", [3, 3, 4, 3, 4])):
    add(f"migrate_{_name}", _migrate(_targets, 2 if _name == "ring" else 1), _migrate_sql(_targets, 2 if _name == "ring" else 1))
add(
    "price_ic",
    lambda s, d: _rounded(metrics.pps(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").alias("f"), F.col("l_quantity").alias("y")))),
    f"""with r as (select l_extendedprice as f, l_quantity as y, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as rf,
  rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as ry from lineitem),
m as (select {corr_sql("f", "y")} as ic, {corr_sql("rf", "ry")} as rank_ic from r)
select round(ic, 6) as ic, round(rank_ic, 6) as rank_ic, round(0.3 * ic + 0.7 * rank_ic, 6) as pps from m""",
)


_SCORED = "(select p_partkey as ind_id, p_retailprice / 2000 as pps, (p_partkey % 97) / 97.0 as rre, (p_partkey % 11) / 11.0 as pfs, p_retailprice / 500 as novelty, p_size as complexity from part)"


def fitness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scored members; their fitness in generation 90 of 100."""
    from ..config import FitnessWeights
    from ..operators.scores import novelty_weight

    key, price = F.col("p_partkey"), F.col("p_retailprice")
    scores = {"pps": price / 2000, "rre": (key % 97) / 97.0, "pfs": (key % 11) / 11.0, "novelty": price / 500}
    members = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("ind_id"), *(c.alias(n) for n, c in scores.items()), F.col("p_size").alias("complexity"))
    weights = FitnessWeights()
    return members.select("ind_id", half_up(population.fitness(weights, novelty_weight(weights.novelty, 90, 100), 0.001), 6).alias("fitness"))


add("fitness", fitness_query, f"select ind_id, round(0.3 * pps + 0.3 * rre + 0.3 * pfs + 0.1 * (1 - (90 - 75) / 25.0) * novelty - 0.001 * complexity, 6) as fitness from {_SCORED}")


def schedule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a member of one of 110 generations, the last ten behind the planned end: its novelty bonus of weight 0.3."""
    part, generation = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 110 + 1
    weight = population.novelty_weight(generation, 0.3, 100)
    return part.select(F.col("p_partkey").alias("ind_id"), generation.alias("generation"), half_up(weight, 6).alias("weight"), half_up(weight * F.col("p_retailprice") / 500, 6).alias("bonus"))


_WEIGHT = "case when g <= 75 then 0.3 else 0.3 * greatest(0, 1 - (g - 75) / 25.0) end"
add("novelty_schedule", schedule_query, f"select ind_id, g as generation, round({_WEIGHT}, 6)::double as weight, round({_WEIGHT} * price / 500, 6)::double as bonus from (select p_partkey as ind_id, p_partkey % 110 + 1 as g, p_retailprice as price from part)")


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors' values on the 500 fixed rows, place by place."""
    panel = events_panel(spark, sf_dir)
    names = ["momentum", "spread"]
    signals = compile_forest(panel, {n: parse(_TREES[n]) for n in names}, FEATURES)
    prints = population.fingerprints(signals, names, population.fingerprint_rows(panel, 500))
    return prints.select("ind_id", F.posexplode("behavior").alias("place", "v")).select("ind_id", "place", half_up(F.col("v").cast("double"), 3).alias("value"))


add(
    "fingerprints",
    fingerprint_query,
    f"""with {PANEL}, a as (select *, {rolling_sql("ts_delta", "x1", "", 3, "")} as m from panel),
t as (select row_id, {rolling_sql("ts_mean", "m", "", 5, "")} as momentum, {_TREE_STEPS["spread"][1]} as spread from a),
p as (select row_id, cast(row_number() over (order by md5(cast(row_id as varchar))) - 1 as integer) as place from panel qualify place < 500),
long as (select 'momentum' as ind_id, place, momentum as v from t join p using (row_id) union all select 'spread', place, spread from t join p using (row_id))
select ind_id, place, round(cast(cast(v as float) as double), 3) as value from long""",
)


# ---- a front on rows that it hasn't seen ------------------------------------------------------------------------------------------

#: Individuals as a search gives them: trees, weights, combination, training pps.
_FRONT = (
    (("momentum", "spread", "decayed"), (0.5, 0.3, 0.2), "weighted_sum", 0.04),
    (("momentum", "mixed"), (0.5, 0.5), "vote", 0.07),
    (("momentum", "spread"), (0.5, 0.5), "rank_average", 0.02),
)
_USED = ("momentum", "spread", "mixed", "decayed")


def _front_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.genetic import Individual
    from ..operators.oos import evaluate_oos

    panel = forward_target(events_panel(spark, sf_dir), 5, close="x1", target="simple_return")
    panel = written(with_row_id(panel.withColumnRenamed("row_id", "event"), ["event"]), "oos-panel")
    front = [Individual(tuple(parse(_TREES[n]) for n in trees), weights, how, pps=pps) for trees, weights, how, pps in _FRONT]
    return evaluate_oos(panel, front, FEATURES, digits=9)


def _member_sql(trees: tuple[str, ...], weights: tuple[float, ...], how: str) -> str:
    if how == "weighted_sum":
        return " + ".join(f"{w} * {t}" for t, w in zip(trees, weights, strict=True))
    if how == "vote":
        return f"cast(sign({' + '.join(f'sign({t})' for t in trees)}) as double)"
    return f"({' + '.join(cross_sql('cs_rank', t, '') for t in trees)}) / {len(trees)}"


_BY_TRAIN = sorted(_FRONT, key=lambda m: -m[3])
_OOS = f"""with {PANEL.replace("panel as", "events_panel as", 1)},
later as (select *, lead(x1, 5) over (partition by asset order by row_id) as ahead from events_panel),
panel as (select row_number() over (order by row_id) - 1 as row_id, x1, x2, x3, x4, coalesce(ahead / nullif(x1, 0) - 1, 0.0) as y from later where ahead is not null),
a as (select *, {rolling_sql("ts_delta", "x1", "", 3, "")} as m1, sqrt(abs(x1 * x3) + 1e-6) as m2 from panel),
t as (select row_id, y, round({rolling_sql("ts_mean", "m1", "", 5, "")}, 9) as momentum, round({_TREE_STEPS["spread"][1]}, 9) as spread,
  round({_TREE_STEPS["mixed"][1]}, 9) as mixed, round({rolling_sql("decay", "m2", "", 5, "")}, 9) as decayed from a),
w as (select *, {", ".join(f"round({_member_sql(*m[:3])}, 9) as m{k}" for k, m in enumerate(_BY_TRAIN, 1))} from t),
long as ({" union all ".join(f"select '{n}' as name, {n} as f, y from w" for n in (*_USED, *(f"m{k}" for k in range(1, len(_FRONT) + 1))))}),
r as (select name, f, y, rank() over (partition by name order by f) + (count(*) over (partition by name, f) - 1) / 2.0 as rf,
  rank() over (partition by name order by y) + (count(*) over (partition by name, y) - 1) / 2.0 as ry from long),
c as (select name, {corr_sql("f", "y")} as ic, {corr_sql("rf", "ry")} as rank_ic from r group by name), e as ({rre_sql("r", "rf", "name")}),
s as (select name, round(0.3 * ic + 0.7 * rank_ic, 4) as oos_pps, round(ic, 4) as oos_ic, round(rank_ic, 4) as oos_rankic, round(rre, 4) as oos_rre from c join e using (name))"""


def _size(trees: tuple[str, ...]) -> int:
    return sum(parse(_TREES[t]).size for t in trees)


_MEMBER_ROWS = ", ".join(f"('m{k}', {k}, {m[3]}, {_size(m[0])})" for k, m in enumerate(_BY_TRAIN, 1))
_TREE_ROWS = ", ".join(f"('{t}', {k}, {i}, {parse(_TREES[t]).size}, {parse(_TREES[t]).depth})" for k, m in enumerate(_BY_TRAIN, 1) for i, t in enumerate(m[0], 1))
add(
    "oos_members",
    lambda s, d: _front_results(s, d)[0],
    f"""{_OOS}, i(name, k, train_pps, complexity) as (values {_MEMBER_ROWS})
select cast(row_number() over (order by oos_pps desc, k) as integer) as rank, oos_pps, oos_ic, oos_rankic, oos_rre, cast(train_pps as double) as train_pps, complexity from i join s using (name)""",
)
add(
    "oos_trees",
    lambda s, d: _front_results(s, d)[1],
    f"""{_OOS}, i(name, individual_rank, tree_idx, tree_size, tree_depth) as (values {_TREE_ROWS})
select individual_rank, tree_idx, oos_pps, oos_ic, oos_rankic, oos_rre, tree_size, tree_depth,
  cast(row_number() over (partition by individual_rank order by oos_pps desc, tree_idx) as integer) as tree_rank from i join s using (name)""",
)


def overfit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of mean pps from training to the scored rows."""
    from ..operators.oos import overfit_table

    found = overfit_table(_front_results(spark, sf_dir)[0])
    return found.select(*(half_up(c, 4).alias(c) for c in found.columns))


add(
    "overfit_check",
    overfit_query,
    f"""{_OOS}, i(name, k, train_pps, complexity) as (values {_MEMBER_ROWS}), means as (select avg(train_pps::double) as tr, avg(oos_pps) as te from i join s using (name))
select round(tr, 4) as train_pps, round(te, 4) as oos_pps, case when tr > 0 then round((tr - te) / tr * 100, 4) end as degradation from means""",
)


def traits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error in seven periods of every individual of the population, in blocks of rows."""
    from ..operators.evaluation import population_traits
    from ..operators.genetic import Individual

    panel = forward_target(events_panel(spark, sf_dir), 5, close="x1", target="simple_return")
    own = [Individual(tuple(parse(_TREES[n]) for n in trees), weights, how) for trees, weights, how in _POPULATION]
    found = population_traits(panel, own, FEATURES, [], 7, block_rows=4096)
    return found.select("i", F.posexplode("errors").alias("period", "e")).select("i", "period", half_up("e", 4).alias("err"))


#: A population as a generation has it: cross-sections inside trees, nested ones, all combinations, a tree twice.
_POPULATION = (
    (("momentum", "spread", "decayed"), (0.5, 0.3, 0.2), "weighted_sum"),
    (("momentum", "mixed"), (0.5, 0.5), "vote"),
    (("momentum", "spread"), (0.5, 0.5), "rank_average"),
    (("ranked", "scored"), (0.5, 0.5), "weighted_sum"),
    (("scored", "ranked", "ranked"), (0.4, 0.3, 0.3), "rank_average"),
)


def population_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every individual's scores on the whole events panel, in blocks of rows."""
    from ..operators.evaluation import population_scores
    from ..operators.genetic import Individual

    panel = forward_target(events_panel(spark, sf_dir), 5, close="x1", target="simple_return")
    own = [Individual(tuple(parse(_TREES[n]) for n in trees), weights, how) for trees, weights, how in _POPULATION]
    out = population_scores(panel, own, FEATURES, block_rows=4096, digits=9)
    return out.select("i", *(half_up(c, 4).alias(c) for c in ("pps", "ic", "rank_ic", "rre", "fitness")), "complexity")


_ALL_TREES = tuple(_TREES)
_POPULATION_ROWS = ", ".join(f"('i{k}', {k}, {_size(m[0])})" for k, m in enumerate(_POPULATION))
_POPULATION_SIGNALS = f"""with {PANEL.replace("panel as", "events_panel as", 1)},
later as (select *, lead(x1, 5) over (partition by asset order by row_id) as ahead from events_panel),
panel as (select row_number() over (order by row_id) - 1 as row_id, x1, x2, x3, x4, coalesce(ahead / nullif(x1, 0) - 1, 0.0) as y from later where ahead is not null),
a as (select *, {rolling_sql("ts_delta", "x1", "", 3, "")} as m1, sqrt(abs(x1 * x3) + 1e-6) as m2, {rolling_sql("ts_sum", "x2", "", 5, "")} as m3, {rolling_sql("ts_max", "x1", "", 5, "")} as m from panel),
b as (select *, {_ZS} as z from a),
t as (select row_id, y, round({rolling_sql("ts_mean", "m1", "", 5, "")}, 9) as momentum, round({_TREE_STEPS["spread"][1]}, 9) as spread, round({_TREE_STEPS["mixed"][1]}, 9) as mixed,
  round({rolling_sql("decay", "m2", "", 5, "")}, 9) as decayed, round({cross_sql("cs_rank", "m3", "")}, 9) as ranked, round({ELEMENT_SQL["safe_tanh"].format(x="z")}, 9) as scored from b),
w as (select *, {", ".join(f"round({_member_sql(*m)}, 9) as i{k}" for k, m in enumerate(_POPULATION))} from t)"""
add(
    "population_scores",
    population_query,
    f"""{_POPULATION_SIGNALS},
long as ({" union all ".join(f"select 'i{k}' as name, i{k} as f, y from w" for k in range(len(_POPULATION)))}),
r as (select name, f, y, rank() over (partition by name order by f) + (count(*) over (partition by name, f) - 1) / 2.0 as rf,
  rank() over (partition by name order by y) + (count(*) over (partition by name, y) - 1) / 2.0 as ry from long),
c as (select name, {corr_sql("f", "y")} as ic, {corr_sql("rf", "ry")} as rank_ic from r group by name), e as ({rre_sql("r", "rf", "name")}),
p(name, i, complexity) as (values {_POPULATION_ROWS})
select i, round(0.3 * ic + 0.7 * rank_ic, 4) as pps, round(ic, 4) as ic, round(rank_ic, 4) as rank_ic, round(rre, 4) as rre,
  round(0.3 * (0.3 * ic + 0.7 * rank_ic) + 0.3 * rre - 0.001 * complexity, 4) as fitness, complexity from p join c using (name) join e using (name)""",
)


_PERIOD = "least(row_id // ((select count(*) from w) // 7), 6)"
add(
    "population_errors",
    traits_query,
    f"""{_POPULATION_SIGNALS},
long as ({" union all ".join(f"select {k} as i, cast({_PERIOD} as integer) as period, abs(i{k} - y) as e from w" for k in range(len(_POPULATION)))})
select i, period, round(avg(e), 4) as err from long group by all""",
)


# ---- trees as rows ---------------------------------------------------------------------------------------------------------------

#: A tree for every part; its key says how deep it may be and whether it grows. The defaults of a search draw from all operators.
_FOREST_CFG, _FOREST_SEED = GPConfig(min_depth=1, max_depth=4), 7
_ROOTS = "select p_partkey as tree, cast(p_partkey % 5 as int) as max_depth, p_partkey % 2 = 0 as grow from part"


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    roots = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("tree"), (key % 5).cast("int").alias("max_depth"), (key % 2 == 0).alias("grow"))
    return forest.random_trees(roots, _FOREST_CFG, len(FEATURES), _FOREST_SEED, _FOREST_CFG.max_depth)


def _quoted(values) -> str:
    return f"[{', '.join(repr(v) for v in values)}]"


def _draw_sql(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 13))::bigint + 0.5) / {1 << 52}::double)"


def _gauss_sql(key: str) -> str:
    u = [f"((('0x' || substr(md5({key}), {at}, 13))::bigint + 0.5) / {1 << 52}::double)" for at in (1, 14)]
    return f"sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]})"


def _forest_sql() -> str:
    """``nodes`` as ``forest.random_trees`` draws them; used in a WITH RECURSIVE list."""
    c = _FOREST_CFG
    u = lambda what: _draw_sql(f"'{_FOREST_SEED}-' || tree || '-' || path || '-{what}'")
    pick = lambda values, what: f"({_quoted(values)})[cast(floor({u(what)} * {len(values)}) as int) + 1]"
    elementary, financial = [*c.unary_ops, *c.binary_ops], [*c.ts_unary_ops, *c.ts_binary_ops, *c.cs_ops]
    two, rolling_ops = [o for o in (*elementary, *financial) if OPS[o].arity == 2], [o for o in financial if OPS[o].rolling]
    leaf = f"(max_depth <= depth or (depth >= {c.min_depth} and grow and {u('leaf')} < 0.5))"
    op = f"case when {leaf} then null when {u('kind')} < {c.fin_op_prob} then {pick(financial, 'op')} else {pick(elementary, 'op')} end"
    value = _gauss_sql(f"'{_FOREST_SEED}-' || tree || '-' || path || '-value'")
    return f"""drawn(tree, max_depth, grow, path, depth, op) as (
  select *, {op} from (select tree, max_depth, grow, '' as path, 0 as depth from ({_ROOTS}))
  union all select *, {op} from (select tree, max_depth, grow, path || c as path, depth + 1 as depth from drawn, (values ('0'), ('1')) cs(c) where op is not null and (c = '0' or list_contains({_quoted(two)}, op)))),
nodes as (select tree, path, depth, op, case when list_contains({_quoted(rolling_ops)}, op) then {pick(c.ts_windows, "window")} end as "window",
  case when op is null and {u("constant")} >= {c.const_prob} then cast(floor({u("feature")} * {len(FEATURES)}) as int) + 1 end as feature,
  case when op is null and {u("constant")} < {c.const_prob} then {value} end as value from drawn),
held as (select *, row_number() over (partition by tree order by path) - 1 as pos from nodes),
iv as (select h.*, s.size, s.high - h.depth as height from held h join (select a.tree, a.path, count(*) as size, max(b.depth) as high from held a join held b on a.tree = b.tree and starts_with(b.path, a.path) group by all) s using (tree, path))"""


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("tree", "path", "depth", "op", "window", "feature", half_up("value", 6).alias("value"), *more)


_SHOWN = "tree, path, depth, op, \"window\", feature, round(value, 6) as value"
add("random_forest_trees", lambda s, d: _shown(_forest(s, d)), f"with recursive {_forest_sql()} select {_SHOWN} from nodes")
add(
    "tree_intervals",
    lambda s, d: forest.intervals(_forest(s, d)).select("tree", "pos", "depth", "size", "height", "op"),
    f"with recursive {_forest_sql()} select tree, pos, depth, size, height, op from iv",
)


def crossover_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every odd part's tree crossed with its successor's."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    pairs = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")).join(part.select(F.col("p_partkey").alias("b")), "b")
    return _shown(forest.crossover(written(_forest(spark, sf_dir), "forest"), pairs.select("a", "b"), _FOREST_CFG.max_depth, _FOREST_SEED))


_TRY = lambda side: _draw_sql(f"'{_FOREST_SEED}-' || a || '-' || b || '-' || nth || '-{side}'")
add(
    "crossover_pairs",
    crossover_query,
    f"""with recursive {_forest_sql()},
pairs as (select o.p_partkey as a, e.p_partkey as b from part o join part e on e.p_partkey = o.p_partkey + 1 where o.p_partkey % 2 = 1),
sized as (select a, b, x.size as size_a, y.size as size_b, unnest([1, 2, 3]) as nth from pairs join iv x on x.tree = a and x.path = '' join iv y on y.tree = b and y.path = ''),
tries as (select *, cast(floor({_TRY("a")} * size_a) as bigint) as pos_a, cast(floor({_TRY("b")} * size_b) as bigint) as pos_b from sized),
fit as (select a, b, nth, x.path as at_a, y.path as at_b from tries join iv x on x.tree = a and x.pos = pos_a join iv y on y.tree = b and y.pos = pos_b
  where x.depth + y.height <= {_FOREST_CFG.max_depth} and y.depth + x.height <= {_FOREST_CFG.max_depth} qualify row_number() over (partition by a, b order by nth) = 1),
sp as (select a as tree, at_a as at, b as donor, at_b as donor_at from fit union all select b, at_b, a, at_a from fit),
new as (select n.tree, n.path, n.op, n."window", n.feature, n.value from nodes n left join sp on sp.tree = n.tree where sp.at is null or not starts_with(n.path, sp.at)
  union all select sp.tree, sp.at || substr(n.path, len(sp.donor_at) + 1), n.op, n."window", n.feature, n.value from nodes n join sp on sp.donor = n.tree where starts_with(n.path, sp.donor_at))
select tree, path, cast(len(path) as integer) as depth, op, "window", feature, round(value, 6) as value from new""",
)
_WHAT = _draw_sql(f"'{_FOREST_SEED}-' || tree || '-what'")
_POOLS = ([*_FOREST_CFG.unary_ops, *_FOREST_CFG.cs_ops], list(_FOREST_CFG.binary_ops), list(_FOREST_CFG.ts_unary_ops), list(_FOREST_CFG.ts_binary_ops))
_OTHER_OP = " ".join(f"when list_contains({_quoted(p)}, op) then list_filter({_quoted(p)}, lambda o: o <> op)[cast(floor({_WHAT} * {len(p) - 1}) as int) + 1]" for p in _POOLS)
_OTHER = f"(cast(floor({_WHAT} * {len(FEATURES) - 1}) as int) + 1)"
_STEP = _gauss_sql(f"'{_FOREST_SEED}-' || tree || '-step'")
add(
    "point_mutation",
    lambda s, d: _shown(forest.point_mutation(written(_forest(s, d), "forest"), _FOREST_CFG, len(FEATURES), _FOREST_SEED)),
    f"""with recursive {_forest_sql()},
hits as (select tree, cast(floor({_draw_sql(f"'{_FOREST_SEED}-' || tree || '-node'")} * size) as bigint) as hit from iv where path = '')
select tree, path, depth, case when pos = hit and op is not null then case {_OTHER_OP} end else op end as op, "window",
  case when pos = hit and feature is not null then {_OTHER} + cast({_OTHER} >= feature as int) else feature end as feature,
  round(case when pos = hit then value + 0.1 * ({_STEP}) else value end, 6) as value from iv join hits using (tree)""",
)


#: Up to so many rows ``gp_search`` holds its panel as a matrix.
MATRIX_ROWS = 200_000


def gp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of a small search over the whole events panel; the last generation follows PFS, constant tuning and a migration."""
    from ..operators import engine

    panel = forward_target(events_panel(spark, sf_dir), 5, close="x1", target="simple_return")
    cfg = GPConfig(population_size=16, n_trees=2, max_depth=3, n_generations=3, elite_count=2, n_islands=2, behavior_sample_size=100, hof_size=10, lexicase_n_periods=5, const_opt_every_n_gens=2, migration_interval=2)
    # a matrix of bounded rows goes out as one broadcast; a larger table is read in blocks, and none of its rows reach the driver
    small = panel.limit(MATRIX_ROWS + 1).count() <= MATRIX_ROWS
    front = engine.run_gp(spark, *engine.panel_matrix(panel, FEATURES, "y"), cfg) if small else engine.run_gp_panel(panel, FEATURES, "y", cfg)
    members = front.members
    rows = [(k, m.key, m.pps, m.rre, m.complexity) for k, m in enumerate(sorted(members, key=lambda m: -m.pps), 1)]
    return spark.createDataFrame(rows, "rank int, trees string, pps double, rre double, complexity int")


add("gp_search", gp_search)


def gp_search_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of a small search that reads the events panel in blocks; a generation follows PFS, constant tuning and a migration."""
    from ..operators.engine import run_gp_panel

    panel = forward_target(events_panel(spark, sf_dir), 5, close="x1", target="simple_return")
    members = run_gp_panel(panel, FEATURES, "y", PANEL_CFG).members
    rows = [(k, m.key, m.pps, m.rre, m.complexity) for k, m in enumerate(sorted(members, key=lambda m: (-m.pps, m.key)), 1)]
    return spark.createDataFrame(rows, "rank int, trees string, pps double, rre double, complexity int")


PANEL_CFG = GPConfig(population_size=8, n_trees=2, max_depth=3, n_generations=3, elite_count=2, n_islands=2, behavior_sample_size=100, hof_size=6, lexicase_n_periods=5, const_opt_every_n_gens=2, migration_interval=2)
add("gp_search_panel", gp_search_panel)


def search_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a search on the rows up to the 70 % date to the scores of its front's members on the rows behind it."""
    from ..operators.engine import run_gp_panel
    from ..operators.oos import evaluate_oos

    panel = forward_target(events_panel(spark, sf_dir), 5, close="x1", target="simple_return")
    train, test = date_split(panel, 0.7, "day")
    front = run_gp_panel(train, FEATURES, "y", SEARCH_CFG).members
    unseen = written(with_row_id(test.withColumnRenamed("row_id", "event"), ["event"]), "unseen")
    return evaluate_oos(unseen, front, FEATURES)[0]


SEARCH_CFG = GPConfig(population_size=8, n_trees=2, max_depth=3, n_generations=2, elite_count=2, n_islands=2, behavior_sample_size=50, hof_size=5, lexicase_n_periods=5, const_opt_every_n_gens=2, migration_interval=1)
add("search_oos", search_oos)


def tuned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of two trees tuned on the whole events panel, as many steps as a search gives them."""
    from ..operators.evaluation import tuned_constants

    panel = forward_target(events_panel(spark, sf_dir), 5, close="x1", target="simple_return")
    trees = [parse(t) for t in TUNED_TREES]
    found = tuned_constants(panel, trees, FEATURES, most=TUNED_STEPS)
    rows = [(k, str(old), k2, before, after) for k, (old, new) in enumerate(zip(trees, found, strict=True)) for k2, (before, after) in enumerate(zip(old.constants(), new.constants(), strict=True))]
    return spark.createDataFrame(rows, "tree int, start string, constant int, before double, after double")


TUNED_TREES, TUNED_STEPS = ("safe_add(x1, safe_mul(5.0, x3))", "safe_sub(ts_mean(x1, d=5), safe_mul(0.5, safe_add(x2, 1.5)))"), GPConfig().const_opt_steps
add("tuned_constants", tuned_query)
