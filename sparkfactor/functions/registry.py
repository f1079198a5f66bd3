"""All operators by name: tier, arity, NumPy kernel and Column form. ``register_op`` adds one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import cross_section, elementwise, kernels, rolling

TIERS = ("unary", "binary", "ts_unary", "ts_binary", "cs")


@dataclass(frozen=True)
class OpSpec:
    """``column``: f(*columns) for element-wise, f(*columns, d, scope) for rolling, f(df, name, out, scope) for cross-sections.

    Element-wise and rolling operators may have a kernel alone; then the kernel runs over Arrow batches. ``most_window``: beyond this window the
    kernel takes the place of a Column form whose plan grows with the window. ``searched``: whether the search draws it by default.
    """

    name: str
    tier: str
    kernel: Callable
    column: Callable | None
    most_window: int | None = None
    searched: bool = True

    @property
    def arity(self) -> int:
        return 2 if self.tier in ("binary", "ts_binary") else 1

    @property
    def rolling(self) -> bool:
        return self.tier.startswith("ts_")

    @property
    def elementwise(self) -> bool:
        return self.tier in ("unary", "binary")

    def by_kernel(self, window: int | None) -> bool:
        """Whether the compiler runs the kernel in a stage of its own."""
        return self.column is None or (self.most_window is not None and window is not None and window > self.most_window)

    @property
    def financial(self) -> bool:
        return not self.elementwise


OPS: dict[str, OpSpec] = {}


def register_op(name: str, tier: str, kernel: Callable, column: Callable | None = None, most_window: int | None = None, searched: bool = True) -> OpSpec:
    """Adds an operator for trees, kernels and Columns; a name can't be taken twice. A cross-section needs a Column form.

    A kernel takes arrays of a series in order (and the window) and gives one value a row. A rolling one may look back window rows at most.
    """
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}")
    if name in OPS:
        raise ValueError(f"operator {name} exists")
    if column is None and tier == "cs":
        raise ValueError("a cross-sectional operator needs a Column form")
    OPS[name] = OpSpec(name, tier, kernel, column, most_window, searched)
    return OPS[name]


for _tier, _kernels, _module in (
    ("unary", kernels.UNARY, elementwise),
    ("binary", kernels.BINARY, elementwise),
    ("ts_unary", kernels.TS_UNARY, rolling),
    ("ts_binary", kernels.TS_BINARY, rolling),
    ("cs", kernels.CROSS, cross_section),
):
    for _name, _kernel in _kernels.items():
        register_op(_name, _tier, _kernel, getattr(_module, "absolute" if _name == "abs" else _name), rolling.MOST_LAGS if _name in ("ts_rank", "decay") else None)


def lookup(name: str) -> OpSpec:
    if name not in OPS:
        raise KeyError(f"unknown operator {name}")
    return OPS[name]


def validate_ops(names: list[str], tier: str | None = None) -> list[str]:
    """The names, if all are known (and of the tier)."""
    for n in names:
        if tier and lookup(n).tier != tier:
            raise ValueError(f"{n} is not a {tier} operator")
        lookup(n)
    return list(names)


def names(tier: str) -> list[str]:
    return [o.name for o in OPS.values() if o.tier == tier and o.searched]
