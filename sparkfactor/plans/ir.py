"""Expression trees: immutable nodes, their text form, and what structural operators need.

A tree is a nested value, so a copy is the tree itself, and equal subtrees are equal keys. Nodes are numbered in pre-order from 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

from ..functions.registry import lookup


@dataclass(frozen=True)
class Node:
    """``op`` with children and for rolling operators a window; or a feature's number from 1; or a constant."""

    op: str | None = None
    children: tuple[Node, ...] = ()
    window: int | None = None
    feature: int | None = None
    value: float | None = None

    @cached_property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)

    @cached_property
    def depth(self) -> int:
        return 1 + max(c.depth for c in self.children) if self.children else 0

    @property
    def is_leaf(self) -> bool:
        return self.op is None

    @cached_property
    def reach(self) -> int:
        """How many rows before its own a value depends on, through rolling operators."""
        own = 0 if self.window is None else self.window if self.op == "ts_delta" else self.window - 1
        return own + max((c.reach for c in self.children), default=0)

    def walk(self) -> Iterator[tuple[int, Node, int]]:
        """(number, node, depth below the root) in pre-order."""
        stack, k = [(self, 0)], 0
        while stack:
            node, level = stack.pop()
            yield k, node, level
            k += 1
            stack += [(c, level + 1) for c in reversed(node.children)]

    def at(self, number: int) -> Node:
        return next(n for k, n, _ in self.walk() if k == number)

    def level(self, number: int) -> int:
        return next(d for k, _, d in self.walk() if k == number)

    def replaced(self, number: int, donor: Node) -> Node:
        """With the subtree at ``number`` replaced."""
        if number == 0:
            return donor
        k, children = 1, list(self.children)
        for i, c in enumerate(children):
            if number < k + c.size:
                children[i] = c.replaced(number - k, donor)
                return replace(self, children=tuple(children))
            k += c.size
        raise IndexError(number)

    def constants(self) -> list[float]:
        """The constants in pre-order."""
        return [n.value for _, n, _ in self.walk() if n.value is not None]

    def with_constants(self, values: list[float]) -> Node:
        """With other constants in the same places."""
        if len(values) != len(self.constants()):
            raise ValueError("the tree has another number of constants")
        left = iter(values)

        def put(n: Node) -> Node:
            return constant(next(left)) if n.value is not None else replace(n, children=tuple(map(put, n.children)))

        return put(self)

    def features(self) -> set[int]:
        return {n.feature for _, n, _ in self.walk() if n.feature is not None}

    def __str__(self) -> str:
        if self.feature is not None:
            return f"x{self.feature}"
        if self.op is None:
            return str(round(self.value, 4))
        return f"{self.op}({', '.join([*map(str, self.children), *([f'd={self.window}'] if self.window is not None else [])])})"


def variable(k: int) -> Node:
    return Node(feature=k)


def constant(v: float) -> Node:
    return Node(value=float(v))


def call(op: str, *children: Node, window: int | None = None) -> Node:
    """An operator node; arity and window are checked."""
    spec = lookup(op)
    if len(children) != spec.arity:
        raise ValueError(f"{op} takes {spec.arity} arguments")
    if spec.rolling != (window is not None):
        raise ValueError(f"{op} takes {'a' if spec.rolling else 'no'} window")
    return Node(op, tuple(children), window)


def parse(text: str) -> Node:
    """The tree of a text form such as ``safe_add(x1, ts_mean(x2, d=5))``."""
    import ast

    def build(e: ast.expr) -> Node:
        if isinstance(e, ast.Call):
            return call(e.func.id, *map(build, e.args), window=next((k.value.value for k in e.keywords if k.arg == "d"), None))
        if isinstance(e, ast.Name):
            return variable(int(e.id[1:]))
        return constant(ast.literal_eval(e))

    return build(ast.parse(text, mode="eval").body)
