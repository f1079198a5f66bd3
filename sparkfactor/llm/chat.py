"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last an assistant's. Each turn may
keep its role or be relabelled, may be merged into the turn before it, and empty turns may be put in front of it or at the end.
Dynamic programming over the automaton's four states (nothing yet, system, user, assistant) finds the cheapest repair; of equally cheap
ones the repair whose states, read from the first turn on, come first.

A conversation may hold a third of all rows, so none is gathered. Rows are dealt by range of (conv_id, turn) and keep their place in
their part. A part's run of a conversation acts on costs as a 4 x 4 matrix in (min, +) algebra; only a part's first and last
conversation can go on elsewhere, so at most two matrices a part reach the driver. It gives every part the costs behind its end, asks
for the state each part then ends in, and so fixes the state each part starts in. All these passes read roles alone; texts join
the outcome by place and are rendered in SQL.

Defined cases: a null conversation id is an id of its own. Null turns come first; rows of one turn number are ordered by the hash of role
and text. A null or unknown role can take any role at ``unknown``'s cost. A null text is empty. Marks inside a text are broken by a
blank, so it can't open or close a turn. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant")
NONE, SYSTEM, USER, ASSISTANT = range(4)
INF = float("inf")
#: Fixed value: which state may follow which.
FOLLOWS = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


class Costs(NamedTuple):
    merge: int = 2
    relabel: int = 3
    unknown: int = 1
    insert: int = 4


class Move(NamedTuple):
    cost: float
    merged: bool
    relabelled: bool
    inserted: tuple[int, ...]


class Automaton:
    """The repair automaton for given costs, with remembered cost vectors."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.moves = {(p, r, q): self._move(p, r, q) for p in range(4) for r in range(4) for q in range(4)}
        self.end = tuple(self._fill(s)[0] for s in range(4))
        self._back: dict = {}
        self._ahead: dict = {}

    def _fill(self, state: int) -> tuple[float, tuple[int, ...]]:
        """Cost and roles of the empty turns that end a conversation in ``state``."""
        missing = {NONE: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]
        return self.costs.insert * len(missing), missing

    def _move(self, p: int, role: int, q: int) -> Move | None:
        """The cheapest way from state ``p`` over a turn of ``role`` (0 for unknown) to ``q``."""
        if q == NONE:
            return None
        changed = role != q
        base = 0 if not changed else self.costs.unknown if role == 0 else self.costs.relabel
        ways = [Move(base + self.costs.merge, True, changed, ())] if p == q else []
        if q in FOLLOWS[p]:
            ways.append(Move(base, False, changed, ()))
        ways += [Move(base + self.costs.insert, False, changed, (x,)) for x in FOLLOWS[p] if q in FOLLOWS[x]]
        return min(ways, key=lambda m: m.cost, default=None)

    def cost(self, p: int, role: int, q: int) -> float:
        move = self.moves[p, role, q]
        return move.cost if move else INF

    def back(self, behind: tuple, role: int) -> tuple:
        """Least costs from before a turn, given those from behind it."""
        if (behind, role) not in self._back:
            self._back[behind, role] = tuple(min(self.cost(p, role, q) + behind[q] for q in range(4)) for p in range(4))
        return self._back[behind, role]

    def ahead(self, before: tuple, role: int) -> tuple:
        """Least costs of each state behind a turn, less the least of them, which comes last."""
        if (before, role) not in self._ahead:
            after = [min(before[p] + self.cost(p, role, q) for p in range(4)) for q in range(4)]
            least = min(after)
            self._ahead[before, role] = (*(x - least for x in after), least)
        return self._ahead[before, role]

    def matrix(self, roles: np.ndarray) -> list[list[float]]:
        """Least cost from each state before a run of turns to each behind it."""
        out = []
        for start in range(4):
            v, total = tuple(0.0 if s == start else INF for s in range(4)), 0.0
            for r in roles.tolist():
                *v, least = self.ahead(v, r)
                v, total = tuple(v), total + least
            out.append([x + total for x in v])
        return out

    def choices(self, roles: np.ndarray, behind: tuple) -> np.ndarray:
        """For each turn and state before it, the state behind it on the best repair."""
        out = np.zeros((len(roles), 4), np.int8)
        for i in range(len(roles) - 1, -1, -1):
            r = int(roles[i])
            for p in range(4):
                total = [self.cost(p, r, q) + behind[q] for q in range(4)]
                out[i, p] = total.index(min(total))
            behind = self.back(behind, r)
            least = min(behind)
            behind = tuple(x - least for x in behind)
        return out


class Segment(NamedTuple):
    """What a part must know of its run of a conversation that goes on elsewhere."""

    state: int
    position: int
    behind: tuple | None  # None: the conversation ends here


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, np.ndarray, np.ndarray]]:
    """(part, conv_id, places, roles) for each run of a conversation in a part; only places and roles of one run are held."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

    for (part, conv), run in groupby(rows(), key=lambda r: (r[0], r[2])):
        both = np.array([(nth, role) for _, nth, _, role in run], np.int64)
        yield part, conv, both[:, 0], both[:, 1].astype(np.int8)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The first and the last run of each part."""
    for _, runs in groupby(_runs(batches), key=lambda r: r[0]):
        last = None
        for k, run in enumerate(runs):
            if k == 0:
                yield run
            last = run if k else None
        if last:
            yield last


def repair(turns: DataFrame, costs: Costs = Costs(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn: conv_id, pos, turn, role, new_role, merged, relabelled, inserted, cost and fragment.

    A conversation's fragments in the order of ``pos`` are its rendering.
    """
    automaton = Automaton(costs)
    spark = turns.sparkSession
    own = turns.select(*(F.col(c).alias(n) for c, n in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))))
    known = {r: i + 1 for i, r in enumerate(ROLES)}
    code = F.coalesce(*(F.when(F.lower(F.trim("role")) == r, i) for r, i in known.items()), F.lit(0)).cast("int")
    tie = F.xxhash64("role", "text")
    rows = own.withColumns({"code": code, "tie": tie}).repartitionByRange("conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie").drop("tie")
    # the id grows by one from row to row of a partition, and its upper bits are the partition
    place = F.monotonically_increasing_id()
    placed = written(rows.withColumn("place", place).withColumns({"part": F.shiftright("place", 33).cast("int"), "nth": F.col("place").bitwiseAND((1 << 33) - 1)}).drop("place"), "turns")
    roles = placed.select("part", "nth", "conv_id", "code").repartition("part").sortWithinPartitions("part", "nth")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, conv, places, codes in _edges(batches):
            flat = [x for row in automaton.matrix(codes) for x in row]
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([conv], pa.int64()), "first": pa.array([int(places[0])]), "n": pa.array([len(places)]), "m": pa.array([flat], pa.list_(pa.float64()))})

    found = sorted(roles.mapInArrow(summaries, "part int, conv_id long, first long, n long, m array<double>").collect(), key=lambda r: (r.part, r.first))
    chains = [list(c) for _, c in groupby(found, key=lambda r: r.conv_id)]
    chains = [c for c in chains if len(c) > 1]
    behind: dict[tuple, tuple] = {}
    for chain in chains:
        after = automaton.end
        for r in reversed(chain):
            behind[r.part, r.conv_id] = after
            after = tuple(min(r.m[4 * p + q] + after[q] for q in range(4)) for p in range(4))
    segments: dict[tuple, Segment] = {}
    if chains:
        shared = spark.sparkContext.broadcast(behind)

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, conv, _, codes in _edges(batches):
                if (part, conv) in shared.value:
                    chosen, state = automaton.choices(codes, shared.value[part, conv]), np.arange(4)
                    for row in chosen:
                        state = row[state]
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([conv], pa.int64()), "to": pa.array([state.tolist()], pa.list_(pa.int32()))})

        to = {(r.part, r.conv_id): r.to for r in roles.mapInArrow(ends, "part int, conv_id long, to array<int>").collect()}
        for chain in chains:
            state, position = NONE, 0
            for r in chain:
                segments[r.part, r.conv_id] = Segment(state, position, None if r is chain[-1] else behind[r.part, r.conv_id])
                state, position = to[r.part, r.conv_id][state], position + r.n
    known_segments = spark.sparkContext.broadcast(segments)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, conv, places, codes in _runs(batches):
            state, position, after = known_segments.value.get((part, conv), Segment(NONE, 0, None))
            chosen = automaton.choices(codes, after or automaton.end)
            out: dict[str, list] = {f.name: [] for f in schema}
            for k, (nth, role_) in enumerate(zip(places.tolist(), codes.tolist(), strict=True)):
                to = int(chosen[k, state])
                move = automaton.moves[state, role_, to]
                last = after is None and k == len(places) - 1
                fill, missing = automaton._fill(to) if last else (0, ())
                values = (part, nth, position + k, to, move.merged, move.relabelled, [ROLES[x - 1] for x in move.inserted], [ROLES[x - 1] for x in missing], int(move.cost + fill), last)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
                state = to
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("s_part", pa.int32()), ("s_nth", pa.int64()), ("pos", pa.int64()), ("state", pa.int32()), ("merged", pa.bool_()), ("relabelled", pa.bool_()), ("inserted", pa.list_(pa.string())), ("closing", pa.list_(pa.string())), ("cost", pa.int32()), ("last", pa.bool_())])
    kinds = "s_part int, s_nth long, pos long, state int, merged boolean, relabelled boolean, inserted array<string>, closing array<string>, cost int, last boolean"
    outcome = roles.mapInArrow(states, kinds)
    both = placed.join(outcome, (F.col("part") == F.col("s_part")) & (F.col("nth") == F.col("s_nth")))
    new_role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("state"))
    return both.withColumn("new_role", new_role).select("conv_id", "pos", "turn", "role", "new_role", "merged", "relabelled", F.concat("inserted", "closing").alias("inserted"), "cost", fragment().alias("fragment"))


def fragment():
    """What a turn adds to its conversation's rendering: what closes the turn before it, empty turns, its own head and text."""
    empty = lambda c: F.array_join(F.transform(c, lambda r: F.concat(F.lit("<|im_start|>"), r, F.lit("\n<|im_end|>\n"))), "")
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|im_(start|end)\|>", "<|im_$1 |>")
    before = F.when(F.col("pos") > 0, F.lit("<|im_end|>\n")).otherwise("")
    head = F.concat(before, empty(F.col("inserted")), F.lit("<|im_start|>"), F.col("new_role"), F.lit("\n"))
    tail = F.when(F.col("last"), F.concat(F.lit("<|im_end|>\n"), empty(F.col("closing")))).otherwise("")
    return F.concat(F.when(F.col("merged"), F.lit("\n\n")).otherwise(head), safe, tail)
