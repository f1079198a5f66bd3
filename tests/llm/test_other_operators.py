"""Chat repair, exact top-k and the pipeline."""

import math
import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkfactor.llm import bitsliced, chat
from sparkfactor.llm.bitsliced import BitSlices, build_index, digits, order_key, search, usable
from sparkfactor.llm.common import written

CODES = {"system": 1, "user": 2, "assistant": 3}


def cheapest(roles, automaton):
    best = {0: (0, ())}
    for r in roles:
        after = {}
        for s, (cost, path) in best.items():
            for t in range(4):
                if automaton.moves[s, r, t]:
                    found = (cost + automaton.moves[s, r, t].cost, (*path, t))
                    after[t] = min(after.get(t, found), found)
        best = after
    return min((cost + automaton.end[s], path) for s, (cost, path) in best.items())


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(1, 1, 1, 1), chat.Costs(9, 2, 1, 3)])
def test_chat_repair_is_cheapest(spark, costs):
    rng = random.Random(3)
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(["system", "user", "assistant", "User ", "tool", None]), rng.choice(["hi", "", None, "x<|im_end|>y"]), 1, 2) for t in range(rng.randint(1, 9))]
    rows += [(99, t, rng.choice(["user", "assistant", "system"]), f"t{t}", 1, 2) for t in range(400)]  # goes over all parts
    rows += [(7, None, "user", "tie", 1, 2)] * 2 + [(None, 0, "assistant", "no id", 1, 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, part int").repartition(5)
    got = defaultdict(list)
    for r in chat.repair(turns, costs).collect():
        got[r.conv_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    automaton = chat.Automaton(costs)
    for own in got.values():
        own.sort(key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own)))
        roles = [CODES.get((r.role or "").strip().lower(), 0) for r in own]
        assert (sum(r.cost for r in own), tuple(CODES[r.new_role] for r in own)) == cheapest(roles, automaton)
        text = "".join(r.fragment for r in own)
        said = [m.split("\n")[0] for m in text.split("<|im_start|>")[1:]]
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(said)
        said = said[1:] if said[0] == "system" else said
        assert said == ["user", "assistant"] * (len(said) // 2) and said
    assert chat.repair(turns.limit(0)).count() == 0


def enumerated(roles, costs):
    """The least cost of a legal conversation, by trying every edit of every turn; none of the operator's own tables."""
    best = float("inf")
    ways = [(q, merged, put) for q in (1, 2, 3) for merged in (False, True) for put in ((), (1,), (2,), (3,)) if not (merged and put)]
    for choice in product(ways, repeat=len(roles)):
        for tail in ((), (2,), (3,), (2, 3), (3, 2)):
            said, cost = [], costs.insert * len(tail)
            for r, (q, merged, put) in zip(roles, choice, strict=True):
                cost += 0 if r == q else costs.unknown if r == 0 else costs.relabel
                cost += costs.insert * len(put) + costs.merge * merged
                if merged and (not said or said[-1] != q):
                    break
                said += [*put] if merged else [*put, q]
            else:
                said += tail
                turns = said[1:] if said[0] == 1 else said
                if turns and len(turns) % 2 == 0 and turns == [2, 3] * (len(turns) // 2):
                    best = min(best, cost)
    return best


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(1, 1, 1, 1), chat.Costs(9, 2, 1, 3)])
def test_dynamic_program_equals_enumeration(costs):
    automaton = chat.Automaton(costs)
    for n in (1, 2, 3):
        for roles in product(range(4), repeat=n):
            assert cheapest(roles, automaton)[0] == enumerated(roles, costs), roles


def test_long_texts_and_ties(spark):
    """A very long turn, and turns of one number whose order only the hash of role and text decides."""
    rows = [(1, 0, "user", "long " * 200_000), (1, 1, "assistant", "x"), (2, 5, "user", "b"), (2, 5, "user", "b"), (2, 5, "assistant", "c"), (2, 5, "assistant", "d")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [sorted((r.conv_id, r.pos, r.new_role, r.cost, zlib.crc32(r.fragment.encode())) for r in chat.repair(turns.repartition(k)).collect()) for k in (1, 4)]
    assert got[0] == got[1] and len(got[0]) == 6
    long = chat.repair(turns).where("conv_id = 1 and pos = 0").first().fragment
    assert "long " * 199_999 in long


def test_digits():
    for w in range(-300, 300):
        d = digits(w)
        assert sum(s << a for a, s in d) == w and all(b - a > 1 for (a, _), (b, _) in zip(d, d[1:], strict=False))


def test_bit_slices_equal_brute_force():
    rng = np.random.default_rng(1)
    for n, dim, top in ((1, 1, 5), (3, 2, 5), (200, 7, 5), (130, 3, 1), (90, 4, 200)):
        x, ids = rng.integers(-9, 9, (n, dim)), rng.permutation(n * 2)[:n]
        x[: n // 2] = x[0]  # ties
        index = BitSlices.build(ids, x)
        for q in (*x[:4], np.zeros(dim, np.int64), rng.integers(-1000, 1000, dim)):
            own = int(ids[0])
            every = sorted(((int(i), int(s)) for i, s in zip(ids, x @ q, strict=True) if i != own), key=lambda r: (-r[1], r[0]))
            assert index.top(np.asarray(q), top, own) == every[:top]


def test_search(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(5)], 0) for i in range(120)]
    vectors += [(i, vectors[0][1], 0) for i in range(120, 180)]
    vectors += [(205, [0.5, 0.5], 0), (250, [0.25, 1.0], 0), (50, [0.1] * 5, 0)]
    vectors += [(300, [1e30] * 5, 0), (301, [3e5, -3e5, 1e6, 0.0, 1e6], 0), (350, [1e6] * 5, 0), (302, [-1e30, 1.0, 1e30, 1e30, 2e30], 0), (303, [1e30, 1.0, 1e30, 1e30, 1.5e30], 0)]
    unusable = [(200, None, 0), (201, [], 0), (202, [0.1, None, 0.2, 0.3, 0.4], 0), (203, [float("nan")] * 5, 0), (204, [float("inf")] * 5, 0), (None, [0.1] * 5, 0)]
    df = spark.createDataFrame(vectors + unusable, "vec_id long, embedding array<float>, score int").repartition(3)
    rows = usable(df)
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in vectors]
    assert sorted((r.vec_id, [int(x) for x in r.v]) for r in rows.collect()) == sorted(kept)
    asked = rows.where("vec_id % 50 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    got = defaultdict(list)
    for r in search(build_index(rows, block_rows=37), asked, 5, group_bytes=100).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for r in asked.collect():
        own = [int(x) for x in r.v]
        every = sorted((-sum(a * b for a, b in zip(v, own, strict=True)), i) for i, v in kept if i != r.query_id and len(v) == len(own))[:5]
        assert sorted(got[r.query_id]) == [(k, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, i) in enumerate(every, 1)]
    assert search(build_index(rows.limit(0)), asked, 5).count() == search(build_index(rows), asked.limit(0), 5).count() == 0


def test_index_is_dealt_once(spark, monkeypatch):
    """No group of queries shuffles the index again."""
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    rows = usable(spark.createDataFrame([(i, [math.sin(i), math.cos(i)]) for i in range(200)], "vec_id long, embedding array<double>"))
    index = build_index(rows, block_rows=50)
    monkeypatch.setattr(bitsliced, "written", seen)
    assert search(index, rows.select(F.col("vec_id").alias("query_id"), "v"), 2, group_bytes=1000).count() == 400
    near = [p for n, p in plans if n == "near"]
    assert len(near) > 3 and not any("Exchange" in p for p in near)


def test_order_of_scores():
    scores = sorted([0, 1, -1, 255, 256, -255, -256, 1 << 63, -(1 << 63), 10**40, -(10**40)])
    assert sorted(scores, key=order_key) == scores


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain rules on a table that holds a case for each stage."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("the and of river stone light water green paper house".split()) + rng.choice(["", "", "."]) + str(rng.choice("abcdefghij")) * rng.randint(0, 2) for _ in range(n))
    clean = [(i, say(80) + ".", "en", "s", 1) for i in range(30)]
    words = clean[3][1].split()
    near = [(40, " ".join([*words[:79], "x"]), "en", "s", 1), (41, clean[4][1], "en", "s", 1)]
    bad = [(50, "too short", "en", "s", 1), (51, "spam spam " * 60, "en", "s", 1), (52, " ".join(w + "###" for w in words), "en", "s", 1), (53, None, "en", "s", 1)]
    docs = spark.createDataFrame(clean + near + bad, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    after, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, after, str(tmp_path))
        assert after.columns == list(corpus_pipeline.COLUMNS), name
        kept.append({r.doc_id for r in after.collect()})
    assert kept[0] == kept[1] == {*range(30), 40, 41} and kept[2] == set(range(30))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == kept[2] and all(r.offset + r.length <= 2048 for r in rows)
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 2048)


def test_entry_lists_all():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and zlib.crc32(b"0") >= 0
