"""Pruned k-NN novelty and the archive against brute force."""

import numpy as np
import pytest

from sparkfactor.operators import archive, neighbours

ODD = [(900, None), (901, []), (902, [float("nan")] * 6), (903, [None] * 6), (904, [float("inf")] * 6)]
SCHEMA = "ind_id long, behavior array<double>"


def plain_novelty(own, others, k):
    d = sorted(float(np.sqrt(((np.array(o) - np.array(own)) ** 2).sum())) for o in others)[:k]
    return sum(d) / len(d) if d else 0.0


@pytest.mark.parametrize("pivots,block_rows,chunk_rows", [(1, 5, 3), (7, 20, 6), (64, 2048, 4096)])
def test_knn(spark, pivots, block_rows, chunk_rows):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (40, 6)) for c in (0, 20, 40)] + [np.tile(rng.normal(size=6), (30, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, [1.0, 2.0]), (201, [1.0, 5.0]), (202, [3.0]), (5, x[7].tolist())]
    stored = [[0.5] * 6, [20.0] * 6, [1.0, 2.0], None, []]
    report: dict = {}
    frame = spark.createDataFrame(rows + ODD, SCHEMA).selectExpr("*", "1 as dim", "2 as cell", "3 as row").repartition(4)
    kept = spark.createDataFrame([(s,) for s in stored], "behavior array<double>")
    got = sorted((r.ind_id, r.novelty) for r in neighbours.knn_novelty(frame, 4, kept, pivots=pivots, block_rows=block_rows, chunk_rows=chunk_rows, report=report).collect())
    want = [(i, plain_novelty(v, [o for j, (_, o) in enumerate(rows) if j != n and len(o) == len(v)] + [s for s in stored if s and len(s) == len(v)], 4)) for n, (i, v) in enumerate(rows)]
    want = sorted(want + [(i, 0.0) for i, _ in ODD])
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([v for _, v in got], [v for _, v in want], atol=1e-9)
    assert report["pairs"] == (len(rows) + 3) * len(rows)
    if pivots == 7:  # three far clusters and a point: most cells are never met
        assert report["compared"] < 0.6 * report["pairs"]
    assert neighbours.knn_novelty(frame.limit(0), 4).count() == 0


def plain_archive(prints, size, k):
    held: list = []
    mean = lambda a, others: float(np.sort(np.sqrt(((np.array(others) - a) ** 2).sum(1)))[:k].mean()) if others else 0.0
    for name, b in prints:
        own = [mean(e, [o for _, o in held[:i] + held[i + 1 :]]) for i, (_, e) in enumerate(held)]
        if held and mean(b, [e for _, e in held]) <= np.mean(own):
            continue
        if len(held) >= size:
            held.pop(int(np.argmin(own)))
        held.append((name, b))
    return [n for n, _ in held]


@pytest.mark.parametrize("slack,margin,turns,first", [(0, 0.0, 3, 5), (2, 0.01, 40, 30), (4, 0.01, 256, 1024), (1, 0.3, 7, 1)])
def test_archive_equals_one_by_one(spark, slack, margin, turns, first):
    rng = np.random.default_rng(2)
    prints = [(i, v) for i, v in enumerate(np.concatenate([rng.normal(size=(120, 6)), rng.normal(size=(180, 6)) * np.linspace(0.5, 2, 180)[:, None]]))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in prints] + ODD, SCHEMA).selectExpr("*", "1 as pos", "2 as a", "3 as tie").repartition(3)
    got = archive.novelty_archive(frame, 12, 3, slack=slack, margin=margin, turns=turns, first=first).orderBy("place").collect()
    assert [r.ind_id for r in got] == plain_archive(prints, 12, 3)
    assert archive.novelty_archive(frame.limit(0), 12, 3).count() == 0


@pytest.mark.parametrize("size,k", [(1, 3), (2, 5), (3, 3), (5, 3)])
def test_small_archive_equals_one_by_one(spark, size, k):
    """Fewer than k entries, just k, and a few more, on a stream that spreads out and comes back."""
    rng = np.random.default_rng(5)
    prints = list(enumerate(rng.normal(size=(150, 4)) * np.concatenate([np.ones(70), np.linspace(1, 3, 50), np.ones(30)])[:, None]))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in prints], SCHEMA).repartition(3)
    got = archive.novelty_archive(frame, size, k, turns=9, first=20).orderBy("place").collect()
    assert [r.ind_id for r in got] == plain_archive(prints, size, k)


def test_archive_that_stays_small_leaves_few_to_the_driver(spark, monkeypatch):
    """On directions alone hardly more than k ever enter; all others are refused by executors, whatever the room."""
    prints, turns, offer = np.random.default_rng(6).normal(size=(3000, 24)), [], archive.NoveltyArchive.offer
    prints /= np.linalg.norm(prints, axis=1)[:, None]
    monkeypatch.setattr(archive.NoveltyArchive, "offer", lambda self, b, name=None: turns.append(name) or offer(self, b, name))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(prints)], SCHEMA)
    got = [r.ind_id for r in archive.novelty_archive(frame, 50, 5).orderBy("place").collect()]
    assert got == plain_archive(list(enumerate(prints)), 50, 5) and len(got) < 9
    assert len(turns) < archive.TURNS + 100


def test_archive_over_ranges_equals_one_by_one(spark, monkeypatch):
    """A stream that is put in order by ranges, not in one task."""
    monkeypatch.setattr(archive, "ONE_TASK_ROWS", 50)
    prints = list(enumerate(np.random.default_rng(7).normal(size=(300, 6))))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in reversed(prints)] + ODD, SCHEMA).repartition(3)
    assert [r.ind_id for r in archive.novelty_archive(frame, 12, 3).orderBy("place").collect()] == plain_archive(prints, 12, 3)


def test_executors_leave_few_to_the_driver(spark):
    """Behind the first stretch nearly all fingerprints of a settled stream are refused without their turn."""
    rng = np.random.default_rng(3)
    prints = np.concatenate([rng.normal(size=(40, 4)) * 10, rng.normal(size=(500, 4))])
    kept = archive.NoveltyArchive(10, 3)
    kept.update(list(prints[:40]))
    rows = spark.createDataFrame([(i, i, p.tolist()) for i, p in enumerate(prints[40:])], "pos long, ind_id long, a array<double>")
    left = archive._may_enter(rows, np.array(kept.entries), 3, 1, 0.99 * kept.threshold())
    assert left.count() < 50


def test_archive_keeps_distances_up_to_date():
    rng = np.random.default_rng(4)
    own = archive.NoveltyArchive(8, 3)
    for b in rng.normal(size=(100, 5)):
        own.offer(b)
        whole = np.sqrt(((np.array(own.entries)[:, None] - np.array(own.entries)[None]) ** 2).sum(2))
        assert all(np.array_equal(n, np.sort(np.delete(d, i))) for i, (n, d) in enumerate(zip(own.near, whole, strict=True)))
