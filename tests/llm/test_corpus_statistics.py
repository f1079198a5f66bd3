"""Importance resampling, the permutation index and the divergence audit against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkfactor.llm import bytewords, divergence, permindex, resampling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(UPPER))


WORDS, TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def test_words_on_bytes_equal_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB9 é日\n-_\x1c.Z🙂\x00") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "x" * 5000, " "]
    rng.shuffle(texts)
    for pattern, member in ((WORDS, resampling.WORD_BYTES), (TERMS, divergence.TERM_BYTES)):
        for batch in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
            for size in (1, 40, 1 << 20):
                got = [[] for _ in texts]
                for w in bytewords.words_of_batch(batch, member, size):
                    for t, c in zip(w.text, w.code, strict=True):
                        got[w.first + t].append(w.distinct[c].decode())
                assert got == [words(t, pattern) for t in texts]
    assert list(bytewords.words_of_batch(pa.array([], pa.string()), resampling.WORD_BYTES)) == []


def test_run_crcs_equal_crcs_of_strings():
    rng = random.Random(2)
    distinct = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 2, 3, 7, 64, 65, 1000, 70_000)]
    text = np.sort(np.array([rng.randrange(5) for _ in range(60)]))
    code = np.array([rng.randrange(len(distinct)) for _ in range(60)])
    got = list(resampling.run_crcs(code, text, distinct, 4))
    for k, (t, crc) in enumerate(got, 1):
        runs = [(text[i], zlib.crc32(b" ".join(distinct[c] for c in code[i : i + k]))) for i in range(61 - k) if text[i] == text[i + k - 1]]
        assert list(zip(t, crc, strict=True)) == runs
    assert len(got) == 4 and [len(t) for t, _ in resampling.run_crcs(code[:1], text[:1], distinct, 3)] == [1]


def resampled(docs, target, n_buckets, percent, seed, least):
    def features(text):
        w = words(text, WORDS)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n_buckets for k in (1, 2) for i in range(len(w) - k + 1)], len(w)

    own, wanted = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for f, _ in own for b in f), Counter(b for f, _ in wanted for b in f)
    n_s, n_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + n_buckets) / ((s[b] + 1) * (n_t + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for (i, _), (f, n) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(f), weight, score, n))
    fit = sorted((r for r in rows if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    drawn = Counter((*r[:4], k) for k, r in enumerate(fit[: len(fit) * percent // 100], 1))
    rest = Counter((*r[:4], None) for r in [r for r in rows if r not in fit] + fit[len(fit) * percent // 100 :])
    return drawn + rest


@pytest.mark.parametrize("part_rows", [7, 1 << 20])
def test_resampling(spark, odd_docs, no_docs, monkeypatch, part_rows):
    rng = random.Random(3)
    target = [" ".join(rng.choice("light water green paper 日本 x9".split()) for _ in range(40)) for _ in range(5)] + [None, ""]
    wanted = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(target)], "item_id long, text string, score double")
    monkeypatch.setattr(resampling.draw, "__defaults__", (part_rows,))
    got = resampling.resample(odd_docs, wanted, percent=30, seed=7, least_words=20, n_buckets=50)
    rows = Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert rows == resampled([(r.doc_id, r.text) for r in odd_docs.collect()], target, 50, 30, 7, 20)
    assert resampling.resample(no_docs, wanted).count() == 0
    alone = resampling.resample(odd_docs, wanted.limit(0), n_buckets=50)
    assert alone.where("doc_id = 100").first().weight == 0 and alone.count() == odd_docs.count()


def audited(docs, least, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        counts[lang, source].update(w := words(text, TERMS))
        seen[lang].update(set(w))
    out = set()
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 1) // (total + v)
    for (lang, source), own in counts.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        sums = {s: sum(c[t] for t in kept) for (l2, s), c in counts.items() if l2 == lang}
        together = {t: sum(c[t] for (l2, _), c in counts.items() if l2 == lang) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        p = {t: share(own[t], sums[source], len(kept)) for t in kept}
        pairs = [(sum(f(p[t], share(counts[lang, o][t], sums[o], len(kept))) for t in kept), o) for o in sums if o != source]
        q = {t: share(together[t], sum(sums.values()), len(kept)) for t in kept}
        terms = [(f(p[t], q[t]), t) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, rows in (("pair", pairs), ("term", terms)):
            for k, (v, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode())), 1):
                if part == "pair" or k <= top:
                    out.add((lang, source, part, item, v, k))
    return out


@pytest.mark.parametrize("postings,sources,top", [(40, 2, 3), (200_000, 128, 200)])
def test_divergence(spark, odd_docs, no_docs, monkeypatch, postings, sources, top):
    """Small blocks of terms and sources, and those in use, against sums over all terms."""
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    rng = random.Random(4)
    vocabulary = ["the", "Of", "straße", "naïve", "日本", *(f"{a}{b}x" for a in "abcdef" for b in "ghijkl")]
    more = [(None, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", "v", "é", None]), 1) for _ in range(150)]
    more += [(1, None, "xx", "only", 0), (1, "rare words", "yy", "a", 0), (1, "other", "yy", "b", 0)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.selectExpr("*", "1 as term", "2 as n", "3 as p", "4 as q", "5 as nth", "6 as value")
    got = [tuple(r) for r in divergence.audit(docs, 3, top, sources).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == audited([(r.text, r.lang, r.source) for r in docs.collect()], 3, top)
    assert divergence.audit(no_docs).count() == 0


@pytest.mark.parametrize("width", [1, 8, 4096])
def test_corrections_equal_sums_over_all_terms(width):
    rng = np.random.default_rng(8)
    table = np.where(rng.random((6, 50)) < 0.3, rng.integers(1, 1_000_000_001, (6, 50)), 0)
    table[2], table[3] = 0, np.where(table[3] > 0, 1_000_000_001, 0)
    p0 = rng.integers(1, 40, 6)
    source, term = np.nonzero(table)
    mixed = rng.permutation(len(source))
    got = divergence.corrections(source[mixed], term[mixed], table[source, term][mixed], p0, width)
    full = np.where(table > 0, table, p0[:, None])
    for g in range(6):
        for h in range(6):
            whole = sum((int(p) - int(q)) ** 2 // int(q) for p, q in zip(full[g], full[h], strict=True))
            assert g == h or got[g, h] == whole - 50 * ((int(p0[g]) - int(p0[h])) ** 2 // int(p0[h]))
    assert not divergence.corrections(source[:0], term[:0], p0[:0], p0).any()


def test_shares_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**13, 10**15, 10**6), (0, 5, 3), (7, 0, 0)], "n long, total long, terms long")
    assert [r.p for r in rows.select(divergence.share("n", "total", "terms").alias("p")).collect()] == [1 + 10**9 * (10**13 + 1) // (10**15 + 10**6), 1 + 10**9 // 8, 1]


def test_permutation_index(spark):
    """Recall against brute force, exact scores and order, on random vectors with copies; odd rows take no part."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[700:1200] = x[700]  # a third of the rows are one vector
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(3000, [0.5, 0.25], 0), (3100, [0.25, 1.0], 0), (3001, [1e200, -1e200], 0), (40, [float(c) for c in x[3]], 0)]
    odd = [(5000, None, 0), (5100, [], 0), (5200, [0.0] * 32, 0), (5300, [float("nan")] * 32, 0), (5400, [None] * 32, 0), (5500, [float("inf")] * 32, 0), (None, [1.0] * 32, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, dim int").repartition(4)
    own = permindex.usable(table)
    assert own.count() == len(rows)
    asked = own.where("vec_id % 50 = 0").groupBy(own.vec_id.alias("query_id")).agg({"v": "min"}).withColumnRenamed("min(v)", "v")
    pivots = permindex.choose_pivots(own, 128)
    assert sorted(pivots) == [2, 32] and len(np.unique(pivots[32], axis=0)) == len(pivots[32]) == 128
    index = permindex.build_index(own, pivots, 64, block_rows=200)
    got = defaultdict(list)
    for r in permindex.search(index, pivots, asked, 10, 64, 0.2, group_bytes=2000).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in asked.collect():
        near = lambda v, q=q: float(np.sqrt(((np.array(v) - np.array(q.v)) ** 2).sum()))
        want = sorted((near(v), i) for i, v, _ in rows if i != q.query_id and len(v) == len(q.v))[:10]
        mine = sorted(got[q.query_id])
        assert [r for r, *_ in mine] == list(range(1, len(want) + 1)) and sorted((s, i) for _, i, s in mine) == [(s, i) for _, i, s in mine]
        apart = defaultdict(set)
        for i, v, _ in rows:
            if len(v) == len(q.v):
                apart[i].add(near(v))
        assert all(s in apart[i] for _, i, s in mine)
        hit += len({i for _, i in want} & {i for _, i, _ in mine})
        total += len(want)
        if q.query_id == 700:
            assert [i for _, i, _ in mine] == list(range(701, 711))
    assert hit / total >= 0.95
    assert permindex.search(index, pivots, asked.limit(0), 10).count() == permindex.nearest(own.limit(0), asked, 10).count() == 0


def test_footrule_by_inverted_files():
    """What the inverted files add up to is the induced footrule with missing pivots at the end."""
    rng = np.random.default_rng(6)
    x, pivots, prefix = rng.normal(size=(60, 5)), rng.normal(size=(20, 5)), 7
    block = permindex.Block.build(np.arange(60), x, pivots, prefix)
    every = permindex.orders(x, pivots, prefix)
    place = np.full((60, 20), prefix)
    np.put_along_axis(place, every, np.arange(prefix)[None].repeat(60, 0), 1)
    for q in range(10):
        footrule = np.abs(place - place[q]).sum(1)
        assert (prefix * (prefix + 1) - 2 * block.nearness(every[q]) == footrule).all()
