"""Token files, packing, quality rules, language, near copies, toxicity, pieces: against brute force and on odd tables."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfactor.llm import langid, neardup, packing, pieces, quality, token_files, tokenizing, toxicity
from sparkfactor.llm.common import bounded_sample, written

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n a", "a \n b", "a\n\n  b\t c", "don't 's", "x <|endoftext|> y", "é ́x", "a.", "É. ß,", "x\x1cy  z", "foo\n bar\nbaz.", None]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoder_equals_the_library(path):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\tabC.,'é1!") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    enc, found = tokenizing.CachedEncoder(path), []
    for _ in range(2):
        found = [ids[a:b].tolist() for _, ids, bounds in enc.encode(pa.array(texts, pa.string())) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert found == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_new_pieces_reach_the_library_in_few_texts(path, monkeypatch):
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdeéñßж") for _ in range(9)) for _ in range(6000)})
    texts = ["a " + " ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    glued = ["a " + " ".join(f"{w}&&&, {w}." for w in words[k : k + 50]) for k in range(0, len(words), 50)]
    lines = ["a " + " ".join(f"{w}.\n{w}! {w}.\n\n{w} {w}\n\t{w}" for w in words[k : k + 50]) for k in range(0, 1000, 50)]
    monkeypatch.setattr(tokenizing, "CACHE_PIECES", 20_000)
    enc, given = tokenizing.CachedEncoder(path), []
    library = enc.tokenizer

    class Counted:
        def encode_batch_fast(self, some, **kw):
            given.extend(some)
            return library.encode_batch_fast(some, **kw)

    enc.tokenizer = Counted()
    for some, most in ((texts, 40), (glued, 40), (lines, 5000)):
        given.clear()
        found = [ids[a:b].tolist() for _, ids, bounds in enc.encode(pa.array(some, pa.string())) for a, b in zip(bounds, bounds[1:], strict=False)]
        assert len(given) <= most
        assert found == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_marks_that_do_not_fit_are_not_used():
    enc = tokenizing.CachedEncoder(BYTE)
    enc.marks[:] = False
    assert [ids.tolist() for _, ids, _ in enc.encode(pa.array(["some new words. Here"]))] == [enc.tokenizer.encode("some new words. Here").ids]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(3)
    for values in ([], [0], [5], [0, 0, 0], np.sort(rng.integers(0, 10**9, 1000)), np.arange(300), [0, 2**40]):
        ef = token_files.EliasFano.from_bytes(token_files.EliasFano.build(np.array(values, np.int64)).to_bytes())
        assert ef.values().tolist() == list(values) == [ef.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        ef.select(2)


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    tok = Tokenizer.from_file(BYTE)
    blocks = token_files.write_token_files(odd_docs, BYTE, 2)
    got = token_files.read_documents(blocks, with_ids=True).collect()
    want = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd_docs.collect()]
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.ids_crc32) for r in got) == Counter((d, tuple(i), len(i), crc(i)) for d, i in want)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    row = blocks.first()
    block = token_files.Block(row.data)
    assert block.document(0).tolist() in [i for _, i in want]
    assert token_files.export(blocks, row.shard, str(tmp_path / "shard")) >= 1
    assert token_files.token_documents(spark, no_docs, BYTE, 2).count() == 0


def test_best_fit_plan_places_all():
    rng = random.Random(5)
    for _ in range(50):
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        runs, n = packing.best_fit_plan(counts, 64)
        bins = defaultdict(list)
        for length in counts:
            ranks = [r for run in runs if run.length == length for r in range(run.first, run.first + run.n)]
            assert sorted(ranks) == list(range(counts[length]))
        for run in runs:
            for i in range(run.n):
                bins[run.bin + i // run.each].append((run.offset + i % run.each * run.length, run.length))
        rooms: list[int] = []  # best fit over the items, one by one
        for length in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((64 if fit is None else fit) - length)
        assert len(bins) == n == len(rooms)
        for parts in bins.values():
            ends = 0
            for at, length in sorted(parts):
                assert at == ends
                ends += length
            assert ends <= 64


def test_packing(odd_docs, no_docs):
    tok = Tokenizer.from_file(WORD)
    got = packing.pack(odd_docs, WORD, 0, 128, with_ids=True)
    rows = got.collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.update((r.doc_id, k // 128, k, len(ids[k : k + 128]), crc(ids[k : k + 128])) for k in range(0, len(ids), 128))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for s in packing.sequences(got).collect():
        parts = sorted((r.offset, r.ids) for r in rows if r.sequence_id == s.sequence_id)
        assert s.ids == [i for _, ids in parts for i in ids] and len(s.ids) <= 128
        assert [o for o, _ in parts] == np.cumsum([0, *(len(i) for _, i in parts)])[:-1].tolist()
    assert packing.pack(no_docs, WORD, 0).count() == 0


def brute_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(odd_docs, no_docs):
    rows = quality.quality_rules(odd_docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((r.doc_id, *brute_measures(r.text)) for r in odd_docs.collect())
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.kept and r.base_failed) for r in rows)
    assert quality.quality_rules(no_docs).count() == 0


def test_quality_em_finds_a_better_rule(spark):
    rows = [(1,) * 7] * 80 + [(-1, 1, 1, 1, -1, -1, 1)] * 15 + [(1, 1, 1, 1, 1, -1, 1)] * 5
    votes = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in quality.RULES)).groupBy(*quality.RULES).agg(F.count(F.lit(1)).alias("n"))
    model = quality.fit(votes)
    good = {tuple(r[k] for k in quality.RULES): r.q for r in votes.withColumn("q", quality.posterior(model)).collect()}
    assert good[rows[0]] > 0.95 and good[rows[80]] < 0.05 and good[rows[-1]] > 0.5


def test_language(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in odd_docs.collect() if r.doc_id is not None}
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        text = lang.get(r.doc_id, (None, None))[1]
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == lang[r.doc_id][0]
    assert langid.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_temperature_softens_wrong_certainty():
    logits, y = np.array([[5.0, 0.0]] * 10), np.array([0] * 6 + [1] * 4)
    assert langid.calibrate(logits, y) > 3


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, {i: len(s) for i, s in sets.items()}


def test_posterior_knows_which_rules_err(spark):
    """Two rules that often err on good documents, and two that don't: the posterior beats a count of bad votes."""
    rng, names = random.Random(8), list(quality.RULES)
    right_on_good = dict.fromkeys(names, 0.98) | {names[0]: 0.65, names[1]: 0.7}
    right_on_bad = dict.fromkeys(names, 0.2) | {names[0]: 0.4, names[1]: 0.35, names[2]: 0.9, names[3]: 0.85}
    docs = []
    for _ in range(6000):
        good = rng.random() < 0.8
        says_right = [rng.random() < (right_on_good if good else right_on_bad)[r] for r in names]
        docs.append((good, *(0 if rng.random() < 0.1 else 1 if right == good else -1 for right in says_right)))
    df = spark.createDataFrame(docs, "good boolean, " + ", ".join(f"{r} int" for r in names))
    model = quality.fit(df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    assert abs(model["p"] - 0.8) < 0.03
    assert all(abs(model[f"a_{r}"] - right_on_good[r]) < 0.05 for r in names) and all(abs(model[f"b_{r}"] - right_on_bad[r]) < 0.08 for r in names)
    rows = df.withColumn("q", quality.posterior(model)).collect()
    found = sum((r.q >= 0.5) == r.good for r in rows) / len(rows)
    for most in (0, 1, 2):
        assert found > sum((sum(r[n] < 0 for n in names) <= most) == r.good for r in rows) / len(rows)
    two = [r for r in rows if r[names[0]] == r[names[1]] == -1 and all(r[n] == 1 for n in names[2:])]
    one = [r for r in rows if r[names[2]] == r[names[3]] == -1 and all(r[n] == 1 for n in names[:2])]
    assert two and one and all(r.q >= 0.5 for r in two) and all(r.q < 0.5 for r in one)


@pytest.mark.parametrize("small", [0, 32])
def test_near_duplicates(spark, odd_docs, no_docs, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", small + 7)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = []
    for i in range(60):  # copies at every distance, so some link only by way of others
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, " ".join(w[: len(w) - rng.randint(0, 4)])))
    docs += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(40)]
    docs += [(200, "A b"), (201, "a B"), (202, "single"), (203, ""), (204, None), (205, "SINGLE")]
    rng.shuffle(docs)
    label, sizes = brute_components(docs, 2, 80)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.component_id == r.doc_id) for r in got)
    if small:
        mixed = [(7, "one two three four five six"), (7, "one two three four five six"), (3, "ONE two three four five six"), (7, "quite another text under this id"), (9, "quite Another text under this id")]
        rows = neardup.near_duplicates(spark.createDataFrame(mixed, "doc_id long, text string"), 2, 80).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(3, 3, True), (7, 3, False), (7, 3, False), (7, 7, True), (9, 7, False)]
        rows = neardup.near_duplicates(odd_docs, 2, 80).collect()
        assert len(rows) == odd_docs.count()
        by = {r.doc_id: r for r in rows}
        assert by[107].component_id == 0 and by[106].component_id == 105 and by[100].kept and by[101].component_id == 101
        assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
        assert neardup.near_duplicates(no_docs).count() == 0


def excerpts(n, blocks=50, share=0.72):
    """``n`` excerpts of one text, each with the same share of its blocks of 20 words; every two are candidates, few are linked."""
    rng = random.Random(12)
    text = [[f"w{rng.randrange(100_000)}" for _ in range(20)] for _ in range(blocks)]
    docs = [(i, " ".join(w for k in sorted(rng.sample(range(blocks), int(share * blocks))) for w in text[k])) for i in range(n)]
    return docs + [(n, " ".join(w for b in text for w in b))]


def test_excerpts_of_one_text(spark, monkeypatch):
    """The rows of all tables but the blocks' own grow with the excerpts, not with their pairs, and links are those of brute force."""
    rows = {}
    for n in (150, 400, 800):
        docs, seen = excerpts(n), rows.setdefault(n, {})

        def counted(df, name, seen=seen):
            out = written(df, name)
            seen[name] = max(seen.get(name, 0), out.count())
            return out

        monkeypatch.setattr(neardup, "written", counted)
        got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()
        if n == 150:
            assert {r.doc_id: r.component_id for r in got} == brute_components(docs, 2, 80)[0]
    for name in ("star-pairs", "listed-pairs", "met-centres", "members", "links"):
        assert rows[800][name] <= 3 * rows[400][name] + 10, (name, rows)
    assert sum(rows[800].values()) < 800 * 250


def test_shared_shingles_and_forest():
    rng = np.random.default_rng(13)
    centre, others = np.arange(100, dtype=np.int64), np.arange(1000, 1030, dtype=np.int64)
    sets = [np.union1d(rng.choice(centre, rng.integers(0, 100), replace=False), rng.choice(others, rng.integers(0, 10), replace=False)) for _ in range(30)]
    own = [np.setdiff1d(s, centre) for s in sets]
    got = neardup.shared_shingles([np.packbits(np.isin(centre, s)).tobytes() for s in sets], own)
    expected = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (got == expected)[~np.eye(30, dtype=bool)].all()
    pairs = np.array([(i, j) for i in range(12) for j in range(i + 1, 12)])
    found = neardup.forest(pairs, np.array([0, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 8]))
    assert len(found) == 8 and neardup.forest(pairs[:0], np.zeros(3)) == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100, 5000):
        assert (neardup.sketch(rng.integers(1, 2**63, n).astype(np.uint64), 220) < np.iinfo(np.uint64).max).all()
    a = rng.integers(1, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(1, 2**63, 100).astype(np.uint64)])
    same = (neardup.sketch(a, 400) == neardup.sketch(b, 400)).mean()
    assert abs(same - 900 / 1100) < 0.08


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = int(rng.random() < 0.3)
        w = [rng.choice("the river stone house light green water paper and of".split()) for _ in range(40)]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(40), rng.choice(["moronic", "stupid", "loser"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    hidden = ["you m0r0n1c one", "so st.u.p.i.d", "a l o s e r here", "what a stuuuupid thing"]
    rows += [(1000 + i, "the river and " + t) for i, t in enumerate(hidden)] + [(2000, "the river of light"), (2001, None), (2002, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert all(got[1000 + i].predicted == 1 for i in range(4)), [got[1000 + i].score for i in range(4)]
    assert got[2000].predicted == got[2001].predicted == got[2002].predicted == 0 and got[2001].score == got[2002].score
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    assert toxicity.toxicity(odd_docs, marks.limit(0)).count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, marks).count() == 0


def brute_segmentations(v, part):
    """All segmentations with their scores, by recursion."""
    out, single = [], {p for p in v.pieces if len(p) == 1}

    def go(at, score, ids):
        if at == len(part):
            out.append((score, ids))
            return
        for n in range(1, len(part) - at + 1):
            p = part[at : at + n]
            if p in v.pieces:
                go(at + n, score + v.pieces[p][1], ids + [v.pieces[p][0]])
        if part[at] not in single:
            go(at + 1, score + v.least, ids + v.unknown_ids(part[at]))

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_nbest_is_exact():
    v = pieces.vocabulary(PIECE)
    for part in ("▁hello", "▁the", "▁stéad", "▁a\nb", "▁▁x", "▁", "▁日x", "▁1234"):
        every, got = brute_segmentations(v, part), v.nbest(part, 6)
        assert [s for s, _ in got] == [s for s, _ in every[:6]]
        assert all((s, ids) in every for s, ids in got) and v.count(part)[0] == every[0][0]


def test_forward_pass_of_many_parts_is_exact():
    """Best score, loss of the second best and, where that isn't 0, the best one's ids, all parts in one go."""
    v, rng = pieces.vocabulary(PIECE), random.Random(10)
    parts = ["▁", "▁▁▁", "▁日x", "▁a\nb", "▁\U0010ffff", "▁\U0010ffff日é", "▁stéad"] + ["▁" + "".join(rng.choice("theandsionrwlé日,%") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    for part, (score, loss, ids) in zip(parts, v.two_best(parts), strict=True):
        every = brute_segmentations(v, part)
        assert score == every[0][0] and loss == (score - every[1][0] if len(every) > 1 else float("inf")), part
        got = list(struct.unpack(f"<{len(ids) // 4}I", ids))
        assert got == every[0][1] if loss else (score, got) in every, part
    assert list(v.two_best([])) == []


def test_only_parts_that_may_deviate_are_searched(spark, monkeypatch):
    """A text of 400 different words: its 4 best segmentations differ in 3 parts, and no other is searched unless its best has an equal."""
    rng, searched, nbest = random.Random(11), [], pieces.Vocabulary.nbest
    monkeypatch.setattr(pieces.Vocabulary, "nbest", lambda self, part, n: searched.append(part) or nbest(self, part, n))
    words = ["".join(rng.choice("theandsionrwl") for _ in range(rng.randint(5, 12))) for _ in range(400)]
    held = type("Held", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, _: run})()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array([" ".join(words)])})
    pieces.known_parts.cache_clear()
    got = [r for b in pieces.segmentations(held, PIECE, 4)(iter([batch])) for r in b.to_pylist()]
    v = pieces.vocabulary(PIECE)
    assert [r["score"] for r in got] == best_sums([nbest(v, "▁" + w, 4) for w in words], 4)
    equal = sum(len(x) > 1 and x[0][0] == x[1][0] for x in (nbest(v, "▁" + w, 2) for w in words))
    assert len(searched) <= 4 * (3 + equal) < 100


def test_counts_follow_the_tokenizer():
    from tokenizers.models import Unigram

    v = pieces.vocabulary(PIECE)
    vocabulary = [("<unk>", 0.0)] + [(p, s) for p, (_, s) in v.pieces.items()]
    library = Tokenizer(Unigram(vocabulary, 0, False))
    rng = random.Random(9)
    for _ in range(500):
        part = "▁" + "".join(rng.choice("theandsionrwlé") for _ in range(rng.randint(1, 14)))
        assert v.count(part)[1] == len(library.encode(part).ids), part


def test_segmentations_and_counts(odd_docs, no_docs):
    v = pieces.vocabulary(PIECE)
    counts = {(r.doc_id, r.score): r.n_tokens for r in pieces.token_counts(odd_docs, PIECE).collect()}
    got = defaultdict(list)
    for r in pieces.segmentations(odd_docs, PIECE, 4, with_ids=True).collect():
        got[r.doc_id].append(r)
    for r in odd_docs.where("doc_id is not null and doc_id <> 107").collect():
        own = sorted(got[r.doc_id], key=lambda x: x["rank"])
        assert [x["rank"] for x in own] == list(range(1, len(own) + 1)) and [x.score for x in own] == sorted((x.score for x in own), reverse=True)
        assert len({tuple(x.ids) for x in own}) == len(own)
        assert all(x.n_pieces == len(x.ids) and x.ids_crc32 == crc(x.ids) for x in own)
        assert all(v.decode(x.ids) == (r.text or "") and x.text_crc32 == zlib.crc32((r.text or "").encode()) for x in own)
        # among equally good segmentations the counts' rule decides, so only the score is the same for certain
        assert (r.doc_id, own[0].score) in counts
        if r.doc_id == 108:  # very long: the sum over its parts, of which the first has 5000 characters
            assert len(own) == 4 and own[0].score == sum(v.count(p)[0] for p in pieces.parts_of(r.text))
    assert pieces.segmentations(no_docs, PIECE).count() == pieces.token_counts(no_docs, PIECE).count() == 0


def best_sums(lists, n):
    """The ``n`` best sums of one choice from each list, by keeping all partial sums that can still be among them."""
    sums = [0.0]
    for x in lists:
        sums = sorted((a + s for a in sums for s, _ in x), reverse=True)[:n]
    return sums


def test_segmentations_equal_all_products(spark):
    """Texts of up to eight parts: every part's segmentations by recursion, and all products of them."""
    rng = random.Random(12)
    words = ["a", "the", "ther", "in", "ab", "xq", "é", "on", "日", "", "word", "zz"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for i in range(60)}
    v = pieces.vocabulary(PIECE)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n in (1, 2, 4, 7):
        got = defaultdict(list)
        for r in pieces.segmentations(docs, PIECE, n).collect():
            got[r.doc_id].append((r["rank"], r.score))
        for i, t in texts.items():
            lists = [brute_segmentations(v, p) for p in pieces.parts_of(t)]
            assert [s for _, s in sorted(got[i])] == best_sums(lists, n), t
    for r in pieces.token_counts(docs, PIECE).collect():
        lists = [brute_segmentations(v, p) for p in pieces.parts_of(texts[r.doc_id])]
        assert r.score == best_sums(lists, 1)[0]
        assert r.n_tokens in {sum(c) for c in product(*({len(ids) for s, ids in x if s == x[0][0]} for x in lists))}


def test_counts_equal_the_library(odd_docs):
    """The unigram model of the ``tokenizers`` library with byte fallback, on the same vocabulary, is the standard for ties."""
    import sentencepiece
    from tokenizers.models import Unigram

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    v = pieces.vocabulary(PIECE)
    # control pieces and bytes can't be met in a text, so they only hold their ids
    vocabulary = [(p if p in v.pieces else f"\x00{i}", s) if not sp.is_byte(i) else (p, s) for i, (p, s) in enumerate(vocabulary)]
    model = Tokenizer(Unigram(vocabulary, unk_id=sp.unk_id(), byte_fallback=True))
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id is not null and doc_id <> 108").collect()}
    for r in pieces.token_counts(odd_docs, PIECE).collect():
        if texts.get(r.doc_id):
            assert r.n_tokens == len(model.encode("▁" + texts[r.doc_id].replace(" ", "▁")).ids), texts[r.doc_id]


def test_lattice_equals_all_paths():
    """Every path of short tokens' lattices, scored by the model's own definition."""
    rng = np.random.default_rng(3)
    speller = toxicity.Speller(rng.integers(0, 50, toxicity.N**3))

    def score(letters):
        codes = [0, 0, *letters, 0]
        return sum(speller.log[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    for token in ("1d", "a$$", "s7uu", "4bb1", "i--d", "5h17", "o0.t", "|zzz", "w*rd"):
        runs = [(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", token)]
        paths = []
        for choice in product(*(speller._options(ch, n) for ch, n in runs)):
            letters = [k for add, _ in choice for k in add]
            paths.append((sum(cost for _, cost in choice) + score(letters), "".join(chr(96 + k) for k in letters)))
        top = max(s for s, _ in paths)
        assert speller.decode(token) in {w for s, w in paths if abs(s - top) < 1e-9}


def test_training_equals_scalar_rule():
    """Follow-the-regularised-leader, one weight at a time, in plain Python."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3), int(rng.integers(3))) for _ in range(25)]
    z, n, bias = {}, {}, 1 << langid.BITS

    def weight(j, c):
        zs, ns = z.get((j, c), 0.0), n.get((j, c), 0.0)
        if abs(zs) <= langid.L1:
            return 0.0
        return -(zs - (langid.L1 if zs > 0 else -langid.L1)) / ((langid.BETA + ns**0.5) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for at, v, y in rows:
            features = [*zip(at.tolist(), v.tolist(), strict=True), (bias, 1.0)]
            w = {(j, c): weight(j, c) for j, _ in features for c in range(3)}
            logits = [sum(w[j, c] * x for j, x in features) for c in range(3)]
            e = [np.exp(x - max(logits)) for x in logits]
            for j, x in features:
                for c in range(3):
                    g = x * (e[c] / sum(e) - (c == y))
                    old = n.get((j, c), 0.0)
                    z[j, c] = z.get((j, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / langid.ALPHA * w[j, c]
                    n[j, c] = old + g * g
    weights, own_bias = langid.train(rows, 3)
    for c in range(3):
        assert np.isclose(own_bias[c], weight(bias, c), atol=1e-6)
        assert np.allclose(weights[:6, c], [weight(j, c) for j in range(6)], atol=1e-6)
    assert not weights[6:].any()


def test_sample_is_exact(spark):
    """One id of 5000 rows, equal rows among them, beside few rows of another group."""
    rows = [(7, f"text {i}", "en") for i in range(4000)] + [(7, "the same", "en")] * 1000 + [(i, f"wenig {i}", "de") for i in range(10)] + [(9, "gleich", "fr")] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    for most in (1, 50, 600):
        got = Counter(r.lang for r in bounded_sample(docs, "lang", most).collect())
        assert got == {"en": min(most, 5000), "de": min(most, 10), "fr": min(most, 700)}
    assert bounded_sample(docs, "lang", 4500).where("lang = 'en'").count() == 4500
    model = langid.fit(spark.createDataFrame(rows[:6010], docs.schema))
    assert model.languages == ["de", "en", "fr"]
