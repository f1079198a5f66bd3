"""Obfuscated words of every kind reach the lattice and are found."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkfactor.llm import toxicity

WORDS = "the river stone house light green water paper and of letter small class good idiot stupid loser asshole shit ass you are an in".split()


@pytest.fixture(scope="module")
def speller():
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) for _ in range(5000))
    k = np.array([0, 0, *(ord(c) - 96 if c.isalpha() else 0 for c in text), 0])
    return toxicity.Speller(np.bincount(k[:-2] * 729 + k[1:-1] * 27 + k[2:], minlength=27**3))


@pytest.mark.parametrize("token, word", [
    *((t, "idiot") for t in ("1d10t", "1d!0t", "1.d.1.0.t", "iidiioott", "IIdiiot", "i" * 30 + "d" * 30 + "10t", "-".join("idiot"))),
    *((t, "stupid") for t in ("stuupid", "sstuppid", "stüupid", "5tup1d", "stu" + "u" * 40 + "pid", "s" + "-" * 50 + "t-u-p-i-d")),
    ("l053r", "loser"), ("5h17", "shit"), ("4$$h0l3", "asshole"), ("@$$hole", "asshole"), ("a55", "ass"), ("4ss", "ass"),
])
def test_restored(speller, token, word):
    assert word in [w for w, _ in speller.words(token)]
    assert toxicity.Lexicon(speller, {"w" + word: 5.0}).score(token) == 5.0


def test_plain_words_stay(speller):
    for word in ("letter", "small", "class", "good", "green", "gréen"):
        assert speller.words(word) == [(word, False)]
    assert speller.words("12345") == speller.words("4$") == speller.words("...") == []


def test_long_ones_are_decoded_in_full(speller):
    lexicon = toxicity.Lexicon(speller, {"wstupid": 5.0})
    phrase = "you are an idiot in the house of paper and the green river " * 4 + "you are 5tup1d"
    letters = phrase.replace(" ", "")
    assert len(letters) > 160
    assert lexicon.spaced(letters) == lexicon.spaced(letters.upper()) == 5.0
    assert lexicon.score("-".join(letters)) == lexicon.score(".".join(letters.replace("o", "0"))) == 5.0
    assert speller.decode("stupid" * 20_000) == "stupid" * 20_000


def test_found_in_documents(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = int(rng.random() < 0.3)
        w = [rng.choice("the river stone house light green water paper and of letter".split()) for _ in range(40)]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(40), rng.choice(["idiot", "stupid", "loser"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    long = "river" * 40 + "5tup1d"
    hidden = ["what a stuupid one", "an 1d10t here", "you l053r", "so iidiioott", "a stu" + "u" * 40 + "pid thing", " ".join(long), "-".join(long)]
    rows += [(1000 + i, "the river and " + t) for i, t in enumerate(hidden)] + [(2000, "the letter of 2nd class 4ab3 " + "-".join("river" * 40))]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, marks).collect()}
    assert all(got[1000 + i] == 1 for i in range(len(hidden))), [got[1000 + i] for i in range(len(hidden))]
    assert got[2000] == 0


INSULTS = "loser clown idiot scum moron trash worthless pathetic disgusting stupid".split()
SIGNS = ({"a": "4", "b": "8", "e": "3", "g": "9", "i": "1", "l": "1", "o": "0", "s": "5", "t": "7"}, {"a": "@", "s": "$", "i": "!", "t": "+", "e": "3", "o": "0", "l": "|", "b": "8", "g": "6"})


@pytest.fixture(scope="module")
def real(spark):
    """The character model of all documents, and a lexicon as the labels give one."""
    speller = toxicity.Speller(toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    return toxicity.Lexicon(speller, {f: 6.0 for w in INSULTS for f in toxicity.features(w)})


def written_as(kind, word, rng):
    at = [i for i, c in enumerate(word) if c in SIGNS[0]]
    n = {"one": 1, "half": max(1, len(at) // 2), "all": len(at)}.get(kind.split()[0], 0)
    signs = set(rng.sample(at, min(n, len(at))))
    letters = [rng.choice(SIGNS)[c] if i in signs else c for i, c in enumerate(word)]
    if "repeats" in kind:
        letters = [c * rng.choice((1, 1, 2, 3)) for c in letters]
    return {"dots": ".", "spaced": " "}.get(kind.split()[-1], "").join(letters)


@pytest.mark.parametrize("kind", ["one", "half", "all", "half dots", "half repeats", "plain dots", "plain repeats"])
def test_restored_under_the_model_of_real_texts(real, kind):
    rng = random.Random(5)
    tokens = [(w, written_as(kind, w, rng)) for w in INSULTS for _ in range(20)]
    assert sum(w in [x for x, _ in real.words(t)] for w, t in tokens) >= 0.95 * len(tokens)
    assert all(real.score(t) == 6.0 for _, t in tokens) or sum(real.score(t) == 6.0 for _, t in tokens) >= 0.95 * len(tokens)


@pytest.mark.parametrize("kind", ["plain spaced", "plain repeats spaced", "half spaced", "half repeats spaced"])
def test_spaced_under_the_model_of_real_texts(real, kind):
    rng = random.Random(6)
    texts = [f"hein eran {written_as(kind, w, rng)}{rng.choice(['', '!', ', the', '.'])}" for w in INSULTS for _ in range(10)]
    found = toxicity.measured(pa.array(texts), [real])[:, 0]
    assert (found == 6.0).mean() >= 0.95


def test_letterless_tokens(real, speller):
    own = toxicity.Lexicon(speller, {"wass": 5.0, "wloser": 4.0})
    assert own.score("455") == own.score("@$$") == own.score("(455)") == 5.0
    assert own.score("2024") == own.score("10:30") == own.score("$$$") == own.score("...") == 0.0
    assert toxicity.spaced_runs(np.array([0, 4]), np.array([0, 1, 0, 1]), ["--", "..."]) == []


def test_gate_changes_no_score(real):
    """Words that are turned away before the lattice have no feature there."""
    rng = random.Random(7)
    for _ in range(3000):
        w = rng.choice(INSULTS)
        k = rng.randrange(len(w) + 1)
        t = "".join(c * rng.choice((1, 1, 1, 2, 3)) for c in w[:k] + rng.choice(["", "a", "er", "é"]) + w[k:][: rng.randrange(6)]) + rng.choice(["", ".", ",", ")", "\""])
        whole = max(((real.plain if restored else real.odds).get(f, 0.0) for x, restored in real.words(t) for f in toxicity.features(x)), default=0.0)
        assert real.score(t) == whole, t
