"""Toxicity of texts as they were meant: obfuscated words are restored before they are scored.

Writers hide words by leetspeak ("1d10t"), spacing ("i d i o t", "i.d.i.o.t") and repetition ("stuuupid"). Such tokens are read
as the output of a noisy channel: each character gives a column of a lattice (itself, the letters that it may stand for, or nothing)
and Viterbi picks the letters that a character trigram model of all documents finds likeliest. Every token with a letter and with a
character that isn't one, or with a doubled letter, is read so, whatever its length; plain words also count as written. Of a token
of single letters between separators ("y.o.u.i.d.i.o.t") each part may be a word, as of a run of tokens that each are one character, repeated
or not ("ii d ii oo t").

The character model alone can't tell "loser" from "ioser" in "10$3r". So a token with such characters, or with a letter three times in a row, is also
read through a trie of the words of the lexicon: a word is taken if its channel costs and ``KNOWN_WORD``, what any known word costs, are no more
than what the likeliest letters cost. A character that may stand for a letter is hardly ever dropped (``DROPPED``).

A restored word has the features word and first four, five and six letters. Their log odds of toxic against clean documents
come from a bounded sample of labelled documents, ``PER_CLASS`` of each label. A logistic regression turns a document's strongest
words into a probability; it is fitted across two halves of the sample, each scored with the log odds of the other, and its
intercept is moved from the sample's share of toxic documents to that of all labelled ones.

Defined cases: null and empty texts get the score of a text without any such word. Documents without doc_id, or with one whose
label is null, are never learned from. Several labels of one doc_id count as toxic if one is. Without documents of both labels
every score is the share of toxic ones (0 if there are none). Other columns are ignored, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, broadcast_if_small, crc32_of_id, written

#: Bound of the sample: labelled documents of each class.
PER_CLASS = 3000
#: A feature is used if so many toxic documents of the sample have it and its log odds reach this.
LEAST_DOCS, LEAST_ODDS = 3, 2.5
THRESHOLD = 0.3
#: Letters that a character may stand for, and characters that only separate.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
SEPARATORS = "._-*~'"
EDGE = ".,;:!?()[]{}\"'`-_*"
#: Of these the ones that can't stand for a letter nor join letters.
PLAIN_EDGE = ".,;:?()[]{}\"'`"
CACHED, CHUNK_CHARS, KNOWN_TOKENS = 40, 4_000_000, 300_000
#: Log probabilities of dropping a separator, a character that may stand for a letter, and another one; of a word of the lexicon; and, for each letter, of a part of a spelt run that is one.
SEPARATED, DROPPED, ODD_DROPPED, KNOWN_WORD, SPELT_LETTER = -0.2, -9.0, -3.0, -8.0, -1.1
N = 27  # a word's border and 26 letters


def _base(ch: str) -> str:
    low = {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "đ": "d", "ł": "l"}.get(ch.lower(), unicodedata.normalize("NFKD", ch.lower())[:1])
    return low if low.isascii() and low.isalpha() else ch.lower()


FOLD = {i: _base(chr(i)) for i in range(0x250)}
CLASS = np.array([ord(c) - 96 if len(c) == 1 and c.isascii() and c.isalpha() else 0 for c in FOLD.values()], np.int64)


def fold(text: str) -> str:
    """Lower case without accents."""
    return text.translate(FOLD)


class Speller:
    """Restores tokens under a character trigram model."""

    def __init__(self, trigrams: np.ndarray):
        n = trigrams.reshape(N, N, N).astype(float) + 0.01
        tri, bi, uni = n / n.sum(2, keepdims=True), n.sum(0) / n.sum((0, 2))[:, None], n.sum((0, 1)) / n.sum()
        self.log = np.log(0.7 * tri + 0.25 * bi[None] + 0.05 * uni[None, None]).tolist()

    @staticmethod
    def _options(ch: str, run: int) -> list[tuple[tuple[int, ...], float]]:
        """What a run of one character may be: letters, and the channel's log probability."""
        if ch.isascii() and ch.isalpha():
            k = ord(ch) - 96
            return [((k,), 0.0)] if run == 1 else [((k,), -1.5), ((k, k), 0.0)] if run == 2 else [((k,), -0.5), ((k, k), -0.7)]
        out = [((), SEPARATED if ch in SEPARATORS else DROPPED if ch in LEET else ODD_DROPPED)]
        for c in LEET.get(ch, ""):
            k, cost = ord(c) - 96, -0.3 - float(np.log(len(LEET[ch])))
            out += [((k,), cost), ((k, k), cost - 0.7)] if run > 1 else [((k,), cost)]
        return out

    def decode(self, token: str) -> str:
        return self.decoded(token)[0]

    def decoded(self, token: str) -> tuple[str, float]:
        """The likeliest letters of a folded token, and their log probability."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # letters are linked from the last one back
        for m in RUNS.finditer(token):
            columns = self._options(m[1], len(m[0]))
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, letters) in best.items():
                for add, cost in columns:
                    s, x, y, word = score + cost, a, b, letters
                    for k in add:
                        s, x, y, word = s + self.log[x][y][k], y, k, (k, word)
                    old = after.get((x, y))
                    if old is None or s > old[0] or (s == old[0] and word is not old[1] and _spelt(word) > _spelt(old[1])):
                        after[x, y] = (s, word)
            best = after
        top = max(s + self.log[a][b][0] for (a, b), (s, _) in best.items())
        return max(_spelt(w) for (a, b), (s, w) in best.items() if s + self.log[a][b][0] == top), top

    def words(self, token: str) -> list[tuple[str, bool]]:
        """The words that a token holds, in lower case, and whether each was restored; restored ones have no accents."""
        low = token.lower()
        core = TAIL.sub("", HEAD.sub("", low)).strip(EDGE)
        out = [(core, False)] if core.isalpha() else [(p, False) for p in re.split(r"[^\w@$!|+]+", core) if p.isalpha() and len(p) > 2]
        # the symbols at the ends may stand for letters too
        for whole in dict.fromkeys((core, low.strip(EDGE))):
            folded = fold(whole)
            # two characters hold no word of three letters
            if len(folded) > 2 and LETTER.search(folded) and (DOUBLE.search(folded) or not whole.isalpha()):
                restored = self.decode(folded)
                # a plain word that the lattice leaves as it is was not obfuscated, and keeps its accents
                if restored != folded or not whole.isalpha():
                    out.append((restored, True))
        return out


#: Runs of symbols at a token's ends are decoration; a single one may stand for a letter.
HEAD, TAIL = re.compile(r"^[^\w\s]{2,}"), re.compile(r"[^\w\s]{2,}$")
LETTER, DOUBLE = re.compile(r"[a-z]"), re.compile(r"(.)\1")
#: What can be read as a letter, what must be, and a letter three times in a row.
HOLDS, STANDS, TRIPLE = re.compile(r"[a-z0-9@$!|+*]"), re.compile(r"[0-9@$!|+*._~'-]"), re.compile(r"([a-z])\1\1")
#: A character with its repeats, and single characters, maybe repeated, with separators between them.
RUNS = re.compile(r"(.)\1*", re.S)
SPELT = re.compile(r"([^\W_]|[@$!|+])\1*(?:[._\-*~']+([^\W_]|[@$!|+])\2*){2,}")


def _spelt(letters: tuple) -> str:
    out = []
    while letters:
        k, letters = letters
        out.append(chr(96 + k))
    return "".join(reversed(out))


def features(word: str) -> list[str]:
    return ["w" + word, *(f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) >= k)] if len(word) > 2 else []


class Lexicon:
    """Scores tokens by the strongest feature of their words. Restored words are looked up without accents."""

    def __init__(self, speller: Speller, odds: dict[str, float]):
        self.speller, self.odds, self.known = speller, odds, {}
        self.plain: dict[str, float] = {}
        for f, s in odds.items():
            self.plain[fold(f)] = max(s, self.plain.get(fold(f), 0.0))
        own = [f[1:] for f in self.plain if f[0] == "w" and f[1:].isascii()]
        self.longest = max(map(len, own), default=0)
        #: The trie of whole words: every beginning of one.
        self.begun = {w[:k] for w in own for k in range(len(w) + 1)} | {""}
        #: How a word must begin to have any feature: with one of four letters, or it is one of three.
        self.starts = {f[1:5] for f in (*self.plain, *odds)}

    def may_hit(self, word: str) -> bool:
        """Whether a word of letters, with doubled ones read as one or two, can have a feature. Exact, and cheaper than the lattice."""
        found = {""}
        for m in RUNS.finditer(word):
            found = {(f + add)[:4] for f in found for add in ((m[1],) if len(m[0]) == 1 else (m[1], m[1] * 2))}
            if all(len(f) == 4 for f in found):
                break
        return not self.starts.isdisjoint(found) or word[:4] in self.starts

    def score(self, token: str) -> float:
        core = token.strip(PLAIN_EDGE)
        if core.isalpha():
            low = core.lower()
            folded = fold(low)
            if folded.isascii() and low[:4] not in self.starts and not self.may_hit(folded):
                return 0.0
        found = max(((self.plain if restored else self.odds).get(f, 0.0) for w, restored in self.words(token) for f in features(w)), default=0.0)
        core = token.lower().strip(EDGE)
        return max(found, self.spaced(core)) if SPELT.fullmatch(core) else found

    def words(self, token: str) -> list[tuple[str, bool]]:
        """The speller's words and the lexicon's reading of the token."""
        out = self.speller.words(token)
        low = token.lower()
        bare = TAIL.sub("", HEAD.sub("", low))
        for whole in dict.fromkeys((bare.strip(EDGE), low.strip(EDGE), bare.strip(PLAIN_EDGE + "-_"))):
            folded = fold(whole)
            if len(folded) > 2 and (STANDS.search(folded) or TRIPLE.search(folded)) and (word := self.reading(folded)):
                out.append((word, True))
        return out

    def _step(self, states: dict[str, float], m: re.Match) -> dict[str, float]:
        """From beginnings of words and their costs to those after one more run of a character."""
        after: dict[str, float] = {}
        options = [("".join(chr(96 + k) for k in add), cost) for add, cost in self.speller._options(m[1], len(m[0]))]
        for begun, cost in states.items():
            for add, more in options:
                word = begun + add
                if word in self.begun and cost + more > after.get(word, -np.inf):
                    after[word] = cost + more
        return after

    def reading(self, token: str) -> str | None:
        """The word of the lexicon that a folded token stands for, if one is likelier than what the character model finds."""
        states = {"": 0.0}
        for m in RUNS.finditer(token):
            states = self._step(states, m)
            if not states:
                return None
        words = [(cost, w) for w, cost in states.items() if "w" + w in self.plain]
        if not words:
            return None
        cost, word = max(words)
        likeliest, score = self.speller.decoded(token)
        return word if word == likeliest or cost + KNOWN_WORD >= score else None

    def spaced(self, letters: str) -> float:
        """A run of single characters may hold several words, so each part of it is looked up as a word."""
        folded = fold(letters)
        word = self.speller.decode(folded)
        found = max((self.plain.get("w" + word[i : i + n], 0.0) for i in range(len(word)) for n in range(3, self.longest + 1) if i + n <= len(word)), default=0.0)
        runs = list(RUNS.finditer(folded))
        for first in range(len(runs)):
            states = {"": 0.0}
            for m in runs[first:]:
                states = self._step(states, m)
                if not states:
                    break
                found = max([found, *(self.plain.get("w" + w, 0.0) for w, cost in states.items() if len(w) > 3 and cost >= SPELT_LETTER * len(w))])
                # what is still empty begins at the next character
                states.pop("", None)
        return found

    def scores(self, tokens: list[str]) -> np.ndarray:
        out = list(map(self.known.get, tokens))
        for i, s in enumerate(out):
            if s is None:
                out[i] = s = self.score(tokens[i])
                if len(self.known) < KNOWN_TOKENS and len(tokens[i]) <= CACHED:
                    self.known[tokens[i]] = s
        return np.array(out, float)


def chunks(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[str]]]:
    """For runs of texts: the run, the texts' bounds in its tokens, and the tokens as numbers of distinct ones."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + CHUNK_CHARS, "right")))
        split = pc.utf8_split_whitespace(texts.slice(first, last - first))
        bounds, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        yield split, bounds - bounds[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = last


def spaced_runs(bounds: np.ndarray, index: np.ndarray, tokens: list[str]) -> list[tuple[int, str]]:
    """(text, letters) for three or more tokens of one character in a row, repeated or not; the last may carry a punctuation mark.

    A repeated character is given three times, which the channel reads as one letter or two.
    """
    single = np.array([t != "" and t == t[0] * len(t) for t in tokens], bool)[index] if tokens else np.zeros(0, bool)
    out, doc = [], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    three = np.flatnonzero(single[:-2] & single[1:-1] & single[2:] & (doc[:-2] == doc[2:])) if len(single) > 2 else []
    end = -1
    for i in three:
        if i < end:
            continue
        end = i
        while end < len(index) and doc[end] == doc[i] and single[end]:
            end += 1
        tail = tokens[index[end]] if end < len(index) and doc[end] == doc[i] else ""
        last = tail[:-1] if len(tail) > 1 and tail[-1] in EDGE and tail[:-1] == tail[0] * (len(tail) - 1) else ""
        own = [tokens[k] for k in index[i:end]] + [last]
        run = "".join(t if len(t) < 2 else t[0] * 3 for t in own)
        if HOLDS.search(fold(run.lower())):
            out.append((int(doc[i]), run.lower()))
    return out


def measured(texts: pa.Array, lexicons: list[Lexicon], use: np.ndarray | None = None) -> np.ndarray:
    """For each text: its two strongest words' log odds and the logarithm of one plus its number of hits. ``use``: each text's lexicon."""
    out, first = np.zeros((len(texts), 3)), 0
    for _, bounds, index, tokens in chunks(texts):
        n = len(bounds) - 1
        doc = np.repeat(np.arange(n), np.diff(bounds))
        for k, lexicon in enumerate(lexicons):
            own = np.ones(n, bool) if use is None else use[first : first + n] == k
            scores = lexicon.scores(tokens)
            at = np.flatnonzero(scores[index] >= LEAST_ODDS) if len(index) else np.empty(0, np.int64)
            hits = list(zip(doc[at].tolist(), scores[index[at]].tolist(), index[at].tolist(), strict=True))
            hits += [(d, s, -1) for d, run in spaced_runs(bounds, index, tokens) if (s := lexicon.spaced(run)) >= LEAST_ODDS]
            found: dict[int, tuple[int, dict[int, float]]] = {}
            for d, s, token in hits:
                if own[d]:
                    count, best = found.get(d, (0, {}))
                    best[token] = max(s, best.get(token, 0.0))
                    found[d] = (count + 1, best)
            for d, (count, best) in found.items():
                top = sorted(best.values(), reverse=True)
                out[first + d] = top[0], top[1] if len(top) > 1 else 0.0, np.log1p(count)
        first += n
    return out


class Model(NamedTuple):
    speller: Speller
    odds: dict[str, float]
    weights: np.ndarray  # the last is the intercept

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over the folded letters of all texts; each task sends its 27 ** 3 sums at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    c = np.frombuffer(t.as_py().encode("utf-32-le", "surrogatepass"), "<u4")
                    k = np.concatenate([[0, 0], CLASS[np.where(c < len(CLASS), c, 32)], [0]])
                    total += np.bincount(k[:-2] * (N * N) + k[1:-1] * N + k[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(N**3, np.int64)
    for r in docs.select(text).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


def _odds(rows: list, toxic: int, clean: int, which: tuple[int, ...]) -> dict[str, float]:
    """Smoothed log odds of the features, from the halves ``which``."""
    rate, out = toxic / (toxic + clean), {}
    for r in rows:
        t, c = sum(r[f"t{h}"] for h in which), sum(r[f"c{h}"] for h in which)
        s = float(np.log((t + 2 * rate) / (c + 2 * (1 - rate)) * (1 - rate) / rate))
        if t + c and s >= LEAST_ODDS:
            out[r.feature] = s
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """``labels``: (doc_id, toxic), with only what may be learned from."""
    speller = Speller(character_model(docs, text))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r.toxic): r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    chosen = broadcast_if_small(bounded_sample(known, "toxic", per_class))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = written(own.join(chosen, "doc_id").select("doc_id", "toxic", half, "text"), "sample-texts")
    if sample.count() > chosen.count():  # a doc_id with several texts
        sample = bounded_sample(sample, "toxic", per_class)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[str]] = {}
        for batch in batches:
            for y, half, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found: set[str] = set()
                for token in set((t or "").split()):
                    if token not in cache:
                        cache[token] = [f for w, _ in speller.words(token) for f in features(w)]
                    found.update(cache[token])
                if len(cache) > KNOWN_TOKENS:
                    cache.clear()
                for at in range(0, len(rows := sorted(found)), 50_000):
                    part = rows[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({"feature": part, "y": pa.array([y] * len(part), pa.int32()), "half": pa.array([half] * len(part), pa.int32())})

    seen = sample.select(F.col("toxic").cast("int").alias("toxic"), "half", "text").mapInArrow(words, "feature string, y int, half int")
    sums = [F.sum(F.when((F.col("y") == y) & (F.col("half") == h), 1).otherwise(0)).alias(f"{'ct'[y]}{h}") for y in (0, 1) for h in (0, 1)]
    kept = seen.groupBy("feature").agg(*sums).where(F.expr(f"t0 + t1 >= {LEAST_DOCS} and t0 + t1 >= 0.2 * (c0 + c1)")).collect()
    n = Counter({(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()})
    if not all(n[y, h] for y in (0, 1) for h in (0, 1)):
        return Model(speller, {}, np.array([0.0, 0.0, 0.0, np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))]))
    halves = [Lexicon(speller, _odds(kept, n[1, h], n[0, h], (h,))) for h in (1, 0)]  # texts of half 0 get half 1's

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measured(batch.column(2), halves, batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in x.T)], names=["y", "x0", "x1", "x2"])

    rows = sorted(sample.select(F.col("toxic").cast("int").alias("toxic"), "half", "text").mapInArrow(inputs, "y int, x0 double, x1 double, x2 double").collect())
    x, y = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    w = logistic(x, y)
    w[-1] += np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean()))
    toxic, clean = n[1, 0] + n[1, 1], n[0, 0] + n[0, 1]
    return Model(speller, _odds(kept, toxic, clean, (0, 1)), w)


#: The lexicon of the model that this worker scores with; what it knows of tokens serves its next tasks too.
_HELD: dict[str, Lexicon] = {}


def _lexicon(key: str, model: Model) -> Lexicon:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Lexicon(model.speller, model.odds)
    return _HELD[key]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score and predicted for each row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = _lexicon(key, m)
        for batch in batches:
            p = m.probability(measured(batch.column(batch.num_columns - 1), [lexicon]))
            columns = [*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*keep, F.col(text).alias("_t")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double, predicted int"]))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted; learned from labels that aren't held out."""
    held = F.coalesce(crc32_of_id(F.col(doc_id)) % 4 == 2, F.lit(True))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    learn = labels.where(crc32_of_id(F.col("doc_id")) % 4 != 2).select("doc_id", "toxic")
    return score(own, fit(own, learn), ("doc_id", "held_out"))
