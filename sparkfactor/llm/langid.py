"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and all their n-grams of one to three characters are hashed to 2 ** 15 features, with weights
log(1 + count) * idf scaled to length one. Document frequencies come from every document that may be learned from. The weights are
learned by follow-the-regularised-leader (McMahan et al., 2013) with L1 and L2 penalties, so most stay exactly zero, from a bounded
sample: the ``PER_LANGUAGE`` labelled documents of each language with the least hash. A fifth of the sample
is held back to fit the temperature that calibrates the probabilities.

Defined cases: ``und`` with score 0 for texts that are null or hold no letter, and for all texts when nothing could be learned.
Documents without doc_id or without language are never learned from; they count as held out only without doc_id. Rows that
share a doc_id are scored one by one. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc32_of_id, release

BITS, ORDERS = 15, (1, 2, 3)
#: Bound of the sample: labelled documents of each language.
PER_LANGUAGE = 600
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 0.02, 0.001
UNKNOWN = "und"
#: Rows that a worker hands back at once.
BATCH_ROWS = 1000
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a whole text, ascending, and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    seen = np.zeros(1 << BITS, np.int64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint64)
                for k in range(n):
                    h = h + (c[k : len(c) - n + 1 + k] + np.uint64(1)) * _FACTORS[k]
                h = (h ^ (h >> np.uint64(29))) * _FACTORS[0]
                seen += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(seen)
    return at, seen[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n) * idf[at]
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (features, values, class) rows, in the given order in every epoch; gives weights and biases."""
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))

    def solved(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, v, y in rows:
            at, v = np.append(at, 1 << BITS), np.append(v, 1.0)  # the last feature is the bias
            w = solved(z[at], n[at])
            error = _softmax(v @ w)
            error[y] -= 1
            g = v[:, None] * error
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    w = solved(z, n)
    return w[:-1].astype(np.float32), w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda u: -np.log(np.maximum(_softmax(logits / np.exp(u))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, g = np.log(0.5), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from documents with a language and a letter; the caller leaves out those that are held out."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df[counts(t.as_py())[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1).astype(np.int32)), "n": pa.array(np.append(df[at], n))})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(2)]
            lists = [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["tie", "lang", "at", "n"])

    df = {r.feature: r.n for r in known.select("text").mapInArrow(lambda batches: release(frequencies(batches)), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    sample = bounded_sample(known, "lang", per_language).select(F.xxhash64("doc_id").alias("tie"), "lang", "text")
    rows = sorted(sample.mapInArrow(features, "tie long, lang string, at array<int>, n array<int>").collect(), key=lambda r: (r.tie, r.lang, r.at))
    if not rows:
        return None
    total = df.pop(-1)
    idf = np.ones(1 << BITS)
    idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values())))) + 1
    languages = sorted({r.lang for r in rows})
    data = [(at := np.array(r.at), weighted(at, np.array(r.n), idf), languages.index(r.lang)) for r in rows]
    held, learn = (data[::5], [x for i, x in enumerate(data) if i % 5]) if len(data) >= 10 else ([], data)
    weights, bias = train(learn, len(languages))
    logits = np.array([v @ weights[at] + bias for at, v, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf.astype(np.float32), weights, bias, calibrate(logits, np.array([y for *_, y in held], int)))


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # a text that is kept goes to the worker once
    sent = list(keep) if text in keep else [*keep, text]
    at_text, n_kept = sent.index(text), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b.slice(first, BATCH_ROWS) for b in batches for first in range(0, b.num_rows, BATCH_ROWS)):
            lang, score = [], []
            for t, known in zip(batch.column(at_text), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if m is None or not known:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, n = counts(t.as_py())
                p = _softmax((weighted(at, n, m.idf) @ m.weights[at] + m.bias) / m.temperature)
                lang.append(m.languages[int(p.argmax())])
                score.append(float(p.max()))
            columns = [*batch.columns[:n_kept], pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*sent, letters.alias("_letters")).mapInArrow(lambda batches: release(run(batches)), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"]))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from documents that aren't held out."""
    held = F.coalesce(crc32_of_id(F.col(doc_id)) % 3 == 1, F.lit(True))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held.alias("held_out"))
    return predict(own, fit(own.where(~F.col("held_out"))), ("doc_id", "held_out"))
