"""Words of whole Arrow batches, found on their UTF-8 bytes.

A class of word characters that holds every character outside ASCII or none is a class of bytes, so words are runs of bytes and no
text is decoded. Texts are taken in runs of bounded size, or one at a time where one is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on in one go.
RUN_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(ascii_chars: str) -> np.ndarray:
    """Marks the bytes of ``ascii_chars`` (after A-Z are lower-cased) and of all characters outside ASCII."""
    out = np.arange(256) >= 0x80
    out[[ord(c) for c in ascii_chars]] = True
    return out


class Words(NamedTuple):
    """The words of a run of texts in order, A-Z lower-cased."""

    first: int  #: number in the batch of the run's first text
    n_texts: int
    text: np.ndarray  #: of each word its text's number within the run
    code: np.ndarray  #: of each word its place in ``distinct``
    distinct: list  #: the distinct words as bytes


def words_of_batch(texts: pa.Array, member: np.ndarray, run_bytes: int = RUN_BYTES) -> Iterator[Words]:
    """The words of each run of texts; null texts have none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + run_bytes, "right")) - 1)
        bounds = at[first : last + 1] - at[first]
        lowered = _LOWER[data[at[first] : at[last]]]
        yield Words(first, last - first, *_words(lowered, bounds, member))
        first = last


def _words(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    inside = member[data]
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # a text's first byte begins a word, and its last one ends it, whatever the neighbour texts hold
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[heads] = inside[heads]
    tails = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    ends[tails] = inside[tails]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    cuts = np.column_stack([a, b]).ravel()
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    coded = spans.take(pa.array(np.arange(0, len(cuts) - 1, 2))).dictionary_encode()
    return np.searchsorted(bounds, a, "right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
