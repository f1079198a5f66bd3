"""Exact, cached encoding with a ``tokenizers`` model file.

Most time of a BPE encoder goes to words that it has seen before. A text is cut where the model's own pre-tokenizer always
cuts, the pieces' ids are kept in a bounded table, and new pieces are cut further into parts, of which only new ones reach the
library, many in one text. Texts for which a cut could change the ids go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import drop_kept

#: Fixed value: white space outside ASCII and the control characters that libraries class differently (an RE2 class body).
ODD_SPACE = r"\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Pieces kept, the longest piece that is kept, and the characters that are encoded in one go.
CACHE_PIECES, CACHE_CHARS, CHUNK_CHARS = 400_000, 40, 4_000_000
#: Letters in every version of Unicode that neither normal forms nor lower case take apart, and characters that never
#: belong to the word before them.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e\u0400-\u0481]"
BEHIND = r"[.,!?;:#&%*$|<>()\-\n]"
#: What marks a cut within a piece (texts that hold it are encoded whole), and the parts that the library gets in one text.
CUT, TOGETHER = "\0", 2_000


class CachedEncoder:
    """``encode(texts)`` gives the ids of all texts in one array and each text's bounds in it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.mode = self._mode(spec)
        norm = json.dumps(spec.get("normalizer") or {})
        # only where the model itself lower-cases may a piece be looked up in lower case
        self.lowers = self.mode == "drop" and ('"Lowercase"' in norm or '"lowercase": true' in norm)
        special = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        runs = [r"  ", r" [\t\n\v\f\r]", r"^ ", r" $"] if self.mode == "lead" else []
        self.whole = "(?s)" + "|".join([f"[{ODD_SPACE}]", r"\x{0}", *special, *runs])
        self.cache: dict[str, bytes] = {}
        self.solid = re.compile(" [^ ]+" if self.mode == "lead" else f"{LETTER}+").fullmatch
        self.marks = self._marks(spec)

    @staticmethod
    def _mode(spec: dict) -> str:
        """``drop``: white space never reaches the model. ``lead``: a blank heads the word behind it. ``none``: unknown."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model.get("dropout"):
            return "none"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "lead"
        first, norm = (pre.get("pretokenizers") or [{}])[0], json.dumps(spec.get("normalizer") or {})
        pattern = (first.get("pattern") or {}).get("Regex", "")
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in pattern
        return "drop" if drops and not re.search(r"Prepend|Strip|Precompiled", norm) else "none"

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _key(self, piece: str) -> str:
        return piece.lower() if self.lowers and piece.isascii() else piece

    def _marks(self, spec: dict) -> np.ndarray | None:
        """For each id if it is the first (``lead``) or last (``drop``) one of a word, where the vocabulary tells."""
        suffix = spec["model"].get("end_of_word_suffix")
        if self.mode == "none" or self.mode == "drop" and not suffix:
            return None
        vocab = self.tokenizer.get_vocab()
        marks = np.zeros(max(vocab.values()) + 1, bool)
        marks[[i for t, i in vocab.items() if (t.startswith("\u0120") if self.mode == "lead" else t.endswith(suffix))]] = True
        return marks

    def _cut(self, pieces: list[str]) -> pa.Array:
        """The parts of each piece that are apart to the model: a word, what is behind it, and the word behind a single line end."""
        cut = pc.replace_substring_regex(pa.array(pieces, pa.large_string()), f"({LETTER})({BEHIND})", f"\\1{CUT}\\2")
        if self.mode == "lead":
            # of several line ends the model takes the last one apart, but only before a word
            cut = pc.replace_substring_regex(cut, rf"([^ \t\n\v\f\r]\n)({LETTER})", f"\\1{CUT}\\2")
        return pc.split_pattern(cut, CUT)

    def _together(self, parts: list[str]) -> list[bytes]:
        """The ids of parts for which ``solid`` holds, encoded in one text and cut at the marks."""
        joined = "".join(parts) if self.mode == "lead" else " ".join(parts)
        ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.marks[ids])
        if len(at) != len(parts):
            return self._raw(parts)
        ends = np.append(at, len(ids)) if self.mode == "lead" else np.append(0, at + 1)
        raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        solid = [p for p in parts if self.solid(p)] if self.marks is not None else []
        found = {}
        for k in range(0, len(solid), TOGETHER):
            run = solid[k : k + TOGETHER]
            found.update(zip(run, self._together(run), strict=True))
        alone = [p for p in parts if p not in found]
        return found | dict(zip(alone, self._raw(alone), strict=True))

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces. New pieces are cut into parts, and only new parts reach the library."""
        cache = self.cache
        out = list(map(cache.get, pieces))
        new = [i for i, ids in enumerate(out) if ids is None]
        if not new:
            return out
        cut = self._cut([pieces[i] for i in new])
        coded = cut.flatten().dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        keys = list(map(self._key, keys)) if self.lowers else keys
        found = self._new(list(dict.fromkeys(k for k in keys if k not in cache)))
        known = [found[k] if k in found else cache[k] for k in keys]
        parts, ends = [known[i] for i in coded.indices.to_numpy().tolist()], cut.offsets.to_numpy().tolist()
        for i, a, b in zip(new, ends, ends[1:], strict=False):
            out[i] = parts[a] if b - a == 1 else b"".join(parts[a:b])
        if len(cache) < CACHE_PIECES // 4:
            # the first pieces hold the frequent ones; after them the room is for parts, from which others are put together
            found |= {pieces[i]: out[i] for i in new}
        if len(cache) + len(found) <= CACHE_PIECES:
            cache.update((k, ids) for k, ids in found.items() if len(k) <= CACHE_CHARS)
        return out

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.utf8_split_whitespace(texts) if self.mode == "drop" else pc.split_pattern(texts, " ")
        bounds, flat = split.offsets.to_numpy().astype(np.int64), split.flatten()
        coded = flat.dictionary_encode()
        index, unique = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = bounds - bounds[0]
        if self.mode == "lead":
            # a text's first word has no blank before it
            heads = flat.take(pa.array(bounds[:-1])).to_pylist()
            index[bounds[:-1]] = np.arange(len(unique), len(unique) + len(heads))
            unique = [" " + u for u in unique] + heads
        ids = self.lookup(unique)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        held = np.empty(len(ids), object)
        held[:] = ids
        return np.frombuffer(b"".join(held[index].tolist()), self.dtype), np.concatenate([[0], np.cumsum(size[index])])[bounds]

    def encode(self, texts: pa.Array, chunk_chars: int = CHUNK_CHARS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first one's number, the ids of the run, and the texts' bounds in them. Null texts are empty.

        A run has up to ``chunk_chars`` characters, or one text; shorter runs take less memory and more lookups.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + chunk_chars, "right")))
            run = texts.slice(first, last - first)
            whole = pc.match_substring_regex(run, self.whole).to_numpy(zero_copy_only=False) if self.mode != "none" else np.ones(len(run), bool)
            whole |= pc.equal(run, "").to_numpy(zero_copy_only=False)
            if not whole.any():
                yield first, *self._regular(run)
            else:
                ids, bounds = self._regular(run.filter(pa.array(~whole))) if not whole.all() else (np.empty(0, self.dtype), np.zeros(1, np.int64))
                alone, k = iter(self._raw(run.filter(pa.array(whole)).to_pylist())), iter(range(len(bounds) - 1))
                parts = [np.frombuffer(next(alone), self.dtype) if w else ids[bounds[j := next(k)] : bounds[j + 1]] for w in whole]
                yield first, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            first = last


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """One encoder for each Python worker and file."""
    return CachedEncoder(path)


drop_kept.append(encoder.cache_clear)
