"""Segmentations and token counts over a SentencePiece vocabulary read as a unigram model.

The pieces of a model file with their scores are the vocabulary. An Aho-Corasick automaton lists all pieces in a text; dynamic
programming over them gives the best segmentation by the unigram tokenizer's rules:

* a piece replaces the best one that ends at a place only if its score is strictly higher, and pieces are tried by their start, so
  of equal ones the longest wins;
* a character at which no single-character piece starts counts as unknown, 10 below the lowest score; with byte fallback it is as
  many pieces as it has UTF-8 bytes.

Scores are added in double precision, which is exact for whole-number scores. (The library adds in single precision, so it can
differ from the exact rule where a text's sum needs more than 24 bits.)

No piece but runs of the blank mark holds that mark inside, so a text falls into parts that start with blanks, and its segmentations
are products of its parts' segmentations. That is checked when the file is read. Parts repeat, so each is solved once in a worker
process, which keeps up to ``KNOWN_PARTS`` of them from task to task.

Of the n best segmentations of a text all parts but n - 1 take their best one. So all new parts of a run go through the forward pass
together, for their best segmentation and what the second best loses; the A-star search is for the parts that may deviate, and for
those whose best isn't the only one.

Defined cases: null and empty texts have no pieces: a count of 0 with score 0, and one segmentation that is empty. Rows that share
a doc_id, or have none, are handled one by one. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts and searched parts kept in a worker, the longest kept, and the characters that are handled in one go.
KNOWN_PARTS, KNOWN_SEGMENTS, LONGEST, CHUNK_CHARS = 500_000, 200_000, 60, 4_000_000
#: Characters of the parts that go through the forward pass together.
TOGETHER_CHARS = 1 << 17
PART = re.compile(" +[^ ]*")
score_of = itemgetter(0)


class Vocabulary:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = sp.unk_id()
        self.bytes: dict[int, int] = {}
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece] = (i, sp.get_score(i))
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece holds the blank mark behind another character")
        if sp.normalize(" \uff41  b\ufb01 ") != "▁▁\uff41▁▁b\ufb01▁":
            raise ValueError("the model file changes characters or white space, or puts no blank in front")
        text_of = {i: p.replace(BLANK, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelling = pa.array([text_of.get(i, b"") for i in range(sp.get_piece_size())], pa.binary())
        self.joined = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.least = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, (i, s) in self.pieces.items():
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.sizes, self.scores = np.zeros(sp.get_piece_size() + 1, np.int64), np.zeros(sp.get_piece_size() + 1)
        self.ids = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, (i, s) in self.pieces.items():
            self.sizes[i], self.scores[i] = len(p), s
            self.ids.add_word(p, i)
        self.ids.make_automaton()
        # the last place is what id -1 finds: an unknown character
        self.sizes[-1], self.scores[-1] = 1, self.least
        self.apart = next(c for c in map(chr, range(0x10FFFF, 0, -1)) if all(c not in p for p in self.pieces))

    def unknown_ids(self, ch: str) -> list[int]:
        return [self.bytes[b] for b in ch.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def edges(self, part: str) -> list[list[tuple[int, float, int]]]:
        """For each place, the pieces (start, score, id) that end there, by ascending start; id -1 is an unknown character.

        The automaton gives the matches of one end from the longest on, and an unknown character is the shortest.
        """
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(part) + 1)]
        for end, (n, s, i) in self.automaton.iter(part):
            out[end + 1].append((end + 1 - n, s, i))
        for k in range(len(part)):
            e = out[k + 1]
            if not e or e[-1][0] != k:
                e.append((k, self.least, -1))
        return out

    def segments(self, part: str) -> list[str]:
        """The part cut where no piece can reach over: between two characters that stand side by side in no piece."""
        joined, cuts = self.joined, [0]
        for k in range(1, len(part)):
            if part[k - 1 : k + 1] not in joined:
                cuts.append(k)
        return [part[a:b] for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)] if len(cuts) > 1 else [part]

    def count(self, part: str) -> tuple[float, int]:
        """Best score and its number of pieces; nothing else is kept."""
        n = len(part)
        best, pieces = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for end, edges in enumerate(self.edges(part)):
            for start, s, i in edges:
                if best[start] + s > best[end]:
                    best[end] = best[start] + s
                    pieces[end] = pieces[start] + (1 if i >= 0 else len(self.unknown_ids(part[start])))
        return best[n], pieces[n]

    def two_best(self, parts: list[str]) -> Iterator[tuple[float, float, bytes]]:
        """For each part the best score, what the second best loses (infinite if there is none) and the best one's packed ids.

        The places of all parts are numbered in one text, and the forward pass takes the places of one distance from their part's start
        together. If the second best loses nothing, the ids are those of any of the best.
        """
        if not parts:
            return
        text = self.apart.join([*parts, ""])
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        met = np.fromiter(self.ids.iter(text), [("end", np.int64), ("id", np.int64)])
        end, ids = met["end"] + 1, met["id"]
        start = end - self.sizes[ids]
        unknown = np.ones(len(text), bool)
        unknown[ends] = False
        unknown[start[self.sizes[ids] == 1]] = False
        unknown = np.flatnonzero(unknown)
        start, end, ids = np.concatenate([start, unknown]), np.concatenate([end, unknown + 1]), np.concatenate([ids, np.full(len(unknown), -1)])
        depth = np.arange(len(text)) - np.repeat(begins, size + 1)
        order = np.argsort(end, kind="stable")
        order = order[np.argsort(depth[end[order]].astype(np.uint16), kind="stable")]
        start, end, ids = start[order], end[order], ids[order]
        score, levels = self.scores[ids], np.concatenate([[0], np.cumsum(np.bincount(depth[end], minlength=2))])
        best, second, by = np.full(len(text), -np.inf), np.full(len(text), -np.inf), np.zeros(len(text), np.int64)
        best[begins] = 0.0
        for a, b in zip(levels[1:], levels[2:], strict=False):
            place = end[a:b]
            groups = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            n = np.diff(groups, append=b - a)
            first, other = best[start[a:b]] + score[a:b], second[start[a:b]] + score[a:b]
            top, place = np.maximum.reduceat(first, groups), place[groups]
            which = np.minimum.reduceat(np.where(first == np.repeat(top, n), np.arange(b - a), b - a), groups)
            first[which] = -np.inf
            best[place], second[place], by[place] = top, np.maximum.reduceat(np.maximum(first, other), groups), a + which
        # from the ends back along the best edges
        own, at, paths = np.arange(len(parts)), ends, []
        while len(own):
            edge = by[at]
            paths.append((own, edge))
            at = start[edge]
            more = at > begins[own]
            own, at = own[more], at[more]
        lengths = np.zeros(len(parts), np.int64)
        for own, _ in paths:
            lengths[own] += 1
        upto, path = np.cumsum(lengths), np.empty(lengths.sum(), np.int64)
        for k, (own, edge) in enumerate(paths, 1):
            path[upto[own] - k] = edge
        packed = ids[path]
        odd = np.flatnonzero(packed < 0)
        if len(odd):
            spelt = {c: self.unknown_ids(c) for c in {text[k] for k in start[path[odd]].tolist()}}
            lists = [spelt[text[k]] for k in start[path[odd]].tolist()]
            n = np.ones(len(path), np.int64)
            n[odd] = list(map(len, lists))
            stops = np.cumsum(n)
            packed, upto = np.repeat(packed, n), stops[upto - 1]
            packed[packed < 0] = [i for x in lists for i in x]
        data, cuts = packed.astype("<u4").tobytes(), (4 * upto).tolist()
        loss = best[ends] - second[ends]
        for s, lost, a, b in zip(best[ends].tolist(), loss.tolist(), [0, *cuts], cuts, strict=False):
            yield s, lost, data[a:b]

    def nbest(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations, best first, by A-star from the end.

        What is left to the start is known exactly from the forward pass, so paths leave the agenda in the order of their total score, and
        every path in it stands for another segmentation of just that score. So only as many paths are kept as segmentations are
        still asked for. Equal ones leave in the order in which they were met.
        """
        edges, insort, least = [[] for _ in range(len(part) + 1)], bisect.insort, float("-inf")
        for end, (size, s, i) in self.automaton.iter(part):
            edges[end + 1].append((end + 1 - size, s, i))
        ahead = [0.0]
        for k, es in enumerate(edges[1:]):
            if not es or es[-1][0] != k:
                es.append((k, self.least, -1))
            top = least
            for start, s, _ in es:
                v = ahead[start] + s
                if v > top:
                    top = v
            ahead.append(top)
        found: list[tuple[float, list[int]]] = []
        agenda, met, room = [(-ahead[-1], 0, len(part), 0.0, None)], 0, n
        while agenda:
            _, _, place, behind, path = agenda.pop(0)
            if place == 0:
                ids: list[int] = []
                while path:
                    i, at, path = path
                    if i >= 0:
                        ids.append(i)
                    else:
                        ids += self.unknown_ids(part[at])
                found.append((behind, ids))
                room -= 1
                continue
            size = len(agenda)
            for start, s, i in edges[place]:
                after = s + behind
                f = -(ahead[start] + after)
                if size < room:
                    size += 1
                elif f < agenda[-1][0]:
                    agenda.pop()
                else:
                    continue
                met += 1
                insort(agenda, (f, met, start, after, (i, start, path)))
        return found

    def decoded(self, ids: np.ndarray) -> memoryview:
        """The bytes of a segmentation's text, without the blank in front; an unknown piece without byte fallback has none."""
        taken = self.spelling.take(pa.array(ids))
        at = taken.offset
        bounds = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * at)
        data = memoryview(taken.buffers()[2] or b"")[bounds[0] : bounds[-1]]
        return data[1:] if data[:1] == b" " else data

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation of a whole text."""
        return bytes(self.decoded(np.array(ids, np.int32))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=3)
def known_parts(path: str, n: int) -> dict:
    """What this process has solved: counts for ``n`` = 0, else best segmentations, with ``-n`` the ``n`` best of parts and segments searched."""
    return {}


def parts_of(text: str) -> list[str]:
    """The independent parts of a text, with blank marks; the tokenizer puts one in front of the text."""
    return [p.replace(" ", BLANK) for p in PART.findall(" " + text)] if text else []


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """For runs of texts: the texts' bounds in the run's parts, and the parts as numbers of distinct ones."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + CHUNK_CHARS, "right")))
        run = texts.slice(first, last - first)
        odd = pc.match_substring_regex(run, r"  |^ | $|^$|▁").to_numpy(zero_copy_only=False)
        if odd.any():
            lists = [parts_of(t) if o else [BLANK + p for p in t.split(" ")] for o, t in zip(odd, run.to_pylist(), strict=True)]
            flat, bounds = pa.array([p for x in lists for p in x], pa.large_string()), np.cumsum([0, *map(len, lists)])
            coded = flat.dictionary_encode()
            unique = coded.dictionary.to_pylist()
        else:
            split = pc.split_pattern(run, " ")
            bounds, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
            bounds = bounds - bounds[0]
            unique = [BLANK + p for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        yield bounds, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), unique
        first = last


def _solved(unique: list[str], known: dict, solve) -> list:
    out = list(map(known.get, unique))
    for i, x in enumerate(out):
        if x is None:
            out[i] = x = solve(unique[i])
            if len(known) < KNOWN_PARTS and len(unique[i]) <= LONGEST:
                known[unique[i]] = x
    return out


def token_counts(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of every whole text's best segmentation; no ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = vocabulary(model_path), known_parts(model_path, 0)
        for batch in batches:
            n, score = [], []
            for bounds, index, unique in chunks(batch.column(1)):
                solved = _solved(unique, known, words.count)
                for out, k in ((score, 0), (n, 1)):
                    total = np.concatenate([[0], np.cumsum(np.array([x[k] for x in solved], float)[index])]) if unique else np.zeros(1)
                    out.append(total[bounds[1:]] - total[bounds[:-1]])
            both = [np.concatenate(x) if x else np.empty(0) for x in (n, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[0].astype(np.int64)), pa.array(both[1])], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")


def combined(lists: list[list[tuple[float, list[int]]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The ``n`` best products of parts' segmentations: score and, by part, which one is taken where it isn't the first.

    Only the n - 1 parts that lose least by a second choice can deviate in the n best.
    """
    top = sum(x[0][0] for x in lists)
    loose = heapq.nsmallest(n - 1, ((x[0][0] - x[1][0], k) for k, x in enumerate(lists) if len(x) > 1))
    where = sorted(k for _, k in loose)
    agenda, seen, out = [(0.0, (0,) * len(where))], {(0,) * len(where)}, []
    while agenda and len(out) < n:
        loss, choice = heapq.heappop(agenda)
        out.append((top - loss, {k: c for k, c in zip(where, choice, strict=True) if c}))
        for j, k in enumerate(where):
            after = (*choice[:j], choice[j] + 1, *choice[j + 1 :])
            if choice[j] + 1 < len(lists[k]) and after not in seen:
                seen.add(after)
                heapq.heappush(agenda, (sum(lists[m][0][0] - lists[m][c][0] for m, c in zip(where, after, strict=True)), after))
    return out


def segmentations(docs: DataFrame, model_path: str, n: int = 4, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``n`` best segmentations of every whole text (all, if fewer): doc_id, rank from 1, score, n_pieces, ids_crc32, text_crc32, and ids where asked for.

    ``text_crc32`` is of the UTF-8 text that the ids decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, searched = vocabulary(model_path), known_parts(model_path, n), known_parts(model_path, -n)

        def best_of(part: str) -> tuple:
            """The best of a part or segment, as (score, packed ids).

            A part's segmentations are products of its segments', of which the best are kept segment by segment.
            """
            every = searched.get(part)
            if every is None:
                first, *more = words.segments(part)
                if not more:
                    every = tuple((s, struct.pack(f"<{len(ids)}I", *ids)) for s, ids in words.nbest(part, n))
                else:
                    every = best_of(first)
                for segment in more:
                    other = best_of(segment)
                    if len(every) == len(other) == 1:
                        every = ((every[0][0] + other[0][0], every[0][1] + other[0][1]),)
                    else:
                        every = sorted([(a + b, x + y) for a, x in every for b, y in other], key=score_of, reverse=True)[:n]
                if len(searched) < KNOWN_SEGMENTS and len(part) <= LONGEST:
                    searched[part] = every
            return every

        def solve(part: str) -> tuple[float, float, bytes]:
            every = best_of(part)
            return every[0][0], every[0][0] - every[1][0] if len(every) > 1 else np.inf, every[0][1]

        def solved_parts(unique: list[str]) -> list[tuple[float, float, bytes]]:
            """Best score, loss of the second best and the best one's packed ids of each part."""
            out = list(map(known.get, unique))
            new = [i for i, x in enumerate(out) if x is None]
            short = [i for i in new if len(unique[i]) <= LONGEST]
            upto = np.cumsum([len(unique[i]) for i in short])
            first = 0
            while first < len(short):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + TOGETHER_CHARS, "right")))
                some = short[first:last]
                for i, x in zip(some, words.two_best([unique[i] for i in some]), strict=True):
                    out[i] = x if x[1] > 0 else solve(unique[i])
                first = last
            for i in short[: max(0, KNOWN_PARTS - len(known))]:
                known[unique[i]] = out[i]
            for i in new:
                if out[i] is None:
                    out[i] = solve(unique[i])
            return out

        def choices(part: str) -> list[tuple[float, np.ndarray]]:
            return [(s, np.frombuffer(ids, "<u4")) for s, ids in best_of(part)]

        for batch in batches:
            doc = 0
            for bounds, index, unique in chunks(batch.column(1)):
                solved = solved_parts(unique)
                size = np.fromiter((len(x[2]) // 4 for x in solved), np.int64, len(solved))
                pool, start = np.frombuffer(b"".join([x[2] for x in solved]), "<u4"), np.cumsum(size) - size
                score, loss = (np.array([x[k] for x in solved], float) for k in (0, 1))
                rows: dict[str, list] = {f.name: [] for f in schema}
                for a, b in zip(bounds, bounds[1:], strict=False):
                    own = index[a:b]
                    lengths = size[own]
                    ends = np.cumsum(lengths)
                    base = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[own] - (ends - lengths), lengths)]
                    # the parts that may deviate: the n - 1 of least loss, the earlier of equal ones
                    loose = loss[own]
                    few = np.flatnonzero(loose <= np.partition(loose, n - 2)[n - 2]) if 1 < n <= len(own) else np.arange(len(own))
                    few = few[np.argsort(loose[few], kind="stable")][: n - 1]
                    few = np.sort(few[np.isfinite(loose[few])])
                    lists = [choices(unique[own[k]]) for k in few]
                    first = sum(x[0][0] for x in lists)
                    for rank, (lost, choice) in enumerate(combined(lists, n), 1):
                        cuts, at = [], 0
                        for k, c in sorted(choice.items(), key=lambda kc: few[kc[0]]):
                            where = few[k]
                            cuts += [base[at : ends[where] - lengths[where]], lists[k][c][1]]
                            at = ends[where]
                        ids = np.concatenate([*cuts, base[at:]]) if choice else base
                        values = [batch.column(0)[doc].as_py(), rank, float(score[own].sum()) + (lost - first), len(ids), zlib.crc32(ids), zlib.crc32(words.decoded(ids))] + [ids.astype(np.int32)] * with_ids
                        for name, value in zip(rows, values, strict=True):
                            rows[name].append(value)
                    doc += 1
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
    kinds = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, text_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kinds)
