"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

A sketch has ``bands * rows`` coordinates (Dahlgaard, Knudsen and Thorup, 2017). In round i every shingle is thrown into a hashed
bin; a bin keeps the least value of the first round that reached it, and rounds i >= t visit bin i - t with all shingles, so every
coordinate is filled after 2t rounds at most. Coordinates of one round come from different shingles, which gives the
estimate better concentration than independent minima. With 44 bands of 5 a pair at similarity 0.8 shares no band with
probability 3e-8.

Rows with equal sets become one class first, so copies cost nothing later. Within a bucket nobody emits all pairs:

1. Each bucket has a centre, the member that meets most others over all bands. Members are verified against it, and the links
   give components.
2. What is left are pairs of a bucket in different components. Small buckets list them, and each listed pair is verified once, however
   many buckets it has.
3. The members of a larger bucket are dealt, by a centre that they have met and by size, to blocks of bounded rows and bytes. Only blocks
   whose sizes may link meet, two to a task, and the task counts the shingles that each two members share: those of the
   centre by a product of bitmaps, the others by one over the shingles that two of its members show. It gives no pairs but true links, of these a
   spanning forest, so rows grow with the members, not with their pairs. The counting itself is arithmetic over all pairs of
   two blocks.

Sets hold 64-bit hashes of shingles and are read from the texts again for documents that share a bucket, no others.

Defined cases: null and empty texts, and rows without doc_id, are linked with nothing. A row without a doc_id has no component and
is kept. Rows that share a doc_id are judged by their own text, each as a node of its own; equal ones are all kept, if any is.
Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..sources.shared import discard
from .common import ascii_lower, broadcast_if_small, release, words_of, written
from .graph import components

BANDS, ROWS = 44, 5
#: Up to so many members a bucket's pairs between components are listed directly, which is linear in the rows.
SMALL_BUCKET = 32
#: Up to so many keys of buckets, 16 bytes each, go to the bands instead of being sorted with them.
BROADCAST_KEYS = 1_000_000
#: A block of a large bucket's members holds about so many, and so many bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20
#: Columns of the tables of zeros and ones that are multiplied at once.
WIDTH = 8192

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of ``size`` words in a row, ascending; of all words where there are fewer."""
    n, size = len(words), min(size, len(words))
    if not n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            h = mix(h * _GOLD + words[k : n - size + 1 + k])
    return np.unique(h)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: ``t`` filled coordinates, each the round and a 32-bit value."""
    out, first, n = np.full(t, np.iinfo(np.uint64).max), 0, len(elements)
    while first < 2 * t and (first == 0 or out.max() == np.iinfo(np.uint64).max):
        rounds = np.arange(first, min(2 * t, first + max(1, 5 * t // n)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = mix(elements[None, :] + mix((rounds + np.uint64(1)) * _GOLD)[:, None])
        bins = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)
        late = rounds >= t
        bins[late] = (rounds[late] - np.uint64(t))[:, None]
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds << np.uint64(32))[:, None] | (h & np.uint64(0xFFFFFFFF))).ravel())
        first += len(rounds)
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for column in coordinates.reshape(bands, rows).T:
            h = mix(h * _M1 + column)
    return h.view(np.int64)


def _word_lists(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    lists = batch.column(column)
    values, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    for a, b in zip(at, at[1:], strict=False):
        yield values[a:b]


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    words = F.transform(words_of(ascii_lower(F.col(text))), lambda w: F.xxhash64(w))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), words.alias("words"))


def _print(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items, digest_size=16).digest() if len(items) else None


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, print (of the whole set, null for an empty one) and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w, shingle) for w in _word_lists(batch, 1)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "print": pa.array([_print(s) for s in sets], pa.binary()),
                "bands": pa.array([band_keys(sketch(s, bands * rows), bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
            })

    return _hashed(docs, doc_id, text).mapInArrow(lambda batches: release(run(batches)), "doc_id long, n_shingles long, print binary, bands array<long>")


def full_sets(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, items): whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w, shingle).view(np.int64) for w in _word_lists(batch, 1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "print": pa.array(list(map(_print, sets)), pa.binary()), "items": pa.array(sets, pa.list_(pa.int64()))})

    return _hashed(docs, doc_id, text).mapInArrow(lambda batches: release(run(batches)), "doc_id long, print binary, items array<long>")


def printed(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """The rows with the print of their whole sets; null where there is no word."""
    names = [*docs.columns, "print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            prints = pa.array([_print(shingle_set(w, shingle)) for w in _word_lists(batch, last)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], prints], names=names)

    words = F.transform(words_of(ascii_lower(F.col(text))), lambda w: F.xxhash64(w))
    return docs.select("*", words.alias("_words")).mapInArrow(run, StructType([*docs.schema.fields, StructField("print", BinaryType())]))


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds items_a and items_b to written pairs (a, b). Few pairs go to the sets, so that only the sets they name are shuffled."""
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    centres = written(pairs.select("a").distinct(), "compared-with")
    return broadcast_if_small(pairs).join(right, "b").join(left.join(broadcast_if_small(centres), "a", "left_semi"), "a")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written pairs (a, b) that are linked, by their full sets."""
    n, common = F.size("items_a") + F.size("items_b"), F.size(F.array_intersect("items_a", "items_b"))
    return _paired(pairs, sets).where((100 + percent) * common.cast("long") >= percent * n.cast("long")).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    found = labels.select(F.col("node").alias(key), F.col("component").alias("_c"))
    return rows.join(found, key, "left").withColumn(name, F.coalesce("_c", key)).drop("_c")


def _listed(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of the small buckets (key, id, n, comp) that are in different components and of sizes that can link."""
    x = rows.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = rows.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    return x.join(y, "key").where("a < b and ca <> cb").where(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na").select("a", "b").distinct()


def _split_by_centre(paired: DataFrame) -> DataFrame:
    """(a, b, comp, n, inside, own): which shingles of its centre a member has, as bits, and those it has besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, own = [], []
            for x, y in zip(_lists(batch.column(3)), _lists(batch.column(4)), strict=True):
                inside.append(np.packbits(np.isin(x, y, assume_unique=True)).tobytes())
                own.append(np.setdiff1d(y, x, assume_unique=True))
            n = pa.array([len(y) for y in _lists(batch.column(4))], pa.int64())
            columns = [*batch.columns[:3], n, pa.array(inside, pa.binary()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "comp", "n", "inside", "own"])

    return paired.select("a", "b", "comp", "items_a", "items_b").mapInArrow(run, "a long, b long, comp long, n long, inside binary, own array<long>")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(at, at[1:], strict=False):
        yield values[a:b]


def shared_shingles(inside: list[bytes], own: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two members of one centre have in common."""
    n = len(own)
    out = np.zeros((n, n), np.int64)

    def add(table: np.ndarray) -> None:
        nonlocal out
        out += np.rint(table @ table.T).astype(np.int64)

    bits = np.frombuffer(b"".join(inside), np.uint8).reshape(n, -1)
    for first in range(0, bits.shape[1], WIDTH // 8):
        add(np.unpackbits(bits[:, first : first + WIDTH // 8], axis=1).astype(np.float32))
    member = np.repeat(np.arange(n), [len(o) for o in own])
    _, code, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    several = times > 1
    place, shown = np.cumsum(several) - 1, several[code]
    column, member = place[code[shown]], member[shown]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    for first in range(0, int(several.sum()), WIDTH):
        a, b = np.searchsorted(column, (first, first + WIDTH))
        table = np.zeros((n, WIDTH), np.float32)
        table[member[a:b], column[a:b] - first] = 1
        add(table)
    return out


def forest(pairs: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (of places) those that join components (of places) which no earlier one has joined."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for i, j in pairs.tolist():
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _met_in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of members (a, b, comp, n, inside, own) of the same centre.

    Texts that link differ in size by a factor of 100 / percent at most, so they are in the same class of sizes or in neighbouring ones.
    """

    def meet(table):
        ids, comp, n = (table.column(c).to_numpy() for c in ("b", "comp", "n"))
        block = table.column("block").to_numpy()
        common = shared_shingles(table.column("inside").to_pylist(), list(_lists(table.column("own").combine_chunks())))
        linked = ((100 + percent) * common >= percent * (n[:, None] + n[None, :])) & (comp[:, None] != comp[None, :])
        one = len(np.unique(block)) == 1
        pairs = np.argwhere(np.triu(linked & (one | (block[:, None] != block[None, :])), 1))
        found = forest(pairs, comp)
        x, y = np.array([ids[i] for i, _ in found], np.int64), np.array([ids[j] for _, j in found], np.int64)
        return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    # a hair wider than the factor, so that rounding puts no pair two classes apart
    size = F.floor(F.ln(F.col("n").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.lit(0)
    classed = members.withColumn("s", size)
    weight = F.octet_length("inside") + 8 * F.size("own").cast("long")
    blocks = classed.groupBy("a", "s").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(weight) / BLOCK_BYTES)).cast("int").alias("k"))
    blocks = written(blocks, "blocks")
    held = blocks.select("a", F.col("s").alias("s1"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    with_ = blocks.select(F.col("a").alias("a2"), F.col("s").alias("s2"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    meets = held.join(with_, (F.col("a") == F.col("a2")) & ((F.col("s2") == F.col("s1")) & (F.col("j") >= F.col("i")) | (F.col("s2") == F.col("s1") + 1))).select("a", "s1", "i", "s2", "j")
    sides = F.array_distinct(F.array(F.struct(F.col("s1").alias("s"), F.col("i").alias("block")), F.struct(F.col("s2").alias("s"), F.col("j").alias("block"))))
    asked = meets.select("*", F.explode(sides).alias("own_block")).select("a", "own_block.*", F.struct("s1", "i", "s2", "j").alias("meet"))
    dealt = classed.join(blocks, ["a", "s"]).withColumn("block", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
    rows = dealt.join(asked, ["a", "s", "block"]).select("a", "meet", "b", "comp", "n", "inside", "own", (F.col("s") * (1 << 20) + F.col("block")).alias("block"))
    return rows.groupBy("a", "meet").applyInArrow(meet, "a long, b long")


def class_links(reps: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (a, b) between classes (id, n, bands) that give the components of all links between texts.

    ``sets_of``: from a table of ids (id) to their full sets (id, items).
    """
    bands = reps.select("id", "n", F.explode("bands").alias("key"))
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared-keys")
    rows = written(bands.join(broadcast_if_small(shared, BROADCAST_KEYS), "key"), "buckets")
    sets = written(sets_of(rows.select("id").distinct()), "sets")
    degree = rows.groupBy("id").agg(F.sum("m").alias("degree"))
    best = F.max(F.struct("degree", (-F.col("id")).alias("i"))).alias("best")
    # written first, so that the join deals rows alone and a large bucket can be split
    centres = written(rows.join(degree, "id").groupBy("key").agg(best), "centres")
    starred = written(rows.join(centres, "key").withColumn("c", -F.col("best.i")), "stars")
    stars = written(starred.where("c <> id").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
    first = written(_compared(stars, sets, percent), "star-links")

    labels = written(components(first), "labels")
    labelled = _labelled(starred.where("id <> c"), labels, "id", "comp")
    ends = _labelled(starred, labels, "id", "comp").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    left = written(labelled.join(ends.where("lo <> hi").select("key"), "key"), "left")
    small = written(_listed(left.where(F.col("m") <= SMALL_BUCKET), percent), "listed-pairs")

    # any text can be the centre of what is left of a bucket: the best one that its members have met serves many buckets at once
    large = left.where(F.col("m") > SMALL_BUCKET)
    met = large.join(large.groupBy("id").agg(F.max("best").alias("met")), "id").groupBy("key").agg((-F.max("met")["i"]).alias("a"))
    met = written(large.join(met, "key").where("a <> id").select("a", F.col("id").alias("b"), "comp").distinct(), "met-centres")
    members = written(_split_by_centre(_paired(met, sets)), "members")
    links = written(first.union(_compared(small, sets, percent)).union(_met_in_blocks(members, percent)), "links")
    discard(shared, rows, sets, centres, starred, stars, first, left, small, met, members)
    return links


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, print (of its set), n_shingles, component_id and kept."""
    signed = written(signatures(docs, shingle, bands, rows, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "signatures")
    known = signed.where("print is not null and doc_id is not null")
    # one row stands for each set; rows, not doc_ids, are the nodes, as a doc_id may come with several texts
    least = F.min(F.struct("doc_id", "row", F.col("n_shingles").alias("n"), "bands")).alias("r")
    groups = written(known.groupBy("print").agg(least).select("print", F.col("r.doc_id").alias("rep"), F.col("r.row").alias("id"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands")), "groups")
    repeated = not known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = written(groups.select("id", "print", "rep").join(ids, "id", "left_semi"), "asked")
        own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        sets = full_sets(own.join(asked, own.doc_id == asked.rep, "left_semi"), shingle)
        if not repeated:
            return sets.join(asked, sets.doc_id == asked.rep).select("id", "items")
        both = sets.join(asked, (sets.doc_id == asked.rep) & (sets["print"] == asked["print"])).select("id", "items")
        return both.groupBy("id").agg(F.first("items").alias("items"))

    labels = components(class_links(groups.select("id", "n", "bands"), sets_of, percent))
    named = written(groups.select("print", "rep", "id").join(labels, F.col("id") == F.col("node")).select("print", "rep", "component"), "named")
    lowest = named.groupBy("component").agg(F.min("rep").alias("low"))
    linked = named.join(lowest, "component").select("print", "low")
    named = groups.select("print", "rep").join(linked, "print", "left").select(F.col("print").alias("p"), F.coalesce("low", "rep").alias("component_id"))
    out = signed.join(named, signed["print"] == F.col("p"), "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "print", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id and kept."""
    return classes(docs, shingle, percent, bands, rows, doc_id, text).drop("print")
