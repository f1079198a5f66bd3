"""How far the sources of a language are apart in their use of words, and by which words each stands out.

A language keeps the V terms that occur in enough of its documents. A group (language, source) gives each kept term the smoothed share
p = 1 + floor(1e9 * (count + 1) / (N + V)), N the sum of its counts. Its distance from another one is the sum over all kept terms
of f(p, q) = floor((p - q)^2 / q).

Most counts are 0, so a pair starts at V times f(p0, q0), the value of a term that neither has. Terms are posted in an inverted
index, and only what is posted corrects that sum:

* a term that g has moves the pair (g, h) by f(p, q0) - f(p0, q0); as this hangs on the count alone, g's counts are first gathered as
  a histogram. The same for a term that h has;
* a term that both have moves it by what is then still missing: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The postings of a language are dealt to blocks of terms, and its sources to blocks of ``SOURCES``; a task meets one block of terms of
two blocks of sources, so its memory is bounded by ``POSTINGS`` and neither a language nor a source nor a term is a task. Partial sums are
added by Spark. All arithmetic is on integers: counts and their products as decimals, p and f as longs, sums as decimals.

Defined cases: null text, lang and source are ''. Every (lang, source) that occurs is a group, without terms too. A language without kept terms has
distance 0 between all its sources. Every row is a document, whatever its doc_id. Other columns are ignored, whatever their names.
An empty table gives no rows. Ties of value go by the UTF-8 bytes of the item.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewords import byte_class, words_of_batch
from .common import release, written

TERM_BYTES = byte_class(string.ascii_lowercase)
#: About so many postings make a block of terms, and so many sources a block of sources.
POSTINGS, SOURCES = 200_000, 128
#: Terms that stand in a dense table at once.
WIDTH = 4096
#: A table of groups is broadcast up to so many rows and so many bytes of names.
FEW_GROUPS, FEW_BYTES = 20_000, 4 << 20
BILLION = 1_000_000_000


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in the group's documents, and how many of these have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of_batch(batch.column(2), TERM_BYTES):
                if not len(w.code):
                    continue
                names = [batch.column(k).slice(w.first, w.n_texts).dictionary_encode() for k in (0, 1)]
                lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in names)
                group = lang_of * len(names[1].dictionary) + source_of
                own, n = np.unique(w.text * len(w.distinct) + w.code, return_counts=True)
                key, at = np.unique(group[own // len(w.distinct)] * len(w.distinct) + own % len(w.distinct), return_inverse=True)
                of_group, term = key // len(w.distinct), key % len(w.distinct)
                order = np.argsort(at, kind="stable")
                sums = np.add.reduceat(n[order], np.searchsorted(at[order], np.arange(len(key))))
                yield pa.RecordBatch.from_pydict({
                    "lang": names[0].dictionary.take(pa.array(of_group // len(names[1].dictionary))),
                    "source": names[1].dictionary.take(pa.array(of_group % len(names[1].dictionary))),
                    "term": pa.array(w.distinct, pa.binary()).cast(pa.string()).take(pa.array(term)),
                    "n": pa.array(sums, pa.int64()),
                    "docs": pa.array(np.bincount(at, minlength=len(key)), pa.int64()),
                })

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)), F.col(text).cast("string"))
    found = named.mapInArrow(lambda batches: release(run(batches)), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(1e9 * (count + 1) / (total + terms)), 1 where there are no terms."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(BILLION).cast("decimal(10,0)") * (F.col(count) + 1).cast("decimal(20,0)"), big(total) + big(terms))
    return F.when(F.col(terms) > 0, whole.cast("long") + 1).otherwise(F.lit(1).cast("long"))


def _few(groups: DataFrame) -> DataFrame:
    rows, size = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source")), F.lit(0))).first()
    return F.broadcast(groups) if rows <= FEW_GROUPS and size <= FEW_BYTES else groups


def inverted_index(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, nth, n_group, n_terms, n_lang, blocks, p0) and postings (lang, source, nth, term, blocks, n_terms, p, q), p0 and p the group's, q the language's."""
    counts = written(term_counts(docs), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("posted")).where(F.col("docs") >= least_docs)
    terms = written(terms.select("lang", "term", "total", "posted"), "kept-terms")
    posted = written(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "posted")
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("n_lang"), F.ceil(F.sum("posted") / POSTINGS).cast("int").alias("blocks"))
    sums = posted.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = occurring.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["n_terms", "n_lang", "n_group"]).fillna(1, ["blocks"])
    nth = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("nth")
    groups = groups.withColumn("none", F.lit(0).cast("long")).select("lang", "source", nth, "n_group", "n_terms", "n_lang", "blocks", share("none", "n_group", "n_terms").alias("p0"))
    groups = written(groups, "groups")
    joined = posted.join(_few(groups), ["lang", "source"])
    return groups, written(joined.select("lang", "source", "nth", "term", "blocks", "n_terms", share("n", "n_group", "n_terms").alias("p"), share("total", "n_lang", "n_terms").alias("q")), "postings")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def corrections(source: np.ndarray, term: np.ndarray, p: np.ndarray, p0: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """By how much postings (source, term, p) move each pair of sources (p0 of each) from its baseline; sums are exact in 64 bits."""
    n, f0 = len(p0), _f(p0[:, None], p0[None, :])
    out = np.zeros((n, n), np.int64)
    order = np.lexsort((term, source))
    source, term, p = source[order], term[order], p[order]
    ends = np.searchsorted(source, np.arange(n + 1))
    for g in range(n):
        values, times = np.unique(p[ends[g] : ends[g + 1]], return_counts=True)
        if len(values):
            out[g] += (times[:, None] * (_f(values[:, None], p0[None, :]) - f0[g])).sum(0)
            out[:, g] += (times[:, None] * (_f(p0[None, :], values[:, None]) - f0[:, g])).sum(0)
    for first in range(0, int(term.max()) + 1 if len(term) else 0, width):
        own = (term >= first) & (term < first + width)
        table = np.zeros((n, width), np.int64)
        table[source[own], term[own] - first] = p[own]
        for g in range(n):
            at = np.flatnonzero(table[g])
            h, k = np.nonzero(table[:, at])
            if len(h):
                pg, q = table[g, at[k]], table[h, at[k]]
                sums = np.concatenate([[0], np.cumsum(_f(pg, q) - _f(pg, p0[h]) - _f(p0[g], q) + f0[g, h])])
                bounds = np.searchsorted(h, np.arange(n + 1))
                out[g] += sums[bounds[1:]] - sums[bounds[:-1]]
    return out


def pair_distances(groups: DataFrame, postings: DataFrame, sources: int = SOURCES) -> DataFrame:
    """(lang, a, b, value): the distance of each group a (its nth) from each other group b of its language."""

    def meet(key, table):
        lang, block, i, j = (k.as_py() for k in key)
        nth, p = table.column("nth").to_numpy(), table.column("p").to_numpy()
        terms = table.column("term").combine_chunks().dictionary_encode().indices
        marks = terms.is_null().to_numpy(zero_copy_only=False)
        ids, at = np.unique(nth[marks], return_index=True)
        p0 = p[marks][at]
        moved = corrections(np.searchsorted(ids, nth[~marks]), terms.drop_null().to_numpy().astype(np.int64), p[~marks], p0)
        if block == 0:
            moved += table.column("n_terms").to_numpy()[0] * _f(p0[:, None], p0[None, :])
        side = ids // sources
        wanted = (side[:, None] == i) & (side[None, :] == j) | (side[:, None] == j) & (side[None, :] == i)
        a, b = np.nonzero(wanted & ~np.eye(len(ids), dtype=bool))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(ids[a], pa.int32()), "b": pa.array(ids[b], pa.int32()), "value": pa.array(moved[a, b], pa.int64())})

    last = groups.groupBy("lang").agg(F.floor(F.max("nth") / sources).cast("int").alias("last"))
    term = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    rows = postings.select("lang", "nth", "term", "n_terms", "p", term.alias("block"))
    # a row without a term tells each block of a source that may have none there
    marks = groups.select("lang", "nth", F.lit(None).cast("string").alias("term"), "n_terms", F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = F.floor(F.col("nth") / sources).cast("int")
    met = rows.union(marks).join(F.broadcast(last) if last.count() <= FEW_GROUPS else last, "lang").select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    met = met.select("lang", "block", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "nth", "term", "n_terms", "p")
    found = met.groupBy("lang", "block", "i", "j").applyInArrow(meet, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = 3, top_terms: int = 200, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every two sources of a language, ``term`` rows for a group's ``top_terms``."""
    groups, postings = inverted_index(docs, least_docs)
    order = [F.desc("value"), F.asc("item")]
    standing = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    terms = standing.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top_terms)
    names = _few(groups.select("lang", "nth", "source"))
    apart = written(pair_distances(groups, postings, sources), "pairs")
    named = apart.join(names.withColumnRenamed("nth", "a"), ["lang", "a"]).join(names.select("lang", F.col("nth").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = named.select("lang", "source", "item", "value", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)).alias("rank"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


def oracle_sql(least_docs: int = 3, top_terms: int = 200) -> str:
    f, share_ = "((p - q) * (p - q)) // q", f"1 + ({BILLION}::hugeint * ({{}} + 1)) // ({{}} + V)"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {words} as w from documents),
t as (select r, lang, source, unnest(w) as term from d), c as (select lang, source, term, count(*)::hugeint as n from t group by all),
k as (select lang, term, count(*)::hugeint as total from t group by all having count(distinct r) >= {least_docs}),
l as (select lang, count(*)::hugeint as V, sum(total)::hugeint as NL from k group by lang),
g as (select a.lang, a.source, coalesce(sum(c.n), 0)::hugeint as N from (select distinct lang, source from d) a left join (select c.* from c join k using (lang, term)) c on a.lang = c.lang and a.source = c.source group by all),
x as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {share_.format("coalesce(c.n, 0)", "g.N")} as p, {share_.format("total", "NL")} as q
  from g join k on g.lang = k.lang join l on g.lang = l.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pr as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select lang, s1, s2, sum({f}) as value from (select a.lang, a.source as s1, b.source as s2, a.p, b.p as q from x a join x b on a.lang = b.lang and a.term = b.term) group by all) s
  on s.lang = a.lang and s.s1 = a.source and s.s2 = b.source),
o as (select 'pair' as part, * from pr union all select 'term', lang, source, term, ({f})::bigint from x where n > 0 and p > q),
ranked as (select *, row_number() over (partition by part, lang, source order by value desc, item) as rank from o)
select lang, source, part, item, value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {top_terms}"""
