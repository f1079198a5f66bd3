"""Quality by weak supervision: rules vote or abstain, and a posterior replaces the test that all must pass.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation estimates the share of good
documents, and for each rule how often it votes right on good documents and how often on bad ones (the two-coin model; abstaining
tells nothing). No labels are used. The likelihood depends on a document only through its votes, so EM runs over the counts of
vote patterns, at most 3 ** 7 rows, with all documents counted that pass the base test (the others are out in any case, and one
plain kind of fault among them would make the whole bad class).

DataFrame functions only. Counting repeated windows stays inside a row: the windows' hashes are sorted with their positions, so a
text of n words takes n log n steps and no shuffle. Windows are compared by a 64-bit hash of their three words' hashes.

Defined cases: a null or empty text has no words and fails the base test. Documents without a doc_id or with the same one are
judged one by one. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, words_of, written

#: Fixed value: what counts as a symbol.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Each rule: its bad and its good range, in SQL over the measures. Between them it abstains: it speaks for good only where a measure
#: is as in plain prose, so that a doubtful one is left to the other rules. Rates are estimated freely, so no two rules may measure the same.
RULES = {
    "symbols": ("n_symbols > 0.03 * word_chars", "n_symbols <= 0.01 * word_chars"),
    "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.2 * n_words"),
    "dup_lines": ("n_dup_lines > 0.3 * n_lines", "n_lines >= 3 and n_dup_lines <= 0.15 * n_lines"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars >= 3.5 * n_words and word_chars <= 9 * n_words"),
    "letters": ("n_letters < 0.75 * word_chars", "n_letters > 0.92 * word_chars"),
    "sentences": ("n_words < 3 * (n_stops + 1) or n_words > 60 * (n_stops + 1)", "n_words >= 5 * (n_stops + 1) and n_words <= 40 * (n_stops + 1)"),
    "variety": ("n_distinct < 0.1 * n_words and n_words < 2000", "n_distinct > 0.4 * n_words"),
}
#: EM starts from these (share of good, right on good, right on bad) and runs so many rounds. PRIOR: as many votes each start counts for,
#: as a beta prior that keeps rates inside 0 and 1; beyond that they are what the votes say.
START, ROUNDS, PRIOR = (0.8, 0.98, 0.6), 20, 10.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_stops", "n_distinct")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """The words in three-word windows that occur twice or more."""

    def covered(windows: Column) -> Column:
        same = F.transform(
            windows,
            lambda x, i: F.when((F.get(windows, i - 1)["k"] == x["k"]) | (F.get(windows, i + 1)["k"] == x["k"]), x["p"]),
        )
        at = F.sort_array(F.filter(same, lambda p: p.isNotNull()))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x))

    def windows(h: Column) -> Column:
        keys = F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("p")))), covered)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashed, windows))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` and the counts that the rules use. All counts are of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = " \t\n\x0b\x0c\r"
    words = words_of(t)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    letters = F.regexp_replace(t, r"[^\p{L}]+", "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        *keep,
        counts.alias("_w"),
        by_line.alias("_l"),
        F.length(_without(t, blank)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        F.length(letters).cast("long").alias("n_letters"),
        (F.length(t) - F.length(_without(t, ".!?"))).cast("long").alias("n_stops"),
    ).select("doc_id", *keep, *(F.col(f"_w.{c}" if c in ("n_words", "n_repeat_words", "n_distinct") else f"_l.{c}" if c in ("n_lines", "n_dup_lines") else c).alias(c) for c in MEASURES))


def vote_sql(rule: str) -> str:
    bad, good = RULES[rule]
    return f"case when n_words = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end"


def _log_odds(prefix: str, a: str, b: str) -> str:
    """SQL of what a rule's vote adds to the log odds of good."""
    return f"case when {prefix} = 1 then ln({a} / (1 - {b})) when {prefix} = -1 then ln((1 - {a}) / {b}) else 0 end"


def fit(patterns: DataFrame) -> dict[str, float]:
    """EM over counts ``n`` of vote patterns (a column for each rule): ``p``, and ``a_rule``, ``b_rule`` for each rule.

    The patterns, at most 3 ** 7 of them, become one array, and all rounds are one expression over it.
    """
    p, a, b = START
    k, names = len(RULES), ["p", *(f"a_{r}" for r in RULES), *(f"b_{r}" for r in RULES)]

    def total(scored: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(scored, F.lit(0.0), lambda s, x: s + value(x))

    def step(m: Column, seen: Column) -> Column:
        def q(x: Column) -> Column:
            odds = F.log(m[0] / (1 - m[0]))
            for i in range(k):
                odds = odds + F.when(x["v"][i] == 1, F.log(m[1 + i] / (1 - m[1 + k + i]))).when(x["v"][i] == -1, F.log((1 - m[1 + i]) / m[1 + k + i])).otherwise(0.0)
            return 1 / (1 + F.exp(-odds))

        def estimates(scored: Column) -> Column:
            rate = lambda yes, no, prior: (yes + PRIOR * prior) / (yes + no + PRIOR)
            when = lambda i, vote, w: total(scored, lambda x: F.when(x["v"][i] == vote, x["n"] * w(x)).otherwise(0.0))
            good, bad = (lambda x: x["q"]), (lambda x: 1 - x["q"])
            return F.array(
                (total(scored, lambda x: x["n"] * x["q"]) + PRIOR * p) / (total(scored, lambda x: x["n"]) + PRIOR),
                *(rate(when(i, 1, good), when(i, -1, good), a) for i in range(k)),
                *(rate(when(i, -1, bad), when(i, 1, bad), b) for i in range(k)),
            )

        return let(F.transform(seen, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), q(x).alias("q"))), estimates)

    seen = F.array_sort(F.collect_list(F.struct(F.array(*RULES).alias("v"), F.col("n").cast("double").alias("n"))))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.array(*map(F.lit, [p, *[a] * k, *[b] * k])), lambda m, _: step(m, F.col("seen")))
    return dict(zip(names, patterns.agg(seen.alias("seen")).select(rounds.alias("m")).first().m, strict=True))


def posterior(model: dict[str, float]) -> Column:
    """The probability that a document with these vote columns is good."""
    odds = F.lit(math.log(model["p"] / (1 - model["p"])))
    for r in RULES:
        a, b = model[f"a_{r}"], model[f"b_{r}"]
        odds = odds + F.when(F.col(r) == 1, math.log(a / (1 - b))).when(F.col(r) == -1, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(measured: DataFrame) -> DataFrame:
    """Adds the votes, ``quality`` (the posterior), ``base_failed`` and ``kept`` to measured documents; fits on all that pass the base test."""
    voted = measured.select("*", *(F.expr(vote_sql(r)).alias(r) for r in RULES))
    model = fit(voted.where(~base_failed()).groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")))
    scored = voted.withColumn("quality", posterior(model)).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its measures, votes, posterior and verdict."""
    return judge(written(measures(docs, doc_id, text), "measures"))


def oracle_sql(source: str = "documents") -> str:
    """The same in one SQL statement for DuckDB: windows are counted by a join over unnested words, EM is unrolled."""
    p, a, b = START
    votes = ", ".join(f"{vote_sql(r)} as {r}" for r in RULES)
    rules = list(RULES)
    log_odds = " + ".join(["ln(m.p / (1 - m.p))", *(_log_odds(f"t.{r}", f"m.a_{r}", f"m.b_{r}") for r in rules)])
    first = ", ".join([f"{p}::double as p", *(f"{a}::double as a_{r}, {b}::double as b_{r}" for r in rules)])
    steps = [f"m0 as (select {first})"]
    for k in range(ROUNDS):
        est = [f"(sum(n * q) + {PRIOR * p}) / (sum(n) + {PRIOR}) as p"]
        for r in rules:
            yes, no = f"coalesce(sum(case when {r} = 1 then n * q end), 0)", f"coalesce(sum(case when {r} = -1 then n * q end), 0)"
            right, wrong = f"coalesce(sum(case when {r} = -1 then n * (1 - q) end), 0)", f"coalesce(sum(case when {r} = 1 then n * (1 - q) end), 0)"
            for name, hit, miss, prior in (("a", yes, no, a), ("b", right, wrong, b)):
                est.append(f"({hit} + {PRIOR * prior}) / ({hit} + {miss} + {PRIOR}) as {name}_{r}")
        steps.append(f"m{k + 1} as materialized (select {', '.join(est)} from (select t.*, 1 / (1 + exp(-({log_odds}))) as q from patterns t, m{k} m))")
    return f"""
with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as t from {source}),
w as (select rid, regexp_extract_all(t, '{WORD}') as w from d),
tri as (select rid, i, (w[i], w[i + 1], w[i + 2]) as k from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from tri) where c > 1),
rep as (select rid, count(distinct i + s) as n from twice, (select unnest([0, 1, 2]) as s) group by rid),
ln_ as (select rid, l from (select rid, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '{WORD}')),
lines as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from ln_ group by rid),
measures as (
  select d.doc_id, len(w.w)::bigint as n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines,
    length(regexp_replace(t, '[^\\pL]+', '', 'g'))::bigint as n_letters, length(regexp_replace(t, '[^.!?]+', '', 'g'))::bigint as n_stops,
    len(list_distinct(w.w))::bigint as n_distinct
  from d join w using (rid) left join rep using (rid) left join lines using (rid)),
voted as (select *, {votes} from measures),
patterns as materialized (select {", ".join(rules)}, count(*)::double as n from voted
  where n_words >= {LEAST_WORDS} and 100 * n_repeat_words <= {MOST_REPEATED} * n_words group by all),
{", ".join(steps)},
scored as (select t.*, 1 / (1 + exp(-({log_odds}))) as quality,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from voted t, m{ROUNDS} m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and quality >= 0.5 as kept,
  round(quality, 6) as quality from scored
"""
