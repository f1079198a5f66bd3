"""The pipeline's stages against brute-force versions, each on the input that the stage itself got."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from test_text_operators import brute_components, crc
from tokenizers import Tokenizer

import corpus_pipeline
from sparkfactor.llm import langid, packing, quality, tokenizing
from sparkfactor.llm.common import release

WORDS = {
    "en": "the river of stone and light in water under green paper house with a small bridge near that old road".split(),
    "de": "der fluss aus stein und licht im wasser unter dem haus mit einer kleinen brücke nahe der alten straße".split(),
}


def sentences(rng, lang, n):
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "st"]) for _ in range(n)]
    return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(words)) + "."


def table():
    rng, rows = random.Random(17), []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        rows.append((i, sentences(rng, lang, rng.randint(60, 140)), lang, "s", 1))
    for i in range(20):  # copies at all distances
        words = rows[i % 7][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = "zz"
        rows.append((200 + i, " ".join(words), rows[i % 7][2], "s", 1))
    for i in range(12):  # faults of several kinds
        words = rows[30 + i][1].split()
        junk = [w + rng.choice(["###", "$%", "&&&"]) for w in words] if i % 2 else words[:20] * 6
        rows.append((300 + i, " ".join(junk), "en", None, 1))
    rows += [(400, None, "en", "s", 0), (401, "", None, "s", 0), (402, "short text", "en", "s", 1), (403, sentences(rng, "en", 9000), None, "s", 1)]
    rng.shuffle(rows)
    return rows


def predicted(model, text):
    """Language and probability of one text, term by term."""
    at, n = langid.counts(text)
    values = [math.log1p(int(k)) * float(model.idf[j]) for j, k in zip(at, n, strict=True)]
    norm = math.sqrt(sum(v * v for v in values))
    logits = [sum(v / norm * float(model.weights[j, c]) for j, v in zip(at, values, strict=True)) + float(model.bias[c]) for c in range(len(model.languages))]
    e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
    return model.languages[int(np.argmax(e))], max(e) / sum(e)


def best_fit(lengths, size):
    """The number of sequences of best-fit decreasing, document by document."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(size - n)
    return len(room)


def test_stages_equal_plain_rules(spark, tmp_path):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)

    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(docs.columns, zip(*rows, strict=True), strict=True))))
    judged = con.execute(quality.oracle_sql()).fetchall()
    good = stages["quality_rules"](spark, docs, str(tmp_path))
    good.write.parquet(str(tmp_path / "good"))
    good = spark.read.parquet(str(tmp_path / "good"))
    after = {r.doc_id: r for r in good.collect()}
    assert set(after) == {r[0] for r in judged if r[7]} and {400, 401, 402} & set(after) == set() and 403 in after

    learned = [r for r in after.values() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = langid.fit(spark.createDataFrame(learned, good.schema))
    sure = {i for i, r in after.items() if predicted(model, r.text)[1] >= corpus_pipeline.LEAST_CERTAIN}
    named = stages["language_id"](spark, good, str(tmp_path))
    assert {r.doc_id for r in named.collect()} == sure

    label, _ = brute_components([(i, after[i].text) for i in sure], 5, 80)
    single = stages["near_dedup"](spark, named, str(tmp_path)).collect()
    assert {r.doc_id for r in single} == {i for i in label if label[i] == i} and len(single) < len(sure)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [0] for r in single}
    cut = {(i, p): x[2048 * p : 2048 * p + 2048] for i, x in ids.items() for p in range(-(-len(x) // 2048))}
    packed = stages["best_fit_packing"](spark, spark.createDataFrame(single, good.schema), str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == {(i, p): (2048 * p, len(x), crc(x)) for (i, p), x in cut.items()}
    places = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 2048 and len(places) == best_fit([len(x) for x in cut.values()], 2048)


def test_odd_tables(spark, odd_docs, no_docs, tmp_path):
    """Null, empty and very long texts, repeated ids, ties and clashing columns; and no rows."""
    good = corpus_pipeline.quality_rules(spark, odd_docs, str(tmp_path))
    kept = {(r.doc_id, r.text) for r in good.collect()}
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert kept <= texts and not any(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) < 50 for _, t in kept)
    single = corpus_pipeline.near_dedup(spark, odd_docs, str(tmp_path))
    assert single.columns == list(corpus_pipeline.COLUMNS)
    left = [(r.doc_id, r.text) for r in single.collect()]
    # equal rows leave one, ties the least id, rows without an id or a word all stay
    assert sum(i == 107 for i, _ in left) == 0 and sum(t == "tie tie tie" for _, t in left) == 1 and (105, "tie tie tie") in left
    assert sum(i is None for i, _ in left) == 2 and {(100, None), (101, ""), (102, " \t\n")} <= set(left) and any(i == 108 for i, _ in left)
    several = spark.createDataFrame([(7, "one two three four five six seven", "en", "s", 1), (3, "one two three four five six seven", "en", "s", 1), (7, "quite another text that stands under the same id", "en", "s", 1), (7, "quite another text that stands under the same id", "en", "s", 1)], no_docs.schema)
    assert sorted((r.doc_id, r.text[:3]) for r in corpus_pipeline.near_dedup(spark, several, str(tmp_path)).collect()) == [(3, "one"), (7, "qui")]
    out = no_docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        assert out.count() == 0


def test_workers_drop_the_encoder(tmp_path):
    """An operator that doesn't tokenise drops the encoder that packing has left in a worker; packing's own tasks keep it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizing.encoder(path)
    assert list(release(iter([1]), keep=True)) == [1] and tokenizing.encoder.cache_info().currsize == 1
    assert list(release(iter([1, 2]))) == [1, 2] and tokenizing.encoder.cache_info().currsize == 0


def test_language_id_sends_a_text_once(spark, tmp_path):
    """Texts that are kept aren't sent a second time to be read, and rows come back in small batches, in order."""
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(docs)
    many = docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k")).repartition(2).select(*corpus_pipeline.COLUMNS, "k")
    named = langid.predict(many, model, (*corpus_pipeline.COLUMNS, "k"))
    sent = named._jdf.queryExecution().analyzed().children().head().schema()
    assert [f.dataType().simpleString() for f in map(sent.apply, range(sent.size()))].count("string") == 3
    expected = {(r.doc_id, r.text): predicted(model, r.text) if re.search(r"[^\W\d_]", r.text or "") else ("und", 0.0) for r in docs.collect()}
    rows = named.collect()
    assert len(rows) == 20 * len(expected) and len({(r.doc_id, r.text, r.k) for r in rows}) == len(rows)
    for r in rows:
        lang, score = expected[r.doc_id, r.text]
        assert r.lang_pred == lang and math.isclose(r.score, score, abs_tol=1e-4)


def test_packing_starts_no_second_workers(spark):
    """The plan of runs comes as Arrow data, not through an RDD of Python objects, which has workers of its own."""
    pieces = spark.range(50).selectExpr("id as doc_id", "1 + id % 7 as length", "0 as task", "id div 7 as nth")
    placed = packing.place(pieces, 16)
    assert "ExistingRDD" not in placed._jdf.queryExecution().toString()
    assert placed.count() == 50
