"""From raw documents to packed training sequences: quality, language, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's input. All but the last return the columns of ``documents``. Extra columns that clash with an operator's own are no
matter: a stage decides by row, with a row number that it makes itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfactor.llm import langid, neardup, packing, quality
from sparkfactor.llm.common import broadcast_if_small, crc32_of_id, table, written
from sparkfactor.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is less certain than this is rejected.
LEAST_CERTAIN = 0.5
#: Up to so many ids of documents that go, some 16 MB, are broadcast.
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base test and that the weak-supervision posterior finds good.

    A null, empty or wordless text fails the base test and goes. Texts of any length are judged whole, row by row, so rows that share a
    doc_id, or have none, are judged apart. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    return quality.judge(written(quality.measures(docs, keep=COLUMNS[1:]), "measures")).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known with some certainty. Learns from documents of this input that aren't held out.

    A null text, or one without a letter, has no language and goes. Rows without doc_id or lang aren't learned from, but are judged. Texts of any length are
    judged whole. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.where(F.coalesce(crc32_of_id(F.col("doc_id")) % 3 != 1, F.lit(False))))
    named = langid.predict(docs, model, COLUMNS)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near copies, over 5-word shingles at similarity 0.8.

    Rows without doc_id or without a word stay, null and empty texts among them. Texts of any length are compared whole, and an empty table
    stays empty. Where a doc_id comes with several texts each is judged by its own; of rows that share
    doc_id and shingles one stays, the least.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null")
    judged = written(neardup.classes(named, shingle=5, percent=80).select("doc_id", "print", "kept"), "judged")
    repeated = written(judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    # the documents that go are few, so that mostly their ids go to the texts and no text is shuffled
    gone = written(judged.where("not kept").select("doc_id").union(repeated).distinct(), "gone")
    once = named.join(broadcast_if_small(gone, BROADCAST_IDS), "doc_id", "left_anti")
    again = broadcast_if_small(repeated)
    several = neardup.printed(named.join(again, "doc_id", "left_semi"), shingle=5)
    kept = judged.where("kept").join(again, "doc_id", "left_semi").select("doc_id", "print").distinct()
    least = several.join(kept, ["doc_id", "print"], "left_semi").groupBy("doc_id", "print").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    wordless = several.where("print is null").select(*COLUMNS)
    return once.select(*COLUMNS).union(least.select(*COLUMNS)).union(wordless).union(docs.where("doc_id is null"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a row for each piece.

    A null or empty text is its end token alone; a text of more than 2048 tokens is cut. Rows with one doc_id, or none, are documents of their
    own. An empty table gives no rows.
    """
    return packing.pack(docs.select(*COLUMNS), tokenizer_file("word_bpe_49k.json"), end_id=0, max_len=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: FTRL training, sketching and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
