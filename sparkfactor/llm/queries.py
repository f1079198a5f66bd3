"""The operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from Elias-Fano token files."""
    from .token_files import token_documents

    return token_documents(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's sequence and offset in sequences of at most 2048 tokens."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=0, max_len=2048)


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, base test, quality posterior and verdict."""
    from pyspark.sql import functions as F

    from .quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *counts, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _op8_sql() -> str:
    from .quality import oracle_sql

    return oracle_sql()


ORACLE["op8_quality_rules"] = _op8_sql()


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies, over 2-word shingles at similarity 0.8."""
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language and calibrated probability."""
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic, scored on its restored words."""
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of highest integer inner product for every vec_id that 50 divides, against all rows."""
    from pyspark.sql import functions as F

    from .bitsliced import build_index, search, usable

    rows = usable(table(spark, sf_dir, "embeddings"))
    asked = rows.where("vec_id % 50 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return search(build_index(rows), asked, k=5)


ORACLE["op4_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on len(q.v) = len(c.v) and q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


@query
def op3_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document over the piece lattice."""
    from .pieces import segmentations

    return segmentations(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), n=4)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens by count-only Viterbi."""
    from .pieces import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op2_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of all conversations after role repair, with its part of the rendering."""
    from .chat import repair

    return repair(table(spark, sf_dir, "conversations"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark and its rank among the quarter drawn."""
    from .resampling import resample

    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, seed=7, least_words=20, longest=2, n_buckets=10_000)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _op11_sql() -> str:
    from .resampling import oracle_sql

    return oracle_sql()


ORACLE["op11_importance_resampling"] = _op11_sql()


@query
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for every vec_id that 100 divides, among all rows."""
    from pyspark.sql import functions as F

    from .permindex import nearest, usable

    rows = usable(table(spark, sf_dir, "embeddings"))
    asked = rows.where("vec_id % 100 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return nearest(rows, asked, k=10)


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distance from the others of its language, and the 200 terms by which it stands out."""
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), least_docs=3, top_terms=200)


def _op13_sql() -> str:
    from .divergence import oracle_sql

    return oracle_sql()


ORACLE["op13_source_divergence"] = _op13_sql()
