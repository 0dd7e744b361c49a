"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import graded_quality, toxicity
from .collocations import collocations
from .common import discarding, materialize, read, work_path
from .jaccard_join import jaccard_components
from .lattice_sampling import sample_segmentations
from .near_dup import near_dup_classes
from .oracles import ORACLE
from .packing import pack
from .quality_rules import judge
from .resampling import resample
from .secrets import secret_digest
from .token_files import write_token_files
from .url_filter import judge_urls
from .vector_search import scaled, top_k

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of every text, with digests; null and empty texts have the empty one, see sample_segmentations()."""
    return sample_segmentations(read(spark, sf_dir, "documents"), PIECE_BPE, k=3, digest=True)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of 4096 along the curve; null texts are the end id alone, see pack()."""
    return pack(read(spark, sf_dir, "documents"), WORD_BPE, end_id=2, length=4096, ids=False)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document; empty texts are copies of each other, null ids count for no class_id, see near_dup_classes()."""
    return near_dup_classes(read(spark, sf_dir, "documents"))


def op4_graded_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tails of every document; documents without a label are scored by their text as any, see score()."""
    docs = read(spark, sf_dir, "documents")
    graded = read(spark, sf_dir, "labels").select("doc_id", graded_quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    scored = graded_quality.score(docs, graded_quality.train(docs, graded))
    return scored.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_good"), F.col("tails")[1].alias("p_best"), "kept")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document; null texts have none, copies are scanned once, see find_secrets()."""
    return secret_digest(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; null texts fail the base rules, see judge()."""
    judged = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the same number stands for a page's outcome: good if its quality is 1."""
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge_urls(read(spark, sf_dir, "pages"), outcomes).withColumn("reputation", F.round("reputation", 9))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from written token files; null texts are the end id alone, see write_token_files()."""
    files = write_token_files(read(spark, sf_dir, "documents"), work_path(spark, "token-files"), WORD_BPE, end_id=1)
    return files.documents(ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; empty and null texts have the curve's value at zero, see score()."""
    docs = read(spark, sf_dir, "documents")
    with discarding(spark):
        return materialize(toxicity.score(docs, *toxicity.train(docs, read(spark, sf_dir, "labels"))), "toxicity", outer=True)


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best of every twentieth vector against all; null and non-finite vectors take no part, see top_k()."""
    vectors = scaled(read(spark, sf_dir, "embeddings"), scale=64)
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenth of the documents that the benchmark's words favour; null and empty texts have weight 0 and aren't drawn, see resample()."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed="2024")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases; null texts have none, a null language is `und`, see collocations()."""
    return collocations(read(spark, sf_dir, "documents"), least=30, top=2000, percent=80)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link by their 5-word shingles; null and empty texts link with nothing, see jaccard_components()."""
    return jaccard_components(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_sampling, op2_packing, op3_near_dup, op4_graded_quality, op5_secrets, op6_url_filter, op7_token_files, op8_quality_rules, op9_toxicity, op10_vector_search, op11_importance_resampling, op12_collocations, op13_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
