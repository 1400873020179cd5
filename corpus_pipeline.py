"""The corpus pipeline: quality, line dedup, near-duplicate documents, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last keep the columns of
documents.

Defined cases: a null text is scored as the empty one by the quality stage and passes the
others as it is; rows without id are judged by quality and mixed, but take no part in the
two deduplications and stay; repeated rows are one document to the line stage and copies
to the near-duplicate stage, which keeps the smallest id of a group; ties go to the earlier
id and line; an empty table gives empty results; further columns, whatever their names,
pass through the stages that keep the columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm import textkit as tk
from pageloom.llm.bpe_codec import bpe_encode_decode
from pageloom.llm.line_dedup import dedup_lines
from pageloom.llm.mixing import mix_sources
from pageloom.llm.ngram_join import ngram_jaccard_components
from pageloom.llm.quality_gam import THRESHOLD, fit_quality, quality_score
from pageloom.llm.queries import ARROW_BYTES, ARROW_ROWS, MIX_TARGETS, VOCABULARY, language_labels
from pageloom.runtime import Scratch


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of about a block of text: an executor's C library keeps what larger buffers took, for each of its threads, until the executor ends."""
    spark.conf.set(ARROW_ROWS, "2048")
    spark.conf.set(ARROW_BYTES, str(tk.BATCH_BYTES))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt to all cores where one task would read over twice a core's share: files are only split between row groups, and some writers make few."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    most, whole = docs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return docs.repartition(3 * cores) if most and most * cores > 2 * whole else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. The model is fitted on the input's labelled documents."""
    bound_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return spread(docs).where(quality_score(docs, model, F.col("text")) >= THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later matching lines; n_chars is that of the new text."""
    bound_batches(spark)
    kept = dedup_lines(docs, percent=80, least_words=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles: the one with the smallest id."""
    bound_batches(spark)
    groups = ngram_jaccard_components(docs, n=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct()
    groups = Scratch(spark, "stage").save(groups, "gone")
    # ids of later members are sent to all executors while they are few; beyond, a shuffled join
    groups = F.broadcast(groups) if groups.count() <= 1 << 20 else groups
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the language targets; a rate is never below 1, so none is lost."""
    return mix_sources(docs, language_labels(spark, sf_dir), MIX_TARGETS, low=1.0, high=4.0)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens."""
    bound_batches(spark)
    return bpe_encode_decode(spread(docs), public_tokenizers.path(VOCABULARY)).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The classifier and the fitted rates can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
