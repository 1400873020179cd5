"""Registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set(ARROW_ROWS, "2048")  # texts may be long: bounds what a Python worker holds
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.nn_graph import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), every=100, top=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pageloom.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=2048)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pageloom.llm.bpe_codec import bpe_encode_decode

    coded = bpe_encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_joins",
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"), width=200).select(
        "doc_id",
        "n_bytes",
        F.expr("n_bytes - octet_length(kept)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Target weights of the language domains.
MIX_TARGETS = {"de": 0.2, "en": 0.5, "es": 0.1, "fr": 0.2}


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of domains: documents that ``labels`` covers, with their language."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.mixing import mixing_rates

    return mixing_rates(_table(spark, sf_dir, "documents"), language_labels(spark, sf_dir), MIX_TARGETS, low=0.0, high=4.0)


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.flac import media_column

    return media_column(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.quality_gam import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.line_dedup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents"), percent=80, least_words=1)
    return kept.select("doc_id", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1))).cast("long").alias("n_kept_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.license_scan import license_scan

    found = license_scan(_table(spark, sf_dir, "documents"))
    labels = F.array_union("base.label", "spans.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))).alias("score"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.vector_codes import books_digest, compress, with_label_sums

    coded, books = compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return with_label_sums(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document (by crc32 of its id) repeats a stretch of its words from some word on to its end."""
    split = F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')")
    hashed = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string))").alias("h"))
    words = hashed.select("doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.expr("h % 10 = 0"), split).alias("words"))
    sized = words.withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    placed = sized.withColumn("a", F.expr("cast(g % n as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    told = F.expr("slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int)))), 1, n)")
    return placed.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.word_runs import word_runs

    found = word_runs(with_repeats(_table(spark, sf_dir, "documents")), least=6, power=4)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        F.expr("-top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.expr("-top.period").alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_nn_descent": op2_nn_descent,
    "op3_token_counts": op3_token_counts,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_flac_media": op7_flac_media,
    "op8_quality_gam": op8_quality_gam,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_toxicity": op11_toxicity,
    "op12_vector_codes": op12_vector_codes,
    "op13_word_runs": op13_word_runs,
}

ORACLE_SQL: dict[str, str] = {}
