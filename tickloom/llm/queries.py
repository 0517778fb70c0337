"""The registered queries of this subpackage, one for each numbered operator, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import conversations, decontaminate, embeddings, filter_audit, fingerprints, jaccard, language, lm, mixing, quality, sharding, suffixes
from tickloom.llm.common import shared_dir, table, written
from tickloom.llm.tokens import TokenRollup, with_tokens


def op1_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` against all, as in near_duplicates(): unusable vectors link with nothing, equal vectors link with each other."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all, as in links(): texts without words link with nothing, equal texts are one class, repeated rows are rows."""
    return jaccard.links(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, scores to 4 decimals, as in score_documents(): null and empty texts score 0, repeated rows count and score each."""
    return lm.score_documents(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4) + 0.0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all items of ``benchmark``, as in leaks(): null and empty texts on either side find nothing, repeated rows have theirs."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, weights 1, 2, 3, at most 3 times a source, as in mix(): empty texts have size 0, a null source is one, equal ids are taken alike."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, strings of 50 bytes, as in remove_repeats(): null texts are empty, equal ids aren't smaller than each other, null ids largest."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op7_token_rollup(spark: SparkSession, sf_dir: str, ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", version: str = "byte_bpe_50k") -> DataFrame:
    """All documents come in; then the toxic ones go and the low-quality ones are revised to single spaces, committed twice.

    Null texts have no tokens, repeated rows each count, rows without an id are never changed, empty tables give no rows.
    """
    from public_tokenizers import PATTERN

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.lit(version).alias("version"))
    spaced = F.regexp_replace("text", r"\s+", " ")
    # counted once, both as it is and as revised; texts are neither joined nor shuffled
    counted = with_tokens(docs.withColumn("spaced", F.when(spaced != F.col("text"), spaced)).withColumn("same", F.col("spaced").isNull()), ranks, PATTERN, {"tokens": "text", "revised": "spaced"}, keep=False)
    counted = written(counted.withColumn("revised", F.when(F.col("same"), F.col("tokens")).otherwise(F.col("revised"))).drop("same"), "tokens")
    labels = table(spark, sf_dir, "labels").where("toxic = 1 OR quality = 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    changed = counted.join(labels, "doc_id").withColumn("op", F.when(F.col("toxic") == 1, "delete").otherwise("revise")).withColumn("tokens", F.col("revised"))
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit(1, counted.withColumn("op", F.lit("insert")))
    for _ in range(2):
        rollup.commit(2, changed)
    return rollup.totals()


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, fitted on ``labels`` outside fold 2 of 4, as in classify(): null texts score as empty ones, repeated rows alike."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learned outside fold 0 of 5, as in language_id(): texts without letters are ``und``, ties go to the first name."""
    return language.language_id(table(spark, sf_dir, "documents"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` into 8 shards, as in kd_shards(): null texts have size 1, equal texts stay together where a shard's size allows, repeated rows are rows."""
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged by damage(), as in repair_report(): nulls are one space, rows of one turn stand by role and a hash of the text, repeated rows are duplicates."""
    conversations_ = table(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damage(conversations_), conversations_)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by source, as in interactions(): null texts are empty, a null source is the empty part, repeated rows count each."""
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, as in document_fingerprints(): null texts are empty, equal ids are ordered by a hash of their text, repeated rows are rows."""
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of corpus_pipeline.run(); each stage states its cases."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_embeddings": op1_near_embeddings,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_stupid_backoff": op3_stupid_backoff,
        "op4_decontaminate": op4_decontaminate,
        "op5_mix_sources": op5_mix_sources,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_token_rollup": op7_token_rollup,
        "op8_quality_pu": op8_quality_pu,
        "op9_language_id": op9_language_id,
        "op10_kd_shards": op10_kd_shards,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_filter_audit": op12_filter_audit,
        "op13_fingerprints": op13_fingerprints,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_stupid_backoff": lm.ORACLE,
        "op5_mix_sources": mixing.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
    }
