"""The operators as queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import checks, extraction, lexical, lm_scores, mixing, neardup, negatives, packing, quality_rules, secrets, sharding, substrings, topk, warc
from spendloom.llm.common import checkpointed, shared_folder, table

#: Where the public tokenizer files are; a parameter of the operators that need one.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = quality_rules.measures(docs).withColumn("row", F.struct("row.doc_id"))
    voted = checkpointed(quality_rules.with_votes(measured))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judged(voted, quality_rules.fit(voted)).select("row.doc_id", *columns)


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents")).select("row.*", "copy", "mix_key")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    return warc.round_trip(table(spark, sf_dir, "pages"), folder)


def op8_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings, every seventh label of which is first moved on."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(vectors.withColumn("label", moved))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the documents as they lie in eight shards; the law is that counts are at most one apart."""
    found = sharding.placed(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return found.select(
        "row.doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_secret_scan": op3_secret_scan,
    "op4_lm_scores": op4_lm_scores,
    "op5_top_k": op5_top_k,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_extract_html": op8_extract_html,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_pack_sequences": op10_pack_sequences,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical": op12_lexical,
    "op13_shards": op13_shards,
}

CHECKS: dict[str, str] = {
    "op1_quality_rules": checks.quality_rules_sql(),
    "op2_poisson_mix": checks.poisson_mix_sql(),
    "op5_top_k": checks.top_k_sql(),
    "op6_substring_dedup": checks.substrings_sql(),
    "op7_warc": checks.warc_sql(),
    "op11_hard_negatives": checks.hard_negatives_sql(),
    "op12_lexical": checks.lexical_sql(),
}
