"""The opN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.host_rules import host_rules
from patchlens.llm.chat_format import digests, format_windows
from patchlens.llm.html_main import extract_main
from patchlens.llm.language_id import identify
from patchlens.llm.lz_fingerprint import lz_fingerprints
from patchlens.llm.mixing import mix_sources
from patchlens.llm.ngram_join import similar_components
from patchlens.llm.packing import pack
from patchlens.llm.pii import PATTERNS, find_personal_data, spans_text
from patchlens.llm.timestamps import normalise_timestamps
from patchlens.llm.token_alignment import align_tokens
from patchlens.llm.token_counts import count_tokens
from patchlens.llm.toxicity import score_toxicity

#: The tokenizer file of the queries; operators take a path.
VOCABULARY = "byte_bpe_50k.json"
#: The tokenizer that op12 aligns with it.
OTHER_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(_documents(spark, sf_dir), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op2_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(_documents(spark, sf_dir))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), vocabulary()).drop("ids")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), vocabulary())


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = identify(_documents(spark, sf_dir), learn_if=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], c.schema)
    return digests(format_windows(c.unionByName(more), vocabulary()))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_if=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_documents(spark, sf_dir), vocabulary(), vocabulary(OTHER_VOCABULARY))


def op13_timestamp_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_timestamps(spark.read.parquet(f"{sf_dir}/stamps.parquet"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from patchlens.llm import oracle

    return {k: v for k, v in vars(oracle).items() if k.startswith("op")}
