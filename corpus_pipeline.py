"""The corpus pipeline: documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import cut, fresh_path, n_words
from patchlens.llm.language_id import identify
from patchlens.llm.mixing import mix_sources, take_words
from patchlens.llm.ngram_join import similar_components
from patchlens.llm.packing import pack
from patchlens.llm.pii import find_personal_data
from patchlens.llm.queries import vocabulary

#: Of the documents that go as copies, rows up to which they are broadcast (some 24 bytes each).
BROADCAST_IDS = 500_000
#: Share of its words that a learned language must explain. Of 1,500 held-out documents of sf0.1 the least has 0.984, one in an unlearned script 0.
EXPLAINED = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with `lang` as identified from the text.

    Rejected are documents without a letter, those whose best language has a score under 0.3, and those of
    whose words less than EXPLAINED are explained by any learned language.
    """
    found = identify(docs, keep=("text", "source", "n_chars"), explained=True)
    return found.filter(f"lang_pred <> 'und' and score >= 0.3 and explained >= {EXPLAINED}").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that of the least id.

    Rows are told apart by id and text, so null and repeated ids are judged one
    by one; rows equal in both count once.
    """
    found = similar_components(docs)
    rows = found.groupBy("doc_id", "text_key").agg(F.bool_or("is_first").alias("stays"), F.count("*").alias("rows"))
    odd = cut(rows.filter("not stays or rows > 1").toDF("odd_id", "odd_key", "stays", "rows"))
    small = odd.count() <= BROADCAST_IDS
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    j = docs.join(F.broadcast(odd) if small else odd, F.col("doc_id").eqNullSafe(F.col("odd_id")) & (own == F.col("odd_key")), "left")
    columns = docs.columns
    single = j.filter("rows is null").select(*columns)
    repeated = j.filter("stays and rows > 1").select(*columns).dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts sanitised."""
    found = find_personal_data(docs, sanitised=True, keep=("lang", "source"))
    return found.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken; the document at a source's budget is cut there. Words are counted once."""
    sized = cut(docs.select("doc_id", "text", "lang", "source", n_words(F.col("text")).alias("size")))
    taken = take_words(mix_sources(sized, size_col="size", keep=("text", "lang")), others=("lang",))
    return taken.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: a row per piece, with its ids."""
    return pack(docs, vocabulary())


STAGES = [("language_id", languages), ("ngram_jaccard_join", copies), ("personal_data", personal_data), ("source_mix", mixing), ("balanced_packing", packing)]

#: Language models, hash joins and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's result is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = fresh_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
