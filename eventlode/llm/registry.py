"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.llm import align, ann, chat, collocations, langid, lm, mixing, neardup, packing, pii, quality, substring, warc
from eventlode.llm.common import cut, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers that are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.TEST_TEXT).alias("text"))
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.page_digests(warc.read_warc(manifest, data=False))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces are cut from their lineage: counts and ranks then read them without tokenizing again."""
    pieces = cut(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
    return packing.pack(pieces)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before has kept."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_ann_search": op1_ann_search,
        "op2_chat_format": op2_chat_format,
        "op3_mixing": op3_mixing,
        "op4_lm_scores": op4_lm_scores,
        "op5_warc": op5_warc,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_packing": op9_packing,
        "op10_language_id": op10_language_id,
        "op11_token_alignment": op11_token_alignment,
        "op12_collocations": op12_collocations,
        "op13_personal_data": op13_personal_data,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.oracle(), "op3_mixing": mixing.oracle(), "op5_warc": warc.oracle(), "op8_quality_rules": quality.oracle(), "op12_collocations": collocations.oracle()}
