"""The corpus pipeline: quality rules, near-duplicate removal, substring dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has kept, and returns a DataFrame; run()
writes each as Parquet in the shared folder and rereads it. All stages but the last return the columns of
documents. What a stage decides takes effect in its rows: the first two drop documents, the third shortens
texts (and drops documents that have no words left of them), the fourth puts rows in the order of the mix, and
the last returns the pieces of documents with their places in sequences, which follow that order among equal lengths.

Defined results of every stage: a null text is an empty one, a null source or language a value as any other; documents
without an id are kept by the stages that compare documents (2 and 3), as they can't be told apart; rows that repeat an
id are judged one by one, and go or stay together in stage 2; an empty table stays empty; columns other than those of
documents are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.llm import mixing, neardup, packing, quality, substring
from eventlode.llm.common import cut, new_shared_path, table
from eventlode.llm.registry import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_only(docs.select(*COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of smallest id; documents without an id all stay."""
    classes = neardup.near_duplicates(docs.select("doc_id", "text")).filter("doc_id <> class_id").select("doc_id")
    return docs.join(classes, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences that repeat an earlier document's passage; a document that is all repeats goes."""
    cleaned = substring.substring_dedup(docs, keep=["lang", "source", "n_chars"])
    text = F.when(F.col("n_removed") > 0, F.trim("kept_text")).otherwise(F.col("kept_text"))
    out = cleaned.withColumn("text", text).filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files in order, and rows in order within a file."""
    mixed = mixing.mix(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), *COLUMNS), id_col="id", source="src", keep=COLUMNS)
    return mixed.repartitionByRange("slot", "in_block", "id").sortWithinPartitions("slot", "in_block", "id").select(*COLUMNS)


def _order_written(docs: DataFrame) -> Column | None:
    """Where the mixing stage put a row: the number of its file, then its number in the file. None for rows that are in no files."""
    try:
        docs.select("_metadata.row_index", "_metadata.file_name").schema  # noqa: B018
    except AnalysisException:
        return None
    part = F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as bigint)"), F.lit(0))
    return F.shiftleft(part, packing.PLACE_BITS) + F.col("_metadata.row_index")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens.

    Of pieces of equal length those that come earlier in the mix are in earlier sequences.
    """
    place = _order_written(docs)
    pieces = cut(packing.token_pieces(docs, tokenizer_path(), place=place))
    return packing.pack(pieces, place=None if place is None else "place").drop("place")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Near-duplicate classes, sentence spans and packing are no SQL; tests hold them against brute force.
ORACLE_SQL = None
