"""From raw documents to packed sequences: each stage's kept documents are written and read as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import language_id, ngram_join, packing, quality_pu, suffix_dedup
from tallyspark.llm.common import table, written
from tallyspark.llm.queries import _path

#: Near duplicates: words of a shingle and percent of Jaccard.
WIDTH, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on this stage's input, rejects; null and empty texts are scored too, repeats alike."""
    held_out = language_id.id_hash(F.col("doc_id")) % 5 == 0
    model = quality_pu.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return quality_pu.keep(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null text and text without letters.

    A score is a share among the learned languages, so text in any other is
    given to its nearest one and stays.
    """
    held_out = language_id.id_hash(F.col("doc_id")) % 4 == 2
    return language_id.keep(docs, language_id.fit(docs.where(~held_out), _path("piece_bpe_32k.model")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group, and documents without an id or without words; rows that share an id stay or go together."""
    classes = ngram_join.near_duplicate_classes(docs, percent=PERCENT, width=WIDTH)
    gone = classes.where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; documents of which nothing is left go, null and empty ones stay as empty text."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = suffix_dedup.remove_repeats(docs, carry=rest).where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    cut = cut.select(*(F.col(f"rest.{c}").alias(c) for c in rest), text.alias("text"))
    n = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.withColumns(n).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a packed sequence."""
    packed = packing.pack(docs, _path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("pack", pack)]

#: No SQL expresses trained models and tokenizers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
