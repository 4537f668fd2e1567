"""From raw documents to packed training sequences: quality, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import linededup, mixing, neardup, packing, quality
from tracelake.llm.common import bundled, reach_workers, read_table, unbundled
from tracelake.plans.sizing import dimension
from tracelake.session import stored_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones outside its held-out fold."""
    model = quality.trained(docs, read_table(spark, sf_dir, "labels"))
    good = quality.with_quality(bundled(docs, "text"), model).where("predicted = 1")
    return unbundled(good, docs.columns, text=F.col("text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id has."""
    reach_workers(spark)
    cut = linededup.dedup_lines(bundled(docs, "doc_id", "text"))
    return unbundled(cut, docs.columns, doc_id=F.col("doc_id"), text=F.col("text"), n_chars=F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates, and documents without id.

    Documents are near-duplicates if their 5-word shingles have a Jaccard similarity of 0.8 or more. Rows of one id are one document.
    """
    reach_workers(spark)
    copies = stored_table(neardup.similar_documents(docs).where("doc_id != component_id").select("doc_id").distinct())
    return unbundled(bundled(docs, "doc_id").join(dimension(copies).hint("shuffle_hash"), "doc_id", "left_anti"), docs.columns, doc_id=F.col("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their source ask for."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences."""
    reach_workers(spark)
    return packing.pack(stored_table(packing.pieces(docs)))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot fit the classifier, nor hash and tokenise as the stages do; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``; every stage is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored_table(stage(spark, docs, sf_dir))
    return docs
