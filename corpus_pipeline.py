"""Corpus pipeline: five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.llm.exact_dedup import drop_copies
from subsidia.llm.jaccard_join import drop_similar
from subsidia.llm.language_id import fit_filters, held_out, keep_known_languages
from subsidia.llm.mixing import draw_mix
from subsidia.llm.packing import pack_public
from subsidia.session import shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or of which no language has an n-gram, go.

    Rows are judged one by one, by their text alone: null and empty texts go,
    repeated rows and null ids are nothing special, very long texts are judged
    whole, an empty table stays empty and further columns stay as they are.
    """
    return keep_known_languages(docs, fit_filters(docs.where(~held_out(F.col("doc_id")))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id; null ids are the smallest, and of equal ids the last row stays.

    Null counts as the empty text.  Rows are told apart by their place, so a
    repeated id takes no other text along.  An empty table stays empty and
    further columns stay as they are.
    """
    return drop_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; null ids are the largest, and of equal ids the first row stays.

    Texts without a word all stay.  Rows are told apart by their place.  An
    empty table stays empty and further columns stay as they are.
    """
    return drop_similar(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without a word go.

    A null source is a source of its own; rows with equal ids are taken or left
    together if they are of one source, null ids being one id.  An empty table
    stays empty and further columns stay as they are.
    """
    return draw_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; see ``pack_documents`` for nulls, repeated rows and empty tables."""
    return pack_public(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard", ngram_jaccard), ("source_mix", source_mix), ("packing", packing)]

#: Language filters and n-gram components can't be written in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
