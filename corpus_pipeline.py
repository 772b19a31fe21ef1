"""Corpus pipeline: unknown languages go, then exact copies, then near copies; sources are mixed, documents packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilespark.llm import exact_dedup, langid, mixing, ngram_jaccard, packing
from tilespark.llm.util import documents, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a known language go: null, empty and letterless ones, and those that no learned language fits."""
    return langid.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; null counts as empty, null ids rank lowest."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at Jaccard 0.8 or more, the smallest doc_id stays, null last; wordless texts stay."""
    return ngram_jaccard.JaccardJoin(docs).keep_one()


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks that the mix takes: whole copies of documents, and the words of drawn blocks. Texts without words go; a null source is one of its own."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens. No documents give no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]

#: SQL can't express the classifier, the similarity join or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. Any stage may leave an empty table."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir)).table
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
