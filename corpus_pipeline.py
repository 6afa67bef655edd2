"""The training-data pipeline: quality rules, language identification, near-duplicate removal, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
Nulls in any column and further columns pass through the filters; a document without text fails the quality rules; rows that repeat a doc_id with the same
text count once from the third stage on, rows without a doc_id are neither grouped nor cut; ties stay as the operators define; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import jaccard, langid, packing, quality, substrings
from tidebar.llm.common import scratch_name, stored, table

#: Words of a shingle and percent of similarity from which two documents are near duplicates.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized; learned from those that name theirs, a quarter of which calibrates.

    Where no document names a language, none can be found unlike the learned ones, and only texts without letters are rejected.
    """
    model = langid.fit(docs, F.lit(True), langid.fold(4) == 3)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = tuple(scratch_name(docs, x) for x in ("lang", "score", "accepted"))
    return langid.identify(docs, model, added=names).where(names[2]).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates; rows without a doc_id stay."""
    return jaccard.representatives(docs, size=SHINGLE, percent=PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of lesser doc_id has; n_chars follows the text."""
    cut = substrings.deduplicate(docs, spans=scratch_name(docs, "spans"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("packing", packed)]

#: Language identification, chunking and packing have no SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
