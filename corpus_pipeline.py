"""A training corpus in five stages: quality, near copies, repeated passages, benchmark leaks, source mix.

Each stage reads what the one before it kept, from Parquet in the shared folder, so that a lost executor costs
no more than the stage at hand. Once its rows are written, the tables that it made on the way are removed, and so are
the rows of the stage before it.

Edges, of all stages: columns beyond doc_id, text, lang, source and n_chars go through unchanged whatever their names,
up to the last stage; a stage that gets no rows gives none. Rows without text, or without words, are voted on as empty
texts; they are no copies, repeats or leaks of anything, and the mix takes nothing of them. Rows without doc_id can't be
labelled and are otherwise like others. Repeated rows are copies: one stays. A text cut by `repeats` keeps whole
characters, is '' if nothing is left, and n_chars is counted anew. Ties are settled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontamination, mixing, ngram_join, quality_knn, suffix_dedup
from sparkloom.llm._common import fresh_dir, read_table, remove, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote rejects go."""
    return quality_knn.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return ngram_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start more than once are cut from the texts."""
    return suffix_dedup.remove_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken (words, repeats counted), and the
    document's source, lang and text. Documents of which it takes nothing go."""
    return mixing.mix(docs, carry=["source", "lang", "text"]).where("taken > 0")


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("leaks", leaks), ("mix", mix)]
#: The vote and the classes of near copies are not expressed in SQL: tests/llm/test_pipeline.py holds every stage against
#: a brute-force version on its own input, and run() against their chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
