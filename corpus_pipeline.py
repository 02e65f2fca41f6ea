"""A training corpus from raw documents, in five stages that each read what the one before wrote.

Defined cases of all stages: an empty table gives an empty one, with the same columns but for the last stage. Columns that a stage does not use, whatever
their names, stay as they are. A null text is an empty one. Texts of any length are read whole. What a stage does with null or repeated ids, ties and repeated rows is
said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linewise.llm import decontamination, language_id, mixing, near_dedup, token_files
from linewise.llm.common import new_folder

#: Documents below this score resemble no language that was learned.
LEAST_SCORE = 0.05
ORACLE_SQL = None  # the stages are not expressible in SQL; tests hold them against brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without text or letters, or that resemble no language, go.

    Rows are judged by their texts alone, so repeated rows and rows with null or equal ids go or stay together with their texts.
    """
    return language_id.drop_unidentified(docs, language_id.train(docs), least_score=LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id; a null id is larger than all others.

    Rows with one id, or none, but different texts are judged each for itself; of rows that repeat an id and a text one stays.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark. Rows are judged by their texts alone; items without words are in no document."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice.

    Null is a source of its own, the last. Ties are settled by a hash of the id; rows that repeat an id, size and source are taken as often as the least of
    them. Documents without words are not taken.
    """
    return mixing.take_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row per document and copy with its place in them.

    Documents are in ascending order of id, a null id first; copies and other rows of one id follow each other in order of text.
    """
    return token_files.token_files_round_trip(spark, docs)


STAGES = [("language", identify_language), ("near_dedup", drop_near_copies), ("decontamination", decontaminate), ("mixing", mix), ("tokens", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
