"""Queries of the text problems (7 to 9).  Only the round trip has an SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm import bpe, contamination, sentences
from kelpline.sources.tables import reader


#: Setting by which a caller deals the documents out to so many tasks; unset, they are taken as their files are cut.
PARTITIONS = "spark.kelpline.text.partitions"


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    docs, asked = reader(spark, directory)("documents"), spark.conf.get(PARTITIONS, None)
    return docs.repartition(int(asked)) if asked else docs


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, directory))


def p7_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Every text, decoded from its ids; null texts come back empty."""
    return bpe.decode_documents(p7_ids(spark, directory))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return contamination.leaked_items(_documents(spark, directory), reader(spark, directory)("eval_items"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return sentences.sentence_units(_documents(spark, directory))


QUERIES = {f.__name__: f for f in (p7_ids, p7_round_trip, p8_found, p9_found)}

ORACLES = {"p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
