"""Queries p6, p7 and p8 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import mixing, packing, pii
from codeloom.tables import table

#: The session setting that holds the secret of the pseudonyms, and the key of sessions without it.
KEY_SETTING, DEMO_KEY = "codeloom.pseudonym.key", "codeloom-demo"


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "container_sizes")
    return packing.fill(packing.packed(table(spark, d, "documents"), sizes), sizes)


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.chosen(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.chosen(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.pieces(table(spark, d, "documents"))


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "documents"), spark.conf.get(KEY_SETTING, DEMO_KEY))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per source, as written in lower case and trimmed, and type: documents with such pieces, and pieces."""
    docs = table(spark, d, "documents")
    places = docs.select("doc_id", F.lower(F.trim("source")).alias("source"))
    return pii.pieces(docs).join(places, "doc_id").groupBy("source", "pii_type").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_pieces"))


QUERIES = {f.__name__: f for f in (p6_packed, p6_fill, p7_mixed, p7_shares, p8_found, p8_masked, p8_counts)}
SQL: dict[str, str] = {}
