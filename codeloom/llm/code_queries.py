"""Queries p2 and p3 over source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import provenance, syntax
from codeloom.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(syntax.known_files(table(spark, d, "source_files"))).select("file_path")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per project and language: files, files that don't parse, and their rate."""
    files = syntax.known_files(table(spark, d, "source_files"))
    bad = syntax.invalid_files(files).select("file_path", F.lit(1).alias("bad"))
    each = files.groupBy("file_path").agg(F.max("project").alias("project"), F.max("lang").alias("lang"))
    counted = each.join(bad, "file_path", "left").groupBy("project", F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid"))
    return counted.withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))


def _made(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(syntax.known_files(table(spark, d, "source_files")), table(spark, d, "vendor_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("file_path")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Per project and kind the files that weren't written by hand."""
    return _made(spark, d).groupBy("project", "kind").agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p3_found, p3_kinds)}
SQL: dict[str, str] = {}
