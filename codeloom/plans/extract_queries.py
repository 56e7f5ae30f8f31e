"""Extraction over the source files of all projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract import interpret
from codeloom.extract.captures import captures
from codeloom.session import pin, spread
from codeloom.tables import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    frameworks = table(spark, d, "projects").groupBy(F.col("name").alias("project")).agg(F.min("framework").alias("framework"))
    files = spread(table(spark, d, "source_files").where("file_path is not null").select("file_path", "project", "content"))
    return files.join(F.broadcast(frameworks), "project", "left")  # one row a project name


def _paths(files: DataFrame) -> DataFrame:
    return files.select("file_path", "project", "framework").distinct()


def _captures(files: DataFrame) -> DataFrame:
    """The pattern pass, made once: several joins read it.  Repeated rows of a file give their matches once."""
    return pin(captures(files), "captures").dropDuplicates(["file_path", "pattern", "match_id"])


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("project", "framework").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("n_files"))


def extract_captures(spark: SparkSession, d: str) -> DataFrame:
    return _captures(_files(spark, d)).groupBy("framework", "pattern").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("n_files"))


def extract_routes(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return _counted(interpret.routes(_captures(files)).unionByName(interpret.convention_routes(_paths(files))))


def extract_services(spark: SparkSession, d: str) -> DataFrame:
    return interpret.services(_captures(_files(spark, d))).select("file_path", "name", "line", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("annotations", ",").alias("annotations"))


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return interpret.entities(_captures(_files(spark, d))).select("file_path", "name", "table_name", F.size("fields").alias("n_fields"))


def extract_components(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return _counted(interpret.components(_captures(files), _paths(files)))


def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return interpret.imports(_captures(_files(spark, d)))


def extract_doc_references(spark: SparkSession, d: str) -> DataFrame:
    return interpret.doc_references(_files(spark, d))


QUERIES = {f.__name__: f for f in (extract_captures, extract_routes, extract_services, extract_entities, extract_components, extract_imports, extract_doc_references)}
SQL: dict[str, str] = {}
