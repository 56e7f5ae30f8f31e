"""What earlier extractions recorded for files: the last content hash per path, and what it says about files now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recorded_hashes(log: DataFrame) -> DataFrame:
    """(file_path, cached_hash): the hash of the greatest result_id that has one.  Null paths are no files."""
    own = log.where("content_hash is not null and file_path is not null")
    return own.groupBy("file_path").agg(F.max(F.struct("result_id", "content_hash"))["content_hash"].alias("cached_hash"))


def changed(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """(file_path, state) of files (file_path, content_hash) that are new or have another hash than was recorded."""
    joined = now.join(recorded, "file_path", "left").where("cached_hash is null or cached_hash <> content_hash")
    return joined.select("file_path", F.when(F.col("cached_hash").isNull(), "new").otherwise("changed").alias("state"))


def purged(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(file_path) of records of files that are no more."""
    return recorded.select("file_path").join(now.select("file_path"), "file_path", "left_anti")


def invalidate(recorded: DataFrame, paths: Sequence[str]) -> DataFrame:
    """The records without those of these paths, which are extracted again next time."""
    return recorded.where(~F.col("file_path").isin(list(paths))) if paths else recorded


def statistics(log: DataFrame) -> DataFrame:
    """One row: distinct results, files and hashes."""
    return log.agg(F.count_distinct("result_id").alias("n_results"), F.count_distinct("file_path").alias("n_files"), F.count_distinct("content_hash").alias("n_hashes"))
