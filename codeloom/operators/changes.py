"""Which files the next extraction has to read, from the log of what was extracted before."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.ledger import LatestByKey
from codeloom.session import work_folder


def succeeded_waves(waves: DataFrame) -> DataFrame:
    """(wave_id, started_at) of waves of which any row says ok, ignoring case and outer blanks."""
    ok = F.lower(F.trim("status")) == "ok"
    return waves.where(F.col("wave_id").isNotNull()).groupBy("wave_id").agg(F.max("started_at").alias("started_at"), F.max(F.coalesce(ok, F.lit(False))).alias("ok")).where("ok").drop("ok")


def latest_records(spark: SparkSession, folder: str) -> LatestByKey:
    """Per path the record of the latest wave by its start."""
    return LatestByKey(spark, folder, "file_path", F.struct("started_at", "result_id"), F.struct("content_hash"))


def ready_records(log: DataFrame, waves: DataFrame) -> DataFrame:
    """The log's records of waves that succeeded, with the wave's start."""
    return log.select("result_id", "wave_id", "file_path", "content_hash").join(succeeded_waves(waves), "wave_id")


def halfway(log: DataFrame) -> Column:
    """Whether a record had arrived by the middle of the time in which records arrived; false where that isn't known."""
    moment = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    first, last = log.agg(F.min(moment), F.max(moment)).first()
    middle = F.lit(None).cast("long") if first is None else F.lit((first + last) // 2)
    return F.coalesce(moment <= middle, F.lit(False))


def files_to_extract(spark: SparkSession, files: DataFrame, log: DataFrame, waves: DataFrame, folder: str | None = None, arrivals: Sequence[Column] = ()) -> DataFrame:
    """Paths of ``files`` whose latest succeeded record is missing, has no hash, or has another hash.

    The log is folded through the ledger in ``folder`` (a fresh one if none is given): only record numbers
    in the gaps are read, late ones included.  ``arrivals`` replays a history: one run for the records that
    each of these conditions lets in, then one for the whole log.  A wave that succeeds after its records were folded
    is a new record for them, so records of waves still open stay pending.  Null paths and null contents: a null path
    is no file, a null content has no hash and is always to be extracted.  Repeated rows count once.
    """
    latest = latest_records(spark, folder or f"{work_folder(spark)}/changes-{uuid.uuid4().hex}")
    for there in (*arrivals, F.lit(True)):
        latest.run(ready_records(log.where(there), waves), "result_id")
    state = latest.state().select(F.col("key").alias("_path"), F.col("best.v.content_hash").alias("_hash"))
    now = files.where(F.col("file_path").isNotNull()).select("file_path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))
    joined = now.join(state, F.col("file_path") == F.col("_path"), "left")
    changed = F.col("hash").isNull() | F.col("_hash").isNull() | (F.col("hash") != F.col("_hash"))
    return joined.where(changed).select("file_path").distinct()
