"""Following a log of extraction records as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.changes import latest_records


def watch_log(spark: SparkSession, source: str, schema: str, folder: str, once: bool = True) -> StreamingQuery:
    """Fold Parquet files of log records that appear in ``source`` into the ledger in ``folder``.

    Records need result_id, started_at, file_path and content_hash.  A micro-batch that is run again after a failure
    commits nothing new, as its numbers are in the ledger already; late numbers are gaps and are taken.
    ``once`` stops when all files there are read, else the query goes on.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def fold(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            latest_records(spark, folder).run(batch, "result_id")

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/stream")
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_counts(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Records per window of seen_at; records later than ``late`` behind the newest are left to the batch run."""
    return stream.withWatermark("seen_at", late).groupBy(F.window("seen_at", window)).agg(F.count(F.lit(1)).alias("n"))
