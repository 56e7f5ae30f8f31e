"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("codeloom")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is absent a local folder is made and set, but only if master and executors are one machine; a
    cluster without the setting is refused.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="codeloom-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


_PINNED: list[str] = []


def drop_pins(spark: SparkSession) -> int:
    """Delete the tables that ``pin`` wrote; results not yet computed must not be needed any more.  Returns how many."""
    n, jvm = 0, spark.sparkContext._jvm
    while _PINNED:
        path = jvm.org.apache.hadoop.fs.Path(_PINNED.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def pin(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the loss of an executor costs nothing."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _PINNED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: work that is dear per row should not wait for one file.

    Large inputs have more partitions than that already and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
