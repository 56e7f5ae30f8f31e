"""Processing only new records: a ledger of processed sequence numbers as disjoint intervals.

A run subtracts the processed intervals from the ranges that are there, reads only rows in the gaps
(late commits below the highest number included), and commits the merged intervals in the same step
as its output.  A run that dies leaves no commit, so the next one does the same work again; a run
that committed is never repeated.  The first run is no special case: it subtracts nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.intervals import merge_within
from codeloom.session import pin

#: Ranges are cut at multiples of this, so that all work on them is per block and no range list reaches one task.
BLOCK = 1 << 16
#: So many partial results are kept before a run folds them into one.
COMPACT = 16


def _cell(column: Column) -> Column:
    return F.floor(column / F.lit(BLOCK))


def sequence_ranges(df: DataFrame, seq: str) -> DataFrame:
    """The sequence numbers in ``df`` as disjoint half-open ranges (cell, lo, hi), merged within each block.

    Null numbers belong to no range; repeated ones count once.
    """
    own = df.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("lo")).distinct()
    return merge_within(own.select(_cell(F.col("lo")).alias("cell"), "lo", (F.col("lo") + 1).alias("hi")), ["cell"], "lo", "hi")


def subtract_ranges(there: DataFrame, done: DataFrame) -> DataFrame:
    """What of the ranges ``there`` isn't covered by ``done``: one sweep over both sets of bounds, per block."""
    marks = there.select("cell", "lo", "hi", F.lit(1).alias("t")).unionByName(done.select("cell", "lo", "hi", F.lit(0).alias("t")))
    bounds = marks.selectExpr("cell", "inline(array(struct(lo as at, t as a, 1 - t as d), struct(hi as at, -t as a, t - 1 as d)))").groupBy("cell", "at").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    order = Window.partitionBy("cell").orderBy("at")
    level = bounds.select("cell", F.col("at").alias("lo"), F.lead("at").over(order).alias("hi"), F.sum("a").over(order).alias("a"), F.sum("d").over(order).alias("d"))
    return merge_within(level.where("a > 0 and d = 0 and hi is not null").select("cell", "lo", "hi"), ["cell"], "lo", "hi")


RANGES = "cell long, lo long, hi long"


@dataclass
class Commit:
    number: int
    ranges: str | None
    outputs: list[str]


class Ledger:
    """Commits under one folder of the shared file system.

    ``commits/<n>.json`` names the output folders and the folder of merged ranges.  It is created under its final name
    and never over another, which decides between two runs that try the same number.  A commit whose writing broke
    off can't be read and doesn't count; its number stays taken.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        fs, at = self._fs(), self._path("commits")
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def latest(self) -> Commit:
        """The last commit that was written whole."""
        for number in reversed(self._numbers()):
            stream = self._fs().open(self._path("commits", f"{number}.json"))
            try:
                said = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
                return Commit(number, said["ranges"], said["outputs"])
            except ValueError:
                continue
            finally:
                stream.close()
        return Commit(0, None, [])

    def clear(self) -> None:
        """Forget all commits and outputs; the next run processes everything."""
        self._fs().delete(self._path(), True)

    def processed(self) -> DataFrame:
        """Processed ranges (cell, lo, hi); empty before the first commit."""
        last = self.latest()
        return self.spark.createDataFrame([], RANGES) if last.ranges is None else self.spark.read.schema(RANGES).parquet(last.ranges)

    def gaps(self, df: DataFrame, seq: str) -> DataFrame:
        """Ranges of ``df`` that aren't processed yet."""
        return subtract_ranges(sequence_ranges(df, seq), self.processed())

    def pending(self, df: DataFrame, seq: str, gaps: DataFrame) -> DataFrame:
        """Rows of ``df`` whose number is in a gap, repeats included as delivered.

        Per block one sweep over rows and gaps by number: each row is held against the last gap that began before it.
        """
        rows = df.where(F.col(seq).isNotNull()).select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), _cell(F.col(seq)).alias("_cell"), F.col(seq).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_hi"))
        starts = gaps.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("cell").alias("_cell"), F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.col("hi").alias("_hi"))
        so_far = Window.partitionBy("_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        held = rows.unionByName(starts).withColumn("_end", F.last("_hi", ignorenulls=True).over(so_far))
        return held.where((F.col("_kind") == 1) & (F.col("_at") < F.col("_end"))).select("_row.*")

    def commit(self, base: Commit, ranges: DataFrame, outputs: list[str]) -> Commit:
        """Commit ``outputs`` together with the merged ranges, on top of ``base``."""
        fs = self._fs()
        path = f"{self.folder}/ranges/{base.number + 1}-{uuid.uuid4().hex}"
        merge_within(self.processed().unionByName(ranges.select("cell", "lo", "hi")), ["cell"], "lo", "hi").write.parquet(path)
        fs.mkdirs(self._path("commits"))
        number = max([base.number, *self._numbers()]) + 1
        if self.latest().number != base.number:
            raise RuntimeError(f"another run has committed after {base.number}")
        try:
            stream = fs.create(self._path("commits", f"{number}.json"), False)
        except Exception as error:  # the file system's own exception for a name that is taken
            raise RuntimeError(f"commit {number} was made by another run") from error
        try:
            stream.write(bytearray(json.dumps({"ranges": path, "outputs": outputs}).encode()))
        finally:
            stream.close()
        return Commit(number, path, outputs)


class LatestByKey:
    """Keep, for each key, the record with the greatest order, fed from an append-only log.

    Each run folds the records of the gaps into one partial result per key; the state is the list of
    committed partial results, and ``state()`` takes the greatest of them.  Folding is idempotent and
    commutative, so late records and runs in any order give the same state.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, order: Column, value: Column):
        self.ledger, self.key, self.order, self.value = Ledger(spark, folder), key, order, value

    def _fold(self, df: DataFrame) -> DataFrame:
        """Ties in the order go to the greater value, null last."""
        best = F.max(F.struct(self.order.alias("o"), self.value.alias("v")))
        return df.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("key")).agg(best.alias("best"))

    def run(self, log: DataFrame, seq: str, enrich=lambda df: df) -> Commit | None:
        """Process what isn't processed; ``enrich`` may join the gaps' rows with what the order needs.  None if nothing is new."""
        base = self.ledger.latest()
        gaps = pin(self.ledger.gaps(log, seq), "gaps")  # read once: what commits is exactly what was processed
        if base.ranges is not None and gaps.isEmpty():
            return None
        fresh = self._fold(enrich(self.ledger.pending(log, seq, gaps)))
        path = f"{self.ledger.folder}/output/{uuid.uuid4().hex}"
        if len(base.outputs) >= COMPACT:
            self._latest(fresh.unionByName(self.ledger.spark.read.schema(fresh.schema).parquet(*base.outputs))).write.parquet(path)
            return self.ledger.commit(base, gaps, [path])
        fresh.write.parquet(path)
        return self.ledger.commit(base, gaps, [*base.outputs, path])

    def _latest(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("key").agg(F.max("best").alias("best"))

    def state(self) -> DataFrame:
        """(key, best struct<o, v>) over all commits."""
        outputs = self.ledger.latest().outputs
        if not outputs:
            raise ValueError("nothing was committed yet")
        parts = self.ledger.spark.read.parquet(*outputs)
        return parts if len(outputs) == 1 else self._latest(parts)
