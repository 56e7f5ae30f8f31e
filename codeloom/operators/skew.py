"""Fragment-replicate by estimated load.

Keys are packed into tasks by their counted load.  A key above the fair share of a task is cut into
shards in proportion to its load; the other side of a join is copied to those shards and nowhere else.
Rows are sent to the very task the plan names (``place``), not to where a hash of it falls; joins and aggregates
that include ``_task`` in their keys then run inside that task without another shuffle.
What reaches the driver is bounded by the number of tasks: the heavy keys (at most ``HEAVY_PER_TASK``
a task, as each holds that part of a fair share) and the loads of ``BUCKETS_PER_TASK`` hash buckets a task.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS_PER_TASK = 8
HEAVY_PER_TASK = 4


@dataclass(frozen=True)
class LoadPlan:
    """Where the rows of each key go: heavy keys to their own shards, the rest by hash bucket."""

    tasks: int
    buckets: int
    bucket_task: tuple[int, ...]
    heavy: tuple[tuple[str, tuple[int, ...], int], ...]
    loads: tuple[int, ...]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets))

    def _tables(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("_heavy_key", T.StringType()), T.StructField("_shards", T.ArrayType(T.IntegerType()))])
        return F.broadcast(spark.createDataFrame([(k, list(s)) for k, s, _ in self.heavy], schema))  # at most HEAVY_PER_TASK rows a task

    def scatter(self, df: DataFrame, key: str, spread: Column) -> DataFrame:
        """Give each row one ``_task``: of a heavy key the shard that ``spread`` chooses."""
        own = F.array(*[F.lit(t) for t in self.bucket_task])
        if not self.heavy:
            return df.withColumn("_task", own[self._bucket(F.col(key)).cast("int")])
        picked = df.join(self._tables(df.sparkSession), F.col(key) == F.col("_heavy_key"), "left")
        shard = F.col("_shards")[F.pmod(F.xxhash64(spread), F.size("_shards")).cast("int")]
        return picked.withColumn("_task", F.coalesce(shard, own[self._bucket(F.col(key)).cast("int")])).drop("_heavy_key", "_shards")

    def place(self, df: DataFrame) -> DataFrame:
        """Send each row to the partition numbered by its ``_task``."""
        return df.repartitionById(self.tasks, F.col("_task"))

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """Give each row every ``_task`` that holds rows of its key."""
        own = F.array(*[F.lit(t) for t in self.bucket_task])
        one = F.array(own[self._bucket(F.col(key)).cast("int")])
        if not self.heavy:
            return df.withColumn("_task", one[0])
        picked = df.join(self._tables(df.sparkSession), F.col(key) == F.col("_heavy_key"), "left")
        return picked.withColumn("_task", F.explode(F.array_distinct(F.coalesce(F.col("_shards"), one)))).drop("_heavy_key", "_shards")


def plan_loads(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Count the load of each key (combined before the shuffle) and pack it into tasks, largest first."""
    spark = df.sparkSession
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = tasks * BUCKETS_PER_TASK
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = df.where(F.col(key).isNotNull()).count()
    least = max(2, total // (tasks * HEAVY_PER_TASK))
    cell = F.when(F.col("n") >= least, F.lit(None)).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)))
    loads = counts.groupBy(cell.alias("bucket"), F.when(F.col("n") >= least, F.col("key")).alias("heavy")).agg(F.sum("n").alias("n")).collect()
    fair = max(1, -(-total // tasks))
    parts: list[tuple[int, str | int, int]] = []
    for row in loads:
        if row["heavy"] is None:
            parts.append((row["n"], int(row["bucket"]), 0))
        else:
            shards = min(tasks, max(1, -(-row["n"] // fair)))
            parts += [(row["n"] // shards, row["heavy"], s) for s in range(shards)]
    heap = [(0, t) for t in range(tasks)]
    bucket_task, shards_of, held = [b % tasks for b in range(buckets)], {}, [0] * tasks
    for n, what, _ in sorted(parts, key=lambda p: (-p[0], str(p[1]), p[2])):
        load, task = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, task))
        held[task] += n
        if isinstance(what, int):
            bucket_task[what] = task
        else:
            shards_of.setdefault(what, []).append(task)
    sizes = {r["heavy"]: r["n"] for r in loads if r["heavy"] is not None}
    heavy = tuple((k, tuple(dict.fromkeys(s)), sizes[k]) for k, s in sorted(shards_of.items()))
    return LoadPlan(tasks, buckets, tuple(bucket_task), heavy, tuple(held))


def balanced_join(left: DataFrame, right: DataFrame, key: str, how: str, spread: Column, plan: LoadPlan, extra: Column | None = None, carry: Sequence[str] | None = None, keep_task: bool = False) -> DataFrame:
    """Join on ``key`` so that each task gets about the same number of left rows.

    ``how`` is inner, left, left_semi or left_anti; ``extra`` is a further condition in which the right
    columns bear their names (they must differ from the left ones); ``carry`` picks the right columns.
    A null key matches nothing.  Right rows of split keys are copied to the shards of that key only.  With ``keep_task``
    the rows keep their ``_task``, so that ``aggregate_placed`` can go on in the same tasks.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"balanced_join can't do {how}")
    mark = uuid.uuid4().hex[:8]
    names = {"key": f"_k{mark}", "task": f"_t{mark}"}
    a = plan.place(plan.scatter(left, key, spread))
    b = plan.replicate(right.select(F.col(key), *[F.col(c) for c in (carry or [c for c in right.columns if c != key])]), key)
    b = plan.place(b).withColumnRenamed(key, names["key"]).withColumnRenamed("_task", names["task"])
    condition = (F.col("_task") == F.col(names["task"])) & (F.col(key) == F.col(names["key"]))
    joined = a.join(b, condition if extra is None else condition & extra, how)
    return joined.drop(names["key"], names["task"]) if keep_task else joined.drop("_task", names["key"], names["task"])


_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "distinct": F.count_distinct}
_FINAL = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "distinct": F.sum}


def aggregate_placed(placed: DataFrame, key: str, aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per-key results of rows that lie where their ``_task`` says: inside each task first, then over the shards of split keys."""
    first = placed.groupBy(key, "_task").agg(*[_PARTIAL[kind](column).alias(name) for name, (kind, column) in aggregates.items()])
    return first.groupBy(key).agg(*[_FINAL[kind](name).alias(name) for name, (kind, _) in aggregates.items()])


def balanced_aggregate(df: DataFrame, key: str, aggregates: dict[str, tuple[str, Column]], spread: Column, plan: LoadPlan) -> DataFrame:
    """Per-key results in two steps: rows go to the tasks the plan gives their key, partial results of a split key are combined.

    ``aggregates`` maps a name to (kind, column), kind being count, sum, min, max or distinct.  For ``distinct``
    ``spread`` must be that column, so that a value meets its repeats in one shard and the counts add up.
    """
    return aggregate_placed(plan.place(plan.scatter(df, key, spread)), key, aggregates)
