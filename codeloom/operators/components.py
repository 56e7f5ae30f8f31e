"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import pin

MAX_ROUNDS = 60


def _fingerprint(links: DataFrame) -> tuple:
    """Number and combined hash of distinct rows: equal sets agree, others all but surely differ."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every vertex of an edge; the component is named by its smallest id.

    Alternates two steps until nothing changes: every vertex sends its larger neighbours to its smallest
    one, then every vertex its smaller neighbours.  Rounds grow with the logarithm of the longest path.  A
    vertex of very high degree is spread by its neighbours: minima are combined before the shuffle, and no
    neighbourhood is collected.  Null ends are dropped; self-edges make components of one; repeats collapse.
    """
    own = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    vertices = own.select(F.explode(F.array(a, b)).alias("id")).distinct()
    links = pin(own.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = _fingerprint(links)
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        joined = large.join(small_least, F.col("u") == F.col("_u"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        links, before = pin(small, "links"), seen
        seen = _fingerprint(links)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    labels = links.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.join(labels, F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component"))
