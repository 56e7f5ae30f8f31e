"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import aggregate_placed, balanced_aggregate, balanced_join, plan_loads


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per edge_id; redelivered rows agree in everything but ingested_at.  Edges without an id are dropped."""
    own = edges.where(F.col("edge_id").isNotNull())
    return own.groupBy("edge_id").agg(*[F.max(c).alias(c) for c in ("source", "target", "relation", "source_file")])


def per_key(edges: DataFrame, key: str, matching: DataFrame, carry: str, aggregates: dict) -> DataFrame:
    """Per non-null value of ``key`` the aggregates of its edges, and ``carry`` of its row in ``matching`` (one per key, may be missing).

    Fragment-replicate: edges go to the tasks of the load plan, a key above a task's share to several; its matching row is
    copied to those tasks only; join and aggregation run there, and the partial results of split keys are combined.
    Edges are sharded by edge_id, so repeats of one edge meet and distinct counts add up.
    """
    own = edges.where(F.col(key).isNotNull() & F.col("edge_id").isNotNull())
    plan = plan_loads(own, key)
    joined = balanced_join(own, matching, key, "left", F.col("edge_id"), plan, carry=[carry], keep_task=True)
    return aggregate_placed(joined, key, aggregates | {carry: ("max", F.col(carry))})


def known_nodes(nodes: DataFrame) -> DataFrame:
    """(target, node): of the rows of one id the one seen first, then the smallest label."""
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    seen = F.struct(F.col("first_seen_at").isNull(), "first_seen_at", "label", "project", folder)
    return nodes.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("target")).agg(F.min_by(F.struct("label", "project", folder.alias("folder")), seen).alias("node"))


def file_nodes(nodes: DataFrame) -> DataFrame:
    """(source_file, node_count): distinct nodes of each file."""
    return nodes.where(F.col("source_file").isNotNull() & F.col("id").isNotNull()).select("source_file", "id").distinct().groupBy("source_file").agg(F.count(F.lit(1)).alias("node_count"))


def hot_keys(edges: DataFrame, nodes: DataFrame, share: float = 0.04) -> DataFrame:
    """(key_field, key_value, label, n_edges, share) of keys that hold at least ``share`` of the distinct edges.

    ``edges.target`` is measured against all edges, ``edges.source_file`` (the importing file) against the
    distinct edges of relation imports_from.  Null keys never are hot but count in the total.  ``label`` is the label of
    the target's node, null without one, and of a file the number of its nodes.
    """
    count = {"n": ("distinct", F.col("edge_id"))}
    columns = ["edge_id", "target", "source_file"]
    targets = per_key(edges.select(*columns), "target", known_nodes(nodes), "node", count).select(F.lit("edges.target").alias("key_field"), F.col("target").alias("key_value"), F.col("node.label").alias("label"), "n")
    imports = edges.where(F.col("relation") == "imports_from").select(*columns)
    files = per_key(imports, "source_file", file_nodes(nodes), "node_count", count).select(F.lit("edges.source_file").alias("key_field"), F.col("source_file").alias("key_value"), F.col("node_count").cast("string").alias("label"), "n")
    parts = []
    for counts, own in ((targets, edges), (files, imports)):
        total = own.where(F.col("edge_id").isNotNull()).select("edge_id").distinct().agg(F.count(F.lit(1)).alias("total"))
        rated = counts.crossJoin(F.broadcast(total))  # the total is one row
        parts.append(rated.where(F.col("n") >= F.col("total") * share).select("key_field", "key_value", "label", F.col("n").alias("n_edges"), F.round(F.col("n") / F.col("total"), 6).alias("share")))
    return parts[0].unionByName(parts[1])


def target_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per target: distinct edges, distinct sources, and the label, project and folder of the node of that name.

    The node side is copied to the shards of hot targets only; rows are sharded by their source, so that
    distinct sources add up.  A target without a node keeps null label, project and folder.
    """
    own = distinct_edges(edges).where(F.col("target").isNotNull())
    plan = plan_loads(own, "target")
    joined = balanced_join(own.select("target", "source"), known_nodes(nodes), "target", "left", F.col("source"), plan, keep_task=True)
    counted = aggregate_placed(joined, "target", {"n_edges": ("count", F.lit(1)), "n_sources": ("distinct", F.col("source")), "node": ("max", F.col("node"))})
    return counted.select("target", F.col("node.label").alias("label"), F.col("node.project").alias("project"), F.col("node.folder").alias("folder"), "n_edges", "n_sources")


def import_counts(edges: DataFrame) -> DataFrame:
    """Per importing file its distinct imports_from edges and distinct targets."""
    own = distinct_edges(edges).where((F.col("relation") == "imports_from") & F.col("source_file").isNotNull())
    return balanced_aggregate(own, "source_file", {"import_count": ("count", F.col("edge_id")), "n_targets": ("distinct", F.col("target"))}, F.col("target"), plan_loads(own, "source_file"))


def folder_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per folder: distinct nodes in it, and in- and out-degree over edges that leave or enter it.

    Both ends of an edge are looked up by load-balanced joins; edges with an end that has no node or no
    source file, and edges within one folder, don't count.
    """
    own = distinct_edges(edges).where(F.col("target").isNotNull() & F.col("source").isNotNull()).select("edge_id", "source", "target")
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    place = nodes.where(F.col("source_file").isNotNull() & F.col("id").isNotNull()).groupBy(F.col("id")).agg(F.min(folder).alias("folder"))
    target = place.select(F.col("id").alias("target"), F.col("folder").alias("to_folder"))
    source = place.select(F.col("id").alias("source"), F.col("folder").alias("from_folder"))
    ends = balanced_join(own, target, "target", "inner", F.col("edge_id"), plan_loads(own, "target"))
    ends = balanced_join(ends, source, "source", "inner", F.col("edge_id"), plan_loads(own, "source")).where("to_folder <> from_folder")
    sides = ends.groupBy("to_folder", "from_folder").agg(F.count(F.lit(1)).alias("n"))
    incoming = sides.select(F.col("to_folder").alias("folder"), F.col("n").alias("in_degree"), F.lit(0).alias("out_degree"))
    outgoing = sides.select(F.col("from_folder").alias("folder"), F.lit(0).alias("in_degree"), F.col("n").alias("out_degree"))
    degrees = incoming.unionByName(outgoing).groupBy("folder").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    children = place.groupBy("folder").agg(F.count(F.lit(1)).alias("child_count"))
    joined = children.join(degrees, "folder", "left").na.fill(0, ["in_degree", "out_degree"])
    return joined.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
