"""Measures of the graph: statistics, degrees, coupling of folders, hub files, cohesion, surprising connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import folder
from codeloom.operators.filters import IMPORT_RELATIONS

# How surprising a relation is, lower is more.
SURPRISE = {"injects": 0, "calls": 1, "imports": 2, "imports_from": 3}
EXPECTED = ("calls_api", "shares_db_entity")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every node; a self-edge counts on both sides."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(counted, "id", "left").na.fill(0, ["in_degree", "out_degree"]).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density m/(n(n-1)), isolated nodes.  Up to one node the density is 0."""
    d = degrees(nodes, edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("degree") == 0).alias("n_isolated"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    one = d.crossJoin(F.broadcast(m))  # both are one row
    n = F.col("n_nodes").cast("double")
    return one.withColumn("density", F.when(F.col("n_nodes") > 1, F.round(F.col("n_edges") / (n * (n - 1)), 9)).otherwise(0.0))


def folder_coupling(nodes: DataFrame, edges: DataFrame, least: int = 5, top: int | None = 20) -> DataFrame:
    """Folders by the number of edges that cross their border; a folder belongs to one project.

    Centrality is the degree over the number of nodes outside.  Ties go by project and folder.
    """
    place = nodes.where(F.col("source_file").isNotNull()).select("id", F.coalesce("project", F.lit("")).alias("project"), folder(F.col("source_file")).alias("folder"))
    a = place.select(F.col("id").alias("source"), F.struct("project", "folder").alias("from"))
    b = place.select(F.col("id").alias("target"), F.struct("project", "folder").alias("to"))
    crossing = edges.select("source", "target").join(a, "source").join(b, "target").where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    side = lambda key, i, o: crossing.select(F.col(key).alias("k"), (F.col("n") * i).alias("i"), (F.col("n") * o).alias("o"))
    sums = side("to", 1, 0).unionByName(side("from", 0, 1)).groupBy("k").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    children = place.groupBy(F.struct("project", "folder").alias("k")).agg(F.count(F.lit(1)).alias("child_count"))
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    rows = children.join(sums, "k").crossJoin(F.broadcast(total)).withColumn("degree", F.col("in_degree") + F.col("out_degree")).where(F.col("degree") >= least)
    out = rows.select(F.col("k.project").alias("project"), F.col("k.folder").alias("folder_path"), "child_count", "in_degree", "out_degree", "degree", F.round(F.col("degree") / F.greatest(F.lit(1), F.col("total") - F.col("child_count")), 9).alias("centrality"))
    return out if top is None else out.orderBy(F.desc("degree"), "project", "folder_path").limit(top)


def hub_files(nodes: DataFrame, edges: DataFrame, top: int | None = 20) -> DataFrame:
    """Importing files by their number of import edges, with the number of nodes in the file."""
    imports = edges.where(F.col("relation").isin(*IMPORT_RELATIONS) & F.col("source_file").isNotNull()).groupBy(F.col("source_file").alias("file_path")).agg(F.count(F.lit(1)).alias("import_count"))
    inside = nodes.where("source_file is not null").groupBy(F.col("source_file").alias("file_path")).agg(F.count(F.lit(1)).alias("node_count"))
    rows = imports.join(inside, "file_path", "left").na.fill(0, ["node_count"])
    return rows if top is None else rows.orderBy(F.desc("import_count"), "file_path").limit(top)


def imported_files(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """Imported files by the number of import edges into their nodes and of files these come from."""
    files = nodes.where("source_file is not null").select(F.col("id").alias("target"), F.col("source_file").alias("file_path"))
    counts = edges.where(F.col("relation").isin(*IMPORT_RELATIONS)).groupBy("target", "source_file").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(files, "target").groupBy("file_path").agg(F.sum("n").alias("imported_count"), F.count_distinct("source_file").alias("importing_files"))
    return rows.orderBy(F.desc("imported_count"), "file_path").limit(top)


def cohesion(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(community, internal, boundary, cohesion): internal over all edges of a group, 1 if it has none.  One pass over the edges."""
    a = groups.select(F.col("id").alias("source"), F.col("community").alias("a"))
    b = groups.select(F.col("id").alias("target"), F.col("community").alias("b"))
    sides = edges.select("source", "target").join(a, "source", "left").join(b, "target", "left").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    inner = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    rows = sides.select(F.col("a").alias("community"), inner.alias("internal"), (F.col("n") - inner).alias("boundary")).unionByName(sides.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("b").alias("community"), F.lit(0).cast("long").alias("internal"), F.col("n").alias("boundary")))
    sums = rows.where("community is not null").groupBy("community").agg(F.sum("internal").alias("internal"), F.sum("boundary").alias("boundary"))
    every = groups.select("community").distinct().join(sums, "community", "left").na.fill(0, ["internal", "boundary"])
    total = F.col("internal") + F.col("boundary")
    return every.withColumn("cohesion", F.when(total == 0, 1.0).otherwise(F.round(F.col("internal") / total, 6)))


def surprising_connections(nodes: DataFrame, edges: DataFrame, groups: DataFrame, top: int = 20) -> DataFrame:
    """Edges between communities, most surprising relation first, then by labels and ids; expected relations left out."""
    a = groups.select(F.col("id").alias("source"), F.col("community").alias("src_community")).join(nodes.select(F.col("id").alias("source"), F.col("label").alias("source_label")), "source")
    b = groups.select(F.col("id").alias("target"), F.col("community").alias("tgt_community")).join(nodes.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target")
    own = edges.where(F.col("relation").isNotNull() & ~F.col("relation").isin(*EXPECTED)).select("source", "target", "relation", "source_file")
    rows = own.join(a, "source").join(b, "target").where("src_community <> tgt_community")
    order = F.coalesce(F.create_map(*[F.lit(x) for pair in SURPRISE.items() for x in pair])[F.col("relation")], F.lit(99))
    return rows.orderBy(order, "source_label", "source", "target").limit(top).select("source", "source_label", "target", "target_label", "relation", "src_community", "tgt_community", "source_file")


def common_prefix(nodes: DataFrame) -> DataFrame:
    """(project, root): the longest path all files of a project lie below; of sorted paths the first and last decide."""
    dirs = nodes.where("source_file is not null and project <> ''").groupBy("project").agg(F.min(F.split(folder(F.col("source_file")), "/")).alias("lo"), F.max(F.split(folder(F.col("source_file")), "/")).alias("hi"))
    shared = F.expr("filter(sequence(1, least(size(lo), size(hi))), k -> slice(lo, 1, k) = slice(hi, 1, k))")
    depth = F.coalesce(F.array_max(shared), F.lit(0))
    return dirs.select("project", F.array_join(F.when(depth > 0, F.slice("lo", 1, depth)).otherwise(F.array().cast("array<string>")), "/").alias("root"))


def project_counts(nodes: DataFrame) -> DataFrame:
    """Per project and in all (project null): nodes of each kind, by one rollup."""
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("route", "class", "entity", "component")]
    return nodes.rollup("project").agg(F.count(F.lit(1)).alias("n_nodes"), *counts, F.grouping("project").cast("int").alias("is_total"))
