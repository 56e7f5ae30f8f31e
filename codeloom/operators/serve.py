"""Read queries on the graph, each a bounded answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search(nodes: DataFrame, edges: DataFrame, term: str, limit: int = 20, each: int = 5) -> DataFrame:
    """Nodes whose label contains the term, by (label, id), with up to ``each`` edges out and in.

    Rows are (id, label, type, direction, other, relation); a node without edges has one row with null direction.
    """
    if not term:
        raise ValueError("search needs a term")
    hits = nodes.where(F.lower("label").contains(term.lower())).orderBy("label", "id").limit(limit).select("id", "label", "type")
    out = edges.join(F.broadcast(hits.select(F.col("id").alias("source"))), "source").select(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other"), "relation")  # hits: at most ``limit`` rows
    into = edges.join(F.broadcast(hits.select(F.col("id").alias("target"))), "target").select(F.col("target").alias("id"), F.lit("in").alias("direction"), F.col("source").alias("other"), "relation")
    ranked = out.unionByName(into).withColumn("rank", F.row_number().over(Window.partitionBy("id", "direction").orderBy("other", "relation"))).where(F.col("rank") <= each).drop("rank")
    return hits.join(ranked, "id", "left")


def list_routes(routes: DataFrame, project: str | None = None, limit: int = 50) -> DataFrame:
    own = routes if project is None else routes.where(F.lower("project").contains(project.lower()))
    return own.orderBy("project", "method", "path", "id").limit(limit).select("project", "method", "path", "handler", "id")


def list_services(nodes: DataFrame, project: str | None = None, limit: int = 50) -> DataFrame:
    own = nodes.where(F.col("type") == "class")
    own = own if project is None else own.where(F.lower("project").contains(project.lower()))
    return own.orderBy("project", "label", "id").limit(limit).select("project", "label", "framework", "id")


def cross_project(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two named projects: (relation, source_project, target_project, n_edges)."""
    a = nodes.where("project <> ''").select(F.col("id").alias("source"), F.col("project").alias("source_project"))
    b = nodes.where("project <> ''").select(F.col("id").alias("target"), F.col("project").alias("target_project"))
    return edges.select("source", "target", "relation").join(a, "source").join(b, "target").where("source_project <> target_project").groupBy("relation", "source_project", "target_project").agg(F.count(F.lit(1)).alias("n_edges"))


def top_per_relation(links: DataFrame, most: int = 50) -> DataFrame:
    order = Window.partitionBy("relation").orderBy(F.desc("n_edges"), "source_project", "target_project")
    return links.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def primary_notes(nodes: DataFrame) -> DataFrame:
    """One note per source file: entity before class, component and route, then label and id."""
    rank = F.when(F.col("type") == "entity", 0).when(F.col("type") == "class", 1).when(F.col("type") == "component", 2).otherwise(3)
    best = nodes.where("source_file is not null").groupBy("source_file").agg(F.min(F.struct(rank.alias("r"), "label", "id")).alias("b"), F.count(F.lit(1)).alias("n_nodes"))
    return best.select("source_file", F.col("b.id").alias("id"), F.col("b.label").alias("label"), "n_nodes")


def qualify_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (source, project, name) with the project they lead to: the own one if it has the name, else the only one, else none."""
    known = nodes.where("project <> ''").select(F.col("label").alias("name"), F.col("project").alias("target_project")).distinct()
    single = known.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("target_project").alias("only"))
    home = known.select("name", F.col("target_project").alias("project"), F.lit(True).alias("home"))
    joined = links.join(home, ["name", "project"], "left").join(single, "name", "left")
    where = F.when(F.col("home"), F.col("project")).when(F.col("n") == 1, F.col("only"))
    return joined.select("source", "project", "name", where.alias("target_project"))
