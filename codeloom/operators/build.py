"""The property graph from its rows: nodes and edges collapsed, imports mapped, references resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import import_label

NODE_COLUMNS = ("label", "type", "source_file", "line", "project", "framework", "implements", "extends")
EDGE_COLUMNS = ("relation", "confidence", "confidence_score", "source_file")


def collapse_nodes(rows: DataFrame) -> DataFrame:
    """One row per id; of each column the last value that isn't null, by first_seen_at and then the greater value.

    Aggregates combine before the shuffle, so an id with very many rows is no hot spot.  Null ids are dropped.
    """
    own = rows.where(F.col("id").isNotNull())
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("first_seen_at").alias("t"), F.col(c).alias("v"))))["v"].alias(c) for c in NODE_COLUMNS]
    return own.groupBy("id").agg(*last)


def collapse_edges(rows: DataFrame) -> DataFrame:
    """One row per (source, target): that of the greatest (seen_at, edge_id).  Edges lacking an end are dropped."""
    own = rows.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    best = F.max(F.struct("seen_at", "edge_id", *EDGE_COLUMNS))
    return own.groupBy("source", "target").agg(best.alias("b")).select("source", "target", *[F.col(f"b.{c}").alias(c) for c in EDGE_COLUMNS], F.col("b.seen_at").alias("seen_at"))


def connected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source is a node."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi")


def external_stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stub nodes for targets that no node has: label the id, type external, no project."""
    missing = edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return missing.select("id", F.col("id").alias("label"), F.lit("external").alias("type"), F.lit("").alias("project"))


def pick_first(candidates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first candidate per key, by a stated order; candidates per key are those of one label."""
    ranked = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def remap_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, file_path, import_path) edges from rows (file_path, import_path).

    Every node of the importing file is a source.  The target is a node whose label is the import's name, or else
    whose lower-case label is its lower-case name; one of the same project is preferred, then the smallest id.
    Edges to the node itself are dropped, imports that name nothing too.
    """
    named = imports.where(F.col("file_path").isNotNull() & F.col("import_path").isNotNull()).select("file_path", "import_path").distinct().withColumn("name", import_label(F.col("import_path")))
    sources = nodes.where(F.col("source_file").isNotNull()).select(F.col("id").alias("source"), F.col("source_file").alias("file_path"), F.col("project").alias("own"))
    names = named.select("name").distinct()
    exact = names.join(nodes.select("id", "project", F.col("label").alias("name")), "name").withColumn("grade", F.lit(0))
    lower = names.withColumn("low", F.lower("name")).join(nodes.select("id", "project", F.lower("label").alias("low")), "low").select("name", "id", "project", F.lit(1).alias("grade"))
    both = exact.select("name", "id", "project", "grade").unionByName(lower)
    # of each name the best of each project, and the best of all: a label shared by very many nodes stays small
    per_project = both.groupBy("name", "project").agg(F.min(F.struct("grade", "id")).alias("best"))
    overall = both.groupBy("name").agg(F.min(F.struct("grade", "id")).alias("any"))
    joined = sources.join(named, "file_path").join(overall, "name").join(per_project.select("name", F.col("project").alias("own"), "best"), ["name", "own"], "left")
    # an exact name anywhere goes before a lower-case one at home
    home = F.col("best").isNotNull() & (F.col("best.grade") <= F.col("any.grade"))
    target = F.when(home, F.col("best.id")).otherwise(F.col("any.id"))
    return joined.select("source", target.alias("target"), "file_path", "import_path").where("source <> target").distinct()


def implementations(nodes: DataFrame) -> DataFrame:
    """(interface, impl): of all labels that implement or extend it one that ends in Impl or Implementation, else the smallest label."""
    rows = nodes.select("label", F.explode(F.array_union(F.coalesce("implements", F.array().cast("array<string>")), F.coalesce("extends", F.array().cast("array<string>")))).alias("interface"))
    order = F.struct((~F.col("label").rlike("(Impl|Implementation)$")).alias("late"), "label")
    return rows.where("interface is not null and label is not null").groupBy("interface").agg(F.min(order)["label"].alias("impl"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with their target: rows of ``refs`` plus (target, confidence, confidence_score, relation).

    A name that an implementation stands for leads to that (INFERRED, 0.8), any other name to the node with that
    label (EXTRACTED, 1.0).  Among several, one of the source's own project is preferred, then the smallest id.
    What leads nowhere keeps a null target.
    """
    impl = implementations(nodes)
    own = refs.withColumn("_own", F.substring_index("source_node_id", "::", 1)).join(impl.withColumnRenamed("interface", "ref_name"), "ref_name", "left").withColumn("_name", F.coalesce("impl", "ref_name"))
    per_project = nodes.groupBy(F.col("label").alias("_name"), F.col("project").alias("_own")).agg(F.min("id").alias("_home"))
    overall = nodes.groupBy(F.col("label").alias("_name")).agg(F.min("id").alias("_any"))
    found = own.join(overall, "_name", "left").join(per_project, ["_name", "_own"], "left")
    target = F.coalesce("_home", "_any")
    hop = F.col("impl").isNotNull()
    grade = lambda a, b: F.when(target.isNull(), F.lit(None)).when(hop, a).otherwise(b)
    return found.select(*refs.columns, target.alias("target"), grade("INFERRED", "EXTRACTED").alias("confidence"), grade(0.8, 1.0).alias("confidence_score"), F.when(target.isNotNull(), "injects").alias("relation"))
