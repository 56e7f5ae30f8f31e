"""The property graph of a set of source trees, built as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract import interpret
from codeloom.extract.captures import captures
from codeloom.functions.text import extract_commands, extract_urls
from codeloom.operators import build, enrich, filters
from codeloom.session import pin


@dataclass
class Graph:
    """``nodes`` (id, label, type, source_file, line, project, framework, implements, extends, detail) and ``edges``
    (source, target, relation, confidence, confidence_score, source_file); ``unresolved`` are references without a target."""

    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame


def _ordered(rows: DataFrame, kind: int) -> DataFrame:
    """First places by project, file, kind and line; later rows of one id override earlier ones, column by column."""
    return rows.withColumn("_ord", F.struct("project", F.lit(kind).alias("kind"), "source_file", "line"))


def _nodes(files: DataFrame, caught: DataFrame) -> DataFrame:
    names = F.concat_ws("::", "project", "name")
    empty = F.array().cast("array<string>")
    base = lambda df, ident, label, kind, n, detail: _ordered(df.select(ident.alias("id"), label.alias("label"), F.lit(kind).alias("type"), F.col("file_path").alias("source_file"), "line", "project", "framework", *[(F.col(c) if c in df.columns else empty).alias(c) for c in ("implements", "extends")], detail.alias("detail")), n)
    routes = interpret.routes(caught).unionByName(interpret.convention_routes(files))
    route_label = F.format_string("%s [%s %s]", "handler", "method", "path")
    out = base(routes, F.concat_ws("::", "project", "handler", F.lit("route"), "method", "path"), route_label, "route", 0, F.to_json(F.struct("method", "path", "handler", "tags")))
    services = interpret.services(caught)
    entities = interpret.entities(caught)
    components = interpret.components(caught, files)
    rest = [
        base(services, names, F.col("name"), "class", 1, F.to_json(F.struct("dependencies", "annotations"))),
        base(entities, names, F.col("name"), "entity", 2, F.to_json(F.struct("table_name", "fields", "relations"))),
        base(components, names, F.col("name"), "component", 3, F.to_json(F.struct("props", "hooks", "is_page"))),
    ]
    for one in rest:
        out = out.unionByName(one)
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("_ord"), F.col(c).alias("v"))))["v"].alias(c) for c in ("label", "type", "source_file", "line", "project", "framework", "implements", "extends", "detail")]
    return out.where("id is not null").groupBy("id").agg(*last)


def build_graph(files: DataFrame, roots: DataFrame | None = None, doc_references: bool = False) -> Graph:
    """The graph of files (file_path, project, framework, content).

    Order of work: extract, collapse, map imports, resolve references, filter artifacts, languages and services, add
    API calls, commands and shared entities, add stubs for unknown targets.  ``roots`` (project, root) makes the
    artifact test relative to projects.  Of several edges between two nodes the last kind counts: import, reference,
    injection; what is inferred never replaces what was found.
    """
    caught = pin(captures(files), "captures")
    nodes = pin(_nodes(files, caught), "nodes")
    imports = interpret.imports(caught)
    edge = lambda df, relation, order: df.select("source", "target", F.lit(relation).alias("relation"), (F.col("confidence") if "confidence" in df.columns else F.lit("EXTRACTED")).alias("confidence"), (F.col("confidence_score") if "confidence_score" in df.columns else F.lit(1.0)).alias("confidence_score"), F.col("source_file"), F.lit(order).alias("_order"))
    mapped = build.remap_imports(imports, nodes).withColumn("source_file", F.col("file_path"))
    edges = edge(mapped, "imports_from", 0)
    if doc_references:
        words = interpret.doc_references(files).withColumnRenamed("name", "import_path")
        told = build.remap_imports(words, nodes).withColumn("source_file", F.col("file_path")).withColumn("confidence", F.lit("INFERRED")).withColumn("confidence_score", F.lit(0.5))
        edges = edges.unionByName(edge(told, "references", 1))
    services = interpret.services(caught)
    refs = services.select(F.concat_ws("::", "project", "name").alias("source_node_id"), F.explode("dependencies").alias("ref_name"), F.col("file_path").alias("source_file"), "framework")
    bound = interpret.bindings(caught).select(F.concat_ws("::", "project", "name").alias("source_node_id"), "ref_name", F.col("file_path").alias("source_file"), "framework")
    handlers = interpret.routes(caught).select("file_path", "handler", F.concat_ws("::", "project", "handler", F.lit("route"), "method", "path").alias("source_node_id"))
    asked = interpret.depends(caught).join(handlers, ["file_path", "handler"]).select("source_node_id", "ref_name", F.col("file_path").alias("source_file"), "framework")
    refs = refs.unionByName(bound).unionByName(asked).distinct()
    resolved = pin(build.resolve(refs, nodes), "references")
    edges = edges.unionByName(edge(resolved.where("target is not null and target <> source_node_id").withColumn("source", F.col("source_node_id")).drop("relation"), "injects", 2))
    one = edges.groupBy("source", "target").agg(F.max(F.struct("_order", "relation", "confidence", "confidence_score", "source_file")).alias("b")).select("source", "target", "b.relation", "b.confidence", "b.confidence_score", "b.source_file")
    nodes, one = filters.drop_artifacts(nodes, one, roots)
    kept = pin(filters.drop_cross_service(filters.drop_cross_language(one, nodes), nodes), "edges")
    every = enriched(nodes, kept, files)
    stubs = build.external_stubs(every, nodes)
    return Graph(nodes.unionByName(stubs, allowMissingColumns=True), every, resolved.where("target is null").select("source_node_id", "ref_name", "framework"))


def enriched(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with API calls, commands and shared entities added."""
    text = files.select(F.col("file_path").alias("source_file"), extract_urls(F.col("content")).alias("urls"), extract_commands(F.col("content")).alias("commands"))
    callers = nodes.where("type in ('component', 'class', 'route')").select("id", "project", "source_file").join(text, "source_file")
    routes = enrich.routes_of(nodes)
    api = enrich.match_api_calls(callers.select("id", "project", F.explode("urls").alias("url")), routes).select("source", "target", F.lit("calls_api").alias("relation"), "confidence", "confidence_score")
    handlers = routes.where("method = 'INVOKE'").select("id", "project", F.col("handler").alias("label"))
    told = enrich.match_commands(callers.select("id", "project", F.explode("commands").alias("command")), handlers).select("source", "target", F.lit("invokes_command").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"))
    files_of = nodes.select(F.col("id").alias("source"), "source_file")
    fresh = api.unionByName(told).groupBy("source", "target").agg(F.min(F.struct("relation", "confidence", "confidence_score")).alias("b")).select("source", "target", "b.*").join(edges.select("source", "target"), ["source", "target"], "left_anti").join(files_of, "source", "left")
    both = edges.unionByName(fresh)
    shared = enrich.shared_entities(both, nodes)
    marked = enrich.annotate_or_insert(both, shared)
    return pin(marked.join(both.select("source", "target", "source_file"), ["source", "target"], "left"), "edges")


def graph_of_tables(spark: SparkSession, folder: str) -> Graph:
    """The graph of stored node and edge rows."""
    from codeloom.tables import table

    columns = ("id", *build.NODE_COLUMNS, "first_seen_at")
    nodes = build.collapse_nodes(table(spark, folder, "nodes").select(*columns).unionByName(table(spark, folder, "shared_nodes").select(*columns)))
    edges = build.collapse_edges(table(spark, folder, "edges"))
    refs = table(spark, folder, "unresolved_refs").where("ref_name is not null and source_node_id is not null").select("source_node_id", "ref_name", "framework").distinct()
    resolved = build.resolve(refs, nodes)
    return Graph(nodes.withColumn("detail", F.lit(None).cast("string")).unionByName(build.external_stubs(edges, nodes), allowMissingColumns=True), edges.drop("seen_at"), resolved.where("target is null").select("source_node_id", "ref_name", "framework"))
