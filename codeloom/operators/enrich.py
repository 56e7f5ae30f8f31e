"""Edges that follow from others: API calls, commands, shared entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import last_literal, normal_path, path_pattern, segment_count


def routes_of(nodes: DataFrame) -> DataFrame:
    """(id, project, method, path, handler) of route nodes, read from labels like ``handler [VERB /path]``."""
    own = nodes.where(F.col("type") == "route")
    part = lambda k: F.regexp_extract("label", "^(.*) \\[(\\S+) ([^\\]]*(?:\\][^\\]]*)*)\\]$", k)
    return own.select("id", "project", "source_file", part(2).alias("method"), part(3).alias("path"), part(1).alias("handler")).where("path <> ''")


def route_table(routes: DataFrame) -> DataFrame:
    """One route per normalised path, the last by id; with its pattern, segment count, and place and text of its last literal segment."""
    best = routes.groupBy(normal_path(F.col("path")).alias("route_path")).agg(F.max(F.struct("id", "project")).alias("r"))
    return best.select("route_path", F.col("r.id").alias("route_id"), F.col("r.project").alias("route_project"), path_pattern(F.col("route_path")).alias("pattern"), segment_count(F.col("route_path")).alias("segments"), last_literal(F.col("route_path")).alias("l")).select("*", F.col("l.at").alias("at"), F.col("l.literal").alias("literal")).drop("l")


def match_api_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, target, confidence, confidence_score) of calls (id, project, url) to routes of other projects.

    An exact path is taken first and, if its route is the caller's own, the call matches nothing.  Other calls
    match the first route by path whose pattern covers them; candidates come from an equi-join on the number of
    segments and place and text of the pattern's last literal segment, the one that tells most, never from all pairs.
    Only a pattern of nothing but parameters is joined on the number of segments alone.
    """
    own = calls.where(F.col("url").isNotNull()).select(F.col("id").alias("source"), F.col("project").alias("src_project"), normal_path(F.col("url")).alias("path")).distinct()
    table = route_table(routes)
    joined = own.join(table.select("route_path", "route_id", "route_project"), F.col("path") == F.col("route_path"), "left")
    different = ~F.col("src_project").eqNullSafe(F.col("route_project"))
    exact = joined.where(F.col("route_id").isNotNull() & different).select("source", F.col("route_id").alias("target"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"))
    rest = joined.where("route_id is null").select("source", "src_project", "path").withColumn("segments", segment_count(F.col("path")))
    patterns = table.where(F.col("pattern").contains("[^/]+"))
    cut = rest.select("*", F.posexplode(F.split("path", "/")).alias("at", "literal")).where("literal <> ''")
    by_literal = cut.join(patterns.where("literal is not null"), ["segments", "at", "literal"])
    by_count = rest.join(patterns.where("literal is null").drop("at", "literal"), "segments").select(*[c for c in by_literal.columns if c not in ("at", "literal")])
    by_literal = by_literal.drop("at", "literal")
    hit = by_literal.unionByName(by_count).where(different & F.expr("path rlike concat('^', pattern, '$')"))
    first = hit.groupBy("source", "path").agg(F.min(F.struct("route_path", "route_id")).alias("r"))
    inferred = first.select("source", F.col("r.route_id").alias("target"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score"))
    best = exact.unionByName(inferred).groupBy("source", "target").agg(F.max(F.struct("confidence_score", "confidence")).alias("b"))
    return best.select("source", "target", F.col("b.confidence").alias("confidence"), F.col("b.confidence_score").alias("confidence_score"))


def match_commands(calls: DataFrame, commands: DataFrame) -> DataFrame:
    """(source, target) of command calls (id, project, command) to handlers (id, project, label) of other projects; the
    command is the first word of the label, and of several handlers the last by id counts."""
    table = commands.groupBy(F.substring_index("label", " ", 1).alias("command")).agg(F.max(F.struct("id", "project")).alias("h"))
    joined = calls.where("command is not null").join(table, "command").where(~F.col("project").eqNullSafe(F.col("h.project")))
    return joined.select(F.col("id").alias("source"), F.col("h.id").alias("target")).distinct()


def shared_entities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, shared_entities): representatives of two projects that touch the same entity.

    Per entity and project the smallest neighbour of type class, route or component stands for the project; pairs are
    formed between projects, whose number is the bound of a group.  Entities of one pair come as a sorted list.
    """
    types = nodes.select(F.col("id"), F.col("type"), F.col("project"))
    a = types.select(F.col("id").alias("source"), F.col("type").alias("st"), F.col("project").alias("sp"))
    b = types.select(F.col("id").alias("target"), F.col("type").alias("tt"), F.col("project").alias("tp"))
    ends = edges.select("source", "target").join(a, "source").join(b, "target")
    users = ("class", "route", "component")
    touch = ends.where((F.col("tt") == "entity") & F.col("st").isin(*users)).select(F.col("target").alias("entity"), F.col("source").alias("node"), F.col("sp").alias("project")).unionByName(ends.where((F.col("st") == "entity") & F.col("tt").isin(*users)).select(F.col("source").alias("entity"), F.col("target").alias("node"), F.col("tp").alias("project")))
    reps = touch.where("project <> ''").groupBy("entity", "project").agg(F.min("node").alias("node"))
    left = reps.select("entity", F.col("project").alias("p1"), F.col("node").alias("source"))
    right = reps.select("entity", F.col("project").alias("p2"), F.col("node").alias("target"))
    pairs = left.join(right, "entity").where("p1 < p2")
    labels = nodes.select(F.col("id").alias("entity"), F.col("label").alias("entity_label"))
    return pairs.join(labels, "entity").groupBy("source", "target").agg(F.array_sort(F.collect_set("entity_label")).alias("shared_entities"))


def annotate_or_insert(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Edges with shared entities added: an edge that is there gets the list, a pair without one becomes an edge."""
    joined = edges.join(shared, ["source", "target"], "full_outer")
    fresh = F.col("relation").isNull() & F.col("shared_entities").isNotNull()
    return joined.select("source", "target", F.when(fresh, "shares_db_entity").otherwise(F.col("relation")).alias("relation"), F.when(fresh, "INFERRED").otherwise(F.col("confidence")).alias("confidence"), F.when(fresh, 0.9).otherwise(F.col("confidence_score")).alias("confidence_score"), F.array_join("shared_entities", ",").alias("shared_entities"))
