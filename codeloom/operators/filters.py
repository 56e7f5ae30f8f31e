"""Filters that take spurious nodes and edges out of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import extension

# Folders of build output, file extensions of two language families, markers of shared code.
ARTIFACT_FOLDERS = "target build dist node_modules .next .nuxt out output __pycache__ .gradle vendor bin obj .dart_tool .build .cache".split()
JVM_EXTENSIONS = ".java .kt .kts".split()
JS_EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs".split()
SHARED_FOLDERS = "shared common lib libs core utils util commons base".split()
IMPORT_RELATIONS = ("imports", "imports_from")
KEPT_RELATIONS = ("calls_api", "shares_db_entity")


def _has_part(path: Column, parts: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts])), F.lit(False))


def is_artifact(path: Column, root: Column | None = None) -> Column:
    """Whether a part of the path, below the project's root where one is given, names a folder of build output."""
    own = path if root is None else F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.lit(1 << 30))).otherwise(path)
    return _has_part(own, ARTIFACT_FOLDERS)


def drop_artifacts(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes outside folders of build output, and edges that touch none of those dropped.

    ``roots`` (project, root) makes the test relative to the project; a node without a file is kept.
    """
    if roots is None:
        marked = nodes.withColumn("_gone", is_artifact(F.col("source_file")))
    else:
        one = roots.groupBy("project").agg(F.min("root").alias("_root"))
        marked = nodes.join(one, "project", "left").withColumn("_gone", F.when(F.col("_root").isNull(), is_artifact(F.col("source_file"))).otherwise(is_artifact(F.col("source_file"), F.col("_root")))).drop("_root")
    gone = marked.where("_gone").select(F.col("id"))
    kept = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    return marked.where("not _gone").drop("_gone"), kept.select(*edges.columns)


def _with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("id").alias("source"), F.col("source_file").alias("_sf"), F.col("project").alias("_sp"))
    b = nodes.select(F.col("id").alias("target"), F.col("source_file").alias("_tf"), F.col("project").alias("_tp"))
    return edges.join(a, "source", "left").join(b, "target", "left")


def drop_cross_language(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without imports between JVM and JavaScript files; edges with an unknown end or file stay."""
    ends = _with_ends(edges, nodes)
    a, b = extension(F.col("_sf")), extension(F.col("_tf"))
    crossing = (a.isin(JVM_EXTENSIONS) & b.isin(JS_EXTENSIONS)) | (a.isin(JS_EXTENSIONS) & b.isin(JVM_EXTENSIONS))
    spurious = F.col("relation").isin(*IMPORT_RELATIONS) & F.coalesce(crossing, F.lit(False))
    return ends.where(~F.coalesce(spurious, F.lit(False))).select(*edges.columns)


def drop_cross_service(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without imports from one project into another, unless the target lies in a shared folder; unknown projects stay."""
    ends = _with_ends(edges, nodes)
    other = (F.coalesce("_sp", F.lit("")) != "") & (F.coalesce("_tp", F.lit("")) != "") & (F.col("_sp") != F.col("_tp"))
    shared = _has_part(F.lower("_tf"), SHARED_FOLDERS)
    spurious = F.col("relation").isin(*IMPORT_RELATIONS) & other & ~shared
    return ends.where(~F.coalesce(spurious, F.lit(False))).select(*edges.columns)
