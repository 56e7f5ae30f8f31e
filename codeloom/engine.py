"""The engine: scan, build, save, and answer."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import config as settings
from codeloom.graph import Graph, build_graph
from codeloom.operators import enrich, serve, traverse
from codeloom.sinks import articles, files
from codeloom.sources.scan import decoded, detect_projects, discover, read_ignore_file, scan

IGNORE_FILE = ".codeloomignore"


class Engine:
    """A graph and the questions it answers; each answer is a bounded DataFrame."""

    def __init__(self, spark: SparkSession, graph: Graph, config: settings.Config | None = None):
        self.spark, self.graph, self.config = spark, graph, config

    @classmethod
    def scan(cls, spark: SparkSession, *paths: str, doc_references: bool = False) -> Engine:
        """Projects below the paths, each scanned and all built into one graph."""
        roots = [r for p in paths for r in (discover(p) or [Path(p)])]
        return cls._of(spark, settings.Config([settings.Project(r.name, str(r.resolve())) for r in roots], doc_references=doc_references))

    @classmethod
    def from_config(cls, spark: SparkSession, path: str) -> Engine:
        return cls._of(spark, settings.load(path))

    @classmethod
    def _of(cls, spark: SparkSession, config: settings.Config) -> Engine:
        every: DataFrame | None = None
        for p in config.projects:
            root = Path(p.path)
            own = decoded(scan(spark, f"file://{root}", [*read_ignore_file(root / IGNORE_FILE), *p.ignore])).select("file_path", "content")
            signatures = [(str(f), f.read_text(encoding="utf-8", errors="replace")) for f in sorted(root.iterdir()) if f.is_file()] if root.is_dir() else []
            found = detect_projects(spark.createDataFrame(signatures, "file_path string, content string")).collect()
            framework = p.framework or (found[0]["framework"] if found else None)
            own = own.withColumn("project", F.lit(p.name)).withColumn("framework", F.lit(framework).cast("string"))
            every = own if every is None else every.unionByName(own)
        roots = spark.createDataFrame([(p.name, p.path) for p in config.projects], "project string, root string")
        return cls(spark, build_graph(every, roots, config.doc_references), config)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Engine:
        return cls(spark, files.load_tables(spark, folder))

    def save(self, folder: str) -> None:
        """Tables, report and, as configured, wiki, vault and context files."""
        files.save_tables(self.graph, f"{folder}/graph")
        Path(folder, "REPORT.md").write_text(articles.report(self.graph), encoding="utf-8")
        if self.config is None or self.config.wiki:
            files.write_files(articles.wiki(self.graph), f"{folder}/wiki")
        if self.config is not None and self.config.vault:
            files.write_files(articles.vault(self.graph), f"{folder}/vault")
        for target in self.config.context_map if self.config else []:
            path = Path(folder, target)
            path.write_text(articles.merge_block(path.read_text(encoding="utf-8") if path.is_file() else "", articles.context_block(self.graph)), encoding="utf-8")

    def search(self, term: str, limit: int = 20) -> DataFrame:
        return serve.search(self.graph.nodes, self.graph.edges, term, limit)

    def ids(self, label: str, most: int = 3) -> list[str]:
        """Ids of nodes so labelled, case ignored, exact ones first."""
        if not label:
            raise ValueError("a label is needed")
        hits = self.graph.nodes.where((F.lower("label") == label.lower()) | F.lower("label").contains(label.lower()) | (F.col("id") == label))
        return [r["id"] for r in hits.orderBy(F.lower("label") != label.lower(), "label", "id").limit(most).collect()]

    def path(self, source: str, target: str) -> DataFrame:
        """The shortest path between the first nodes of two labels that are joined by one; hops are rows less one."""
        empty = self.spark.createDataFrame([], "place int, id string")
        for a in self.ids(source):
            for b in self.ids(target):
                found = traverse.shortest_path(self.graph.edges, a, b)
                if not found.isEmpty():
                    return found
        return empty

    def blast_radius(self, label: str, depth: int = 2) -> DataFrame:
        """(id, direction, depth) of what a node reaches in some steps, and of what uses it directly."""
        start = self.spark.createDataFrame([(i,) for i in self.ids(label, 1)], "id string")
        down = traverse.downstream(self.graph.edges, start, depth).withColumn("direction", F.lit("downstream"))
        up = traverse.upstream(self.graph.edges, start).withColumn("depth", F.lit(1)).withColumn("direction", F.lit("upstream"))
        return down.select("id", "direction", "depth").unionByName(up.select("id", "direction", "depth"))

    def routes(self, project: str | None = None, limit: int = 50) -> DataFrame:
        return serve.list_routes(enrich.routes_of(self.graph.nodes), project, limit)

    def services(self, project: str | None = None, limit: int = 50) -> DataFrame:
        return serve.list_services(self.graph.nodes, project, limit)

    def communities(self) -> DataFrame:
        """(id, community): Louvain where there are edges; every other node is a community of its own."""
        found = traverse.louvain(self.graph.edges)
        return traverse.consecutive(self.graph.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community")))
