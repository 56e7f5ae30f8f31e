"""Graphs in and out: Parquet tables, node-link JSON, text files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.graph import Graph


def save_tables(graph: Graph, folder: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    graph.unresolved.write.mode("overwrite").parquet(f"{folder}/unresolved")


def load_tables(spark: SparkSession, folder: str) -> Graph:
    return Graph(*[spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges", "unresolved")])


def save_node_link(graph: Graph, path: str) -> None:
    """One JSON file {directed, multigraph, nodes, links}, streamed to this machine partition by partition.

    For graphs that fit in a file; large ones belong in ``save_tables``.
    """
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"directed": true, "multigraph": false, "nodes": [')
        for k, row in enumerate(graph.nodes.select(F.to_json(F.struct("*"))).toLocalIterator()):
            out.write((",\n" if k else "\n") + row[0])
        out.write('\n], "links": [')
        for k, row in enumerate(graph.edges.select(F.to_json(F.struct("*"))).toLocalIterator()):
            out.write((",\n" if k else "\n") + row[0])
        out.write("\n]}\n")


def load_node_link(spark: SparkSession, path: str) -> Graph:
    whole = spark.read.option("multiLine", True).json(path)
    nodes, edges = whole.selectExpr("inline(nodes)"), whole.selectExpr("inline(links)")
    return Graph(nodes, edges, spark.createDataFrame([], "source_node_id string, ref_name string, framework string"))


def below(path: str) -> bool:
    """Whether an article path stays below its folder."""
    parts = PurePosixPath(path).parts
    return bool(parts) and not path.startswith("/") and ".." not in parts


def write_files(articles: DataFrame, folder: str) -> int:
    """Write (path, content) rows as files below a folder that all executors share; returns how many.

    Each partition writes its own files: first beside, then renamed, so that a lost task leaves no half file.
    Paths that lead out of the folder are refused.
    """
    root = folder.removeprefix("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = 0
            for path, content in zip(batch["path"], batch["content"]):
                if not below(path):
                    continue
                target = Path(root) / path
                target.parent.mkdir(parents=True, exist_ok=True)
                draft = target.with_name(f".{target.name}.{os.getpid()}")
                draft.write_text(content or "", encoding="utf-8")
                draft.replace(target)
                n += 1
            yield pd.DataFrame({"n": [n]})

    return articles.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
