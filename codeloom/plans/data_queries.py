"""Queries p1, p4 and p5: dangling references, changed records, hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import changes, hotkeys, orphans
from codeloom.tables import table


def _refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.references(table(spark, d, "edges"), table(spark, d, "unresolved_refs"))
    return refs, orphans.life_spans(table(spark, d, "nodes"), table(spark, d, "shared_nodes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*_refs(spark, d)).select("ref_table", "ref_field", "ref_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_refs(spark, d))


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Two runs: what had arrived halfway, then the rest, late records with low numbers among it."""
    log = table(spark, d, "local_extract_results")
    return changes.files_to_extract(spark, table(spark, d, "source_files"), log, table(spark, d, "wave_results"), arrivals=[changes.halfway(log)])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _changed(spark, d)


def p4_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Per project the files to extract and those skipped."""
    files = table(spark, d, "source_files").where("file_path is not null").groupBy("file_path").agg(F.min("project").alias("project"))
    todo = _changed(spark, d).withColumn("todo", F.lit(1))
    return files.join(todo, "file_path", "left").groupBy("project").agg(F.count(F.lit(1)).alias("file_count"), (F.count(F.lit(1)) - F.count("todo")).alias("skipped_count"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.hot_keys(table(spark, d, "edges"), _nodes(spark, d)).select("key_field", "key_value")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    columns = ("id", "label", "project", "source_file", "first_seen_at")
    return table(spark, d, "nodes").select(*columns).unionByName(table(spark, d, "shared_nodes").select(*columns))


def p5_target_degrees(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.target_degrees(table(spark, d, "edges"), _nodes(spark, d))


def p5_import_counts(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.import_counts(table(spark, d, "edges"))


def p5_folder_degrees(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.folder_degrees(table(spark, d, "edges"), _nodes(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p4_found, p4_skipped, p5_found, p5_target_degrees, p5_import_counts, p5_folder_degrees)}

_ALL_NODES = "(SELECT id, label, project, source_file, first_seen_at, removed_at FROM nodes UNION ALL SELECT id, label, project, source_file, first_seen_at, removed_at FROM shared_nodes)"
_REFS = """(SELECT 'edges' AS ref_table, 'target' AS ref_field, edge_id AS ref_id, target AS k, 'id' AS kind, seen_at FROM edges WHERE target IS NOT NULL
  UNION ALL SELECT 'unresolved_refs', 'source_node_id', ref_id, source_node_id, 'id', seen_at FROM unresolved_refs WHERE source_node_id IS NOT NULL
  UNION ALL SELECT 'unresolved_refs', 'ref_name', ref_id, ref_name, 'label', seen_at FROM unresolved_refs WHERE ref_name IS NOT NULL)"""
_ORPHANS = f"""SELECT DISTINCT r.ref_table, r.ref_field, r.ref_id FROM {_REFS} r WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT 'id' AS kind, id AS k, first_seen_at, removed_at FROM {_ALL_NODES} UNION ALL SELECT 'label', label, first_seen_at, removed_at FROM {_ALL_NODES}) n
  WHERE n.kind = r.kind AND n.k = r.k AND n.first_seen_at <= r.seen_at AND (n.removed_at IS NULL OR r.seen_at < n.removed_at))"""
_TODO = """SELECT DISTINCT f.file_path FROM source_files f LEFT JOIN (
  SELECT l.file_path, max_by(coalesce(l.content_hash, ''), w.started_at) AS h FROM local_extract_results l
  JOIN (SELECT wave_id, max(started_at) AS started_at FROM wave_results WHERE lower(trim(status)) = 'ok' GROUP BY 1) w ON w.wave_id = l.wave_id
  GROUP BY 1) s ON s.file_path = f.file_path WHERE s.h IS NULL OR f.content IS NULL OR s.h <> sha256(f.content)"""
_EDGES = "(SELECT edge_id, max(source) AS source, max(target) AS target, max(relation) AS relation, max(source_file) AS source_file FROM edges GROUP BY 1)"
_PLACE = f"(SELECT id, min(regexp_replace(source_file, '/[^/]*$', '')) AS folder FROM {_ALL_NODES} WHERE source_file IS NOT NULL GROUP BY 1)"
_ENDS = f"ends AS MATERIALIZED (SELECT a.folder AS to_folder, b.folder AS from_folder FROM {_EDGES} e JOIN {_PLACE} a ON a.id = e.target JOIN {_PLACE} b ON b.id = e.source)"

SQL = {
    "p1_found": _ORPHANS,
    "p1_report": f"""SELECT r.ref_table, r.ref_field, strftime(r.seen_at, '%Y-%m') AS period, count(DISTINCT r.ref_id) AS n_refs, count(DISTINCT o.ref_id) AS n_orphans,
  round(count(DISTINCT o.ref_id) / count(DISTINCT r.ref_id), 6) AS orphan_rate
  FROM {_REFS} r LEFT JOIN ({_ORPHANS}) o ON o.ref_table = r.ref_table AND o.ref_field = r.ref_field AND o.ref_id = r.ref_id GROUP BY 1, 2, 3""",
    "p4_found": _TODO,
    "p4_skipped": f"""SELECT f.project, count(*) AS file_count, count(*) - count(t.file_path) AS skipped_count
  FROM (SELECT file_path, min(project) AS project FROM source_files GROUP BY 1) f LEFT JOIN ({_TODO}) t ON t.file_path = f.file_path GROUP BY 1""",
    "p5_found": """SELECT 'edges.target' AS key_field, target AS key_value FROM edges WHERE target IS NOT NULL GROUP BY target
  HAVING count(DISTINCT edge_id) >= 0.04 * (SELECT count(DISTINCT edge_id) FROM edges)
  UNION ALL SELECT 'edges.source_file', source_file FROM edges WHERE source_file IS NOT NULL AND relation = 'imports_from' GROUP BY source_file
  HAVING count(DISTINCT edge_id) >= 0.04 * (SELECT count(DISTINCT edge_id) FROM edges WHERE relation = 'imports_from')""",
    "p5_target_degrees": f"""SELECT e.target, any_value(n.label) AS label, any_value(n.project) AS project, any_value(n.folder) AS folder, count(*) AS n_edges, count(DISTINCT e.source) AS n_sources
  FROM {_EDGES} e LEFT JOIN (SELECT id, label, project, regexp_replace(source_file, '/[^/]*$', '') AS folder FROM {_ALL_NODES}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY first_seen_at NULLS LAST, label, project NULLS FIRST, source_file NULLS FIRST) = 1) n ON n.id = e.target
  WHERE e.target IS NOT NULL GROUP BY e.target""",
    "p5_import_counts": f"SELECT source_file, count(*) AS import_count, count(DISTINCT target) AS n_targets FROM {_EDGES} WHERE relation = 'imports_from' AND source_file IS NOT NULL GROUP BY 1",
    "p5_folder_degrees": f"""WITH {_ENDS} SELECT c.folder, c.child_count, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree
  FROM (SELECT folder, count(*) AS child_count FROM {_PLACE} GROUP BY 1) c
  LEFT JOIN (SELECT to_folder, count(*) AS n FROM ends WHERE to_folder <> from_folder GROUP BY 1) i ON i.to_folder = c.folder LEFT JOIN (SELECT from_folder, count(*) AS n FROM ends WHERE to_folder <> from_folder GROUP BY 1) o ON o.from_folder = c.folder""",
}
