"""Queries of the graph engine over the domain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.extract import interpret
from codeloom.functions import text as fn
from codeloom.operators import analyze, build, cache, enrich, filters, serve, traverse
from codeloom.operators.components import connected_components
from codeloom.sinks import articles
from codeloom.sources import scan
from codeloom.tables import table

#: Nodes of the shared repository, in every size of the tables: one that much depends on, one that uses much, and a goal.
HUB, START, FAR = "platform-kit::ChilledPantryHistoryManager", "platform-kit::LargeBinderPlanFactory", "ext/narrow-receipt-policy-form"


def _raw_nodes(spark: SparkSession, d: str) -> DataFrame:
    columns = ("id", *build.NODE_COLUMNS, "first_seen_at")
    return table(spark, d, "nodes").select(*columns).unionByName(table(spark, d, "shared_nodes").select(*columns))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return build.collapse_nodes(_raw_nodes(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return build.collapse_edges(table(spark, d, "edges"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _nodes(spark, d), _edges(spark, d)


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select(F.col("name").alias("project"), F.col("path").alias("root"))


def _groups(nodes: DataFrame) -> DataFrame:
    """Projects as communities."""
    return nodes.where("project <> ''").select("id", F.col("project").alias("community"))


def q01_nodes(spark, d):
    return _nodes(spark, d).select("id", "label", "type", "source_file", "line", "project", "framework")


def q02_edges(spark, d):
    return _edges(spark, d).select("source", "target", "relation", "confidence", "source_file")


def q03_node_counts(spark, d):
    return _nodes(spark, d).groupBy("type", "project").agg(F.count(F.lit(1)).alias("n_nodes"))


def q04_rel_counts(spark, d):
    return _edges(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"))


def q05_graph_stats(spark, d):
    return analyze.graph_stats(*_graph(spark, d))


def q06_degrees(spark, d):
    return analyze.degrees(*_graph(spark, d))


def q07_folder_coupling_top20(spark, d):
    return analyze.folder_coupling(*_graph(spark, d))


def q08_hub_files(spark, d):
    return analyze.hub_files(*_graph(spark, d))


def q09_hub_files_imported(spark, d):
    return analyze.imported_files(*_graph(spark, d))


def q10_cross_project(spark, d):
    return serve.top_per_relation(serve.cross_project(*_graph(spark, d)))


def q11_filter_artifacts(spark, d):
    nodes, edges = filters.drop_artifacts(*_graph(spark, d), _roots(spark, d))
    a = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kept"), "n")
    return a.unionByName(edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("edges "), "relation").alias("kept"), "n"))


def q12_filter_cross_language(spark, d):
    nodes, edges = _graph(spark, d)
    return filters.drop_cross_language(edges, nodes).select("source", "target", "relation")


def q13_filter_cross_service(spark, d):
    nodes, edges = _graph(spark, d)
    return filters.drop_cross_service(edges, nodes).select("source", "target", "relation")


def q14_shared_entity(spark, d):
    nodes, edges = _graph(spark, d)
    return enrich.shared_entities(edges, nodes).select("source", "target", F.array_join("shared_entities", ",").alias("shared_entities"))


def q14b_shared_entity_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return enrich.annotate_or_insert(edges, enrich.shared_entities(edges, nodes)).groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.count("shared_entities").alias("n_annotated"))


def _refs(spark, d):
    return table(spark, d, "unresolved_refs").where("ref_name is not null and source_node_id is not null and ref_id is not null").select("ref_id", "source_node_id", "ref_name").distinct()


def q15_resolve_refs(spark, d):
    return build.resolve(_refs(spark, d), _nodes(spark, d)).where("target is not null").select("ref_id", "source_node_id", "ref_name", "target", "confidence", "confidence_score")


def q16_implementations(spark, d):
    return build.implementations(_nodes(spark, d))


def q17_unresolved(spark, d):
    return build.resolve(_refs(spark, d), _nodes(spark, d)).where("target is null").select("ref_id", "source_node_id", "ref_name")


def _imports(spark, d):
    rows = table(spark, d, "local_extract_results").where("file_path is not null").select("file_path", F.explode("unresolved").alias("import_path"))
    return rows.where("import_path is not null").distinct()


def q18_remap_imports(spark, d):
    return build.remap_imports(_imports(spark, d), _nodes(spark, d))


def q19_external_stubs(spark, d):
    nodes, edges = _graph(spark, d)
    return build.external_stubs(build.connected_edges(edges, nodes), nodes)


def _client_calls(spark, d):
    """What clients call: the path of the route an API edge leads to, parameters filled in by an odd line number."""
    nodes, edges = _graph(spark, d)
    routes = enrich.routes_of(nodes).select(F.col("id").alias("target"), "path")
    callers = nodes.select(F.col("id").alias("source"), "project", "line")
    calls = edges.where(F.col("relation") == "calls_api").select("source", "target").join(routes, "target").join(callers, "source")
    filled = F.regexp_replace("path", "<[^<>/]*>|\\{[^{}/]*\\}|\\[[^\\[\\]/]*\\]|:[A-Za-z_]\\w*", "17")
    return calls.select(F.col("source").alias("id"), "project", F.when(F.col("line") % 2 == 1, F.concat(filled, F.lit("?page=2"))).otherwise(F.col("path")).alias("url")), enrich.routes_of(nodes)


def q20_api_exact(spark, d):
    return enrich.match_api_calls(*_client_calls(spark, d)).where("confidence = 'EXTRACTED'").select("source", "target")


def q21_api_param(spark, d):
    return enrich.match_api_calls(*_client_calls(spark, d)).where("confidence = 'INFERRED'").select("source", "target")


def q22_command_match(spark, d):
    nodes = _nodes(spark, d)
    calls = table(spark, d, "unresolved_refs").where("ref_type = 'inject'").join(nodes.select(F.col("id").alias("source_node_id"), "project"), "source_node_id").select(F.col("source_node_id").alias("id"), "project", F.col("ref_name").alias("command"))
    handlers = nodes.where("type = 'component'").select("id", "project", "label")
    return enrich.match_commands(calls, handlers)


def _files(spark, d):
    """Rows as delivered, repeats included: what is found in them is made distinct, so that no text is shuffled."""
    return table(spark, d, "source_files").where("file_path is not null").select("file_path", "project", "content")


def _paths(spark, d):
    return table(spark, d, "source_files").where("file_path is not null").groupBy("file_path").agg(F.max("project").alias("project"))


def q23_url_extract(spark, d):
    return _files(spark, d).select("file_path", F.explode(fn.extract_urls(F.col("content"))).alias("url")).distinct()


def q24_url_normalize(spark, d):
    return q23_url_extract(spark, d).select(fn.normal_path(F.concat(F.col("url"), F.lit("/?x=1#top"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def q25_route_join(spark, d):
    routes = enrich.routes_of(_nodes(spark, d))
    return routes.select("id", fn.join_path(F.lit("'/v1/'"), F.col("path"), F.lit("")).alias("path"), fn.http_method(F.col("method")).alias("method"))


def q26_resource_expand(spark, d):
    names = _nodes(spark, d).where("type = 'entity'").select(F.lower("label").alias("name")).distinct()
    actions = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(p).alias("suffix"), F.lit(a).alias("action")) for m, p, a in fn.RESOURCE_ROUTES])
    rows = names.select("name", F.explode(actions).alias("r"))
    return rows.select(F.col("r.method").alias("method"), F.concat(F.lit("/"), fn.resource_path(F.col("r.suffix"), F.col("name"))).alias("path"), F.concat("name", F.lit("#"), "r.action").alias("handler"))


def q27_import_label(spark, d):
    rows = table(spark, d, "local_extract_results").select(F.explode("imports").alias("path")).where("path is not null").distinct()
    return rows.select("path", fn.import_label(F.concat("path", F.lit(".ts"))).alias("of_file"), fn.import_label(F.replace(F.col("path"), F.lit("/"), F.lit("."))).alias("of_dotted"))


def q28_language_vote(spark, d):
    return scan.dominant_language(_paths(spark, d))


def q29_hash_cache(spark, d):
    return _files(spark, d).select("file_path", F.sha2("content", 256).alias("content_hash"), F.substring(F.sha2("content", 256), 1, 12).alias("short_hash"), fn.colour(F.col("project")).alias("colour")).distinct()


def _cache(spark, d):
    return cache.recorded_hashes(table(spark, d, "local_extract_results"))


def q30_changed_files(spark, d):
    return cache.changed(q29_hash_cache(spark, d).select("file_path", "content_hash"), _cache(spark, d))


def q31_purged(spark, d):
    return cache.purged(_cache(spark, d), _paths(spark, d))


def q32_components(spark, d):
    return connected_components(_edges(spark, d), "source", "target")


def _start(spark):
    return spark.createDataFrame([(START,)], "id string")


def q33_blast_radius_2(spark, d):
    return traverse.downstream(_edges(spark, d), _start(spark), 2)


def q34_upstream(spark, d):
    return traverse.upstream(_edges(spark, d), spark.createDataFrame([(HUB,)], "id string"))


def q35_shortest_path(spark, d):
    return traverse.shortest_path(_edges(spark, d), START, FAR)


def q36_communities_lpa(spark, d):
    return traverse.label_propagation(_edges(spark, d), 2)


def q36b_communities_louvain(spark, d):
    return traverse.louvain(_edges(spark, d))


def q37_cohesion(spark, d):
    nodes, edges = _graph(spark, d)
    return analyze.cohesion(edges, _groups(nodes))


def q38_surprising_top20(spark, d):
    nodes, edges = _graph(spark, d)
    return analyze.surprising_connections(nodes, edges, _groups(nodes))


def q39_search_nodes(spark, d):
    return serve.search(*_graph(spark, d), "Ledger")


def q40_routes_list(spark, d):
    return serve.list_routes(enrich.routes_of(_nodes(spark, d)), "API")


def q41_services_list(spark, d):
    return serve.list_services(_nodes(spark, d), "jobs")


def q42_controllers(spark, d):
    return _nodes(spark, d).where(fn.is_controller(F.col("label"))).select("id", "label", fn.type_display(F.col("type"), F.col("label")).alias("display"))


def q43_enclosing_range(spark, d):
    """Each route in the last class above it in its file: a class reaches to the next one."""
    nodes = _nodes(spark, d).where("source_file is not null and line is not null")
    following = F.lead("line").over(Window.partitionBy("source_file").orderBy("line", "id"))
    scopes = nodes.where("type = 'class'").select(F.col("source_file").alias("file_path"), F.col("line").alias("start"), F.coalesce(following, F.lit((1 << 31) - 1)).alias("end"), F.create_map(F.lit("name"), "id").alias("parts"))
    inner = nodes.where("type in ('route', 'component')").select(F.col("source_file").alias("file_path"), F.col("type").alias("pattern"), F.col("id").alias("match_id"), F.col("line").alias("start"))
    return interpret.enclosing(inner, scopes, "holder").where("holder is not null").select(F.col("match_id").alias("id"), F.col("holder.parts")["name"].alias("class_id"))


def q44_adjacent_line(spark, d):
    """For each node the one before it in its file, and the lines between."""
    nodes = _nodes(spark, d).where("source_file is not null and line is not null")
    return interpret.preceding(nodes.select("source_file", "id", "line"), "source_file", "line", "id", "id").select("source_file", "id", "before_id", "gap")


def q45_common_prefix(spark, d):
    return analyze.common_prefix(_nodes(spark, d))


def q46_note_dedupe(spark, d):
    return serve.primary_notes(_nodes(spark, d)).select("source_file", "id", "label", fn.safe_name(F.col("label")).alias("note"), "n_nodes")


def q47_link_qualify(spark, d):
    nodes, edges = _graph(spark, d)
    a = nodes.select(F.col("id").alias("source"), "project")
    b = nodes.select(F.col("id").alias("target"), F.col("label").alias("name"))
    return serve.qualify_links(edges.select("source", "target").join(a, "source").join(b, "target").select("source", "project", "name").distinct(), nodes)


def q48_doc_refs(spark, d):
    """Class names that doc comments refer to, any word of two capitals at the head of a comment included."""
    return interpret.doc_references(_files(spark, d), "(?:@see |@throws |@link |:class:`|[*#] |\"\"\"|// )([A-Z][a-z]+[A-Z]\\w+)", 1)


def q49_project_rollup(spark, d):
    return analyze.project_counts(_nodes(spark, d))


def q50_type_name(spark, d):
    words = _files(spark, d).select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("\\b([A-Za-z]\\w*) \\w+ ?[=;]"), 1))).alias("word")).distinct()
    return words.where(fn.is_type_name(F.col("word")))


def q51_reverse_edges(spark, d):
    e = _edges(spark, d)
    return e.select("source", "target", "relation").unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), fn.reverse_relation(F.col("relation")).alias("relation"))).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def q52_route_segments(spark, d):
    """File-system routes: what a page's path stands for."""
    files = _paths(spark, d).where(F.col("file_path").rlike("/pages/"))
    rel = F.regexp_replace(F.regexp_extract("file_path", "/pages/(.*)$", 1), "\\.[a-z]+$", "")
    return files.select("file_path", fn.route_segments(rel).alias("route"), fn.route_segments(F.concat(F.lit("(group)/"), rel, F.lit("/[id]/[...rest]/index"))).alias("nested"))


def q53_scan_rules(spark, d):
    """What a scan would take of the files: extension allowed, no ignored or hidden folder below the project."""
    files = _paths(spark, d).join(_roots(spark, d).groupBy("project").agg(F.min("root").alias("root")), "project", "left")
    rel = F.when(F.col("file_path").startswith(F.col("root")), F.substring(F.col("file_path"), F.length("root") + 1, F.lit(1 << 30))).otherwise(F.col("file_path"))
    return files.where(scan.scannable(rel)).groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))


def q54_wave_summary(spark, d):
    """Per project: waves, those that succeeded, files and skipped files of their last rows."""
    w = table(spark, d, "wave_results").where("wave_id is not null")
    ok = F.max(F.coalesce(F.lower(F.trim("status")) == "ok", F.lit(False)).cast("int"))
    each = w.groupBy("wave_id", "project").agg(ok.alias("ok"), F.max("file_count").alias("file_count"), F.max(F.greatest(F.least("skipped_count", "file_count"), F.lit(0))).alias("skipped_count"))
    return each.groupBy("project").agg(F.count(F.lit(1)).alias("n_waves"), F.sum("ok").alias("n_ok"), F.sum("file_count").alias("file_count"), F.sum("skipped_count").alias("skipped_count"))


def q55_cache_stats(spark, d):
    return cache.statistics(table(spark, d, "local_extract_results"))


def q56_controller_routes(spark, d):
    """The routes of each controller, by the words of their handlers."""
    nodes = _nodes(spark, d).withColumn("detail", F.lit(None).cast("string"))
    return articles.controller_routes(nodes).select("id", "project", F.explode("routes").alias("route"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and n[1:3].isdigit() and callable(f)}

# ---- SQL -------------------------------------------------------------------------------------------------------
_RAW = "SELECT * FROM nodes UNION ALL SELECT * FROM shared_nodes"
_LAST = ", ".join(f"(max({{'t': first_seen_at, 'v': {c}}}) FILTER ({c} IS NOT NULL)).v AS {c}" for c in ("label", "type", "source_file", "line", "project", "framework", "implements", "extends"))
_CTE = f"""WITH RECURSIVE raw AS ({_RAW}), n AS (SELECT id, {_LAST} FROM raw WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT source, target, relation, confidence, confidence_score, source_file, seen_at FROM edges WHERE source IS NOT NULL AND target IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY seen_at DESC NULLS LAST, edge_id DESC) = 1),
f AS (SELECT DISTINCT ON (file_path) * FROM source_files WHERE file_path IS NOT NULL),
roots AS (SELECT name AS project, min(path) AS root FROM projects GROUP BY 1)"""
_FOLDER = "regexp_replace({0}, '/[^/]*$', '')"
_ENDS = "e LEFT JOIN n a ON a.id = e.source LEFT JOIN n b ON b.id = e.target"
_EXT = "lower(regexp_extract({0}, '(\\.[^./]+)$', 1))"
_JVM, _JSX = "('.java', '.kt', '.kts')", "('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs')"
_PARTS = lambda path, words: f"len(list_intersect(string_split({path}, '/'), {list(words)!r})) > 0"
_SCOPE = """, r AS (SELECT id, project, source_file, regexp_extract(label, '^(.*) \\[(\\S+) ([^\\]]*(?:\\][^\\]]*)*)\\]$', 2) AS method,
 regexp_extract(label, '^(.*) \\[(\\S+) ([^\\]]*(?:\\][^\\]]*)*)\\]$', 3) AS path, regexp_extract(label, '^(.*) \\[(\\S+) ([^\\]]*(?:\\][^\\]]*)*)\\]$', 1) AS handler FROM n WHERE type = 'route')"""
_NORMAL = "CASE WHEN regexp_replace(lower(regexp_replace({0}, '[?#].*$', '')), '/+$', '') = '' THEN '/' ELSE regexp_replace(lower(regexp_replace({0}, '[?#].*$', '')), '/+$', '') END"
_PARAM = "<[^<>/]*>|\\{[^{}/]*\\}|\\[[^\\[\\]/]*\\]|:[A-Za-z_]\\w*"
_API = f"""{_CTE}{_SCOPE}, calls AS (SELECT e.source AS id, c.project, CASE WHEN c.line % 2 = 1 THEN regexp_replace(r.path, '{_PARAM}', '17', 'g') || '?page=2' ELSE r.path END AS url
 FROM e JOIN r ON r.id = e.target JOIN n c ON c.id = e.source WHERE e.relation = 'calls_api' AND r.path <> ''),
rt AS (SELECT {_NORMAL.format('path')} AS route_path, max(id) AS route_id FROM r WHERE path <> '' GROUP BY 1),
rp AS (SELECT rt.*, n.project AS route_project, regexp_replace(regexp_replace(regexp_replace(route_path, '{_PARAM}', chr(1), 'g'), '([\\\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g'), chr(1), '[^/]+', 'g') AS pattern FROM rt JOIN n ON n.id = rt.route_id),
c AS (SELECT DISTINCT id AS source, project, {_NORMAL.format('url')} AS path FROM calls),
exact AS (SELECT c.source, c.project, c.path, rp.route_id, rp.route_project FROM c LEFT JOIN rp ON rp.route_path = c.path),
inferred AS (SELECT x.source, x.path, arg_min(rp.route_id, rp.route_path) AS target FROM exact x JOIN rp ON rp.pattern LIKE '%[^/]+%' AND rp.route_project IS DISTINCT FROM x.project AND regexp_full_match(x.path, rp.pattern) WHERE x.route_id IS NULL GROUP BY 1, 2),
hits AS (SELECT source, route_id AS target, 1.0 AS score FROM exact WHERE route_id IS NOT NULL AND route_project IS DISTINCT FROM project UNION ALL SELECT source, target, 0.8 FROM inferred)"""
_IMPL = "impl AS (SELECT interface, arg_min(label, (CASE WHEN regexp_matches(label, '(Impl|Implementation)$') THEN '0' ELSE '1' END) || label) AS impl FROM (SELECT DISTINCT label, unnest(list_concat(coalesce(implements, []), coalesce(extends, []))) AS interface FROM n) WHERE interface IS NOT NULL AND label IS NOT NULL GROUP BY 1)"
_RESOLVE = f"""{_CTE}, {_IMPL}, refs AS (SELECT DISTINCT ref_id, source_node_id, ref_name FROM unresolved_refs WHERE ref_name IS NOT NULL AND source_node_id IS NOT NULL AND ref_id IS NOT NULL),
done AS (SELECT r.*, impl.impl, (SELECT min(id) FROM n WHERE n.label = coalesce(impl.impl, r.ref_name) AND n.project = split_part(r.source_node_id, '::', 1)) AS home,
 (SELECT min(id) FROM n WHERE n.label = coalesce(impl.impl, r.ref_name)) AS anywhere FROM refs r LEFT JOIN impl ON impl.interface = r.ref_name)"""
_DEGREES = "SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM n LEFT JOIN (SELECT target, count(*) AS c FROM e GROUP BY 1) i ON i.target = n.id LEFT JOIN (SELECT source, count(*) AS c FROM e GROUP BY 1) o ON o.source = n.id"
_CROSS = "SELECT e.relation, a.project AS source_project, b.project AS target_project, count(*) AS n_edges FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE a.project <> '' AND b.project <> '' AND a.project <> b.project GROUP BY 1, 2, 3"
_TOUCH = f"""{_CTE}, t AS (SELECT e.target AS entity, e.source AS node, a.project FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE b.type = 'entity' AND a.type IN ('class', 'route', 'component')
 UNION ALL SELECT e.source, e.target, b.project FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE a.type = 'entity' AND b.type IN ('class', 'route', 'component')),
rep AS (SELECT entity, project, min(node) AS node FROM t WHERE project <> '' GROUP BY 1, 2),
sh AS (SELECT x.node AS source, y.node AS target, list_sort(list(DISTINCT n.label)) AS labels FROM rep x JOIN rep y ON x.entity = y.entity AND x.project < y.project JOIN n ON n.id = x.entity GROUP BY 1, 2)"""
# written out here, not taken from the code under test
_URL_TEXT = r"""(?:fetch|invoke|\$fetch)\s*\(\s*[`"']([^`"'$]+)[`"']
axios\.\w+\b[^`"']*[`"']([^`"'$]+)[`"']
(?:api|http|client|instance|request)\.\w+\b[^`"']*[`"']([^`"'$]+)[`"']
url\s*[:=]\s*[`"']([^`"'$]+)[`"']
["'](/api/[^"'`\s]+)["'`]
"\{\}(/api/[^"'\s]+)"""
_URLS = " || ".join(f"regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in _URL_TEXT.split("\n"))
_URLROWS = f"{_CTE}, u AS (SELECT DISTINCT file_path, url FROM (SELECT file_path, trim(regexp_replace(unnest({_URLS}), '(?s)[?#].*$', '')) AS url FROM f) WHERE regexp_matches(url, '^/[a-zA-Z]'))"
_SIMPLE = "'int', 'long', 'float', 'double', 'boolean', 'void', 'string', 'String', 'Integer', 'Long', 'Float', 'Double', 'Boolean', 'Object', 'any', 'unknown', 'never', 'undefined', 'null', 'true', 'false', 'str', 'bytes', 'list', 'dict', 'tuple', 'set', 'bool', 'type'"
_CACHE = "ca AS (SELECT file_path, arg_max(content_hash, result_id) AS h FROM local_extract_results WHERE content_hash IS NOT NULL GROUP BY 1)"
_RESOURCES = "('GET', '', 'index'), ('GET', '/new', 'new'), ('POST', '', 'create'), ('GET', '/#', 'show'), ('GET', '/#/edit', 'edit'), ('PUT', '/#', 'update'), ('DELETE', '/#', 'destroy')"
_PAIRS = "p AS (SELECT DISTINCT source AS id, target AS other FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target)"


def _round(k: int) -> str:
    return f"""v{k} AS (SELECT id, label, count(*) AS c FROM (SELECT p.id, l.label FROM p JOIN l{k - 1} l ON l.id = p.other UNION ALL SELECT id, label FROM l{k - 1}) GROUP BY 1, 2),
l{k} AS (SELECT id, min(label) AS label FROM v{k} WHERE (id, c) IN (SELECT id, max(c) FROM v{k} GROUP BY id) GROUP BY id)"""


SQL = {
    "q01_nodes": f"{_CTE} SELECT id, label, type, source_file, line, project, framework FROM n",
    "q02_edges": f"{_CTE} SELECT source, target, relation, confidence, source_file FROM e",
    "q03_node_counts": f"{_CTE} SELECT type, project, count(*) AS n_nodes FROM n GROUP BY 1, 2",
    "q04_rel_counts": f"{_CTE} SELECT relation, count(*) AS n_edges FROM e GROUP BY 1",
    "q05_graph_stats": f"{_CTE}, d AS ({_DEGREES}) SELECT count(*) AS n_nodes, count(*) FILTER (degree = 0) AS n_isolated, (SELECT count(*) FROM e) AS n_edges, round((SELECT count(*) FROM e) / (count(*)::DOUBLE * (count(*) - 1)), 9) AS density FROM d",
    "q06_degrees": f"{_CTE} {_DEGREES}",
    "q07_folder_coupling_top20": f"""{_CTE}, pl AS (SELECT id, coalesce(project, '') AS project, {_FOLDER.format('source_file')} AS folder FROM n WHERE source_file IS NOT NULL),
 ends AS MATERIALIZED (SELECT a.project AS sp, a.folder AS sf, b.project AS tp, b.folder AS tf FROM e JOIN pl a ON a.id = e.source JOIN pl b ON b.id = e.target), x AS (SELECT * FROM ends WHERE sp <> tp OR sf <> tf),
 i AS (SELECT tp AS project, tf AS folder, count(*) AS c FROM x GROUP BY 1, 2), o AS (SELECT sp AS project, sf AS folder, count(*) AS c FROM x GROUP BY 1, 2), ch AS (SELECT project, folder, count(*) AS c FROM pl GROUP BY 1, 2)
 SELECT ch.project, ch.folder AS folder_path, ch.c AS child_count, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree,
 round((coalesce(i.c, 0) + coalesce(o.c, 0)) / greatest(1, (SELECT count(*) FROM n) - ch.c), 9) AS centrality FROM ch LEFT JOIN i USING (project, folder) LEFT JOIN o USING (project, folder)
 WHERE coalesce(i.c, 0) + coalesce(o.c, 0) >= 5 ORDER BY degree DESC, project, folder_path LIMIT 20""",
    "q08_hub_files": f"{_CTE} SELECT source_file AS file_path, count(*) AS import_count, coalesce((SELECT count(*) FROM n WHERE n.source_file = e.source_file), 0) AS node_count FROM e WHERE relation IN ('imports', 'imports_from') AND source_file IS NOT NULL GROUP BY source_file ORDER BY import_count DESC, file_path LIMIT 20",
    "q09_hub_files_imported": f"{_CTE} SELECT n.source_file AS file_path, count(*) AS imported_count, count(DISTINCT e.source_file) AS importing_files FROM e JOIN n ON n.id = e.target WHERE e.relation IN ('imports', 'imports_from') AND n.source_file IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "q10_cross_project": f"{_CTE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY n_edges DESC, source_project, target_project) AS rank FROM ({_CROSS})) WHERE rank <= 50",
    "q11_filter_artifacts": f"""{_CTE}, g AS (SELECT n.id FROM n LEFT JOIN roots USING (project) WHERE {_PARTS("CASE WHEN root IS NOT NULL AND starts_with(n.source_file, root) THEN substring(n.source_file, length(root) + 1) ELSE n.source_file END", filters.ARTIFACT_FOLDERS)})
 SELECT 'nodes' AS kept, count(*) AS n FROM n WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'edges ' || relation, count(*) FROM e WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g) GROUP BY relation""",
    "q12_filter_cross_language": f"""{_CTE} SELECT e.source, e.target, e.relation FROM {_ENDS} WHERE NOT coalesce(e.relation IN ('imports', 'imports_from') AND
 (({_EXT.format('a.source_file')} IN {_JVM} AND {_EXT.format('b.source_file')} IN {_JSX}) OR ({_EXT.format('a.source_file')} IN {_JSX} AND {_EXT.format('b.source_file')} IN {_JVM})), false)""",
    "q13_filter_cross_service": f"""{_CTE} SELECT e.source, e.target, e.relation FROM {_ENDS} WHERE NOT coalesce(e.relation IN ('imports', 'imports_from') AND coalesce(a.project, '') <> '' AND coalesce(b.project, '') <> '' AND a.project <> b.project
 AND NOT coalesce({_PARTS("lower(b.source_file)", filters.SHARED_FOLDERS)}, false), false)""",
    "q14_shared_entity": f"{_TOUCH} SELECT source, target, array_to_string(labels, ',') AS shared_entities FROM sh",
    "q14b_shared_entity_edges": f"{_TOUCH} SELECT CASE WHEN e.source IS NULL THEN 'shares_db_entity' ELSE e.relation END AS relation, count(*) AS n_edges, count(sh.labels) AS n_annotated FROM e FULL JOIN sh ON sh.source = e.source AND sh.target = e.target GROUP BY 1",
    "q15_resolve_refs": f"{_RESOLVE} SELECT ref_id, source_node_id, ref_name, coalesce(home, anywhere) AS target, CASE WHEN impl IS NULL THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CASE WHEN impl IS NULL THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence_score FROM done WHERE coalesce(home, anywhere) IS NOT NULL",
    "q16_implementations": f"{_CTE}, {_IMPL} SELECT interface, impl FROM impl",
    "q17_unresolved": f"{_RESOLVE} SELECT ref_id, source_node_id, ref_name FROM done WHERE coalesce(home, anywhere) IS NULL",
    "q18_remap_imports": f"""{_CTE}, im AS (SELECT DISTINCT file_path, import_path, CASE WHEN contains(import_path, '.') AND NOT contains(import_path, '/') THEN string_split(import_path, '.')[-1] ELSE regexp_replace(string_split(import_path, '/')[-1], '\\.[A-Za-z0-9]+$', '') END AS name
 FROM (SELECT file_path, unnest(unresolved) AS import_path FROM local_extract_results) WHERE file_path IS NOT NULL AND import_path IS NOT NULL),
 k AS (SELECT name, id, project, min(grade) AS grade FROM (SELECT im.name, n.id, n.project, 0 AS grade FROM (SELECT DISTINCT name FROM im) im JOIN n ON n.label = im.name UNION ALL SELECT im.name, n.id, n.project, 1 FROM (SELECT DISTINCT name FROM im) im JOIN n ON lower(n.label) = lower(im.name)) GROUP BY 1, 2, 3)
 SELECT DISTINCT source, target, file_path, import_path FROM (SELECT s.id AS source, im.file_path, im.import_path, k.id AS target, row_number() OVER (PARTITION BY s.id, im.file_path, im.import_path ORDER BY k.grade, (k.project IS NOT DISTINCT FROM s.project) DESC, k.id) AS rn
 FROM im JOIN n s ON s.source_file = im.file_path JOIN k ON k.name = im.name) WHERE rn = 1 AND source <> target""",
    "q19_external_stubs": f"{_CTE} SELECT DISTINCT target AS id, target AS label, 'external' AS type, '' AS project FROM e WHERE source IN (SELECT id FROM n) AND target NOT IN (SELECT id FROM n)",
    "q20_api_exact": f"{_API} SELECT source, target FROM hits GROUP BY 1, 2 HAVING max(score) = 1.0",
    "q21_api_param": f"{_API} SELECT source, target FROM hits GROUP BY 1, 2 HAVING max(score) < 1.0",
    "q22_command_match": f"""{_CTE}, h AS (SELECT string_split(label, ' ')[1] AS command, max(id) AS id FROM n WHERE type = 'component' GROUP BY 1)
 SELECT DISTINCT u.source_node_id AS source, h.id AS target FROM unresolved_refs u JOIN n s ON s.id = u.source_node_id JOIN h ON h.command = u.ref_name JOIN n t ON t.id = h.id WHERE u.ref_type = 'inject' AND s.project IS DISTINCT FROM t.project""",
    "q23_url_extract": f"{_URLROWS} SELECT file_path, url FROM u",
    "q24_url_normalize": f"{_URLROWS} SELECT {_NORMAL.format('(url || ' + chr(39) + '/?x=1#top' + chr(39) + ')')} AS path, count(*) AS n FROM u GROUP BY 1",
    "q25_route_join": f"{_CTE}{_SCOPE} SELECT id, '/v1' || CASE WHEN trim(path, '/') = '' THEN '' ELSE '/' || trim(path, '/') END AS path, upper(method) AS method FROM r WHERE path <> ''",
    "q26_resource_expand": f"{_CTE} SELECT m AS method, '/' || name || replace(s, '#', ':' || regexp_replace(name, 's$', '') || '_id') AS path, name || '#' || a AS handler FROM (SELECT DISTINCT lower(label) AS name FROM n WHERE type = 'entity') CROSS JOIN (VALUES {_RESOURCES}) v(m, s, a)",
    "q27_import_label": "SELECT path, string_split(path, '/')[-1] AS of_file, string_split(path, '/')[-1] AS of_dotted FROM (SELECT DISTINCT unnest(imports) AS path FROM local_extract_results) WHERE path IS NOT NULL",
    "q28_language_vote": f"{_CTE} SELECT project, ext AS language, n, n_files FROM (SELECT project, {_EXT.format('file_path')} AS ext, count(*) AS n, sum(count(*)) OVER (PARTITION BY project)::BIGINT AS n_files FROM f GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, ext DESC) = 1",
    "q29_hash_cache": f"{_CTE} SELECT file_path, sha256(content) AS content_hash, substring(sha256(content), 1, 12) AS short_hash, ('0x' || substring(md5(project), 1, 6))::INT AS colour FROM f",
    "q30_changed_files": f"{_CTE}, {_CACHE} SELECT f.file_path, CASE WHEN h IS NULL THEN 'new' ELSE 'changed' END AS state FROM f LEFT JOIN ca ON ca.file_path = f.file_path WHERE h IS NULL OR h <> sha256(content)",
    "q31_purged": f"{_CTE}, {_CACHE} SELECT file_path FROM ca WHERE file_path NOT IN (SELECT file_path FROM f)",
    "q32_components": f"""{_CTE}, l AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE source <> target), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach AS (SELECT DISTINCT a AS id, a AS r FROM both_ways UNION SELECT reach.id, w.b FROM reach JOIN both_ways w ON w.a = reach.r) SELECT id, min(r) AS component FROM reach GROUP BY 1
 UNION ALL SELECT DISTINCT source, source FROM e WHERE source = target AND source NOT IN (SELECT a FROM both_ways)""",
    "q33_blast_radius_2": f"{_CTE}, one AS (SELECT DISTINCT target AS id FROM e WHERE source = '{START}'), two AS (SELECT DISTINCT e.target AS id FROM e JOIN one ON one.id = e.source) SELECT id, min(depth) AS depth FROM (SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two) WHERE id <> '{START}' GROUP BY 1",
    "q34_upstream": f"{_CTE} SELECT DISTINCT source AS id FROM e WHERE target = '{HUB}' AND source <> '{HUB}'",
    "q35_shortest_path": f"""{_CTE}, walk AS (SELECT '{START}' AS id, 0 AS depth UNION SELECT e.target, depth + 1 FROM walk JOIN e ON e.source = walk.id WHERE depth < 6), least_depth AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1),
 back AS (SELECT id, depth AS place FROM least_depth WHERE id = '{FAR}' UNION ALL SELECT (SELECT min(e.source) FROM e JOIN least_depth s ON s.id = e.source AND s.depth = back.place - 1 WHERE e.target = back.id), place - 1 FROM back WHERE place > 0) SELECT place, id FROM back""",
    "q36_communities_lpa": f"{_CTE}, {_PAIRS}, l0 AS (SELECT DISTINCT id, id AS label FROM p), {_round(1)}, {_round(2)} SELECT id, label AS community FROM l2",
    "q37_cohesion": f"""{_CTE}, s AS (SELECT a.project AS a, b.project AS b, count(*) AS c FROM e LEFT JOIN n a ON a.id = e.source AND a.project <> '' LEFT JOIN n b ON b.id = e.target AND b.project <> '' GROUP BY 1, 2),
 k AS (SELECT p.community, coalesce(sum(c) FILTER (a = b), 0)::BIGINT AS internal, coalesce(sum(c) FILTER (a IS DISTINCT FROM b), 0)::BIGINT AS boundary FROM (SELECT DISTINCT project AS community FROM n WHERE project <> '') p LEFT JOIN s ON s.a = p.community OR s.b = p.community GROUP BY 1)
 SELECT community, internal, boundary, CASE WHEN internal + boundary = 0 THEN 1.0 ELSE round(internal / (internal + boundary), 6) END AS cohesion FROM k""",
    "q38_surprising_top20": f"""{_CTE} SELECT e.source, a.label AS source_label, e.target, b.label AS target_label, e.relation, a.project AS src_community, b.project AS tgt_community, e.source_file FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target
 WHERE e.relation NOT IN ('calls_api', 'shares_db_entity') AND a.project <> '' AND b.project <> '' AND a.project <> b.project
 ORDER BY CASE e.relation WHEN 'injects' THEN 0 WHEN 'calls' THEN 1 WHEN 'imports' THEN 2 WHEN 'imports_from' THEN 3 ELSE 99 END, a.label, e.source, e.target LIMIT 20""",
    "q39_search_nodes": f"""{_CTE}, h AS (SELECT id, label, type FROM n WHERE contains(lower(label), 'ledger') ORDER BY label, id LIMIT 20),
 x AS (SELECT source AS id, 'out' AS direction, target AS other, relation FROM e UNION ALL SELECT target, 'in', source, relation FROM e),
 y AS (SELECT x.* FROM x JOIN h ON h.id = x.id QUALIFY row_number() OVER (PARTITION BY x.id, direction ORDER BY other, relation) <= 5) SELECT h.id, label, type, direction, other, relation FROM h LEFT JOIN y ON y.id = h.id""",
    "q40_routes_list": f"{_CTE}{_SCOPE} SELECT project, method, path, handler, id FROM r WHERE path <> '' AND contains(lower(project), 'api') ORDER BY project, method, path, id LIMIT 50",
    "q41_services_list": f"{_CTE} SELECT project, label, framework, id FROM n WHERE type = 'class' AND contains(lower(project), 'jobs') ORDER BY project, label, id LIMIT 50",
    "q42_controllers": f"{_CTE} SELECT id, label, CASE type WHEN 'route' THEN 'API Route' WHEN 'entity' THEN 'Entity' WHEN 'component' THEN 'Frontend Component' WHEN 'class' THEN CASE WHEN label LIKE '%Controller' THEN 'Controller' WHEN label LIKE '%Repository' THEN 'Repository' ELSE 'Service' END ELSE upper(type[1]) || type[2:] END AS display FROM n WHERE regexp_matches(label, '(Controller|Router|Handler|Resource)$')",
    "q43_enclosing_range": f"{_CTE} SELECT i.id, arg_max(c.id, lpad(c.line::VARCHAR, 12, '0') || c.id) AS class_id FROM n i JOIN n c ON c.source_file = i.source_file AND c.type = 'class' AND c.line <= i.line WHERE i.type IN ('route', 'component') GROUP BY 1",
    "q44_adjacent_line": f"{_CTE} SELECT * FROM (SELECT source_file, id, lag(id) OVER w AS before_id, line - lag(line) OVER w AS gap FROM n WHERE source_file IS NOT NULL AND line IS NOT NULL WINDOW w AS (PARTITION BY source_file ORDER BY line, id)) WHERE before_id IS NOT NULL",
    "q45_common_prefix": f"""{_CTE}, b AS (SELECT project, string_split(min({_FOLDER.format('source_file')}), '/') AS x FROM n WHERE source_file IS NOT NULL AND project <> '' GROUP BY 1),
 p AS (SELECT b.project, k, array_to_string(x[1:k], '/') AS root FROM b, unnest(range(1, len(x) + 1)) t(k)),
 g AS (SELECT p.project, p.root, p.k FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.project = p.project AND n.source_file IS NOT NULL AND array_to_string(string_split({_FOLDER.format('n.source_file')}, '/')[1:p.k], '/') <> p.root))
 SELECT project, arg_max(root, k) AS root FROM g GROUP BY 1""",
    "q46_note_dedupe": f"""{_CTE} SELECT source_file, id, label, regexp_replace(label, '[<>:"/\\\\|?*\\s]+', '_', 'g') AS note, c AS n_nodes FROM (SELECT *, count(*) OVER (PARTITION BY source_file) AS c, row_number() OVER (PARTITION BY source_file ORDER BY CASE type WHEN 'entity' THEN 0 WHEN 'class' THEN 1 WHEN 'component' THEN 2 ELSE 3 END, label, id) AS rn FROM n WHERE source_file IS NOT NULL) WHERE rn = 1""",
    "q47_link_qualify": f"""{_CTE}, l AS (SELECT DISTINCT e.source, a.project, b.label AS name FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target), k AS (SELECT DISTINCT label AS name, project FROM n WHERE project <> ''), o AS (SELECT name, count(*) AS c, min(project) AS only_one FROM k GROUP BY 1)
 SELECT l.source, l.project, l.name, CASE WHEN k.name IS NOT NULL THEN l.project WHEN o.c = 1 THEN o.only_one END AS target_project FROM l LEFT JOIN k ON k.name = l.name AND k.project = l.project LEFT JOIN o ON o.name = l.name""",
    "q48_doc_refs": f"{_CTE} SELECT file_path, name FROM (SELECT DISTINCT file_path, unnest(regexp_extract_all(content, '(?:@see |@throws |@link |:class:`|[*#] |\"\"\"|// )([A-Z][a-z]+[A-Z]\\w+)', 1)) AS name FROM f) WHERE length(name) >= 2 AND name NOT IN ({_SIMPLE})",
    "q49_project_rollup": f"{_CTE} SELECT project, count(*) AS n_nodes, count(*) FILTER (type = 'route') AS n_route, count(*) FILTER (type = 'class') AS n_class, count(*) FILTER (type = 'entity') AS n_entity, count(*) FILTER (type = 'component') AS n_component, grouping(project)::INT AS is_total FROM n GROUP BY ROLLUP (project)",
    "q50_type_name": f"{_CTE} SELECT word FROM (SELECT DISTINCT unnest(regexp_extract_all(content, '\\b([A-Za-z]\\w*) \\w+ ?[=;]', 1)) AS word FROM f) WHERE length(word) >= 2 AND word NOT IN ({_SIMPLE}) AND regexp_matches(word, '^[A-Z]')",
    "q51_reverse_edges": f"{_CTE} SELECT relation, count(*) AS n FROM (SELECT relation FROM e UNION ALL SELECT CASE relation WHEN 'imports' THEN 'imported_by' WHEN 'imports_from' THEN 'imported_by' WHEN 'calls' THEN 'called_by' WHEN 'injects' THEN 'injected_by' WHEN 'calls_api' THEN 'api_called_by' WHEN 'shares_db_entity' THEN 'shares_db_entity' ELSE '←' || relation END FROM e) GROUP BY 1",
    "q52_route_segments": f"""{_CTE}, s AS (SELECT file_path, regexp_replace(regexp_extract(file_path, '/pages/(.*)$', 1), '\\.[a-z]+$', '') AS rel FROM f WHERE contains(file_path, '/pages/'))
 SELECT file_path, '/' || array_to_string(list_filter(string_split(rel, '/'), lambda x: x <> '' AND x <> 'index'), '/') AS route, '/' || array_to_string(list_filter(string_split(rel || '/:id/*', '/'), lambda x: x <> '' AND x <> 'index'), '/') AS nested FROM s""",
    "q53_scan_rules": f"""{_CTE}, s AS (SELECT f.project, string_split(ltrim(CASE WHEN root IS NOT NULL AND starts_with(file_path, root) THEN substring(file_path, length(root) + 1) ELSE file_path END, '/'), '/') AS parts, regexp_extract(file_path, '(\\.[^./]+)$', 1) AS ext FROM f LEFT JOIN roots ON roots.project = f.project)
 SELECT project, count(*) AS n_files FROM s WHERE ext IN ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.py', '.go', '.vue', '.svelte', '.rb', '.java', '.kt', '.rs', '.php', '.swift', '.cs', '.ex', '.exs', '.dart', '.scala', '.clj', '.hs', '.graphql', '.gql', '.proto', '.sql') AND len(parts) - 1 <= {scan.MAX_DEPTH} AND len(list_intersect(parts[1:len(parts) - 1], string_split('node_modules .git .next .nuxt .svelte-kit __pycache__ .venv venv env .env dist build out .output coverage .turbo .vercel .codesight .ai-codex vendor .cache .parcel-cache .gradle target .idea .vscode tmp temp .DS_Store bin obj .bundle public .terraform', ' '))) = 0 AND len(list_filter(parts[1:len(parts) - 1], lambda x: starts_with(x, '.'))) = 0 GROUP BY 1""",
    "q56_controller_routes": f"""{_CTE}{_SCOPE} SELECT DISTINCT c.id, c.project, r.method || ' ' || r.path AS route FROM n c JOIN r ON r.project = c.project AND list_contains(regexp_extract_all(r.handler, '[A-Za-z_]\\w*'), c.label)
 WHERE c.type = 'class' AND regexp_matches(c.label, '(Controller|Router|Handler|Resource)$') AND r.path <> ''""",
    "q54_wave_summary": """SELECT project, count(*) AS n_waves, sum(ok)::BIGINT AS n_ok, sum(fc)::BIGINT AS file_count, sum(sc)::BIGINT AS skipped_count FROM (SELECT wave_id, project, max(CASE WHEN lower(trim(status)) = 'ok' THEN 1 ELSE 0 END) AS ok, max(file_count) AS fc,
 max(greatest(least(skipped_count, file_count), 0)) AS sc FROM wave_results WHERE wave_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "q55_cache_stats": "SELECT count(DISTINCT result_id) AS n_results, count(DISTINCT file_path) AS n_files, count(DISTINCT content_hash) AS n_hashes FROM local_extract_results",
}
