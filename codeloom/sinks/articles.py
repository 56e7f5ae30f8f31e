"""Markdown from the graph: wiki articles, linked notes, the report, and blocks for context files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import colour, is_controller, markdown_link, reverse_relation, safe_name, type_display, wikilinks
from codeloom.graph import Graph
from codeloom.operators import analyze, serve
from codeloom.operators.enrich import routes_of

#: Links shown per node and relation; what is left out is counted.
SHOWN = 50
#: Members that say nothing about a class.
ACCESSOR = "^(get|set|is|has)[A-Z]|^(toString|equals|hashCode|compareTo|clone)$"
# Commands by a word in the framework's name, the first that fits.
COMMANDS = [("nest", "npm run start:dev | npm test"), ("next", "npm run dev | npm run build"), ("nuxt", "npm run dev | npm run build"), ("angular", "ng serve | ng test"), ("svelte", "npm run dev | npm run check"), ("vue", "npm run dev | npm run build"), ("react", "npm start | npm test"), ("express", "npm start | npm test"), ("koa", "npm start | npm test"), ("fastify", "npm start | npm test"), ("node", "npm start | npm test"), ("spring", "./mvnw spring-boot:run | ./mvnw test"), ("ktor", "./gradlew run | ./gradlew test"), ("fastapi", "uvicorn main:app --reload | pytest"), ("django", "python manage.py runserver | python manage.py test"), ("flask", "flask run | pytest"), ("python", "python main.py | pytest"), ("gin", "go run . | go test ./..."), ("echo", "go run . | go test ./..."), ("go", "go run . | go test ./..."), ("rails", "bin/rails server | bin/rails test"), ("laravel", "php artisan serve | php artisan test"), ("aspnet", "dotnet run | dotnet test"), ("actix", "cargo run | cargo test"), ("rust", "cargo run | cargo test"), ("tauri", "cargo tauri dev | cargo test"), ("vapor", "swift run | swift test")]


def commands_of(framework: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, text in reversed(COMMANDS):
        out = F.when(F.lower(framework).contains(word), text).otherwise(out)
    return out


def connections(graph: Graph) -> DataFrame:
    """(id, relation, other, other_label, other_project) in both directions; the reverse bears its own name."""
    e = graph.edges.select("source", "target", "relation")
    out = e.select(F.col("source").alias("id"), "relation", F.col("target").alias("other"))
    back = e.select(F.col("target").alias("id"), reverse_relation(F.col("relation")).alias("relation"), F.col("source").alias("other"))
    labels = graph.nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"), F.col("project").alias("other_project"))
    return out.unionByName(back).join(labels, "other")


def _link_lists(graph: Graph, link: Column) -> DataFrame:
    """(id, text) of the links of each node, at most SHOWN per relation, the rest as a number.

    Ranks are cut before anything is collected, so a node with very many links stays small.
    """
    own = connections(graph)
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("id", "relation").orderBy("other_label", "other"))).where(F.col("rank") <= SHOWN)
    totals = own.groupBy("id", "relation").agg(F.count(F.lit(1)).alias("total"))
    lines = ranked.groupBy("id", "relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", link.alias("line")))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("lines")).join(totals, ["id", "relation"])
    more = F.when(F.col("total") > SHOWN, F.format_string("\n- and %d more", F.col("total") - SHOWN)).otherwise("")
    part = F.concat(F.lit("## "), "relation", F.lit("\n"), "lines", more)
    return lines.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(part)), "\n\n").alias("links"))


def controller_routes(nodes: DataFrame) -> DataFrame:
    """(id, project, routes): of each controller the routes of its project whose handler is one of its methods.

    A handler names its controller as a word of it (``UserController.list``, ``UserController@list``,
    ``users#index`` is none), so handlers are cut into words and joined on project and word.
    """
    words = F.explode(F.array_distinct(F.regexp_extract_all("handler", F.lit("[A-Za-z_]\\w*"), 0)))
    handlers = routes_of(nodes).select("project", words.alias("word"), F.format_string("%s %s", "method", "path").alias("route"))
    marks = F.from_json("detail", "annotations array<string>")["annotations"]
    own = nodes.where((F.col("type") == "class") & is_controller(F.col("label"), marks)).select("id", "project", F.col("label").alias("word"))
    return own.join(handlers, ["project", "word"]).groupBy("id", "project").agg(F.array_sort(F.collect_set("route")).alias("routes"))


def _article_path(project: Column, kind: Column, label: Column) -> Column:
    return F.concat(F.when(project != "", project).otherwise(F.lit("external")), F.lit("/"), kind, F.lit("/"), safe_name(label), F.lit(".md"))


def wiki(graph: Graph) -> DataFrame:
    """(path, content): an article per node, an index per project, and the global pages.

    Nodes of one project, kind and name share an article: that of the smallest id.
    """
    n = graph.nodes.where("type <> 'external' and project <> '' and label is not null")
    link = markdown_link(F.col("other_label"), F.concat(F.lit("../../"), _article_path(F.coalesce("other_project", F.lit("")), F.lit("all"), F.col("other_label"))))
    served = controller_routes(n).select("id", F.array_join(F.transform("routes", lambda r: F.concat(F.lit("- "), r)), "\n").alias("served"))
    rows = n.join(_link_lists(graph, link), "id", "left").join(served, "id", "left")
    body = F.concat(F.lit("# "), "label", F.lit("\n\n"), type_display(F.col("type"), F.col("label"), F.from_json("detail", "annotations array<string>")["annotations"]), F.lit(" in "), "project", F.coalesce(F.format_string("\n\nSource: %s:%d", "source_file", "line"), F.lit("")), F.coalesce(F.concat(F.lit("\n\n```json\n"), "detail", F.lit("\n```")), F.lit("")), F.coalesce(F.concat(F.lit("\n\n## Routes\n"), "served"), F.lit("")), F.coalesce(F.concat(F.lit("\n\n"), "links"), F.lit("")), F.lit("\n"))
    pages = rows.groupBy(_article_path(F.col("project"), F.lit("all"), F.col("label")).alias("path")).agg(F.min(F.struct("id", body.alias("content")))["content"].alias("content"))
    counts = analyze.project_counts(n).where("is_total = 0")
    index = counts.select(F.concat("project", F.lit("/index.md")).alias("path"), F.format_string("# %s\n\n| kind | nodes |\n|---|---|\n| route | %d |\n| class | %d |\n| entity | %d |\n| component | %d |\n", "project", "n_route", "n_class", "n_entity", "n_component").alias("content"))
    listed = F.format_string("- [%s](%s/index.md): %d nodes", "project", "project", "n_nodes")
    overview = counts.agg(F.array_join(F.array_sort(F.collect_list(listed)), "\n").alias("t")).select(F.lit("overview.md").alias("path"), F.concat(F.lit("# Overview\n\n"), F.coalesce("t", F.lit("")), F.lit("\n")).alias("content"))  # one line a project
    crossing = serve.top_per_relation(serve.cross_project(graph.nodes, graph.edges), SHOWN)
    line = F.format_string("- %s → %s (%d)", "source_project", "target_project", "n_edges")
    per = crossing.groupBy("relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    cross = per.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("## "), "relation", F.lit("\n"), "t"))), "\n\n").alias("t")).select(F.lit("cross-project.md").alias("path"), F.concat(F.lit("# Connections between projects\n\n"), F.coalesce("t", F.lit("")), F.lit("\n")).alias("content"))
    routes = n.where("type = 'route'").groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    first = n.where("type = 'route'").withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy("label", "id"))).groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: F.concat(F.lit("- "), x["label"])), "\n").alias("t"))
    listing = routes.join(first, "project").select(F.concat("project", F.lit("/routes.md")).alias("path"), F.format_string("# Routes of %s (%d)\n\n%s\n", "project", "n", "t").alias("content"))
    return pages.unionByName(index).unionByName(overview).unionByName(cross).unionByName(listing)


# How names of front-end projects begin, and relations that may lead from or to one.
FRONT_ENDS = "front- dring- app- web- ui-".split()
ACROSS = ("calls_api", "api_called_by", "shares_db_entity")


def is_front_end(project: Column) -> Column:
    out = F.lit(False)
    for head in FRONT_ENDS:
        out = out | project.startswith(head)
    return F.coalesce(out, F.lit(False))


def vault(graph: Graph) -> DataFrame:
    """(path, content) of linked notes: one per source file, named after its primary node, plus a hub per project.

    Links between JVM and JavaScript files are left out, and links from or to a front-end project of other
    relations than API calls and shared entities; a link's name is qualified by its project.  Links whose target
    differs from a note in case, blanks, dashes or underscores only are repaired.  The colours of the projects come last.
    """
    primary = serve.primary_notes(graph.nodes.where("project <> ''")).join(graph.nodes.select("id", "project", "type"), "id")
    name = safe_name(F.col("label"))
    placed = primary.withColumn("rank", F.row_number().over(Window.partitionBy("project", name).orderBy("source_file"))).where("rank = 1").withColumn("note", name)
    of_node = graph.nodes.where("source_file is not null").select("id", "source_file").join(placed.select("source_file", "project", "note"), "source_file")
    a = of_node.select(F.col("id").alias("source"), F.col("source_file").alias("f1"), F.col("project").alias("p1"), F.col("note").alias("n1"))
    b = of_node.select(F.col("id").alias("target"), F.col("source_file").alias("f2"), F.col("project").alias("p2"), F.col("note").alias("n2"))
    jvm, js = "\\.(java|kt|kts)$", "\\.(tsx?|jsx?|mjs|cjs)$"
    spurious = F.col("relation").isin("imports", "imports_from") & ((F.col("f1").rlike(jvm) & F.col("f2").rlike(js)) | (F.col("f1").rlike(js) & F.col("f2").rlike(jvm)))
    foreign = (F.col("p1") != F.col("p2")) & (is_front_end(F.col("p1")) | is_front_end(F.col("p2"))) & ~F.col("relation").isin(*ACROSS)
    links = graph.edges.select("source", "target", "relation").join(a, "source").join(b, "target").where(~spurious & ~foreign).where((F.col("n1") != F.col("n2")) | (F.col("p1") != F.col("p2"))).select("p1", "n1", "relation", "p2", "n2").distinct()
    both = links.unionByName(links.select(F.col("p2").alias("p1"), F.col("n2").alias("n1"), reverse_relation(F.col("relation")).alias("relation"), F.col("p1").alias("p2"), F.col("n1").alias("n2")))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("p1", "n1").orderBy("relation", "p2", "n2")))
    lines = ranked.groupBy(F.col("p1").alias("project"), F.col("n1").alias("note")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "relation", F.lit(": [["), "p2", F.lit("/"), "n2", F.lit("]]")).alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    said = graph.nodes.where("source_file is not null").select("source_file", F.explode(F.from_json("detail", "dependencies array<string>")["dependencies"]).alias("member"))
    members = said.where(~F.col("member").rlike(ACCESSOR)).groupBy("source_file").agg(F.array_join(F.array_sort(F.collect_set("member")), ", ").alias("members"))
    placed = placed.join(members, "source_file", "left")
    body = F.concat(F.lit("---\nproject: "), "project", F.lit("\ntype: "), "type", F.lit("\ncolor: "), colour(F.col("project")).cast("string"), F.lit("\n---\n# "), "label", F.lit("\n\nSource: "), "source_file", F.coalesce(F.concat(F.lit("\n\nMembers: "), "members"), F.lit("")), F.lit("\n\n"), F.coalesce("t", F.lit("")), F.lit("\n\n[[_"), "project", F.lit("]]\n"))
    notes = placed.join(lines, ["project", "note"], "left").select(F.concat("project", F.lit("/"), "note", F.lit(".md")).alias("path"), body.alias("content"))
    hub_rank = placed.withColumn("at", F.row_number().over(Window.partitionBy("project").orderBy("note")))
    hubs = hub_rank.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "project", F.lit("/"), "note", F.lit("]]")))), "\n").alias("t")).select(F.concat("project", F.lit("/_"), "project", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "project", F.lit("\n\n"), "t", F.lit("\n")).alias("content"))
    return repaired(notes.unionByName(hubs).unionByName(loose_notes(graph, placed))).unionByName(colour_groups(graph))


def repaired(notes: DataFrame) -> DataFrame:
    """Notes whose links to no note are led to the note of the same name but for case, blanks, dashes and underscores, the first by name."""
    norm = lambda x: F.lower(F.regexp_replace(x, "[\\s_-]", ""))
    stem = F.regexp_replace("path", "\\.md$", "")
    there = notes.select(stem.alias("stem")).distinct()
    links = notes.select("path", F.explode(F.array_distinct(wikilinks(F.col("content")))).alias("link"))
    lost = links.join(there.withColumnRenamed("stem", "link"), "link", "left_anti").withColumn("norm", norm(F.col("link")))
    mended = lost.join(there.groupBy(norm(F.col("stem")).alias("norm")).agg(F.min("stem").alias("to")), "norm").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("link", "to"))).alias("m"))
    out = F.aggregate("m", F.col("content"), lambda text, x: F.replace(text, F.concat(F.lit("[["), x["link"], F.lit("]]")), F.concat(F.lit("[["), x["to"], F.lit("]]"))))
    return notes.join(mended, "path", "left").select("path", F.coalesce(out, F.col("content")).alias("content"))


def colour_groups(graph: Graph) -> DataFrame:
    """(path, content): the settings file of the note program's graph view, a colour a project."""
    names = graph.nodes.where("project <> ''").select("project").distinct()
    group = F.struct(F.concat(F.lit("path:"), "project").alias("query"), F.struct(F.lit(1).alias("a"), colour(F.col("project")).alias("rgb")).alias("color"))
    every = names.agg(F.array_sort(F.collect_list(group)).alias("colorGroups"))  # one entry a project
    return every.select(F.lit(".obsidian/graph.json").alias("path"), F.to_json(F.struct("colorGroups", F.lit(True).alias("showOrphans"), F.lit(True).alias("showArrow"))).alias("content"))


def loose_notes(graph: Graph, placed: DataFrame) -> DataFrame:
    """(path, content) of a list per project of the nodes without a note: those in no file, and those whose file's note another file took."""
    own = graph.nodes.where("project <> '' and type <> 'external'").join(placed.select("source_file"), "source_file", "left_anti")
    line = F.concat(F.lit("- "), "label", F.lit(" ("), "type", F.lit(")"), F.coalesce(F.concat(F.lit(" in "), "source_file"), F.lit("")))
    listed = own.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("t"))
    return listed.select(F.concat("project", F.lit("/_"), "project", F.lit(" others.md")).alias("path"), F.concat(F.lit("# Others of "), "project", F.lit("\n\n"), "t", F.lit("\n")).alias("content"))


def report(graph: Graph, groups: DataFrame | None = None) -> str:
    """The Markdown report: top lists, and a line per community."""
    stats = analyze.graph_stats(graph.nodes, graph.edges).first()
    out = ["# Graph report", "", f"- nodes: {stats['n_nodes']}", f"- edges: {stats['n_edges']}", f"- density: {stats['density']:.6f}", f"- isolated nodes: {stats['n_isolated']}", "", "## Folders most coupled", ""]
    out += [f"- {r['project']} {r['folder_path']}: degree {r['degree']} (in {r['in_degree']}, out {r['out_degree']}), {r['child_count']} nodes" for r in analyze.folder_coupling(graph.nodes, graph.edges, top=10).collect()]
    groups = groups if groups is not None else graph.nodes.where("project <> ''").select("id", F.col("project").alias("community"))
    out += ["", "## Surprising connections", ""] + [f"- {r['source_label']} → {r['target_label']} ({r['relation']})" for r in analyze.surprising_connections(graph.nodes, graph.edges, groups, 10).collect()]
    out += ["", "## Hub files", ""] + [f"- {r['file_path']}: {r['import_count']} imports, {r['node_count']} nodes" for r in analyze.hub_files(graph.nodes, graph.edges, 10).collect()]
    out += ["", "## Cohesion", ""] + [f"- {r['community']}: {r['cohesion']:.3f}" for r in analyze.cohesion(graph.edges, groups).orderBy("community").collect()]
    return "\n".join(out) + "\n"


def context_block(graph: Graph) -> str:
    """A summary for context files: projects, their counts and commands, and the top files."""
    n = graph.nodes.where("project <> ''")
    rows = analyze.project_counts(n).where("is_total = 0").join(n.groupBy("project").agg(F.max("framework").alias("framework"), F.count_if(is_controller(F.col("label"))).alias("n_controllers")), "project").withColumn("commands", commands_of(F.col("framework"))).orderBy("project").collect()
    out = ["## Code map", ""]
    out += [f"- {r['project']} ({r['framework'] or 'unknown'}): {r['n_route']} routes, {r['n_class']} classes, {r['n_controllers']} controllers, {r['n_entity']} entities, {r['n_component']} components" + (f"; run: {r['commands']}" if r["commands"] else "") for r in rows]
    out += ["", "Most imports:", ""] + [f"- {r['file_path']} ({r['import_count']})" for r in analyze.hub_files(graph.nodes, graph.edges, 5).collect()]
    return "\n".join(out) + "\n"


BEGIN, END = "<!-- code-map:begin -->", "<!-- code-map:end -->"


def merge_block(text: str, block: str) -> str:
    """A context file with the block put between its marks, the user's own text kept."""
    own = f"{BEGIN}\n{block.rstrip()}\n{END}"
    if BEGIN in text and END in text:
        return re.sub(re.escape(BEGIN) + r".*?" + re.escape(END), lambda _: own, text, count=1, flags=re.S)
    return (text.rstrip() + "\n\n" if text.strip() else "") + own + "\n"
