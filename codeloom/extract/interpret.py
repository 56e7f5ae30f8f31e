"""What pattern matches mean: routes, services, entities, components, imports, doc references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import RESOURCE_ROUTES, http_method, is_type_name, join_path, resource_path, route_segments, strip_quotes

AT = ("file_path", "project", "framework")


def _of(captures: DataFrame, *patterns: str) -> DataFrame:
    return captures.where(F.col("pattern").isin(*patterns))


def _part(*names: str) -> Column:
    return F.coalesce(*[F.col("parts")[n] for n in names])


def enclosing(inner: DataFrame, scopes: DataFrame, name: str) -> DataFrame:
    """Rows of ``inner`` with the innermost scope of their file that holds their start: an equi-join on the file, then the range."""
    outer = scopes.select("file_path", F.col("start").alias("_s"), F.col("end").alias("_e"), F.struct("start", "end", "parts").alias("_scope"))
    keyed = inner.withColumn("_key", F.struct("pattern", "match_id"))
    held = keyed.select("file_path", "_key", "start").join(outer, "file_path").where("_s <= start and start < _e").groupBy("file_path", "_key").agg(F.max_by("_scope", F.struct("_s", -F.col("_e"))).alias(name))
    return keyed.join(held, ["file_path", "_key"], "left").drop("_key")


def preceding(rows: DataFrame, key: str, at: str, name: str, tie: str) -> DataFrame:
    """Rows that have another one before them in their group, with its ``name`` and how far ahead it stands."""
    order = Window.partitionBy(key).orderBy(at, tie)
    placed = rows.withColumn("before_" + name, F.lag(name).over(order)).withColumn("gap", F.col(at) - F.lag(at).over(order))
    return placed.where(F.col("before_" + name).isNotNull())


def classes(captures: DataFrame) -> DataFrame:
    return _of(captures, "class")


def _class_prefix() -> Column:
    """The path that a class's own annotation or decorator gives."""
    text = F.col("holder.parts")["annotations"]
    return F.regexp_extract(F.coalesce(text, F.lit("")), "@(?:RequestMapping|Controller)\\(\\s*(?:(?:value|path)\\s*=\\s*)?\\{?\\s*[\"'`]([^\"'`]*)|\\[Route\\(\\s*\"([^\"]*)", 1)


def routes(captures: DataFrame) -> DataFrame:
    """(file_path, project, framework, method, path, handler, line, tags) of all routes in code."""
    own = enclosing(_of(captures, "route", "wired", "minimal"), classes(captures), "holder")
    # what a spring class's own mapping annotation matches isn't a route
    own = own.where(~((F.col("framework") == "spring-boot") & F.col("holder").isNotNull() & (F.col("start") < F.col("holder.start") + F.length(F.coalesce(F.col("holder.parts")["annotations"], F.lit(""))))))
    args = F.coalesce(F.col("parts")["args"], F.lit(""))
    written = F.coalesce(strip_quotes(F.trim(_part("path"))), F.when(args != "", F.regexp_extract(args, "[\"']([^\"']*)[\"']", 1)), F.lit(""))
    several = F.when(F.col("framework") == "vapor", F.array_join(F.regexp_extract_all(F.coalesce(_part("path"), F.lit("")), F.lit("\"([^\"]*)\""), 1), "/")).otherwise(written)
    verb = F.when(_part("method") == "Request", F.regexp_extract(args, "RequestMethod\\.(\\w+)", 1)).otherwise(_part("method"))
    holder = F.col("holder.parts")["name"]
    handler = F.coalesce(F.when(F.col("parts")["controller"].isNotNull(), F.concat_ws("@", F.col("parts")["controller"], strip_quotes(F.col("parts")["action"]))), strip_quotes(_part("handler")), F.when(_part("inner") != "", _part("inner")), F.when(_part("literal").isNotNull(), F.lit("<anonymous>")), F.lit("<anonymous>"))
    named = F.when(F.col("framework").isin("spring-boot", "nestjs", "aspnet", "angular") & holder.isNotNull() & (F.col("pattern") == "route"), F.concat_ws(".", holder, handler)).otherwise(handler)
    aspnet = F.regexp_extract(F.coalesce(F.col("holder.parts")["annotations"], F.lit("")), "\\[Route\\(\\s*\"([^\"]*)", 1)
    token = F.lower(F.regexp_replace(holder, "Controller$", ""))
    prefix = F.when(F.col("framework") == "aspnet", F.replace(aspnet, F.lit("[controller]"), F.coalesce(token, F.lit("")))).when(F.col("framework").isin("spring-boot", "nestjs"), _class_prefix()).otherwise("")
    base = own.select(*AT, "pattern", "match_id", "start", F.col("parts"), F.coalesce(_part("var"), F.lit("")).alias("var"), verb.alias("verb"), several.alias("path"), named.alias("handler"), prefix.alias("class_prefix"), "line")
    base = base.where(~((F.col("framework") == "express") & (F.col("path") != "") & ~F.col("path").rlike("^[/*(]")))  # map.get('x') and the like
    # prefixes by variable: routers, blueprints, groups of one level
    group_path = F.when(F.col("framework") == "vapor", F.array_join(F.regexp_extract_all(_part("path", "path2"), F.lit("\"([^\"]*)\""), 1), "/")).otherwise(strip_quotes(_part("path")))
    order = F.when(F.col("pattern") == "register", 2).otherwise(1)
    given = _of(captures, "prefix", "register", "group").where(_part("path", "path2").isNotNull()).groupBy("file_path", _part("var", "var2").alias("var")).agg(F.max_by(group_path, F.struct(order, "start")).alias("var_prefix"))
    joined = base.join(given, ["file_path", "var"], "left")
    scoped = enclosing(joined, _of(captures, "scope"), "scope")
    outer = _of(captures, "scope").select("file_path", F.col("start").alias("_s"), F.col("end").alias("_e"), strip_quotes(F.trim(F.coalesce(F.col("parts")["path"], F.col("parts")["name"]))).alias("_p"))
    chain = scoped.select("file_path", "pattern", "match_id", "start").join(outer, "file_path").where("_s < start and start < _e").groupBy("file_path", "pattern", "match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_p"))), lambda x: x["_p"]), "/").alias("scope_prefix"))
    all_ = scoped.join(chain, ["file_path", "pattern", "match_id"], "left")
    full = join_path(F.col("class_prefix"), F.col("var_prefix"), F.col("scope_prefix"), F.col("path"))
    verbs = F.when((F.col("framework") == "flask") & (F.col("verb") == "route"), F.coalesce(F.filter(F.transform(F.split(F.col("parts")["methods"], ","), lambda m: F.trim(F.regexp_replace(m, "['\"\\s]", ""))), lambda m: m != ""), F.array(F.lit("GET")))).when(F.col("framework").isin("django", "angular", "vue"), F.array(F.lit("ANY"))).otherwise(F.array(F.col("verb")))
    plain = all_.where(F.col("parts")["call"].isNull() | ~F.col("handler").isin("include")).select(*AT, F.explode(verbs).alias("m"), full.alias("path"), "handler", "line").select(*AT, http_method(F.col("m")).alias("method"), "path", "handler", "line", F.array().cast("array<string>").alias("tags"))
    # resources of seven routes, roots, commands
    res = _of(captures, "resources").select(*AT, "line", F.regexp_replace(strip_quotes(F.trim(_part("name", "path"))), "^:+", "").alias("name"), F.col("parts")["kind"].alias("kind"))
    seven = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(p).alias("suffix"), F.lit(a).alias("action")) for m, p, a in RESOURCE_ROUTES])
    expanded = res.select(*AT, "line", "name", F.explode(F.when(F.col("kind") == "apiResource", F.filter(seven, lambda r: ~r["action"].isin("new", "edit"))).otherwise(seven)).alias("r")).select(*AT, F.col("r.method").alias("method"), join_path(resource_path(F.col("r.suffix"), F.col("name"))).alias("path"), F.concat("name", F.lit("#"), "r.action").alias("handler"), "line", F.array().cast("array<string>").alias("tags"))
    roots = _of(captures, "root").select(*AT, F.lit("GET").alias("method"), F.lit("/").alias("path"), _part("handler").alias("handler"), "line", F.array().cast("array<string>").alias("tags"))
    commands = _of(captures, "command").select(*AT, F.lit("INVOKE").alias("method"), F.concat(F.lit("/tauri/"), _part("handler")).alias("path"), _part("handler").alias("handler"), "line", F.array().cast("array<string>").alias("tags"))
    return plain.unionByName(expanded).unionByName(roots).unionByName(commands)


def convention_routes(files: DataFrame) -> DataFrame:
    """Routes that follow from file paths: pages and app folders, routes folders; tagged file-system-route."""
    path = F.col("file_path")
    app = F.regexp_extract(path, "/app/(.*?)/?(page|route)\\.(?:tsx?|jsx?)$", 1)
    page = F.regexp_extract(path, "/pages/(.*)\\.(?:tsx?|jsx?|vue)$", 1)
    kit = F.regexp_extract(path, "/routes/(.*?)/?\\+(?:page|server)\\.(?:svelte|ts|js)$", 1)
    nextjs, nuxt, svelte = F.col("framework").isin("nextjs", "react"), F.col("framework").isin("nuxt", "vue"), F.col("framework").isin("sveltekit", "svelte")
    rel = F.when(nextjs & path.rlike("/app/(.*/)?(page|route)\\.(tsx?|jsx?)$"), app).when((nextjs | nuxt) & path.rlike("/pages/.+\\.(tsx?|jsx?|vue)$") & ~path.rlike("/pages/_"), page).when(svelte & path.rlike("/routes/(.*/)?\\+(page|server)\\.(svelte|ts|js)$"), kit)
    method = F.when(path.rlike("/(pages/)?api/|/route\\.|\\+server"), "ANY").otherwise("GET")
    return files.select(*AT, rel.alias("rel"), method.alias("method")).where("rel is not null").select(*AT, "method", route_segments(F.col("rel")).alias("path"), F.regexp_extract("file_path", "([^/]+)\\.[^.]+$", 1).alias("handler"), F.lit(1).alias("line"), F.array(F.lit("file-system-route")).alias("tags"))


def _types(params: Column) -> Column:
    """Names of the capitalised types of a parameter list."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(params, F.lit("")), F.lit("\\b([A-Z]\\w*)\\b"), 1))


def _words(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda w: F.trim(F.regexp_replace(w, "<.*", ""))), lambda w: w != "")


def services(captures: DataFrame) -> DataFrame:
    """(file_path, project, framework, name, line, dependencies, annotations, implements, extends) of classes.

    Dependencies come from injected fields and constructor parameters inside the class.
    """
    scopes = classes(captures)
    fields = _of(captures, "field").where(F.coalesce(F.col("parts")["annotations"], F.lit("")).rlike("@(Autowired|Inject|Resource)") | (F.col("parts")["type"].rlike("(Service|Repository|Client|Dao|Store|Gateway)$"))).withColumn("deps", F.array(F.regexp_replace(F.col("parts")["type"], "<.*", "")))
    members = _of(captures, "member").where(F.col("framework").isin("gin", "actix", "tauri")).withColumn("deps", _types(F.col("parts")["type"]))
    built = _of(captures, "constructor").withColumn("deps", _types(F.col("parts")["params"]))
    held = enclosing(fields.unionByName(members).unionByName(built), scopes, "holder").where("holder is not null")
    deps = held.groupBy("file_path", F.col("holder.start").alias("start")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("deps")))).alias("dependencies"))
    empty = F.array().cast("array<string>")
    text = F.coalesce(F.col("parts")["annotations"], F.lit(""))
    marks = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("@(\\w+)"), 1), F.regexp_extract_all(text, F.lit("\\[(\\w+)"), 1), F.flatten(F.transform(F.regexp_extract_all(text, F.lit("derive\\(([^)]*)\\)"), 1), lambda d: F.transform(F.split(d, ","), lambda x: F.trim(x))))))
    supers = _words(F.col("parts")["supers"])
    rows = scopes.join(deps, ["file_path", "start"], "left").select(*AT, F.col("parts")["name"].alias("name"), "line", F.coalesce("dependencies", empty).alias("dependencies"), marks.alias("annotations"), F.array_union(_words(F.col("parts")["implements"]), F.filter(supers, lambda s: s.rlike("^I[A-Z]"))).alias("implements"), F.array_union(_words(F.col("parts")["extends"]), F.filter(supers, lambda s: ~s.rlike("^I[A-Z]"))).alias("extends"))
    return rows.where(F.col("name").isNotNull())


def bindings(captures: DataFrame) -> DataFrame:
    """(file_path, project, framework, name, ref_name) of what containers are told: the class bound, and the interface it is bound to."""
    told = _of(captures, "binding").select(*AT, F.coalesce(F.col("parts")["impl"], F.col("parts")["interface"]).alias("name"), F.coalesce(F.col("parts")["interface"], F.col("parts")["impl"]).alias("ref_name"))
    return told.where("name <> ref_name").distinct()


def depends(captures: DataFrame) -> DataFrame:
    """(file_path, project, framework, handler, ref_name): what the handler of the last route before asks for by Depends."""
    asked = _of(captures, "depends").select(*AT, "start", F.substring_index(F.coalesce(F.col("parts")["target"], F.col("parts")["type"]), ".", -1).alias("ref_name")).where("ref_name is not null")
    handlers = _of(captures, "route").select("file_path", F.col("start").alias("_s"), F.col("parts")["handler"].alias("handler"))
    held = asked.join(handlers, "file_path").where("_s <= start").groupBy(*AT, "start", "ref_name").agg(F.max_by("handler", "_s").alias("handler"))
    return held.select(*AT, "handler", "ref_name").distinct()


_ENTITY = "Entity|Table|Schema|Document|Serialize|Deserialize|Queryable|Insertable|FromRow|DeriveEntityModel"
_RELATIONS = ("OneToMany", "ManyToOne", "OneToOne", "ManyToMany", "ForeignKey", "OneToOneField", "ManyToManyField", "relationship", "Parent", "Children")


def entities(captures: DataFrame) -> DataFrame:
    """(file_path, project, framework, name, table_name, line, fields array<struct<name,type>>, relations array<struct<type,target>>)."""
    cls = classes(captures)
    text = F.coalesce(F.col("parts")["annotations"], F.lit(""))
    base = F.concat_ws(",", F.col("parts")["extends"], F.col("parts")["supers"])
    by_mark = text.rlike(f"@({_ENTITY})\\b|derive\\([^)]*\\b({_ENTITY})\\b")
    by_base = base.rlike("\\b(models\\.Model|Model|Base|BaseModel|SQLModel|ApplicationRecord|ActiveRecord::Base|Eloquent)\\b")
    by_tag = F.lit(False)
    columns = enclosing(_of(captures, "column", "attribute"), cls, "holder").where("holder is not null")
    inner = enclosing(_of(captures, "member", "field"), cls, "holder").where("holder is not null")
    kind = F.coalesce(F.col("parts")["kind"], F.lit(""))
    target = F.coalesce(F.when(F.regexp_extract(F.col("parts")["args"], "=>\\s*(\\w+)", 1) != "", F.regexp_extract(F.col("parts")["args"], "=>\\s*(\\w+)", 1)), F.regexp_extract(F.coalesce(F.col("parts")["args"], F.lit("")), "[\"']?(\\w+)", 1))
    field = F.when(~kind.isin(*_RELATIONS), F.struct(F.col("start").alias("at"), F.col("parts")["name"].alias("name"), F.trim(F.coalesce(F.col("parts")["type"], F.when(kind.isin("Column", "mapped_column"), F.regexp_extract(F.col("parts")["args"], "^\\s*(?:db\\.|sa\\.)?(\\w+)", 1)), kind)).alias("type")))
    relation = F.when(kind.isin(*_RELATIONS), F.struct(kind.alias("type"), target.alias("target")))
    sums = columns.unionByName(inner).groupBy("file_path", F.col("holder.start").alias("start")).agg(F.array_sort(F.collect_set(field)).alias("f"), F.array_sort(F.collect_set(relation)).alias("r"), F.max(F.coalesce(F.col("parts")["tag"], F.lit("")).contains("gorm:")).alias("tagged"))
    verbs = enclosing(_of(captures, "relation"), cls, "holder").where("holder is not null").groupBy("file_path", F.col("holder.start").alias("start")).agg(F.array_sort(F.collect_set(F.struct(F.col("parts")["kind"].alias("type"), F.col("parts")["target"].alias("target")))).alias("v"))
    table = enclosing(_of(captures, "table"), cls, "holder").where("holder is not null").groupBy("file_path", F.col("holder.start").alias("start")).agg(F.min(strip_quotes(F.col("parts")["name"])).alias("t"))
    keys = ["file_path", "start"]
    rows = cls.join(sums, keys, "left").join(verbs, keys, "left").join(table, keys, "left").withColumn("_e", by_mark | by_base | by_tag | F.coalesce("tagged", F.lit(False)) | F.col("t").isNotNull()).where("_e")
    named = F.regexp_extract(text, "@(?:Table|Entity)\\(\\s*(?:name\\s*=\\s*)?[\"']([^\"']+)", 1)
    no_fields, no_relations = F.array().cast("array<struct<name:string,type:string>>"), F.array().cast("array<struct<type:string,target:string>>")
    fields = F.coalesce(F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))), no_fields)
    return rows.select(*AT, F.col("parts")["name"].alias("name"), F.coalesce("t", F.when(named != "", named), F.lower(F.col("parts")["name"])).alias("table_name"), "line", fields.alias("fields"), F.coalesce(F.array_union(F.coalesce("r", no_relations), F.coalesce("v", no_relations)), no_relations).alias("relations"))


def components(captures: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, project, framework, name, line, props, hooks, is_page) of user-interface components.

    Single-file components without a stated name are named after their file; props go to the first component of a file.
    """
    empty = F.array().cast("array<string>")
    named = _of(captures, "component").select(*AT, F.coalesce(_part("name", "arrow"), F.lit("")).alias("name"), "line", _part("params", "arrow_params").alias("params"))
    names = F.filter(F.regexp_extract_all(F.coalesce("params", F.lit("")), F.lit("\\{([^}]*)\\}"), 1), lambda x: x != "")
    listed = F.flatten(F.transform(names, lambda n: F.filter(F.transform(F.split(n, ","), lambda w: F.trim(F.regexp_replace(w, "[=:].*", ""))), lambda w: w.rlike("^\\w+$"))))
    known = named.withColumn("name", strip_quotes(F.col("name"))).withColumn("props", listed)
    single = files.where(F.col("file_path").rlike("\\.(vue|svelte)$")).select(*AT, F.regexp_extract("file_path", "([^/]+)\\.[^.]+$", 1).alias("name"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("params"), empty.alias("props"))
    without = single.join(known.where("name <> ''").select("file_path"), "file_path", "left_anti")
    every = known.where("name <> ''").unionByName(without)
    hooks = _of(captures, "hook").groupBy("file_path").agg(F.array_sort(F.collect_set(F.col("parts")["name"])).alias("hooks"))
    props = _of(captures, "prop").groupBy("file_path").agg(F.array_sort(F.collect_set(F.col("parts")["name"])).alias("p1"))
    listed_props = _of(captures, "props").groupBy("file_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.coalesce(F.col("parts")["typed"], F.col("parts")["args"], F.lit("")), F.lit("['\"]?(\\w+)['\"]?\\s*[?]?\\s*(?=[:,\\]])"), 1))))).alias("p2"))
    first = F.row_number().over(Window.partitionBy("file_path").orderBy("line", "name")) == 1
    rows = every.join(hooks, "file_path", "left").join(props, "file_path", "left").join(listed_props, "file_path", "left").withColumn("first", first)
    own = F.when(F.col("first"), F.array_union(F.col("props"), F.array_union(F.coalesce("p1", empty), F.coalesce("p2", empty)))).otherwise(empty)
    return rows.select(*AT, "name", "line", own.alias("props"), F.coalesce("hooks", empty).alias("hooks"), (F.col("file_path").rlike("/(pages|app|routes|views)/") | F.col("name").rlike("(Page|View)$")).alias("is_page"))


def imports(captures: DataFrame) -> DataFrame:
    """(file_path, import_path), each once a file."""
    return _of(captures, "import").select("file_path", strip_quotes(F.trim(_part("path", "module"))).alias("import_path")).where("import_path <> ''").distinct()


DOC_REFERENCE = (
    "@(?:see|throws|exception|link|param\\s*\\{|type\\s*\\{|returns?\\s*\\{)\\s*\\{?#?([A-Za-z]\\w*)|:class:`~?\\.?([\\w.]+)`|\\{@link\\s+([A-Za-z]\\w*)|(?:See|Raises|Uses):?\\s+`?([A-Z]\\w+)"
)


def doc_references(files: DataFrame, pattern: str = DOC_REFERENCE, groups: int = 4) -> DataFrame:
    """(file_path, name) that doc comments refer to by class name: the ``groups`` of ``pattern``, dotted names by their last part."""
    rows = files.select("file_path", F.explode(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(pattern), k) for k in range(1, groups + 1)])))).alias("word"))
    return rows.select("file_path", F.substring_index("word", ".", -1).alias("name")).where(is_type_name(F.col("name"))).distinct()
