"""Column expressions over names, paths and URLs; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of verbs, decorators and attributes, and the verb they stand for.
METHODS = {
    "get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH",
    "delete": "DELETE", "del": "DELETE", "options": "OPTIONS",
    "head": "HEAD", "any": "ANY", "all": "ANY", "use": "ANY",
    "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT",
    "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": "ANY",
    "Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH",
    "Delete": "DELETE", "Options": "OPTIONS", "Head": "HEAD", "All": "ANY",
    "HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT",
    "HttpPatch": "PATCH", "HttpDelete": "DELETE",
    "HttpOptions": "OPTIONS", "HttpHead": "HEAD",
    "MapGet": "GET", "MapPost": "POST", "MapPut": "PUT",
    "MapPatch": "PATCH", "MapDelete": "DELETE",
}
#: Further names that captures use for routes of no single verb.
OTHER_METHODS = {"route": "ANY", "match": "ANY", "websocket": "WS"}
# Names of simple types, which are no references to classes; upper and lower case are told apart.
SIMPLE_TYPES = [
    "int", "long", "float", "double", "boolean", "void", "string",
    "String", "Integer", "Long", "Float", "Double", "Boolean", "Object",
    "any", "unknown", "never", "undefined", "null", "true", "false",
    "str", "bytes", "list", "dict", "tuple", "set", "bool", "type",
]
# The seven routes of a resource: verb, path, action; ``{id}`` stands for ``:<singular>_id``.
RESOURCE_ROUTES = [
    ("GET", "{name}", "index"),
    ("GET", "{name}/new", "new"),
    ("POST", "{name}", "create"),
    ("GET", "{name}/{id}", "show"),
    ("GET", "{name}/{id}/edit", "edit"),
    ("PUT", "{name}/{id}", "update"),
    ("DELETE", "{name}/{id}", "destroy"),
]
# Relations as seen from the other end.
REVERSE_RELATIONS = {"imports": "imported_by", "imports_from": "imported_by", "calls": "called_by", "injects": "injected_by", "calls_api": "api_called_by", "shares_db_entity": "shares_db_entity"}


def strip_quotes(x: Column) -> Column:
    """Without one pair of matching outer quotes."""
    return F.regexp_replace(x, "^(['\"`])(.*)\\1$", "$2")


def join_path(*parts: Column) -> Column:
    """Parts without outer quotes and slashes, empty ones left out, joined below a leading slash; null parts count as empty."""
    clean = [F.trim(F.regexp_replace(strip_quotes(F.coalesce(p, F.lit(""))), "^/+|/+$", "")) for p in parts]
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(*clean), lambda p: p != ""), "/"))


def http_method(x: Column) -> Column:
    """The verb of a name, upper and lower case told apart; unknown names in upper case, none means ANY."""
    known = F.create_map(*[F.lit(v) for pair in (METHODS | OTHER_METHODS).items() for v in pair])
    return F.when(F.coalesce(x, F.lit("")) == "", "ANY").otherwise(F.coalesce(known[x], F.upper(x)))


def resource_path(template: Column, name: Column) -> Column:
    """The path of one of RESOURCE_ROUTES for a resource; the parameter bears the name without its last s."""
    parameter = F.concat(F.lit(":"), F.regexp_replace(name, "s$", ""), F.lit("_id"))
    return F.replace(F.replace(template, F.lit("{name}"), name), F.lit("{id}"), parameter)


def normal_path(url: Column) -> Column:
    """Lower-case path without query, fragment and trailing slash; nothing becomes a slash."""
    cut = F.regexp_replace(F.lower(F.regexp_replace(url, "[?#].*$", "")), "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


#: A parameter of a path.
PARAMETER = "<[^<>/]*>|\\{[^{}/]*\\}|\\[[^\\[\\]/]*\\]|:[A-Za-z_]\\w*"


def path_pattern(path: Column) -> Column:
    """A regular expression of a route: ``:id``, ``{id}``, ``[id]`` and ``<int:id>`` match one segment, all else itself."""
    marked = F.regexp_replace(path, PARAMETER, "\u0001")
    return F.regexp_replace(F.regexp_replace(marked, "([\\\\.^$|?*+()\\[\\]{}])", "\\\\$1"), "\u0001", "[^/]+")


def segment_count(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def last_literal(path: Column) -> Column:
    """struct<at, literal> of the last segment without a parameter in it, null if there is none."""
    places = F.transform(F.split(path, "/"), lambda s, k: F.struct(k.alias("at"), s.alias("literal")))
    plain = F.filter(places, lambda x: (x["literal"] != "") & ~x["literal"].rlike(PARAMETER))
    return F.get(plain, F.size(plain) - 1)


def import_label(path: Column) -> Column:
    """The name an import stands for: the last part of a dotted name, or the last segment without its extension."""
    dotted = F.substring_index(path, ".", -1)
    segment = F.regexp_replace(F.substring_index(path, "/", -1), "\\.[A-Za-z0-9]+$", "")
    return F.when(path.contains(".") & ~path.contains("/"), dotted).otherwise(segment)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def route_segments(path: Column) -> Column:
    """The route of a file-system path: groups drop out, ``[...x]`` is ``*``, ``[x]`` is ``:x``, index drops out."""
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike("^\\(.*\\)$") & (s != "index"))
    turned = F.transform(kept, lambda s: F.when(s.rlike("^\\[\\[?\\.\\.\\."), "*").otherwise(F.regexp_replace(s, "^\\[(.+)\\]$", ":$1")))
    return F.concat(F.lit("/"), F.array_join(turned, "/"))


def is_type_name(x: Column) -> Column:
    """Whether a word can name a class: two letters or more, capitalised, no simple type."""
    word = F.trim(x)
    return (F.length(word) >= 2) & ~word.isin(SIMPLE_TYPES) & word.rlike("^[A-Z]")


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, '[<>:"/\\\\|?*\\s]+', "_")


def is_controller(label: Column, annotations: Column | None = None) -> Column:
    named = label.rlike("(Controller|Router|Handler|Resource)$")
    return named if annotations is None else named | F.coalesce(F.arrays_overlap(annotations, F.array(*[F.lit(a) for a in ("Controller", "RestController", "Router", "ApiController")])), F.lit(False))


def type_display(kind: Column, label: Column, annotations: Column | None = None) -> Column:
    """The word for a node: of a class by its annotations, the first that says anything, then by its label."""
    by_label = F.when(label.endswith("Controller"), "Controller").when(label.endswith("Repository"), "Repository").otherwise("Service")
    of_class = by_label
    if annotations is not None:
        says = lambda a: F.when(F.lower(a).contains("controller"), "REST Controller").when(F.lower(a).contains("service"), "Service").when(F.lower(a).contains("repository"), "Repository").when(F.lower(a).contains("component"), "Component")
        said = F.filter(F.transform(annotations, says), lambda w: w.isNotNull())
        of_class = F.when(F.size(said) > 0, F.get(said, F.lit(0))).otherwise(by_label)
    return F.when(kind == "class", of_class).when(kind == "entity", "Entity").when(kind == "component", "Frontend Component").when(kind == "route", "API Route").otherwise(F.initcap(kind))


def reverse_relation(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in REVERSE_RELATIONS.items() for v in pair])
    return F.coalesce(known[x], F.concat(F.lit("←"), x))


def gorm_tag(tag: Column) -> Column:
    """The parts of a gorm struct tag, each as gorm:part."""
    inner = F.regexp_extract(tag, 'gorm:"([^"]*)"', 1)
    return F.transform(F.filter(F.split(inner, ";"), lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit("gorm:"), F.trim(p)))


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\[\\[([^\\]|]+)"), 1)


def colour(x: Column) -> Column:
    """A colour number from a name: the first six hex digits of its MD5."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 6), 16, 10).cast("int")


def markdown_link(label: Column, path: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]("), F.replace(path, F.lit(" "), F.lit("%20")), F.lit(")"))


# URL literals in client code; the first group is the URL.
URL_PATTERNS = [
    r"""(?:fetch|invoke|\$fetch)\s*\(\s*[`"']([^`"'$]+)[`"']""",
    r"""axios\.\w+\b[^`"']*[`"']([^`"'$]+)[`"']""",
    r"""(?:api|http|client|instance|request)\.\w+\b[^`"']*[`"']([^`"'$]+)[`"']""",
    r"""url\s*[:=]\s*[`"']([^`"'$]+)[`"']""",
    r"""["'](/api/[^"'`\s]+)["'`]""",
    r'''"\{\}(/api/[^"'\s]+)''',
]
#: Commands sent to a desktop back end; the first group is the command.
COMMAND_PATTERNS = ["invoke(?:<[^>]*>)?\\(\\s*['\"`](\\w+)['\"`]", "ipcRenderer\\.(?:invoke|send)\\(\\s*['\"`]([\\w:-]+)['\"`]"]


def extract_urls(content: Column) -> Column:
    """Distinct URL literals without query and fragment that begin with a slash and a letter."""
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), 1) for p in URL_PATTERNS])
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.trim(F.regexp_replace(u, "(?s)[?#].*$", ""))), lambda u: u.rlike("^/[a-zA-Z]")))


def extract_commands(content: Column) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(content, F.lit(p), 1) for p in COMMAND_PATTERNS]))
