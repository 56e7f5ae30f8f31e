"""One pass over each file: pattern matches as rows, with their places.

A file is read once, by the patterns of its framework and language.  Comments are blanked beforehand (places stay),
strings are kept.  What the matches mean is decided by joins in ``interpret``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import extension

CAPTURES = "file_path string, project string, framework string, pattern string, match_id int, parts map<string,string>, start int, end int, line int, end_line int"

# Frameworks that are read by the patterns of another.
ALIASES = {"koa": "express", "fastify": "express", "node": "express", "echo": "gin", "fiber": "gin", "go": "gin", "axum": "actix", "rocket": "actix", "warp": "actix", "rust": "actix", "tornado": "flask", "aiohttp": "flask", "python": "fastapi", "nextjs": "react", "nuxt": "vue", "svelte": "sveltekit"}
_STR = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
_VERBS = "get|post|put|delete|patch|head|options"

# name -> regular expression with named groups.  ``class`` patterns open a scope that ends with its block.
_JVM = {
    "class": r"(?P<annotations>(?:@\w+(?:\((?:[^()]|\([^()]*\))*\))?\s*)*)(?:(?:public|abstract|final|data|open|sealed)\s+)*(?:class|interface|object)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<extends>[\w.<>]+))?(?:\s+implements\s+(?P<implements>[\w.,<>\s]+?))?(?:\s*:\s*(?P<supers>[\w.,<>()\s]+?))?\s*\{",
    "import": r"(?m:^\s*import\s+(?:static\s+)?(?P<path>[\w.*]+))",
}
PATTERNS: dict[str, dict[str, str]] = {
    "spring-boot": _JVM | {
        "route": r"@(?P<method>Get|Post|Put|Delete|Patch|Request)Mapping\b(?:\((?P<args>(?:[^()]|\([^()]*\))*)\))?(?=[^{};]*?\s(?P<handler>\w+)\s*\()",
        "field": r"(?P<annotations>(?:@\w+(?:\([^)]*\))?\s*)*)(?:private|protected|public)\s+(?:final\s+)?(?P<type>[\w.]+(?:<[\w.,<>\s?]*>)?)\s+(?P<name>\w+)\s*(?:;|=)",
        "constructor": r"(?m:^\s*(?:public|protected)\s+(?P<name>[A-Z]\w*)\s*\((?P<params>[^)]*)\))",
    },
    "ktor": _JVM | {"scope": r"\broute\(\s*(?P<path>" + _STR + r")\s*\)\s*\{", "route": rf"(?<![.\w])(?P<method>{_VERBS})\s*(?:\(\s*(?P<path>{_STR})\s*\))?\s*\{{", "binding": r"\b(?:single|factory)(?:<(?P<interface>\w+)>)?\s*\{\s*(?P<impl>\w+)\(", "table": r"object\s+(?P<name>\w+)\s*:\s*(?:\w*Table)\s*\("},
    "express": {
        "route": rf"\b(?P<var>\w+)\.(?P<method>{_VERBS}|all)\(\s*(?P<path>{_STR})\s*(?:,\s*(?P<handler>[\w.]+))?",
        "mount": rf"\b(?P<var>\w+)\.use\(\s*(?P<path>{_STR})\s*,\s*(?P<target>\w+)",
        "class": r"\bclass\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>[\w.]+))?\s*\{",
        "import": r"(?:\bfrom\s+|\brequire\(\s*|(?m:^\s*import\s+))(?P<path>" + _STR + ")",
    },
    "nestjs": {
        "class": r"(?P<annotations>(?:@\w+\((?:[^()]|\([^()]*\))*\)\s*)*)(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<extends>[\w.<>]+))?(?:\s+implements\s+(?P<implements>[\w.,<>\s]+?))?\s*\{",
        "route": rf"@(?P<method>Get|Post|Put|Delete|Patch|Head|Options|All)\(\s*(?P<path>{_STR})?\s*\)(?=[^{{;]*?\b(?P<handler>\w+)\s*\()",
        "constructor": r"\bconstructor\s*\((?P<params>[^)]*)\)",
        "column": r"@(?P<kind>PrimaryGeneratedColumn|PrimaryColumn|Column|Prop|OneToMany|ManyToOne|OneToOne|ManyToMany)\((?P<args>(?:[^()]|\([^()]*\))*)\)\s*(?:readonly\s+)?(?P<name>\w+)[?!]?\s*:\s*(?P<type>[\w\[\]<>.|\s]+?)\s*[;=\n]",
        "import": r"(?:\bfrom\s+|\brequire\(\s*)(?P<path>" + _STR + ")",
    },
    "fastapi": {
        "prefix": rf"(?m:^(?P<var>\w+)\s*=\s*APIRouter\((?:[^)]*?prefix\s*=\s*(?P<path>{_STR}))?)",
        "route": rf"@(?P<var>\w+)\.(?P<method>{_VERBS}|websocket)\(\s*(?P<path>{_STR})[^)]*\)\s*(?:@[^\n]*\s*)*(?:async\s+)?def\s+(?P<handler>\w+)",
        "class": r"(?m:^(?P<indent>[ \t]*)class\s+(?P<name>\w+)\s*(?:\((?P<extends>[^)]*)\))?\s*:)",
        "table": r"__tablename__\s*=\s*(?P<name>" + _STR + ")",
        "attribute": r"(?m:^[ \t]+(?P<name>[a-z_]\w*)\s*:\s*(?P<type>[\w\[\], .|]+?)\s*(?:=\s*(?P<value>[^\n]*))?$)",
        "column": r"(?m:^[ \t]+(?P<name>\w+)\s*(?::\s*[^=\n]+)?=\s*(?:db\.|sa\.)?(?P<kind>Column|mapped_column|relationship)\((?P<args>(?:[^()]|\([^()]*\))*)\))",
        "depends": r"(?:(?P<name>\w+)\s*(?::\s*(?P<type>[\w.\[\]]+))?\s*=\s*)?Depends\(\s*(?P<target>[\w.]+)?\s*\)",
        "import": r"(?m:^\s*(?:from\s+(?P<path>[\w.]+)\s+import\b|import\s+(?P<module>[\w.]+)))",
    },
    "flask": {
        "prefix": rf"(?m:^(?P<var>\w+)\s*=\s*Blueprint\((?:[^)]*?url_prefix\s*=\s*(?P<path>{_STR}))?)",
        "register": rf"\.register_blueprint\(\s*(?P<var>\w+)(?:[^)]*?url_prefix\s*=\s*(?P<path>{_STR}))",
        "route": rf"@(?P<var>\w+)\.(?P<method>route|{_VERBS})\(\s*(?P<path>{_STR})(?:[^)]*?methods\s*=\s*[\[(](?P<methods>[^\])]*)[\])])?[^)]*\)\s*(?:@[^\n]*\s*)*(?:async\s+)?def\s+(?P<handler>\w+)",
    },
    "django": {
        "route": rf"\b(?:re_)?path\(\s*r?(?P<path>{_STR})\s*,\s*(?P<handler>[\w.]+)(?P<call>\()?",
        "column": r"(?m:^[ \t]+(?P<name>\w+)\s*=\s*models\.(?P<kind>\w+)\((?P<args>(?:[^()]|\([^()]*\))*)\))",
    },
    "gin": {
        "group": rf"\b(?P<var>\w+)\s*:?=\s*(?P<parent>\w+)\.Group\(\s*(?P<path>{_STR})",
        "route": rf"\b(?P<var>\w+)\.(?P<method>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Get|Post|Put|Delete|Patch|Any|All)\(\s*(?P<path>{_STR})\s*,\s*(?:(?P<handler>[\w.]+)\s*[,)]|(?P<literal>func\b))",
        "class": r"\btype\s+(?P<name>\w+)\s+struct\s*\{",
        "member": r"(?m:^[ \t]+(?P<name>[A-Z]\w*)\s+(?P<type>[\w.*\[\]]+)\s*(?P<tag>`[^`]*`)?\s*$)",
        "import": r"(?m:^\s*(?:import\s+)?(?:[\w.]+\s+)?(?P<path>\"[\w./\-]+\")\s*$)",
    },
    "rails": {
        "route": r"(?m:^\s*(?P<method>get|post|put|patch|delete)\s+(?P<path>['\"][^'\"]+['\"])(?:\s*(?:,\s*to:|=>)\s*['\"](?P<handler>[\w#/]+)['\"])?)",
        "resources": r"(?m:^\s*(?P<kind>resources?)\s+:(?P<name>\w+))", "root": r"(?m:^\s*root\s+(?:to:\s*)?['\"](?P<handler>[\w#/]+)['\"])", "scope": r"(?m:^\s*(?:namespace\s+:(?P<name>\w+)|scope\s+['\"](?P<path>[^'\"]+)['\"])[^\n]*\bdo\b)",
        "class": r"(?m:^(?P<indent>[ \t]*)class\s+(?P<name>[\w:]+)\s*(?:<\s*(?P<extends>[\w:]+))?)", "relation": r"(?m:^\s*(?P<kind>has_many|has_one|belongs_to|has_and_belongs_to_many)\s+:(?P<target>\w+))", "import": r"(?m:^\s*require(?:_relative)?\s+(?P<path>['\"][^'\"]+['\"]))",
    },
    "laravel": {
        "scope": r"Route::(?:\w+\([^)]*\)->)*prefix\(\s*(?P<path>" + _STR + r")\s*\)[^;{]*group\(\s*(?:function\s*\([^)]*\)|fn\s*\([^)]*\)\s*=>)?\s*\{",
        "route": rf"Route::(?P<method>{_VERBS}|any)\(\s*(?P<path>{_STR})\s*,\s*(?:\[\s*(?P<controller>\w+)::class\s*,\s*(?P<action>{_STR})\s*\]|(?P<handler>{_STR})|(?P<literal>function|fn))",
        "resources": r"Route::(?P<kind>apiResource|resource)\(\s*(?P<path>" + _STR + ")",
        "class": r"\bclass\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>[\w\\]+))?(?:\s+implements\s+(?P<implements>[\w\\,\s]+?))?\s*\{", "relation": r"\$this->(?P<kind>hasMany|hasOne|belongsTo|belongsToMany)\(\s*(?P<target>\w+)::class", "table": r"\$table\s*=\s*(?P<name>" + _STR + ")", "binding": r"->(?:bind|singleton)\(\s*(?P<interface>\w+)::class\s*,\s*(?P<impl>\w+)::class", "import": r"(?m:^\s*use\s+(?P<path>[\w\\]+))",
    },
    "aspnet": {
        "class": r"(?P<annotations>(?:\[(?:[^\[\]\n]|\[[^\]]*\])+\]\s*)*)(?:(?:public|internal|abstract|sealed|partial|static)\s+)*class\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<supers>[\w.,<>\s]+?))?\s*\{",
        "route": rf"\[Http(?P<method>Get|Post|Put|Delete|Patch)(?:\(\s*(?P<path>{_STR})[^)]*\))?\](?=[^{{;]*?\b(?P<handler>\w+)\s*\()", "minimal": rf"\b\w+\.Map(?P<method>Get|Post|Put|Delete|Patch)\(\s*(?P<path>{_STR})", "constructor": r"(?m:^\s*public\s+(?P<name>[A-Z]\w*)\s*\((?P<params>[^)]*)\))", "binding": r"\.Add(?:Scoped|Singleton|Transient)<\s*(?P<interface>\w+)\s*(?:,\s*(?P<impl>\w+)\s*)?>", "set": r"DbSet<(?P<type>\w+)>\s+(?P<name>\w+)", "import": r"(?m:^\s*using\s+(?P<path>[\w.]+)\s*;)",
    },
    "actix": {
        "route": rf"#\[(?P<method>{_VERBS})\(\s*(?P<path>{_STR})[^)]*\)\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)", "wired": rf"\.route\(\s*(?P<path>{_STR})\s*,\s*(?:web::)?(?P<method>{_VERBS})\(\s*(?P<inner>[\w:]*)\s*\)(?:\.to\(\s*(?P<handler>[\w:]+)\s*\))?",
        "class": r"(?P<annotations>(?:#\[[^\]]*\]\s*)*)(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)[^{;(]*\{", "member": r"(?m:^\s*(?:pub\s+)?(?P<name>[a-z_]\w*)\s*:\s*(?P<type>[\w:<>&, ]+?),?\s*$)", "import": r"(?m:^\s*use\s+(?P<path>[\w:]+))",
    },
    "tauri": {"command": r"#\[tauri::command[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)"},
    "vapor": {
        "group": rf"(?:let\s+(?P<var>\w+)\s*=\s*(?P<parent>\w+)\.grouped\(\s*(?P<path>{_STR}(?:\s*,\s*{_STR})*)|(?P<parent2>\w+)\.group\(\s*(?P<path2>{_STR}(?:\s*,\s*{_STR})*)\s*\)\s*\{{\s*(?P<var2>\w+)\s+in)", "route": rf"\b(?P<var>\w+)\.(?P<method>{_VERBS})\(\s*(?P<path>{_STR}(?:\s*,\s*{_STR})*)?\s*(?:,?\s*use:\s*(?P<handler>[\w.]+))?\s*\)",
        "class": r"\b(?:final\s+)?(?:class|struct)\s+(?P<name>\w+)\s*(?::\s*(?P<supers>[\w.,\s]+?))?\s*\{", "column": r"@(?P<kind>ID|Field|Parent|Children|OptionalField|Timestamp)(?:\((?P<args>[^)]*)\))?\s*var\s+(?P<name>\w+)\s*:\s*(?P<type>[\w?\[\]]+)", "import": r"(?m:^\s*import\s+(?P<path>\w+))",
    },
    "angular": {
        "route": rf"\{{\s*path:\s*(?P<path>{_STR})\s*,\s*(?:component:\s*(?P<handler>\w+)|loadChildren|loadComponent|redirectTo)", "component": r"@Component\(\s*\{(?P<args>[^}]*)\}\s*\)\s*export\s+(?:default\s+)?class\s+(?P<name>\w+)",
    },
    "react": {
        "component": r"(?:export\s+(?:default\s+)?)?(?:function\s+(?P<name>[A-Z]\w*)\s*\((?P<params>[^)]*)\)|const\s+(?P<arrow>[A-Z]\w*)\s*(?::\s*[\w.<>{}\s]+)?=\s*(?:React\.)?(?:memo\(|forwardRef\()?\s*(?:async\s*)?\((?P<arrow_params>[^)]*)\)[^=\n]*=>)", "hook": r"\b(?P<name>use[A-Z]\w*)\s*(?:<[^>]*>)?\(", "import": r"(?:\bfrom\s+|\brequire\(\s*|(?m:^\s*import\s+))(?P<path>" + _STR + ")",
    },
    "vue": {"component": r"defineComponent\(\s*\{(?:\s*name:\s*(?P<name>" + _STR + "))?", "props": r"(?:defineProps(?:<\{(?P<typed>[^}]*)\}>)?\(|props:\s*)(?P<args>\{[^}]*\}|\[[^\]]*\])?", "hook": r"\b(?P<name>use[A-Z]\w*)\s*\(", "route": rf"\bpath:\s*(?P<path>{_STR})", "import": r"\bfrom\s+(?P<path>" + _STR + ")"},
    "sveltekit": {"prop": r"(?m:^\s*export\s+let\s+(?P<name>\w+))", "import": r"\bfrom\s+(?P<path>" + _STR + ")"},
}
PATTERNS["angular"] = PATTERNS["nestjs"] | PATTERNS["angular"]
PATTERNS["django"] = {k: PATTERNS["fastapi"][k] for k in ("class", "import")} | PATTERNS["django"]
PATTERNS["flask"] = {k: PATTERNS["fastapi"][k] for k in ("class", "table", "column", "import")} | PATTERNS["flask"]
PATTERNS["tauri"] = {k: PATTERNS["actix"][k] for k in ("class", "member", "import")} | PATTERNS["tauri"]

# What reads a file whose framework is unknown, and which extensions a framework's patterns are for.
BY_EXTENSION = {".py": "fastapi", ".java": "spring-boot", ".kt": "ktor", ".js": "express", ".mjs": "express", ".cjs": "express", ".ts": "nestjs", ".jsx": "react", ".tsx": "react", ".go": "gin", ".rb": "rails", ".php": "laravel", ".cs": "aspnet", ".rs": "actix", ".swift": "vapor", ".vue": "vue", ".svelte": "sveltekit"}
FAMILY = {"spring-boot": ".java .kt", "ktor": ".kt .kts", "express": ".js .mjs .cjs .ts", "nestjs": ".ts .js", "fastapi": ".py", "flask": ".py", "django": ".py", "gin": ".go", "rails": ".rb", "laravel": ".php", "aspnet": ".cs", "actix": ".rs", "tauri": ".rs .ts .tsx", "vapor": ".swift", "angular": ".ts .html", "react": ".js .jsx .ts .tsx", "vue": ".vue .js .ts", "sveltekit": ".svelte .js .ts"}
_COMMENTS = {".py": r"\#[^\n]*", ".rb": r"\#[^\n]*"}
_LIKE_C = r"//[^\n]*|/\*[\s\S]*?\*/"


def framework_of(framework: str | None, ext: str) -> str | None:
    """Whose patterns read a file: its project's if they are for its extension, else those of the extension."""
    own = ALIASES.get(framework or "", framework or "")
    return own if ext in FAMILY.get(own, "").split() else BY_EXTENSION.get(ext)


@cache
def _compiled(framework: str) -> dict[str, re.Pattern]:
    return {name: re.compile(pattern) for name, pattern in PATTERNS[framework].items()}


@cache
def _comment(ext: str) -> re.Pattern:
    return re.compile(rf"{_STR}|{_COMMENTS.get(ext, _LIKE_C)}")


def blanked(text: str, ext: str) -> str:
    """The text with comments made blanks, line ends kept."""
    if ext == ".php":
        text = re.sub(r"(?m)^\s*#[^\[\n][^\n]*", lambda m: " " * len(m[0]), text)
    return _comment(ext).sub(lambda m: m[0] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0]), text)


def _block_end(text: str, at: int, indent: str | None) -> int:
    """Where the block that a class pattern opened ends: its closing brace, or the next line not indented deeper."""
    if indent is not None:
        for m in re.compile(r"\n([ \t]*)(?=\S)").finditer(text, at):
            if len(m[1]) <= len(indent):
                return m.start()
        return len(text)
    depth = 1
    for m in re.compile(_STR + r"|[{}]").finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return m.end()
    return len(text)


def captures_of(text: str, framework: str, ext: str) -> list[tuple]:
    """(pattern, match_id, parts, start, end, line, end_line) of one text; scopes end with their block."""
    clean = blanked(text, ext)
    starts = [m.start() for m in re.finditer(r"\n", clean)]
    out = []
    for name, pattern in _compiled(framework).items():
        for number, m in enumerate(pattern.finditer(clean)):
            parts = {k: v for k, v in m.groupdict().items() if v is not None and k != "indent"}
            end = m.end()
            if name in ("class", "scope") and (m[0].endswith("{") or "indent" in pattern.groupindex):
                end = _block_end(clean, end, m.groupdict().get("indent"))
            elif name == "scope":
                end = len(clean)
            head = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append((name, number, parts, head, end, bisect_left(starts, head) + 1, bisect_left(starts, m.end()) + 1))
    return out


def captures(files: DataFrame) -> DataFrame:
    """Rows of CAPTURES from (file_path, project, framework, content).

    Files of unknown kinds give nothing, null and empty contents too; rows without a path are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, project, framework, ext, text in zip(batch["file_path"], batch["project"], batch["framework"], batch["ext"], batch["content"]):
                own = framework_of(framework, ext)
                if own and text:
                    rows += [(path, project, own, *c) for c in captures_of(text, own, ext)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURES.split(", ")])

    own = files.where(F.col("file_path").isNotNull()).select("file_path", "project", "framework", extension(F.col("file_path")).alias("ext"), "content")
    return own.mapInPandas(run, CAPTURES)
