"""From a folder of sources to graph, files and answers."""

import io
import json

import pytest
from pyspark.sql import functions as F

from codeloom import config
from codeloom.engine import Engine
from codeloom.server import Server
from codeloom.sinks import articles, files
from codeloom.sources import scan

TREE = {
    "shop-api/requirements.txt": "fastapi\n", "shop-api/app/main.py": "from app.userstore import UserStore\nrouter = APIRouter(prefix='/api/users')\n@router.get('/{id}')\ndef read(id, s = Depends(f)):\n    pass\nclass Reader:\n    pass\n", "shop-api/app/store.py": "class UserStore(BaseModel):\n    name: str\n", "shop-api/node_modules/x.py": "class Hidden: pass\n", "shop-api/docs/readme.md": "# x", "shop-api/skip/me.py": "class Skipped: pass\n", "shop-api/.codeloomignore": "# names\nskip/\n",
    "shop-web/package.json": '{"dependencies": {"react": "1"}}', "shop-web/src/pages/UserPage.tsx": "import React from 'react';\nexport const UserPage = ({ id }) => {\n  return fetch('/api/users/7?x=1');\n};\n", "shop-web/dist/out.js": "class Out { }",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("build") / "repo"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    return Engine.scan(spark, str(tree))


def test_discovery(spark, tree):
    assert [p.name for p in scan.discover(tree)] == ["shop-api", "shop-web"]
    paths = sorted(r["file_path"].split("/repo/")[1] for r in scan.scan(spark, f"file://{tree}").select("file_path").collect())
    assert paths == ["shop-api/app/main.py", "shop-api/app/store.py", "shop-api/skip/me.py", "shop-web/src/pages/UserPage.tsx"]
    rows = [(f"/r/{k}", v) for k, v in TREE.items()]
    got = {r["name"]: (r["framework"], r["language"]) for r in scan.detect_projects(spark.createDataFrame(rows, "file_path string, content string")).collect()}
    assert got == {"shop-api": ("fastapi", "python"), "shop-web": ("react", "typescript")}
    sections = scan.component_sections(spark.createDataFrame([("a.vue", "<template><p/></template><script lang='ts'>x</script>")], "file_path string, content string")).first()
    assert tuple(sections)[1:] == ("ts", "x", "<p/>")


def test_bytes_that_are_no_utf8_are_replaced(spark, tmp_path):
    (tmp_path / "latin.py").write_bytes("x = 'Müller'\n".encode("latin-1"))
    (tmp_path / "fine.py").write_bytes("y = 'Müller'\n".encode())
    got = {r["file_path"].rsplit("/", 1)[1]: r["content"] for r in scan.decoded(scan.scan(spark, f"file://{tmp_path}")).collect()}
    assert got == {"latin.py": "x = 'M\ufffdller'\n", "fine.py": "y = 'Müller'\n"}


def test_frameworks_by_fixed_order(spark):
    rows = [("/r/a/Cargo.toml", 'axum = "1"\ntauri = "2"'), ("/r/b/build.gradle.kts", "plugins { }\nspring"), ("/r/c/build.gradle", "io.ktor:ktor"), ("/r/d/requirements.txt", "requests"), ("/r/d/Pipfile", "Flask = '*'"), ("/r/e/package.json", '{"koa": 1, "express": 1}'), ("/r/e/nuxt.config.ts", ""), ("/r/f/package.json", '{"koa": 1, "express": 1}'), ("/r/g/x.csproj", ""), ("/r/g/package.json", "{}"), ("/r/h/go.mod", None), ("/r/i/Pipfile", "django")]
    got = {r["name"]: (r["framework"], r["language"]) for r in scan.detect_projects(spark.createDataFrame(rows, "file_path string, content string")).collect()}
    assert got == {"a": ("tauri", "rust"), "b": ("spring-boot", "java"), "c": ("ktor", "kotlin"), "d": ("flask", "python"), "e": ("nuxt", "typescript"), "f": ("koa", "typescript"), "g": ("aspnet", "csharp"), "h": ("go", "go")}


def test_graph(engine):
    kinds = {(r["label"], r["type"]) for r in engine.graph.nodes.collect()}
    assert {("Reader", "class"), ("UserStore", "entity"), ("UserPage", "component"), ("read [GET /api/users/{id}]", "route")} <= kinds
    assert not any(label in ("Hidden", "Skipped", "Out") for label, _ in kinds)
    edges = {(r["source"], r["target"], r["relation"]) for r in engine.graph.edges.collect()}
    assert ("shop-web::UserPage", "shop-api::read::route::GET::/api/users/{id}", "calls_api") in edges
    assert ("shop-api::Reader", "shop-api::UserStore", "imports_from") in edges


def test_answers(engine):
    assert {r["label"] for r in engine.search("user").collect()} >= {"UserPage", "UserStore"}
    assert [r["id"].split("::")[1] for r in engine.path("UserPage", "read").orderBy("place").collect()] == ["UserPage", "read"]
    assert {(r["direction"], r["depth"]) for r in engine.blast_radius("UserStore").collect()} == {("upstream", 1)}
    assert engine.routes("api").count() == 1 and engine.services().count() == 1
    assert engine.communities().count() == engine.graph.nodes.count()


def test_files(engine, spark, tmp_path):
    engine.save(str(tmp_path))
    again = Engine.load(spark, f"{tmp_path}/graph")
    assert again.graph.nodes.count() == engine.graph.nodes.count()
    assert "## Folders most coupled" in (tmp_path / "REPORT.md").read_text()
    page = (tmp_path / "wiki/shop-api/all/UserStore.md").read_text()
    assert "imported_by" in page and "Reader" in page
    files.save_node_link(engine.graph, str(tmp_path / "graph.json"))
    said = json.loads((tmp_path / "graph.json").read_text())
    assert len(said["nodes"]) == engine.graph.nodes.count()
    assert files.load_node_link(spark, str(tmp_path / "graph.json")).edges.count() == engine.graph.edges.count()
    notes = {r["path"]: r["content"] for r in articles.vault(engine.graph).collect()}
    assert "calls_api: [[shop-api/" in notes["shop-web/UserPage.md"] and "shop-web/_shop-web.md" in notes
    from codeloom.graph import Graph

    node = "id string, label string, type string, source_file string, line int, project string, framework string, implements array<string>, extends array<string>, detail string"
    one = spark.createDataFrame([("p::A", "A", "class", "/r/a.py", 1, "p", "f", [], [], '{"dependencies": ["getX", "Store", "Clock", "toString"]}')], node)
    bare = Graph(one, spark.createDataFrame([], "source string, target string, relation string"), None)
    assert "Members: Clock, Store\n" in {r["path"]: r["content"] for r in articles.vault(bare).collect()}["p/A.md"]
    escaped = spark.createDataFrame([("../out.md", "x"), ("/abs.md", "x"), ("in/a.md", "y")], "path string, content string")
    assert files.write_files(escaped, str(tmp_path / "safe")) == 1
    merged = articles.merge_block("mine\n", articles.context_block(engine.graph))
    assert merged.startswith("mine") and "shop-api (fastapi)" in merged
    assert articles.merge_block(merged, "new").count(articles.BEGIN) == 1


def test_server(engine, tmp_path):
    server = Server(engine, str(tmp_path))
    out = io.StringIO()
    calls = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"method": "note"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"term": "UserPage"}}}, {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"term": " "}}}, {"id": 5, "method": "tools/call", "params": {"name": "x"}}, {"id": 6, "method": "y"}]
    server.run(io.StringIO("\n".join(map(json.dumps, calls)) + "\n{bad\n"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, None]
    assert "UserPage" in replies[2]["result"]["content"][0]["text"] and "empty" in replies[3]["result"]["content"][0]["text"]
    assert [r["error"]["code"] for r in replies[4:]] == [-32601, -32601, -32700]
    assert server._wiki("../x") == "No such article"


def test_config(tmp_path, tree):
    path = tmp_path / config.FILE
    config.write(path, [config.Project("a", "x"), config.Project("b", "/abs", "flask")])
    (tmp_path / "deep").mkdir()
    assert config.find(tmp_path / "deep") == path
    loaded = config.load(path)
    assert [(p.name, p.framework) for p in loaded.projects] == [("a", None), ("b", "flask")] and loaded.projects[0].path == str(tmp_path / "x")
    path.write_text("version: 2\nprojects: [{path: x}]\n")
    with pytest.raises(ValueError, match="version"):
        config.load(path)
    path.write_text("version: 1\n")
    with pytest.raises(ValueError, match="project"):
        config.load(path)


def test_stream(spark, tmp_path):
    from codeloom.operators.changes import latest_records
    from codeloom.streaming.watch import watch_log

    schema = "result_id long, file_path string, content_hash string, started_at timestamp_ntz"
    rows = spark.range(1, 21).selectExpr("id as result_id", "concat('f', id % 3) as file_path", "concat('h', id) as content_hash", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as started_at")
    source, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/ledger"
    for part in ("result_id % 2 = 0", "result_id % 2 = 1"):  # the second half comes late
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
        watch_log(spark, source, schema, folder).awaitTermination(120)
    state = {r["key"]: r["best"]["v"]["content_hash"] for r in latest_records(spark, folder).state().collect()}
    assert state == {"f0": "h18", "f1": "h19", "f2": "h20"}
    assert [(r["lo"], r["hi"]) for r in latest_records(spark, folder).ledger.processed().collect()] == [(1, 21)]


def test_vault_steps(spark):
    notes = spark.createDataFrame([("a/User_Page.md", "[[a/user page]] [[a/Nothing]] [[b/X]]"), ("b/X.md", "x"), ("b/Y.md", None)], "path string, content string")
    got = {r["path"]: r["content"] for r in articles.repaired(notes).collect()}
    assert got == {"a/User_Page.md": "[[a/User_Page]] [[a/Nothing]] [[b/X]]", "b/X.md": "x", "b/Y.md": None}
    rows = spark.createDataFrame([("web-shop",), ("shop-web",), (None,)], "p string").select(articles.is_front_end(F.col("p"))).collect()
    assert [r[0] for r in rows] == [True, False, False]


def test_controller_routes(spark):
    rows = [("p::UserController", "UserController", "class", "p", None), ("q::UserController", "UserController", "class", "q", None), ("p::r1", "UserController.list [GET /users]", "route", "p", None), ("p::r2", "SuperUserController.x [GET /super]", "route", "p", None), ("p::Odd", "Odd", "class", "p", '{"annotations": ["RestController"]}'), ("p::r3", "Odd@run [POST /odd]", "route", "p", None)]
    nodes = spark.createDataFrame([(*r, "f") for r in rows], "id string, label string, type string, project string, detail string, source_file string")
    got = {r["id"]: r["routes"] for r in articles.controller_routes(nodes).collect()}
    assert got == {"p::UserController": ["GET /users"], "p::Odd": ["POST /odd"]}
