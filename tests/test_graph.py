"""Graph operators on small rows."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import text as fn
from codeloom.operators import analyze, build, enrich, filters, serve, settle, traverse
from codeloom.operators.components import connected_components

NODE = "id string, label string, type string, source_file string, line int, project string, framework string, implements array<string>, extends array<string>, first_seen_at timestamp_ntz"
EDGE = "edge_id long, source string, target string, relation string, confidence string, confidence_score double, source_file string, seen_at timestamp_ntz"
NOW = dt.datetime(2024, 1, 1)


def node(ident, label=None, kind="class", file=None, project="p", line=1, implements=(), extends=(), t=NOW):
    return (ident, label or ident.split("::")[-1], kind, file, line, project, "f", list(implements), list(extends), t)


def edge(a, b, relation="imports_from", n=1, file=None):
    return (n, a, b, relation, "EXTRACTED", 1.0, file, NOW + dt.timedelta(days=n))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_collapse(make):
    raw = make([node("p::A", "A", file="old"), node("p::A", "B", t=NOW + dt.timedelta(1), line=None), (None,) * 10], NODE)
    got = build.collapse_nodes(raw).collect()
    assert [(r["id"], r["label"], r["source_file"], r["line"]) for r in got] == [("p::A", "B", "old", 1)]
    edges = make([edge("a", "b", "imports_from", 1), edge("a", "b", "injects", 2), edge("a", None), edge(None, "b")], EDGE)
    assert [(r["source"], r["relation"]) for r in build.collapse_edges(edges).collect()] == [("a", "injects")]


def test_resolution(make):
    nodes = build.collapse_nodes(make([node("p::Svc"), node("q::Svc", project="q"), node("p::Store", "Store"), node("p::StoreA", "StoreA", implements=["Store"]), node("p::StoreImpl", "StoreImpl", implements=["Store"]), node("p::Child", "Child", extends=["Base"])], NODE))
    refs = make([(1, "q::X", "Svc"), (2, "p::X", "Store"), (3, "p::X", "Base"), (4, "p::X", "Nothing"), (5, "z::X", "Svc")], "ref_id long, source_node_id string, ref_name string")
    got = {r["ref_id"]: (r["target"], r["confidence"]) for r in build.resolve(refs, nodes).collect()}
    assert got == {1: ("q::Svc", "EXTRACTED"), 2: ("p::StoreImpl", "INFERRED"), 3: ("p::Child", "INFERRED"), 4: (None, None), 5: ("p::Svc", "EXTRACTED")}


def test_remap_imports(make):
    nodes = build.collapse_nodes(make([node("p::A", file="a.ts"), node("p::user", "user", file="u.ts"), node("q::User", "User", file="v.ts"), node("q::B", file="b.ts", project="q")], NODE))
    imports = make([("a.ts", "./lib/User.ts"), ("a.ts", "x.y.A"), ("b.ts", "User"), ("b.ts", None), ("none.ts", "User")], "file_path string, import_path string")
    assert rows(build.remap_imports(imports, nodes).select("source", "target")) == [("p::A", "q::User"), ("q::B", "q::User")]


def test_filters(make):
    nodes = build.collapse_nodes(make([node("j", file="/r/a/A.java", project="a"), node("t", file="/r/b/B.ts", project="b"), node("d", file="/build/r/a/dist/x.js", project="a"), node("s", file="/r/c/shared/S.java", project="c"), node("k", file="/r/a/K.java", project="a"), node("n", project="")], NODE))
    edges = make([edge("j", "t", n=1), edge("j", "t2", n=2), edge("t", "j", "calls_api", 3), edge("j", "s", n=4), edge("d", "j", n=5), edge("j", "k", n=6), edge("k", "n", n=7), edge("s", "k", n=8)], EDGE)
    e = build.collapse_edges(edges)
    kept = rows(filters.drop_cross_language(e, nodes).select("source", "target"))
    assert ("j", "t") not in kept and ("t", "j") in kept and ("j", "t2") in kept
    service = rows(filters.drop_cross_service(e, nodes).select("source", "target"))
    assert ("s", "k") not in service and ("j", "s") in service and ("k", "n") in service and ("t", "j") in service
    left, touching = filters.drop_artifacts(nodes, e, make([("a", "/build/r/a")], "project string, root string"))
    assert "d" not in [r["id"] for r in left.collect()] and ("d", "j") not in rows(touching.select("source", "target"))
    assert rows(filters.drop_cross_language(filters.drop_cross_language(e, nodes), nodes)) == rows(filters.drop_cross_language(e, nodes))


@pytest.mark.parametrize(("path", "url", "hit"), [("/api/users/:id", "/api/users/17?x=1", True), ("/api/users/{id}", "/API/users/a.b/", True), ("/api/[id]/x", "/api/9/x", True), ("/api/<int:user_id>", "/api/4", True), ("/api/<id>", "/api/4/5", False), ("/api/a.c", "/api/abc", False), ("/:any/x", "/q/x", True)])
def test_api_matching(make, path, url, hit):
    routes = make([("q::r", "q", path)], "id string, project string, path string")
    calls = make([("p::c", "p", url), ("q::c", "q", url), ("p::d", "p", None)], "id string, project string, url string")
    assert rows(enrich.match_api_calls(calls, routes).select("source", "target")) == ([("p::c", "q::r")] if hit else [])


def test_shared_entities(make):
    nodes = build.collapse_nodes(make([node("e", "E", "entity", project="x"), node("a1", project="a"), node("a2", project="a"), node("b1", project="b"), node("c1", kind="external", project="c")], NODE))
    e = build.collapse_edges(make([edge("a2", "e", n=1), edge("a1", "e", n=2), edge("e", "b1", n=3), edge("c1", "e", n=4), edge("a1", "b1", "calls", 5)], EDGE))
    shared = enrich.shared_entities(e, nodes)
    assert [(r[0], r[1], r[2]) for r in shared.collect()] == [("a1", "b1", ["E"])]
    assert ("a1", "b1", "calls", "E") in [(r["source"], r["target"], r["relation"], r["shared_entities"]) for r in enrich.annotate_or_insert(e, shared).collect()]


def test_empty_graph(make):
    nodes, edges = build.collapse_nodes(make([], NODE)), build.collapse_edges(make([], EDGE))
    assert rows(analyze.graph_stats(nodes, edges)) == [(0, 0, 0, 0.0)]
    assert analyze.folder_coupling(nodes, edges).count() == 0
    assert connected_components(edges, "source", "target").count() == 0
    assert traverse.label_propagation(edges).count() == 0
    assert traverse.louvain(edges).count() == 0


def test_walks(make):
    e = build.collapse_edges(make([edge("a", "b", n=1), edge("b", "c", n=2), edge("c", "a", n=3), edge("a", "d", n=4), edge("d", "c", n=5), edge("c", "c", n=6)], EDGE))
    start = make([("a",)], "id string")
    assert rows(traverse.downstream(e, start, 2)) == [("b", 1), ("c", 2), ("d", 1)]
    assert rows(traverse.upstream(e, start)) == [("c",)]
    assert rows(traverse.shortest_path(e, "a", "c")) == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(traverse.shortest_path(e, "a", "a")) == [(0, "a")]
    assert traverse.shortest_path(e, "a", "zzz").count() == 0


def test_cohesion_and_louvain(make):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    e = build.collapse_edges(make([edge(a, b, n=i) for i, (a, b) in enumerate(pairs)], EDGE))
    groups = traverse.louvain(e)
    assert rows(groups) == [(n, "a" if n < "m" else "x") for n in "abcxyz"]
    assert traverse.modularity(e, groups) > 0.3
    assert rows(analyze.cohesion(e, groups)) == [("a", 3, 1, 0.75), ("x", 3, 1, 0.75)]
    assert {r["community"] for r in traverse.consecutive(groups).collect()} == {0, 1}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=20))
def test_components_against_union_find(make, pairs):
    parent = list(range(15))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(make(pairs, "a int, b int"), "a", "b").collect()}
    used = {x for p in pairs for x in p}
    assert got == {x: min(y for y in used if find(y) == find(x)) for x in used}


def test_search(make):
    nodes = build.collapse_nodes(make([node("p::Ledger"), node("p::other")], NODE))
    e = build.collapse_edges(make([edge("p::Ledger", f"t{i}", n=i) for i in range(8)], EDGE))
    assert serve.search(nodes, e, "ledg").count() == 5
    with pytest.raises(ValueError, match="term"):
        serve.search(nodes, e, "")


@pytest.mark.parametrize(("given_", "expected"), [("a.b.C", "C"), ("./x/y.service.ts", "y.service"), ("react", "react"), ("com/x/Y.java", "Y")])
def test_import_label(make, given_, expected):
    assert make([(given_,)], "p string").select(fn.import_label(F.col("p"))).first()[0] == expected


def test_text_functions(make):
    df = make([("'/api/'", "/users/", "PostMapping", '<tag gorm:"primaryKey;column:x">', "(admin)/[id]/[...rest]/index")], "a string, b string, c string, d string, e string")
    got = df.select(fn.join_path(F.col("a"), F.col("b"), F.lit(None)), fn.http_method(F.col("c")), fn.gorm_tag(F.col("d")), fn.route_segments(F.col("e")), fn.http_method(F.lit("")), fn.strip_quotes(F.lit("`x`")), fn.markdown_link(F.lit("A"), F.lit("a b.md")), fn.wikilinks(F.lit("[[X]] [[Y|z]]"))).first()
    assert tuple(got) == ("/api/users", "POST", ["gorm:primaryKey", "gorm:column:x"], "/:id/*", "ANY", "x", "[A](a%20b.md)", ["X", "Y"])
    urls = make([("fetch('/api/a?x=1'); axios.get(\"/b#t\"); client.post(`/c`); url: '/d'; x = '/api/e'; fetch('http://z')",)], "t string").select(fn.extract_urls(F.col("t"))).first()[0]
    assert sorted(urls) == ["/api/a", "/api/e", "/b", "/c", "/d"]
    assert make([('invoke<T>("save"); ipcRenderer.send("log-it")',)], "t string").select(fn.extract_commands(F.col("t"))).first()[0] == ["save", "log-it"]


def test_louvain_raises_rather_than_stop_early(make):
    e = build.collapse_edges(make([edge(a, b, n=i) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])], EDGE))
    with pytest.raises(RuntimeError, match="settle"):
        traverse.louvain(e, 1, 1)


def tangled(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def gains(pairs, groups, moves):
    """The greatest change of the modularity, times 4 m * m, by one of ``moves``: a set of nodes and the group it joins."""
    m, k = len(pairs), Counter(x for p in pairs for x in p)

    def quality(g):
        weight = Counter()
        for x in k:
            weight[g[x]] += k[x]
        return 4 * m * sum(g[a] == g[b] for a, b in pairs) - sum(w * w for w in weight.values())

    return max(quality({**groups, **dict.fromkeys(nodes, to)}) - quality(groups) for nodes, to in moves)


def test_louvain_jobs_do_not_grow_with_its_moves(spark, make):
    pairs = tangled(150, 600, 3)
    e = make([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "source string, target string")
    spark.sparkContext.setJobGroup("louvain", "")
    groups = {int(r["id"][1:]): int(r["community"][1:]) for r in traverse.louvain(e).collect()}
    n_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n_jobs < 60
    assert groups.keys() == {x for p in pairs for x in p} and all(c == min(x for x in groups if groups[x] == c) for c in groups.values())
    names = sorted(set(groups.values()))
    assert gains(pairs, groups, [({x}, c) for x in groups for c in names]) <= 0
    assert gains(pairs, groups, [({x for x in groups if groups[x] == a}, c) for a in names for c in names]) <= 0


def test_louvain_spread_over_blocks(monkeypatch, make):
    pairs = tangled(24, 50, 4)
    monkeypatch.setattr(traverse, "ONE_TASK", 20)
    e = make([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "source string, target string")
    groups = {int(r["id"][1:]): int(r["community"][1:]) for r in traverse.louvain(e).collect()}
    assert groups.keys() == {x for p in pairs for x in p}
    names = sorted(set(groups.values()))
    assert len(names) < 12 and gains(pairs, groups, [({x for x in groups if groups[x] == a}, c) for a in names for c in names]) <= 0


def test_merged_links():
    pairs, group = tangled(30, 200, 5), np.arange(30) % 4
    weight = {p: i + 1 for i, p in enumerate(pairs)}
    both = sorted([(a, b, w) for (a, b), w in weight.items()] + [(b, a, w) for (a, b), w in weight.items()])
    start = np.concatenate([[0], np.cumsum(np.bincount([a for a, _, _ in both], minlength=30))])
    links = settle.Links(start, np.array([b for _, b, _ in both], dtype=np.int32), np.array([w for *_, w in both]), np.arange(30))
    merged = links.merged(group, 4)
    got = {(u, int(v)): int(w) for u in range(4) for v, w in zip(merged.near[merged.start[u] : merged.start[u + 1]], merged.weights[merged.start[u] : merged.start[u + 1]], strict=True)}
    expected = Counter()
    for (a, b), w in weight.items():
        if group[a] != group[b]:
            expected[group[a], group[b]] += w
            expected[group[b], group[a]] += w
    assert got == expected
    assert merged.own.tolist() == [sum(w for (a, b), w in weight.items() if group[a] == group[b] == c) + sum(x for x in range(30) if group[x] == c) for c in range(4)]
    assert merged.strength().sum() == links.strength().sum() == 2 * (sum(weight.values()) + sum(range(30)))
