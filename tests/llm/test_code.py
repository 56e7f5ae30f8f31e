"""Files that don't parse, and files that nobody wrote by hand."""

import ast
import random
import re
import warnings

import pytest

from codeloom.llm import grammar, provenance, syntax

#: Share of broken Python programs that the productions may let pass: errors that need more than tokens and nesting.
MISSED = 0.1

GOOD = {
    "py": [
        "", "x = 1\n", "def f(a, *, b=2) -> int:\n    if a:\n        return [x for x in a if x]\n    else:\n        pass\n", "class A(B):\n    '''doc'''\n    @p\n    async def g(self):\n        try:\n            await x\n        except (A, B) as e:\n            raise C from e\n        finally:\n            del y\n",
        "a = {'k': 1, **b}\r\nprint(f'{a}')\r\n", "x = lambda q, r=1: q if r else -q\nfor i, j in z:\n\tcontinue\n", "with open(f) as g, h: pass\nassert x, 'y'\ny: int = 3\n", "x = '''\n<<<<<<< HEAD\n'''\n", "match x:\n    case [1, 2]:\n        pass\n",
    ],
    "java": [
        "", "package a.b;\nimport java.util.*;\npublic class A<T extends B & C> extends D implements E, F {\n  @Ann(x = 1) private final Map<String, List<Long>> m = new HashMap<>();\n  public A(int... x) throws E { this.x = (long) y; }\n  <R> R f(List<? super T> q) { for (int i = 0; i < 3; i++) { a[i] += q.get(i) >> 2; } return x ? y : z; }\n}\n",
        "enum C { A(1), B(2) { void f() { } }; private final int x; C(int x) { this.x = x; } }", "interface I { int f(); default void g() { run(() -> { h(); }); } }", "record P(int x, String y) { }", "class S { int f(Object o) { try (R r = new R()) { } catch (A | B e) { throw e; } finally { } return switch (x) { case 1, 2 -> 3; default -> 4; }; } }",
        "class T { String s = \"\"\"\n  <<<<<<< x\n  \"\"\"; int[] a = {1, 2}, b[] = {}; Runnable r = T::new; boolean q = o instanceof String t && t.isEmpty(); }", "class U { void f() { do { x--; } while (x > 0); outer: for (var y : z) { if (a) break outer; else continue; } synchronized (this) { } } }",
    ],
    "js": [
        "", "import a, { b as c } from 'x';\nexport default class A extends B { #p = 1; static async *g() { yield* h(); } get x() { return this.#p; } }\n", "const f = async (a, { b = 1 }, ...c) => ({ ...a, [b]: c?.d ?? 2 });\nlet re = /[/{]\\//g.test(x) / 2\nlabel: for (const k of y) { if (!k) continue label; else break }\n",
        "!function(e,t){for(var n=0;n<3;n++)e(t[n]);return t?e:n}(a,b);var x=y?1:2,z", "const t = `\n<<<<<<< a\n${x ? `y` : z}\n`\nswitch (a) { case 1: b(); break; default: c() }\n", "try { a() } catch { b() } finally { c() }\ndo x++; while (x < 3)\nexport { q } from './q'\nexport * as r from 'r'\n", "if (a) b(); else if (c) d(); else { e() }\nnew Foo().bar`x`\nvoid 0, typeof x, delete y.z\n",
    ],
    "ts": [
        "", "export interface A<T = any> extends B<T> { x?: string; readonly y: number[]; [k: string]: any; f(a: A): void; (q: T): U }\n", "type M = { a: 1 } | 'b' & keyof typeof c;\nexport enum E { A = 1, B }\nabstract class C<T> implements D { constructor(private readonly r: Map<string, T>) { super() } protected x!: T; static async f<U>(a?: U): Promise<U[]> { return a as unknown as U[] } }\n",
        "const f = <T,>(x: T): x is string => x !== null\nfunction g(this: W, ...r: number[]): asserts r { }\ndeclare module 'x' { }\nlet v = w!.z satisfies Q\n", "@Injectable()\nexport class S { @Input() a: string = ''; get b(): number { return 1 } }\n", "const a = 1; export const b = () => { return a }\n",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T) F(a []int, b ...string) (int, error) {\n\tif x := f(); x != nil {\n\t\treturn 0, x\n\t} else if y {\n\t\tgo func() { z <- 1 }()\n\t}\n\tfor i, v := range a {\n\t\ta[i] = v << 2\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tswitch v := x.(type) {\n\tcase int, string:\n\t\tbreak\n\tdefault:\n\t}\n\tm := map[string]int{\"a\": 1}\n\tdefer m.f()\n\treturn len(m), nil\n}\n",
        "package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar s = `\n<<<<<<< x\n`\n\ntype I interface {\n\tF(int) string\n\tio.Reader\n}\n\nfunc G[T any](x T) T { return x }\n\nfunc h() {\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\n\tfor {\n\t}\n}\n",
    ],
}
BAD = {
    "py": ["def f(:\n", "x = (1,\n", "if a:\nb\n", "try:\n    a\n", "x = 'abc\n", "<<<<<<< HEAD\nx = 1\n=======\n", "const x = 1;\n", "def f():\n    return\n   x\n", "else:\n    a\n", "a b\n", "x =\n", "package main\n"],
    "java": ["class A {", "class A { void f() { int x = ; } }", "class A { }\n}", "class A { void f( { } }", "class A { String s = \"x; }", "<<<<<<< HEAD\nclass A { }\n>>>>>>> b\n", "def f(x):\n    return x\n", "void f() { }", "/* open\nclass A { }", "class A { void f() { try { } } }", "class A { void f() { return x return y; } }"],
    "js": ["function f() {", "const x = ;", "const a: string = 'x';", "let y = (1, 2;", "`open", "interface A { x: string }", "package a\n\nfunc f() {\n}\n", "=======\n", "x = {a: 1, b: }", "for (const x of ) { }", "def f(a):\n  return a\n"],
    "ts": ["export class A {", "interface A { x: }", "let a: = 1", "const s = 'x", "public class A { private final int x; }", "package a\n\nimport (\n\t\"x\"\n)\n", "function f(a: string { }", "import { a } form 'x'"],
    "go": ["", "// only words\n", "package a\n\nfunc f() {\n", "package a\n\nfunc f() {\n\tx := \n}\n", "func f() {}\n", "package a\n\nfunc f(x int {\n}\n", "class A { }\n", "package a\n\nfunc f()\n{\n}\n", "package a\n\n<<<<<<< x\n", "import { a } from 'b';\n"],
}


def verdict(ext, text):
    lang = syntax.EXTENSIONS[ext]
    pairs, signatures = syntax.lexer(lang).lex(text.replace("\r\n", "\n"))
    return not set(pairs) - grammar.permissible_pairs(lang) and all(syntax.valid_signature(lang, s) for s in signatures)


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, texts in GOOD.items() for t in texts])
def test_valid_text_is_accepted(ext, text):
    assert verdict(ext, text)


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, texts in BAD.items() for t in texts])
def test_invalid_text_is_found(ext, text):
    assert not verdict(ext, text)


def test_operator(spark):
    rows = [(f"/p/f{i}.{ext}", "p", t) for ext in GOOD for i, t in enumerate(GOOD[ext])]
    bad = [(f"/p/b{i}.{ext}", "q", t) for ext in BAD for i, t in enumerate(BAD[ext])]
    extra = [("/p/null.py", "p", None), ("/p/null.go", "p", None), (None, "p", "x"), ("/p/x.txt", "p", "(("), ("/p/long.py", "p", "x = 1\n" * 20_000)]
    table = spark.createDataFrame(rows + bad + bad[:3] + extra, "file_path string, project string, content string").selectExpr("*", "1 as lang")
    got = sorted(r["file_path"] for r in syntax.invalid_files(syntax.known_files(table.drop("lang"))).collect())
    assert got == sorted([b[0] for b in bad] + ["/p/null.go"])
    assert syntax.invalid_files(syntax.known_files(table.drop("lang").limit(0))).count() == 0


def test_broken_python_against_the_interpreter():
    """Of edited programs, no valid one is condemned, and few broken ones are missed."""
    rng = random.Random(1)
    broken, missed, wrong = 0, [], []
    for text in GOOD["py"]:
        for _ in range(60):
            cut = list(text)
            if cut:
                at = rng.randrange(len(cut))
                cut[at : at + rng.randrange(1, 4)] = rng.choice(["", "", ":", ")", "(", "\n"])
            edited = "".join(cut)
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(edited)
            except (SyntaxError, ValueError):
                broken += 1
                if verdict("py", edited):
                    missed.append(edited)
            else:
                if not verdict("py", edited):
                    wrong.append(edited)
    assert broken > 200 and len(missed) <= MISSED * broken and not wrong, (len(missed), broken, missed[:5], wrong[:5])


def body(seed, n=60):
    rng = random.Random(seed)
    return "\n".join(f"def f{i}(a, b):\n    x{i} = a.{rng.choice('pqrstuv')}({rng.randrange(10**6)}, '{rng.randrange(10**6)}') {rng.choice('+-*/')} b\n    return x{i}" for i in range(n // 3))


def made(spark, rows, items=()):
    files = syntax.known_files(spark.createDataFrame(rows, "file_path string, project string, content string"))
    vendor = spark.createDataFrame(list(items), "item_id long, lib_name string, version string, file_name string, language string, content string")
    return {r["file_path"]: r["kind"] for r in provenance.provenance(files, vendor).collect()}


def irregular(seed):
    """Code in which no lines repeat at a distance."""
    rng = random.Random(seed)
    forms = ["{a} = {b}.{c}({n})", "if {a} > {n}:\n    {b} = '{n}'", "for {a} in {b}:\n    {c} += {n}", "print({a}, {b}, '{n}')", "{a}[{n}] = ({b}, {c})", "while {a}:\n    break", "assert {a} != '{n}', {b}", "del {a}.{b}"]
    return "\n".join(rng.choice(forms).format(a=rng.choice("abcd"), b=rng.choice("efgh"), c=rng.choice("ijkl"), n=rng.randrange(10**6)) for _ in range(60)) + "\n"


def accessors(seed, n=30):
    """Units of one template with ever new names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    return "class X:\n" + "".join(f"    def get_{w}(self):\n        return self._d[{k}]\n\n    def set_{w}(self, v):\n        self._d[{k}] = v\n\n" for k, w in ((k, word()) for k in range(n)))


def test_kinds(spark):
    lib = irregular(1)
    rows = [
        ("/r/a/x.py", "a", lib), ("/r/a/x.py", "a", lib), ("/r/b/deep/y.py", "b", "# ours now\n" + lib.replace("print(", "show(", 1)), ("/r/c/own.py", "c", irregular(2)), ("/r/c/own_copy.py", "c", irregular(2)), ("/r/d/vendors/z.py", "d", irregular(4)),
        ("/r/a/gen.py", "a", accessors(5)), ("/r/a/said.py", "a", "s = '# Code generated by tool. DO NOT EDIT.'\n" + irregular(8)), ("/r/a/meeting.py", "a", "the notes of a meeting say that we " * 30),
        ("/r/a/data.py", "a", "T = [" + ", ".join(str(i * 7919) for i in range(200)) + "]\n"), ("/r/a/min.js", "a", "var " + ",".join(f"a{i}=b{i * i}(c,{i}?d:e{'+f' * (i % 7)}{'*g.h' * (i % 5)})" for i in range(80)) + ";"), ("/r/a/empty.py", "a", ""), ("/r/b/empty.py", "b", None), (None, "a", lib), ("/r/z/none.py", None, irregular(13)),
    ]
    got = made(spark, rows, [(1, "libx", "1", "k.py", "python", irregular(9)), (None, "n", "1", "n.py", "python", irregular(2)), (2, "u", "1", "u.txt", "text", "x"), (3, "v", "1", None, "python", "y")])
    assert got == {"/r/a/x.py": "vendored", "/r/b/deep/y.py": "vendored", "/r/a/gen.py": "generated", "/r/a/data.py": "data", "/r/a/min.js": "minified"}
    assert made(spark, [("/r/e/w.py", "e", irregular(9))], [(1, "libx", "1", "k.py", "python", irregular(9))]) == {"/r/e/w.py": "vendored"}
    cut = irregular(9)[: len(irregular(9)) // 3]
    assert made(spark, [("/r/e/cut.py", "e", cut), ("/r/e/other.py", "e", irregular(11))], [(1, "libx", "1", "k.py", "python", irregular(9))]) == {"/r/e/cut.py": "vendored"}
    assert made(spark, []) == {}


def test_comments_and_folders_are_learned_from_clusters(spark):
    rows = [(f"/r/a/g{k}.py", "a", "# made by the stubmill 1.2, leave it alone\n" + accessors(60 + k)) for k in range(4)]
    rows += [(f"/r/b/h{k}.py", "b", f"# made by the stubmill 3.{k}, leave it alone\n" + irregular(70 + k)) for k in range(3)]
    rows += [(f"/r/c/i{k}.py", "c", "# the house licence of the firm holds here\n" + irregular(80 + k)) for k in range(6)]
    for k in range(6):  # of each library one copy in two projects
        rows += [(f"/r/{p}/outside/lib{k}/l{k}.py", p, irregular(90 + k)) for p in ("d", "e")]
    rows += [("/r/d/outside/other/o.py", "d", irregular(99)), ("/r/d/inside/other/o.py", "d", irregular(98)), ("/r/d/x/outside.py", "d", irregular(97))]
    got = made(spark, rows)
    assert {p for p, k in got.items() if k == "generated"} == {f"/r/a/g{k}.py" for k in range(4)} | {f"/r/b/h{k}.py" for k in range(3)}
    assert {p for p, k in got.items() if k == "vendored"} == {p for p, _, _ in rows if "/outside/" in p}


def test_clusters_find_what_brute_force_finds(spark):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        lines = irregular(100 + k).splitlines()
        for v in range(4):
            own = list(lines)
            for _ in range(v):
                own[rng.randrange(len(own))] = "pass"
            rows.append((f"/r/{k}_{v}.py", f"p{v}", "\n".join(own)))
    files = syntax.known_files(spark.createDataFrame(rows, "file_path string, project string, content string"))
    prints = provenance.fingerprints(files)
    names = {r["f"]: r["file_path"] for r in files.selectExpr("xxhash64(file_path) as f", "file_path").collect()}
    group = {names[r["fid"]]: r["cluster"] for r in provenance.clusters(prints, files)[0].collect()}
    sets = {}
    for path, _, text in rows:
        found = provenance.tokens("python", text)
        hidden, plain, _ = provenance.coded(*provenance.words_of(found, provenance.classes("python", found)))
        sets[path] = (set(provenance.Shingles([hidden]).of(0).tolist()), set(provenance.Shingles([plain]).of(0).tolist()))
    close = lambda a, b: len(a & b) / len(a | b)
    pairs = [(a, b) for a in sets for b in sets if a < b and close(sets[a][0], sets[b][0]) >= 0.8 and close(sets[a][1], sets[b][1]) >= 0.6]
    hit = sum(group.get(a) is not None and group.get(a) == group.get(b) for a, b in pairs)
    assert hit >= 0.9 * len(pairs) > 0
    for a in group:
        for b in group:
            if group[a] == group[b]:
                assert a.split("_")[0] == b.split("_")[0]


def test_copies_of_files_that_tell_of_themselves(spark):
    code = irregular(21)
    spaced = "var " + ", ".join(f"a{i} = b{i * 37 % 11}(c, {i}, d, e)" for i in range(80)) + ";"
    tight = spaced.replace(", ", ",").replace(" = ", "=")
    rows = [("/r/a/gen.py", "a", "# Code generated by tool 1. DO NOT EDIT.\n" + code), ("/r/b/bare.py", "b", code), ("/r/a/lib.min.js", "a", tight), ("/r/b/lib.js", "b", spaced), ("/r/b/own.py", "b", irregular(23))]
    got = made(spark, rows + [("/r/a/units.py", "a", accessors(22))])
    assert set(got) == {"/r/a/gen.py", "/r/b/bare.py", "/r/a/lib.min.js", "/r/b/lib.js", "/r/a/units.py"}
    assert got["/r/b/bare.py"] == "vendored" and got["/r/a/units.py"] == "generated"


def test_bands_reach_the_least_similarities():
    rng = random.Random(4)
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    hit = []
    for seed in range(400):
        found = provenance.tokens("python", irregular(1000 + seed))
        words, row = provenance.words_of(found, provenance.classes("python", found))
        other = [f"n{rng.random()}" if kind == "i" and rng.random() < 0.09 else word for word, kind in zip(words, row)]
        for k in range(len(other)):
            if rng.random() < 0.02:
                other[k], row = str(rng.random()), row[:k] + "n" + row[k + 1 :]
        both = [provenance.coded(words, provenance.words_of(found, provenance.classes("python", found))[1])[:2], provenance.coded(other, row)[:2]]
        hidden, plain = provenance.Shingles([x for x, _ in both]), provenance.Shingles([x for _, x in both])
        if 0.8 <= near(hidden.of(0), hidden.of(1)) < 0.85 and 0.6 <= near(plain.of(0), plain.of(1)) < 0.7:
            keys = provenance.band_keys(hidden, plain)
            hit.append(bool((keys[0] == keys[1]).any()))
    assert len(hit) >= 40
    assert sum(hit) >= 0.95 * len(hit)


def test_every_family_of_a_band_is_found(spark):
    from pyspark.sql import functions as F

    rows = [(f"/r/{k}_{v}.py", f"p{v}", irregular(300 + k) + "x = 1\n" * v) for k in range(4) for v in range(3)]
    files = syntax.known_files(spark.createDataFrame(rows, "file_path string, project string, content string"))
    prints = provenance.fingerprints(files).withColumn("bands", F.expr("array(7L)"))
    names = {r["f"]: r["file_path"] for r in files.selectExpr("xxhash64(file_path) as f", "file_path").collect()}
    groups = {}
    for r in provenance.clusters(prints, files)[0].collect():
        groups.setdefault(r["cluster"], set()).add(names[r["fid"]])
    assert sorted(map(sorted, groups.values())) == [[f"/r/{k}_{v}.py" for v in range(3)] for k in range(4)]


def test_siblings_within_a_project_are_generated(spark):
    def named(k):
        words = re.sub(r"\b[a-l]\b", lambda m: f"{m[0]}{k}", irregular(31)) if k else irregular(31)
        return re.sub(r"\d{3,}", lambda m: str(int(m[0]) + k), words, count=5)

    rows = [(f"/r/a/s{k}.py", "a", named(k)) for k in range(4)] + [(f"/r/b/e{k}.py", "b", irregular(32) + "x = 1\n" * k) for k in range(4)] + [(f"/r/c/two{k}.py", "c", irregular(33 + k)) for k in range(2)]
    assert made(spark, rows) == {f"/r/a/s{k}.py": "generated" for k in range(4)}


def test_no_pair_that_joins_parts_is_left_out(spark):
    """In a band of 20, members close to a lead are close to others too, and the chains from there reach all others."""
    from pyspark.sql import functions as F

    from codeloom.operators.components import connected_components

    def settled(rows, close, parts=provenance.parts_by_kind):
        pairs = spark.createDataFrame([(max(p), min(p), kind) for p, kind in close], "a long, b long, kind string")
        verify = lambda met: met.join(pairs, (F.greatest("fid", "lead") == F.col("a")) & (F.least("fid", "lead") == F.col("b")) & (met["kind"] == pairs["kind"])).select("fid", "lead", met["kind"])
        return provenance.settle_bands(spark.createDataFrame(rows, "fid long, band long, kind string"), verify, parts)

    one = [(k, 7, "copy") for k in range(1, 21)]
    # 10 and 11 are close to leads 1 and 2; only the pair of them joins the two
    chain = [((1, 10), "copy"), ((10, 11), "copy"), ((2, 11), "copy"), ((12, 13), "copy"), ((12, 10), "copy"), ((19, 20), "copy"), ((5, 20), "copy")]
    groups = {}
    for r in connected_components(settled(one, chain), "fid", "lead").collect():
        groups.setdefault(r["component"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 10, 11, 12, 13], [5, 19, 20]]
    # 9 is a copy of lead 1, which says nothing of its siblings
    both = one + [(k, 8, "sibling") for k in range(1, 21)]
    got = {(frozenset((r["fid"], r["lead"])), r["kind"]) for r in settled(both, [((1, 9), "copy"), ((9, 15), "sibling")]).collect()}
    assert got == {(frozenset((1, 9)), "copy"), (frozenset((9, 15)), "sibling")}
    # where only being linked counts: 15 is close to nothing but 9, and 9 to a lead
    ends = lambda pairs: pairs.select(F.explode(F.array("fid", "lead")).alias("fid"), "kind").distinct().withColumn("part", F.lit(0).cast("long"))
    linked = settled(one, [((1, 9), "copy"), ((9, 15), "copy")], ends).select(F.explode(F.array("fid", "lead")).alias("id")).distinct()
    assert sorted(r["id"] for r in linked.collect()) == [1, 9, 15]


def test_a_file_listed_twice_is_no_family(spark):
    rows = [("/r/a/again.py", "a", "a.b(c, d)\n" * 100), ("/r/a/own.py", "a", irregular(41))]
    assert made(spark, rows * 2) == made(spark, rows) == {}


def test_lexed_in_arrays_as_token_by_token():
    texts = [("python", "# head\n\n" + irregular(42) + "# end"), ("java", "/* a */ int x = 1; // N\nfinal String N = \"s\";\n"), ("go", ""), ("javascript", "// only")]
    for lang, text in texts:
        found = provenance.tokens(lang, text)
        kinds = provenance.classes(lang, found)
        *got, quiet = provenance.lexed(lang, found)
        for a, b in zip(got, provenance.coded(*provenance.words_of(found, kinds))):
            assert a.tolist() == b.tolist()
        assert quiet.tolist() == [k for k, kind in enumerate(kinds) if not kind or kind == "N"]


def test_files_are_fingerprinted_in_arrays():
    """Together as one by one, and without a call for each token or line; the calls are counted, as seconds would vary."""
    import cProfile
    import gc
    import pstats

    import pyarrow as pa

    def prints(rows):
        return [r for b in provenance._fingerprints(iter([pa.RecordBatch.from_pylist(rows, schema)])) for r in b.to_pylist()]

    schema = pa.schema([(c, pa.string()) for c in ("file_path", "project", "lang", "content")])
    texts = [("java", "/* it holds a note */\n\nint x = 1;\r\n// of two words\n  \n"), ("javascript", "x = `a\n${b}` /c\n/d\n\n<<<<<<< here\n"), ("go", " \n\n"), ("go", None), ("python", "# a head of words\n\n" + accessors(43)), ("typescript", "const a = 1 /* open \n ")]
    rows = [{"file_path": f"/r/{k}", "project": None, "lang": lang, "content": text} for k, (lang, text) in enumerate(texts)]
    own = lambda r: r | {"head": sorted(r["head"]), "said": sorted(r["said"])}
    together = list(map(own, prints(rows)))
    assert together == [own(prints([r])[0]) for r in rows]
    assert together[4]["units"] and together[4]["head"] and not together[2]["n_tokens"] and not together[3]["said"]
    for lang, text in texts:
        assert provenance.without_line_ends(lang, text or "") == [t for t in provenance.tokens(lang, text or "") if lang == "python" or t != "\n"]
    many = [{"file_path": f"/r/{k}", "project": "p", "lang": "python", "content": irregular(k)} for k in range(200)]
    prints(many)
    gc.collect()
    gc.disable()  # else Spark's own objects are cleared meanwhile, and their calls counted
    try:
        with cProfile.Profile() as calls:
            prints(many)
    finally:
        gc.enable()
    assert pstats.Stats(calls).total_calls < 60 * len(many)


def test_similarities_at_the_bound(spark):
    rows = [(list(range(a)), list(range(a - common, a - common + b)), common / (a + b - common)) for a in range(1, 13) for b in range(1, 13) for common in range(min(a, b) + 1)]
    pairs = spark.createDataFrame(rows, "a array<long>, b array<long>, jaccard double")
    for least in (provenance.SIMILAR, provenance.PLAIN_SIMILAR, provenance.SIBLING_SIMILAR):
        assert pairs.where(provenance.near_enough("a", "b", least) != (pairs["jaccard"] >= least)).count() == 0
