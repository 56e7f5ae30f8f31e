"""Dangling references, changed records and hot keys, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import changes, hotkeys, intervals, ledger, orphans, skew

DAY = dt.datetime(2024, 1, 1)
REFS = "ref_table string, ref_field string, ref_id long, key_kind string, key string, seen_at timestamp_ntz"
SPANS = "kind_key string, born timestamp_ntz, gone timestamp_ntz"
NODES = "id string, label string, first_seen_at timestamp_ntz, removed_at timestamp_ntz"


def at(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def test_merge_intervals(make):
    rows = [("a", 1, 3), ("a", 2, 5), ("a", 5, 6), ("a", 9, None), ("a", 9, 12), ("b", 4, 4), ("b", 7, 8), ("b", 7, 8), (None, 1, 2), ("c", None, 3)]
    got = intervals.merge_intervals(make([(k, a, b) for k, a, b in rows], "k string, lo int, hi int"), ["k"], "lo", "hi", F.col("lo") % 3)
    assert sorted(got.collect(), key=str) == sorted([("a", 1, 6), ("a", 9, None), ("b", 7, 8), (None, 1, 2)], key=str)


def test_orphans_against_brute_force(make):
    rng = random.Random(3)
    names = [f"k{i}" for i in range(12)] + ["hot"]
    nodes = [(rng.choice(names), rng.choice(names), at(a := rng.randrange(40)), at(a + rng.randrange(1, 20)) if rng.random() < 0.6 else None) for _ in range(25)]
    refs = [("edges", "target", i, rng.choice(["id", "label"]), "hot" if rng.random() < 0.4 else rng.choice([*names, "gone", None]), at(rng.choice([*range(60), None]))) for i in range(400)]
    got = orphans.orphan_references(make(refs, REFS), orphans.life_spans(make(nodes, NODES)))

    def alive(kind, key, moment):
        return moment is not None and any((n[0] if kind == "id" else n[1]) == key and n[2] <= moment and (n[3] is None or moment < n[3]) for n in nodes)

    expected = sorted(r[2] for r in refs if r[4] is not None and not alive(r[3], r[4], r[5]))
    assert sorted(r["ref_id"] for r in got.collect()) == expected


def test_orphans_of_empty_tables(make):
    spans = orphans.life_spans(make([], NODES))
    assert orphans.orphan_references(make([], REFS), spans).count() == 0
    assert orphans.orphan_references(make([("edges", "target", 1, "id", "x", at(1))] * 2, REFS), spans).count() == 2
    report = orphans.orphan_report(make([("edges", "target", 1, "id", "x", at(1))] * 2, REFS), spans).collect()
    assert [(r["period"], r["n_refs"], r["n_orphans"]) for r in report] == [("2024-01", 1, 1)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_balanced_join_is_a_join(make, how):
    rng = random.Random(5)
    left = make([(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}" if rng.random() < 0.9 else None) for i in range(2000)], "n int, k string")
    right = make([("hot", 1), ("k1", 2), ("k1", 3), ("k5", 4), (None, 5)], "k string, v int")
    plan = skew.plan_loads(left, "k", 8)
    assert len({t for key, shards, _ in plan.heavy if key == "hot" for t in shards}) > 1
    got = skew.balanced_join(left, right, "k", how, F.col("n"), plan)
    want = left.join(right, "k", how)
    assert sorted(map(str, got.select("n").collect())) == sorted(map(str, want.select("n").collect()))


def test_plan_splits_in_proportion(make):
    rows = [("a",)] * 600 + [("b",)] * 250 + [(f"s{i}",) for i in range(150)]
    plan = skew.plan_loads(make(rows, "k string"), "k", 10)
    shards = {k: len(s) for k, s, _ in plan.heavy}
    assert shards["a"] == 6 and shards["b"] == 3
    assert max(plan.loads) <= 1.5 * 100


HUB_NODES = "id string, label string, project string, source_file string, first_seen_at timestamp_ntz"


def test_hot_keys(make):
    ddl = "edge_id long, source string, target string, relation string, source_file string, seen_at timestamp_ntz, ingested_at timestamp_ntz"
    rows = [(i, "s", "hot" if i < 30 else f"t{i}" if i < 95 else None, "imports_from" if i < 50 else "calls", "f" if i < 10 else None, at(1), at(2)) for i in range(100)]
    nodes = make([("hot", "Hot", "p", "f", at(1)), ("hot", "Hot", "p", "f", at(1)), ("h2", "H2", "p", "f", None)], HUB_NODES)
    got = hotkeys.hot_keys(make(rows + rows[:40], ddl), nodes, 0.04).collect()
    assert sorted((r["key_field"], r["key_value"], r["label"], r["n_edges"]) for r in got) == [("edges.source_file", "f", "2", 10), ("edges.target", "hot", "Hot", 30)]
    assert hotkeys.hot_keys(make([], ddl), nodes.limit(0)).count() == 0


def test_rows_lie_where_the_plan_says(make):
    """The load plan is executed: partitions hold what it promises, and no second shuffle scatters them again."""
    rows = [("hot", i) for i in range(6000)] + [("warm", i) for i in range(2500)] + [(f"k{i % 700}", i) for i in range(9000)]
    df = make(rows, "k string, n long")
    plan = skew.plan_loads(df, "k", 8)
    placed = plan.place(plan.scatter(df, "k", F.col("n")))
    sizes = {r["p"]: r["c"] for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    mean = len(rows) / 8
    assert len(sizes) == 8 and max(sizes.values()) <= 1.2 * mean and min(sizes.values()) >= 0.8 * mean
    assert placed.where(F.spark_partition_id() != F.col("_task")).count() == 0
    right = make([(k, k.upper()) for k in {r[0] for r in rows}], "k string, name string")
    joined = skew.balanced_join(df, right, "k", "inner", F.col("n"), plan, keep_task=True)
    result = skew.aggregate_placed(joined, "k", {"c": ("count", F.lit(1))})
    assert {r["k"]: r["c"] for r in result.where("k in ('hot', 'warm', 'k1')").collect()} == {"hot": 6000, "warm": 2500, "k1": 13}
    text = result._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 2 and text.count("Exchange") - text.count("BroadcastExchange") <= 4, text


def test_a_run_that_dies_between_output_and_commit_is_done_again(make, spark, tmp_path, monkeypatch):
    waves = make([(i, at(i), "ok") for i in range(1, 9)], WAVES)
    rows = [(i, 1 + i % 8, f"f{i % 5}", f"h{i}") for i in range(1, 31)]
    book = changes.latest_records(spark, f"file://{tmp_path}/dies")
    early, whole = (make(r, LOG).join(waves, "wave_id") for r in ([r for r in rows if r[0] % 3], rows))
    book.run(early, "result_id")
    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            book.run(whole, "result_id")
    assert book.ledger.latest().number == 1  # the output without a commit doesn't count
    todo = book.ledger.pending(whole, "result_id", book.ledger.gaps(whole, "result_id"))
    assert sorted(r["result_id"] for r in todo.collect()) == [r[0] for r in rows if r[0] % 3 == 0]
    assert book.run(whole, "result_id").number == 2
    once = changes.latest_records(spark, f"file://{tmp_path}/once2")
    once.run(whole, "result_id")
    assert sorted(map(str, book.state().collect())) == sorted(map(str, once.state().collect()))
    (tmp_path / "dies" / "commits" / "3.json").write_text('{"ranges": ')  # a commit whose writing broke off
    assert book.ledger.latest().number == 2 and book.run(whole, "result_id") is None


def test_outputs_are_compacted(make, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "COMPACT", 2)
    book = changes.latest_records(spark, f"file://{tmp_path}/many")
    waves = make([(i, at(i), "ok") for i in range(1, 9)], WAVES)
    for k in range(1, 5):
        book.run(make([(i, 1 + i % 8, f"f{i % 3}", f"h{i}") for i in range(1, 5 * k)], LOG).join(waves, "wave_id"), "result_id")
    assert len(book.ledger.latest().outputs) <= 2
    assert book.state().count() == 3


def test_target_degrees_keeps_targets_without_node(make):
    edges = make([(1, "a", "x", "calls", "f", at(1), at(1)), (1, "a", "x", "calls", "f", at(1), at(2)), (2, "b", "x", "calls", "f", at(1), at(1)), (3, None, "y", "calls", None, at(1), at(1)), (4, "a", None, "calls", None, at(1), at(1))], "edge_id long, source string, target string, relation string, source_file string, seen_at timestamp_ntz, ingested_at timestamp_ntz")
    nodes = make([("x", "X", "p", "/r/d/f.py", at(2)), ("x", "W", "p", "/r/e/f.py", at(1))], "id string, label string, project string, source_file string, first_seen_at timestamp_ntz")
    got = {r["target"]: tuple(r)[1:] for r in hotkeys.target_degrees(edges, nodes).collect()}
    assert got == {"x": ("W", "p", "/r/e", 2, 2), "y": (None, None, None, 1, 0)}


LOG = "result_id long, wave_id long, file_path string, content_hash string"
WAVES = "wave_id long, started_at timestamp_ntz, status string"


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_files_to_extract(make, spark):
    files = make([("a", "1"), ("a", "1"), ("b", "2"), ("c", "3"), ("d", None), ("e", ""), (None, "x"), ("f", "6")], "file_path string, content string")
    log = make([(1, 1, "a", sha("1")), (1, 1, "a", sha("1")), (2, 1, "b", sha("old")), (3, 2, "b", sha("2")), (4, 3, "b", sha("bad")), (5, 1, "c", None), (6, 1, "e", sha("")), (None, 1, "f", sha("6")), (8, None, "f", sha("6"))], LOG)
    waves = make([(1, at(1), " OK "), (2, at(2), "ok"), (3, at(3), "failed"), (3, at(3), None)], WAVES)
    got = sorted(r[0] for r in changes.files_to_extract(spark, files, log, waves).collect())
    assert got == ["c", "d", "f"]


def test_ledger_runs_process_each_record_once(make, spark, tmp_path):
    waves = make([(i, at(i), "ok") for i in range(1, 9)], WAVES)
    rows = [(i, 1 + i % 8, f"f{i % 5}", f"h{i}") for i in range(1, 61)]
    folder = f"file://{tmp_path}/ledger"
    latest = changes.latest_records(spark, folder)
    first = make([r for r in rows if r[0] < 40 and r[0] % 7], LOG).join(waves, "wave_id")
    assert latest.run(first, "result_id") is not None
    assert latest.run(first, "result_id") is None
    second = make(rows, LOG).join(waves, "wave_id")  # with late numbers below 40
    gaps = {n for r in latest.ledger.gaps(second, "result_id").collect() for n in range(r["lo"], r["hi"])}
    assert gaps == {r[0] for r in rows if not (r[0] < 40 and r[0] % 7)}
    latest.run(second, "result_id")
    assert [(r["lo"], r["hi"]) for r in latest.ledger.processed().collect()] == [(1, 61)]
    once = changes.latest_records(spark, f"file://{tmp_path}/once")
    once.run(second, "result_id")
    assert sorted(map(str, latest.state().collect())) == sorted(map(str, once.state().collect()))


def test_failed_run_leaves_no_commit(make, spark, tmp_path):
    book = changes.latest_records(spark, f"file://{tmp_path}/broken")
    log = make([(1, 1, "a", "h")], LOG).join(make([(1, at(1), "ok")], WAVES), "wave_id")
    with pytest.raises(Exception, match="stop"):
        book.run(log, "result_id", enrich=lambda df: (_ for _ in ()).throw(RuntimeError("stop")))
    assert book.ledger.latest().number == 0
    assert book.run(log, "result_id").number == 1


def test_two_runs_cannot_commit_the_same_number(make, spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/race")
    base = book.latest()
    ranges = ledger.sequence_ranges(make([(1,), (2,), (2,), (9,), (None,)], "n long"), "n")
    book.commit(base, ranges, [])
    with pytest.raises(RuntimeError, match="another run"):
        book.commit(base, ranges, [])
    assert sorted((r["lo"], r["hi"]) for r in book.processed().collect()) == [(1, 3), (9, 10)]


def test_nothing_extracted_yet(make, spark):
    files = make([("a", "1"), ("b", None)], "file_path string, content string")
    got = changes.files_to_extract(spark, files, make([], LOG), make([], WAVES))
    assert sorted(r[0] for r in got.collect()) == ["a", "b"]
    assert changes.files_to_extract(spark, files.limit(0), make([], LOG), make([], WAVES)).count() == 0


def test_extra_columns_with_clashing_names(make, spark):
    def more(df, *names):
        for name in names:
            df = df.withColumn(name, F.lit("x"))
        return df

    files = more(make([("a", "1")], "file_path string, content string"), "hash", "_path", "_hash", "started_at", "key")
    log = more(make([(1, 1, "a", sha("1"))], LOG), "started_at", "ok", "key", "_cell", "best", "status")
    waves = more(make([(1, at(1), "ok")], WAVES), "ok", "file_path", "content_hash", "result_id")
    assert changes.files_to_extract(spark, files, log, waves).count() == 0
    edges = more(make([(i, "a", "x", "imports_from", "f") for i in range(9)], "edge_id long, source string, target string, relation string, source_file string"), "_task", "key", "n", "key_value", "total", "node", "label", "folder")
    nodes = more(make([("x", "X", "p", "/r/f.py", at(1)), ("a", "A", "p", "/q/f.py", at(1))], "id string, label string, project string, source_file string, first_seen_at timestamp_ntz"), "target", "source", "_task", "folder", "node", "born")
    assert hotkeys.hot_keys(edges, nodes).count() == 2
    assert hotkeys.target_degrees(edges, nodes).first()["n_edges"] == 9
    assert sorted(r["degree"] for r in hotkeys.folder_degrees(edges, nodes).collect()) == [9, 9]
    seen = more(edges.withColumn("seen_at", F.lit(at(5)).cast("timestamp_ntz")), "ref_table", "born", "kind_key")
    refs = more(make([(1, "a", "Nope", at(5))], "ref_id long, source_node_id string, ref_name string, seen_at timestamp_ntz"), "key", "gone", "ref_field")
    spans = orphans.life_spans(nodes.withColumn("removed_at", F.lit(None).cast("timestamp_ntz")))
    assert [r["ref_field"] for r in orphans.orphan_references(orphans.references(seen, refs), spans).collect()] == ["ref_name"]
