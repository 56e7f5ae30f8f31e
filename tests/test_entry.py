"""The driver contract, with and without the llm subpackage."""

import sys

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_without_llm(monkeypatch):
    monkeypatch.setitem(sys.modules, "codeloom.llm", None)
    names = entry.queries()
    assert "p1_found" in names and not any(n.startswith(("p2_", "p3_", "p8_")) for n in names)
    assert set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_pins_can_be_dropped(spark):
    from codeloom.session import drop_pins, pin

    kept = pin(spark.range(5).toDF("x"))
    assert kept.count() == 5
    assert drop_pins(spark) >= 1 and drop_pins(spark) == 0
