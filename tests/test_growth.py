"""What may not grow faster than the input: rows of joins, exchanges, memory of a task."""

import random

import pytest

from conftest import canonical, oracle_rows
from relsat.engine import Engine
from relsat.operators import store
from relsat.operators.staging import dealt
from relsat.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_joined_values_are_told_apart_before_the_join(spark):
    # else every customer of a nation meets every supplier of it
    join = optimized(QUERIES["rule_intersect"](spark, SF)).split("Join", 1)[1]
    assert join.count("Aggregate") == 2


def test_atoms_that_only_link(spark):
    e = Engine(spark)
    e.bind("a", spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 2), (4, None)], "x int, n int"), ["i32", "i32"])
    e.bind("b", spark.createDataFrame([(1, 7), (1, 7), (1, 8), (None, 9)], "n int, m int"), ["i32", "i32"])
    e.bind("c", spark.createDataFrame([(7,), (7,), (8,)], "m int"), ["i32"])
    assert rows(e.query("a(x, n), b(n, _) print(x)")) == [(1,), (2,)]
    assert rows(e.query("a(x, n), b(n, m), c(m) print(x, m)")) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    assert rows(e.query("a(x, _), b(_, m) print(m)")) == [(7,), (8,), (9,)]
    assert rows(e.query("a(x, n), b(n, m), if x < m print(n)")) == [(1,)]
    assert rows(e.query("a(_, n), b(n, _), c(_) print(n)")) == [(1,)]


def test_pairs_are_not_exchanged(spark):
    # customers and suppliers of a nation: their pairs grow with the square of the tables
    plan = optimized(QUERIES["guard_var_var"](spark, SF))
    assert "Aggregate" not in plan.split("Join", 1)[0] and "Join" in plan


def test_pairs_of_keys_that_repeat(spark):
    rng = random.Random(7)
    none = lambda x: None if rng.random() < 0.1 else x
    a = [(none(rng.randrange(12)), none(rng.randrange(4)), none(rng.randrange(9) / 2)) for _ in range(60)] + [(100 + k, k % 4, k / 2) for k in range(8)]
    b = [(none(rng.randrange(10)), none(rng.randrange(4)), none(rng.randrange(9) / 2)) for _ in range(40)] + [(200 + k, k % 4, k / 3) for k in range(8)]
    e = Engine(spark)
    e.bind("a", spark.createDataFrame(a, "x int, n int, v double"), ["i32", "i32", "f64"])
    e.bind("b", spark.createDataFrame(b, "y int, n int, w double"), ["i32", "i32", "f64"])
    for program, want in (
        ("a(x, n, v), b(y, n, w), if v > w print(x, y)", {(x, y) for x, n, v in a for y, m, w in b if n is not None and n == m and v is not None and w is not None and v > w}),
        ("a(x, n, _), b(y, n, _) print(x, y)", {(x, y) for x, n, _ in a for y, m, _ in b if n is not None and n == m}),
        ("a(x, n, _), a(y, n, v), b(_, n, v) print(x, y)", {(x, y) for x, n, _ in a for y, m, v in a for _, k, w in b if n is not None and n == m == k and v is not None and v == w}),
        ("a(x, n, v), b(y, n, w) print(x, y, w)", {(x, y, w) for x, n, _ in a for y, m, w in b if n is not None and n == m}),
    ):
        got = e.query(program).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want, program


def test_stored_rows_are_not_told_apart_again(spark):
    e = Engine(spark).run_text("relation p(i32, i32) fact set p(1i32, 2i32); set p(1i32, 3i32)")
    assert "Aggregate" not in optimized(e.query("p(x, y) print(x, y)"))
    assert rows(e.query("p(x, _) print(x)")) == [(1,)]


def test_tasks_read_small_parts_of_exchanges(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(key)
    Engine(spark)
    assert int(spark.conf.get(key)) <= 16 << 20
    spark.conf.set(key, "5m")
    Engine(spark)
    assert spark.conf.get(key) == "5m"
    spark.conf.unset(key)


@pytest.mark.parametrize("name", ["tc_nonlinear", "incremental", "same_generation", "shortest_path", "longest_path"])
def test_dealt_tables_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(store, "DEAL_ROWS", 10)
    monkeypatch.setattr(store, "MOST_LOGS", 3)
    assert canonical(QUERIES[name](spark, SF).toPandas()) == oracle_rows(ORACLES[name], SF)


def test_dealt_tables_are_not_exchanged(spark, monkeypatch):
    monkeypatch.setattr(store, "DEAL_ROWS", 2)
    e = Engine(spark)
    e.bind("edge", spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 9), (3, 1, 2), (3, None, 4), (None, 1, 1), (3, 4, None)], "a int, b int, w int"), ["i32", "i32", "i32"])
    e.run_text("function d(i32, i32) -> i32 merge min rule edge(x, y, w) { set d(x, y) = w } rule leteq v = d(x, z), edge(z, y, w) { set d(x, y) = add(v, w) } run saturate")
    got = e.query("leteq v = d(x, y) print(x, y, v)")
    assert set(map(tuple, got.collect())) == {(1, 2, 1), (1, 3, 2), (1, 1, 4), (2, 3, 1), (2, 1, 3), (2, 2, 4), (3, 1, 2), (3, 2, 3), (3, 3, 4), (1, None, 6), (2, None, 5), (3, None, 4), (None, 1, 1), (None, 2, 2), (None, 3, 3), (None, None, 7)}
    assert got.count() == 16
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    before = e.query("leteq v = d(x, y) print(x, y, v)")
    e.bind("more", spark.createDataFrame([(7, 8, 1)], "a int, b int, w int"), ["i32", "i32", "i32"])
    e.run_text("rule more(x, y, w) { set d(x, y) = w } run saturate")
    assert before.count() == 16 and e.query("leteq v = d(x, y) print(x, y, v)").count() == 17


def test_pairs_of_one_generation_are_not_exchanged(spark, monkeypatch):
    # what is written comes in the table's buckets: from few rows, dealt before they are joined
    monkeypatch.setattr(store, "DEAL_ROWS", 10)
    written = []
    monkeypatch.setattr(store, "dealt", lambda df, *a: (written.append(df._jdf.queryExecution().executedPlan().toString()), dealt(df, *a))[1])
    assert QUERIES["same_generation"](spark, SF).count() == len(oracle_rows(ORACLES["same_generation"], SF)[1])
    assert len(written) > 2
    for plan in written:  # no exchange above the join that makes the pairs
        assert "BroadcastHashJoin" not in plan or "Exchange" not in plan.split("BroadcastHashJoin")[0]
    assert any("BroadcastHashJoin" in plan for plan in written)
