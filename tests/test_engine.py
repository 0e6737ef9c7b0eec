import random

import pytest

from relsat import errors as err
from relsat.cli import interact
from relsat.engine import Engine
from relsat.sources.modules import Modules
from relsat.sources.parser import incomplete, parse


def rows(df):
    return sorted(map(tuple, df.collect()))


CLOSURE = "relation edge(i32, i32) relation path(i32, i32) rule edge(x, y) { set path(x, y) } "
LINEAR, TWICE = "rule path(x, z), edge(z, y) { set path(x, y) } ", "rule path(x, z), path(z, y) { set path(x, y) } "


def facts(pairs):
    return " ".join(f"fact set edge({a}i32, {b}i32)" for a, b in pairs) + " "


@pytest.mark.parametrize("step", [LINEAR, TWICE])
def test_closure(spark, step):
    e = Engine(spark).run_text(CLOSURE + step + facts([(1, 2), (2, 3), (3, 4), (4, 5)]) + "run saturate")
    assert e.query("path(x, y) print(x, y)").count() == 10


def test_cycle_and_repeat(spark):
    e = Engine(spark).run_text(CLOSURE + TWICE + facts([(1, 2), (2, 3), (3, 1)]) + "run saturate")
    assert e.query("path(x, y) print(x, y)").count() == 9
    e = Engine(spark).run_text(CLOSURE + LINEAR + facts([(1, 2), (2, 3), (3, 4), (4, 5)]) + "run repeat 2")
    assert e.query("path(x, y) print(x, y)").count() == 7
    e = Engine(spark).run_text(CLOSURE + facts([(1, 2)]) + "run repeat 0")
    assert e.query("path(x, y) print(x, y)").count() == 0


def test_random_closure_equals_sets(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(14)}
    want = set(edges)
    while new := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= new
    e = Engine(spark).run_text(CLOSURE + TWICE + facts(sorted(edges)) + "run saturate")
    assert rows(e.query("path(x, y) print(x, y)")) == sorted(want)


def test_lattice_improvement_fires_again(spark):
    e = Engine(spark).run_text(
        "relation edge(str, str, i32) function d(str) -> i32 merge min "
        'fact set edge("a", "b", 5i32); set edge("a", "c", 1i32); set edge("c", "b", 1i32); set edge("b", "d", 1i32); set d("a") = 0i32 '
        "rule leteq x = d(a), edge(a, b, w) { set d(b) = add(x, w) } run saturate"
    )
    assert rows(e.query("leteq v = d(x) print(x, v)")) == [("a", 0), ("b", 2), ("c", 1), ("d", 3)]


def test_commutativity_saturates(spark):
    e = Engine(spark).run_text("data E = Add(E, E) | C(i32) fact set E.Add(E.C(1i32), E.C(2i32)) rule leteq r = E.Add(a, b) { union r with E.Add(b, a) } run saturate")
    assert e.query("leteq r = E.Add(a, b) print(r)").count() == 1
    assert e.query("leteq r = E.Add(a, b) print(a, b)").count() == 2


def test_congruence_without_direct_key(spark):
    e = Engine(spark).run_text(
        "data N = Z | B | C | G(N) fact set N.G(N.B()); set N.G(N.C()) fact union N.Z() with N.B(); union N.Z() with N.C()"
    )
    assert e.query("leteq v = N.G(_) print(v)").count() == 1


def test_nullary_pattern_and_repeated_variable(spark):
    e = Engine(spark).run_text("data L = Cons(i32, L) | Nil fact set L.Cons(1i32, L.Nil()); set L.Cons(2i32, L.Cons(1i32, L.Nil()))")
    assert rows(e.query("L.Cons(x, L.Nil()) print(x)")) == [(1,)]
    e = Engine(spark).run_text("relation edge(i32, i32) " + facts([(1, 1), (1, 2)]))
    assert rows(e.query("edge(x, x) print(x)")) == [(1,)]


def test_natives(spark):
    e = Engine(spark).run_text("relation n(i32, i32) relation o(i32, bool) fact set n(2147483647i32, 1i32) rule n(a, b) { set n(add(a, b), sub(-2147483648i32, b)); set o(mul(a, 2i32), not(lt(a, b))) } run repeat 1")
    assert rows(e.query("n(a, b) print(a, b)")) == [(-2147483648, 2147483647), (2147483647, 1)]
    assert rows(e.query("o(a, b) print(a, b)")) == [(-2, True)]


def test_unsigned_and_unused_types(spark):
    e = Engine(spark).run_text("relation big(u64, u8, f64, bool) fact set big(18446744073709551615u64, 255u8, 1.5f64, true)")
    assert [tuple(map(str, r)) for r in e.query("big(a, b, c, d) print(a, b, c, d)").collect()] == [("18446744073709551615", "255", "1.5", "True")]


SHARE = "data E = Add(E, E) | Mul(E, E) | Square(E) | Leaf(i32) cost E.Add = 10 cost E.Mul = 20 cost E.Square = 5 cost E.Leaf = 1 "


def test_extract_shared(spark):
    e = Engine(spark).run_text(SHARE + "fact set E.Add(E.Mul(E.Leaf(2i32), E.Leaf(3i32)), E.Mul(E.Leaf(2i32), E.Leaf(2i32))) fact union E.Mul(E.Leaf(2i32), E.Leaf(2i32)) with E.Square(E.Leaf(2i32))")
    x = e.extract("optimal Add(Mul(Leaf(2i32), Leaf(3i32)), Mul(Leaf(2i32), Leaf(2i32)))")
    assert (x.term, x.cost, x.optimal) == ("(let ([_t0 (E.Leaf 2)]) (E.Add (E.Mul _t0 (E.Leaf 3)) (E.Square _t0)))", 37, True)
    x = e.extract("optimal Add(Mul(Leaf(2i32), Leaf(3i32)), Mul(Leaf(2i32), Leaf(2i32)))", max_classes=2)
    assert x.optimal is False and x.term and x.warnings


def test_optimal_equals_brute_force():
    from itertools import product

    from relsat.catalog import Table
    from relsat.operators.extract import Node, dag_cost, solve

    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(2, 6)
        costs = {f"k{i}": rng.randint(0, 9) for i in range(4)}
        nodes = {}
        for x in range(n):
            nodes[x] = [Node(Table(f"k{rng.randrange(4)}", "constructor", ("T",) * len(c), "T"), c) for c in {tuple(rng.randrange(x + 1, n) for _ in range(rng.randint(0, 2))) if x < n - 1 else () for _ in range(rng.randint(1, 3))}]
        greedy = {x: ns[0] for x, ns in nodes.items()}
        want = min(dag_cost(0, dict(zip(nodes, c)), costs) for c in product(*nodes.values()))
        chosen, proven = solve(0, nodes, greedy, costs)
        assert proven and dag_cost(0, chosen, costs) == want


def test_optimal_with_cycles_equals_brute_force():
    from itertools import product

    from relsat.catalog import Table
    from relsat.operators.extract import Node, cheapest, dag_cost, solve

    def acyclic(x, chosen, above=()):
        return x not in above and all(acyclic(c, chosen, (*above, x)) for c in chosen[x].children)

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(2, 5)
        costs = {f"k{i}": rng.randint(0, 9) for i in range(4)}
        nodes = {x: [Node(Table(f"k{rng.randrange(4)}", "constructor", ("T",) * len(c), "T"), c) for c in {tuple(rng.randrange(n) for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(1, 3))}] for x in range(n)}
        choices = [dict(zip(nodes, c)) for c in product(*nodes.values())]
        want = min((dag_cost(0, c, costs) for c in choices if acyclic(0, c)), default=None)
        greedy = cheapest(nodes, costs)
        assert (0 in greedy) == (want is not None)
        if want is not None:
            chosen, proven = solve(0, nodes, greedy, costs)
            assert proven and acyclic(0, chosen) and dag_cost(0, chosen, costs) == want


@pytest.mark.parametrize("parts", [20, 70])
def test_optimal_of_hundreds_of_classes(parts):
    """A chain of small graphs, each solved by enumeration."""
    from itertools import product

    from relsat.catalog import Table
    from relsat.operators.extract import Node, cheapest, dag_cost, solve

    rng, nodes, want = random.Random(parts), {}, 0
    costs = {f"k{i}": rng.randint(1, 9) for i in range(6)} | {"chain": 1}
    node = lambda k, c: Node(Table(k, "constructor", ("T",) * len(c), "T"), c)
    for i in range(parts):
        first = 1000 + 6 * i
        part = {first + x: [node(f"k{rng.randrange(6)}", tuple(first + rng.randrange(x + 1, 6) for _ in range(rng.randint(1, 3))) if x < 5 else ()) for _ in range(rng.randint(1, 3))] for x in range(6)}
        want += 1 + min(dag_cost(first, dict(zip(part, c)), costs) for c in product(*part.values()))
        nodes |= part
        nodes[i] = [node("chain", (first, i + 1) if i < parts - 1 else (first,))]
    chosen, proven = solve(0, nodes, cheapest(nodes, costs), costs)
    assert proven and dag_cost(0, chosen, costs) == want


def test_without_sharing_greedy_is_optimal():
    from relsat.catalog import Table
    from relsat.operators.extract import Node, cheapest, dag_cost, solve

    leaf = lambda k: Node(Table(k, "constructor", ("i32",), "T"), (1,))
    nodes = {x: [Node(Table("two", "constructor", ("T", "T"), "T"), (2 * x + 1, 2 * x + 2)), leaf("dear")] for x in range(200)} | {x: [leaf("cheap"), leaf("dear")] for x in range(200, 401)}
    costs = {"two": 1, "cheap": 1, "dear": 500}
    chosen, proven = solve(0, nodes, cheapest(nodes, costs), costs, budget=0)
    assert proven and dag_cost(0, chosen, costs) == 401


@pytest.mark.parametrize(
    "text, error",
    [
        ("relation r(i32) relation r(i32)", err.DuplicateTable),
        ("data T = A data T = B", err.DuplicateType),
        ("relation r(T)", err.UnknownType),
        ("query r(x) print(x)", err.UnknownTable),
        ("relation r(i32) query r(5i64) print(x)", err.TypeMismatch),
        ("relation r(i32) query r(x) print(y)", err.UndefinedVariable),
        ("relation r(i32) query r(x, y) print(x)", err.WidthMismatch),
        ("function f(i32) -> str merge min", err.MergeOnNonNumeric),
        ("function f(i32) -> i32", err.MergeRequired),
        ("data T = A(i32) extract T.B(1i32)", err.UnknownConstructor),
        ("extract x", err.VariableInExtract),
        ("cost T.A = 1", err.UnknownConstructor),
        ('run saturate "no such"', err.UnknownGroup),
        ("relation r(i32) rule r(x) { union x with x }", err.UnionOfBaseValues),
        ("data T = A relation r(T, T) query r(x, y), if x < y print(x)", err.OrderOnClass),
        ("relation r(i8) fact set r(200i8)", err.LiteralOutOfRange),
        ("extract expr(x) print(x)", err.ParseError),
        ("relation r(i32) query r(x), if x > 0 print(x)", err.ParseError),
        ("rule leteq", err.ParseError),
    ],
)
def test_rejected(spark, text, error):
    with pytest.raises(error):
        Engine(spark).run_text(text)


def test_null_rows_saturate(spark):
    e = Engine(spark, max_rounds=6)
    e.bind("edge", spark.createDataFrame([(1, 2), (2, None), (None, 3)], "a int, b int"), ["i32", "i32"])
    e.run_text("relation path(i32, i32) rule edge(x, y) { set path(x, y) } rule path(x, y) { set path(y, x) } run saturate")
    assert e.query("path(x, y) print(x, y)").count() == 6


def test_ids_at_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        e = Engine(spark)
        e.bind("n", spark.range(300).selectExpr("cast(id as int)"), ["i32"])
        e.run_text("data V = N(i32) rule n(x) { set V.N(x) } run saturate")
        assert e.query("leteq v = V.N(x) print(v)").count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fresh_ids_and_unions(spark):
    e = Engine(spark).run_text("data V = N(i32) fact set V.N(1i32); set V.N(2i32); set V.N(3i32)")
    ids = {r["x"]: r["v"] for r in e.query("leteq v = V.N(x) print(x, v)").collect()}
    a = e.fresh_id(3)
    assert a > max(ids.values()) and e.fresh_id() == a + 3
    e.insert_df("V.N", spark.createDataFrame([(4, a)], "x int, v long"))
    e.union_df(spark.createDataFrame([(ids[1], ids[3]), (ids[2], a)], "a long, b long"))
    now = {r["x"]: r["v"] for r in e.query("leteq v = V.N(x) print(x, v)").collect()}
    assert now == {1: min(ids[1], ids[3]), 3: min(ids[1], ids[3]), 2: ids[2], 4: ids[2]}


def test_rules_without_new_rows_are_skipped(spark):
    from relsat.operators.match import match

    e = Engine(spark).run_text(CLOSURE + LINEAR + facts([(1, 2), (2, 3)]) + "run saturate")
    assert all(match(e.store, r.plan, r.seen, ["x", "y"]) is None for r in e.rules)
    e.run_text(facts([(3, 4)]))
    assert all(match(e.store, r.plan, r.seen, ["x", "y"]) is not None for r in e.rules)


def test_term_without_lets(spark):
    e = Engine(spark).run_text(SHARE + "fact set E.Add(E.Mul(E.Leaf(2i32), E.Leaf(3i32)), E.Leaf(2i32))")
    text = "Add(Mul(Leaf(2i32), Leaf(3i32)), Leaf(2i32))"
    assert e.extract(text, lets=False).term == "(E.Add (E.Mul (E.Leaf 2) (E.Leaf 3)) (E.Leaf 2))"
    assert e.extract(text).term == "(let ([_t0 (E.Leaf 2)]) (E.Add (E.Mul _t0 (E.Leaf 3)) _t0))"


def test_large_graph_on_the_cluster_prices_like_the_driver(spark, monkeypatch):
    from relsat.operators import extract

    program = SHARE + "fact set E.Add(E.Mul(E.Leaf(2i32), E.Leaf(3i32)), E.Mul(E.Leaf(2i32), E.Leaf(2i32))) fact union E.Mul(E.Leaf(2i32), E.Leaf(2i32)) with E.Square(E.Leaf(2i32))"
    e = Engine(spark).run_text(program)
    text = "Add(Mul(Leaf(2i32), Leaf(3i32)), Mul(Leaf(2i32), Leaf(2i32)))"
    want = e.extract(text).term
    monkeypatch.setattr(extract, "DRIVER_ROWS", 1)
    assert e.extract(text).term == want
    monkeypatch.setattr(extract, "DRIVER_CLASSES", 1)
    assert e.extract(text).term == want


def test_type_programs_of_mutual_terms(spark):
    program = """
    data Ty = Int(u8) | Fn(Ty, Ty) | Tuple(TyList)
    data TyList = End | Then(Ty, TyList)
    data Term = Lit(i64, Ty) | Arg(u32, Ty) | Call(Term, TermList) | Lam(Ty, Term) | If(Term, Term, Term)
    data TermList = None | More(Term, TermList)
    relation typed(Term, Ty)
    cost Term.Call = 4 cost Term.If = 2
    fact set typed(Term.Lit(1i64, Ty.Int(64u8)), Ty.Int(64u8))
    rule typed(t, ty) { set typed(Term.Lam(ty, t), Ty.Fn(ty, ty)) }
    run repeat 2
    """
    e = Engine(spark).run_text(program)
    got = {r["ty"] for r in e.query_terms("typed(_, ty) print(ty)").collect()}
    assert "(Ty.Int 64)" in got and "(Ty.Fn (Ty.Int 64) (Ty.Int 64))" in got


def test_command_line(spark, tmp_path, capsys):
    from relsat.cli import main

    (tmp_path / "one.rsat").write_text("relation r(i32) fact set r(4i32) query r(x) print(x)")
    assert main([str(tmp_path / "one.rsat")]) == 0 and capsys.readouterr().out.strip() == "x: 4"
    assert main([str(tmp_path), "--main", "one"]) == 0 and capsys.readouterr().out.strip() == "x: 4"
    assert main([str(tmp_path), "--main", "two"]) == 1 and "error" in capsys.readouterr().err
    assert main([str(tmp_path / "missing.rsat")]) == 1
    (tmp_path / "bad.rsat").write_text("query r(x) print(x)")
    assert main([str(tmp_path / "bad.rsat")]) == 1


def test_history_is_kept(tmp_path):
    readline = pytest.importorskip("readline")
    from relsat.cli import history

    readline.clear_history()
    for line in ("relation r(i32)", "query r(x) print(x)"):
        with history(tmp_path / "lines"):
            readline.add_history(line)
        readline.clear_history()
    with history(tmp_path / "lines"):
        assert readline.get_current_history_length() == 2


def test_divergence_is_stopped(spark):
    e = Engine(spark, max_rounds=3)
    with pytest.raises(err.Diverged):
        e.run_text("relation n(i32) fact set n(0i32) rule n(x) { set n(add(x, 1i32)) } run saturate")


def test_parser():
    assert len(parse('# one\nrelation a_b(i32) // two\nquery a_b(x), if x<=5i32 print(x)')) == 2
    assert incomplete("rule a(x) {") and incomplete('load "x') and not incomplete("relation a(i32)") and not incomplete(")")


def test_modules_and_groups(spark, tmp_path):
    (tmp_path / "edge.rsat").write_text('load "main2" relation edge(i32, i32)')
    (tmp_path / "main2.rsat").write_text('load "edge" relation path(i32, i32) rule "A" edge(x, y) { set path(x, y) } rule "B" path(x, z), path(z, y) { set path(x, y) }')
    (tmp_path / "go.rsat").write_text('load "edge" ' + facts([(1, 2), (2, 3)]) + 'run saturate "A" run saturate { saturate "B" } query path(x, y) print(x, y)')
    e = Engine(spark)
    Modules(e).run(tmp_path / "go.rsat")
    assert sorted(e.output) == ["x: 1, y: 2", "x: 1, y: 3", "x: 2, y: 3"]
    (tmp_path / "bad.rsat").write_text("relation q(i32) fact set q(1i32)")
    (tmp_path / "use.rsat").write_text('load "bad"')
    with pytest.raises(err.ModuleError):
        Modules(Engine(spark)).run(tmp_path / "use.rsat")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "edge.rsat").write_text("")
    with pytest.raises(err.ModuleError):
        Modules(Engine(spark)).scan(tmp_path)


def test_interactive(spark):
    lines, out = iter(["relation r(i32)", "fact set", "r(4i32)", "query r(x) print(x)", "nonsense", "quit"]), []
    interact(Modules(Engine(spark)), lambda _: next(lines), out.append)
    assert out[0] == "x: 4" and out[1].startswith("error")


def test_stream_feeds_rules(spark, tmp_path):
    from relsat.streaming.incremental import feed

    spark.createDataFrame([(1, 2), (2, 3)], "a int, b int").write.parquet(str(tmp_path / "in"))
    e = Engine(spark).run_text(CLOSURE + TWICE)
    stream = spark.readStream.schema("a int, b int").parquet(str(tmp_path / "in"))
    feed(e, "edge", stream, checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert rows(e.query("path(x, y) print(x, y)")) == [(1, 2), (1, 3), (2, 3)]


def test_components_by_shuffle(spark):
    from relsat.operators.components import connected_components

    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
