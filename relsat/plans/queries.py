"""The engine's registered queries and their SQL: programs over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from relsat.engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Columns and types under which the tables are bound.
SCHEMAS = {
    "region": ("r_regionkey r_name", "i32 str"),
    "nation": ("n_nationkey n_name n_regionkey", "i32 str i32"),
    "customer": ("c_custkey c_name c_nationkey c_acctbal c_mktsegment", "i64 str i32 f64 str"),
    "supplier": ("s_suppkey s_name s_nationkey s_acctbal", "i64 str i32 f64"),
    "part": ("p_partkey p_name p_brand p_type p_size p_retailprice", "i64 str str str i32 f64"),
    "orders": ("o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority", "i64 i64 str f64 str"),
    "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_returnflag", "i64 i64 i64 i32 f64 f64 f64 str"),
    "events": ("event_id user_id event_type value", "i64 i64 str f64"),
}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def engine(spark: SparkSession, sf: str, *tables: str) -> Engine:
    e = Engine(spark)
    for t in tables:
        columns, types = SCHEMAS[t]
        e.bind(t, read(spark, sf, t).select(*columns.split()), types.split())
    return e


def plain(name: str, tables: str, text: str, sql: str, before: str = "") -> None:
    """Register a query over bound tables, after the program ``before``."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = engine(spark, sf, *tables.split())
        return (e.run_text(before) if before else e).query(text)

    QUERIES[name], ORACLES[name] = run, sql


def query(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- scans, filters, joins

plain("scan_project", "nation", "nation(_, name, region) print(name, region)", "SELECT DISTINCT n_name AS name, n_regionkey AS region FROM nation")
plain("const_match", "customer", 'customer(c, name, _, _, "BUILDING") print(c, name)', "SELECT DISTINCT c_custkey AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
for _name, _op, _sql in (("eq", "==", "="), ("neq", "!=", "<>"), ("lt", "<", "<"), ("gt", ">", ">"), ("leq", "<=", "<="), ("geq", ">=", ">=")):
    plain(f"guard_{_name}", "part", f"part(p, _, _, _, size, _), if size {_op} 10i32 print(p, size)", f"SELECT p_partkey AS p, p_size AS size FROM part WHERE p_size {_sql} 10")
plain("guard_float", "lineitem", "lineitem(o, _, _, n, q, _, d, _), if q < 3.0f64, if d >= 0.05f64 print(o, n, q, d)", "SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_quantity AS q, l_discount AS d FROM lineitem WHERE l_quantity < 3 AND l_discount >= 0.05")
plain("guard_var_var", "customer supplier", "customer(c, _, n, cb, _), supplier(s, _, n, sb), if cb > sb print(c, s)", "SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > s_acctbal")
plain("leteq_const", "part", "part(p, _, b, _, size, _), leteq size = 15i32 print(p, b)", "SELECT DISTINCT p_partkey AS p, p_brand AS b FROM part WHERE p_size = 15")
plain("leteq_var", "nation region", "nation(n, _, r), region(k, name), leteq k = r print(n, name)", "SELECT n_nationkey AS n, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey")
plain("join2", "customer nation", "customer(c, _, n, _, _), nation(n, name, _) print(c, name)", "SELECT DISTINCT c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
plain("join3", "customer nation region", 'customer(c, _, n, _, _), nation(n, nm, r), region(r, "ASIA") print(c, nm)', "SELECT DISTINCT c_custkey AS c, n_name AS nm FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
plain("cross_join", "region", "region(a, _), region(_, b) print(a, b)", "SELECT DISTINCT a.r_regionkey AS a, b.r_name AS b FROM region a, region b")
plain("theta_join", "nation", "nation(a, _, r), nation(b, _, r), if a < b print(a, b, r)", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
plain("self_join", "orders", 'orders(a, c, "F", _, _), orders(b, c, "O", _, _) print(a, b)', "SELECT DISTINCT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'")
plain("exists_head", "region events", "region(r, name), events(_, _, _, _) print(r, name)", "SELECT r_regionkey AS r, r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM events)")
plain("repeated_var", "nation", "nation(x, name, x) print(x, name)", "SELECT n_nationkey AS x, n_name AS name FROM nation WHERE n_nationkey = n_regionkey")
plain("dedup_projection", "events", "events(_, u, t, _) print(u, t)", "SELECT DISTINCT user_id AS u, event_type AS t FROM events")


@query("func_lookup", "SELECT DISTINCT l_orderkey AS o, l_partkey AS p, p_size AS s FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "lineitem")
    e.bind("size", read(spark, sf, "part").select("p_partkey", "p_size"), ["i64"], "i32", "min")
    return e.query("lineitem(o, p, _, _, _, _, _, _), leteq s = size(p) print(o, p, s)")


@query("point_lookup", "SELECT p_size AS s FROM part WHERE p_partkey = 42")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark)
    e.bind("size", read(spark, sf, "part").select("p_partkey", "p_size"), ["i64"], "i32", "min")
    return e.query("leteq s = size(42i64) print(s)")


# --- unions, merges, natives

plain(
    "rule_union", "customer orders", "busy(c) print(c)",
    "SELECT o_custkey AS c FROM orders UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'",
    'relation busy(i64) rule orders(_, c, _, _, _) { set busy(c) } rule customer(c, _, _, _, "MACHINERY") { set busy(c) } run saturate',
)
plain("rule_intersect", "customer supplier", "customer(_, _, n, _, _), supplier(_, _, n, _) print(n)", "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier")
for _m in ("min", "max"):
    plain(
        f"merge_{_m}", "lineitem", "leteq v = best(p) print(p, v)", f"SELECT l_partkey AS p, {_m}(l_extendedprice) AS v FROM lineitem GROUP BY l_partkey",
        f"function best(i64) -> f64 merge {_m} rule lineitem(_, p, _, _, _, price, _, _) {{ set best(p) = price }} run saturate",
    )
plain(
    "merge_bool", "part", "leteq v = small(b) print(b, v)", "SELECT p_brand AS b, bool_and(p_size < 45) AS v FROM part GROUP BY p_brand",
    "function small(str) -> bool merge min rule part(_, _, b, _, s, _) { set small(b) = lt(s, 45i32) } run saturate",
)

_WRAP = "CAST((({}) + 2147483648) % 4294967296 - 2147483648 AS INTEGER)"
for _name, _sql in (("add", "CAST(p_size AS BIGINT) + 2147483640"), ("sub", "CAST(p_size AS BIGINT) - 2147483640"), ("mul", "CAST(p_size AS BIGINT) * 2147483640")):
    _sql = _WRAP.format(f"(({_sql}) % 4294967296 + 4294967296)")
    plain(f"native_{_name}", "part", "leteq v = out(p) print(p, v)", f"SELECT p_partkey AS p, {_sql} AS v FROM part", f"function out(i64) -> i32 merge max rule part(p, _, _, _, s, _) {{ set out(p) = {_name}(s, 2147483640i32) }} run saturate")
plain("native_div", "part", "leteq v = out(p) print(p, v)", "SELECT p_partkey AS p, CAST(-((p_size - 1) // 7) AS INTEGER) AS v FROM part", "function out(i64) -> i32 merge max rule part(p, _, _, _, s, _) { set out(p) = div(sub(1i32, s), 7i32) } run saturate")
for _name, _op in (("eq", "="), ("neq", "<>"), ("lt", "<"), ("gt", ">"), ("leq", "<="), ("geq", ">=")):
    plain(f"native_{_name}", "part", "leteq v = out(p) print(p, v)", f"SELECT p_partkey AS p, p_size {_op} 20 AS v FROM part", f"function out(i64) -> bool merge max rule part(p, _, _, _, s, _) {{ set out(p) = {_name}(s, 20i32) }} run saturate")
plain("native_not", "part", "leteq v = out(p) print(p, v)", "SELECT p_partkey AS p, NOT (p_size < 20) AS v FROM part", "function out(i64) -> bool merge max rule part(p, _, _, _, s, _) { set out(p) = not(lt(s, 20i32)) } run saturate")
for _name in ("and", "or"):
    plain(f"native_{_name}", "part", "leteq v = out(p) print(p, v)", f"SELECT p_partkey AS p, (p_size < 30) {_name} (p_size > 10) AS v FROM part", f"function out(i64) -> bool merge max rule part(p, _, _, _, s, _) {{ set out(p) = {_name}(lt(s, 30i32), gt(s, 10i32)) }} run saturate")
plain("let_body", "part", "twice(p, v) print(p, v)", "SELECT p_partkey AS p, CAST(2 * p_size + 1 AS INTEGER) AS v FROM part", "relation twice(i64, i32) rule part(p, _, _, _, s, _) { let d = add(s, s); let e = add(d, 1i32); set twice(p, e) } run saturate")


@query("native_registered", "SELECT p_partkey AS p, CAST(length(p_name) AS BIGINT) AS v FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "part")
    e.register_native("size_of", ["str"], "i64", F.length)
    return e.run_text("relation out(i64, i64) rule part(p, name, _, _, _, _) { set out(p, size_of(name)) } run saturate").query("out(p, v) print(p, v)")


@query("native_python", "SELECT p_partkey AS p, CAST(p_size % 7 AS BIGINT) AS v FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    import pandas as pd

    def residue(s: pd.Series) -> pd.Series:
        return (s % 7).astype("int64")

    e = engine(spark, sf, "part")
    e.register_native("residue", ["i32"], "i64", residue, python=True)
    return e.run_text("relation out(i64, i64) rule part(p, _, _, _, s, _) { set out(p, residue(s)) } run saturate").query("out(p, v) print(p, v)")


# --- recursion

_PARENT = "WITH RECURSIVE e AS (SELECT c_custkey AS x, c_custkey // 10 AS y FROM customer WHERE c_custkey > 0), "
_CLOSED = "p(x, y) AS (SELECT x, y FROM e UNION SELECT p.x, e.y FROM p JOIN e ON p.y = e.x) "


def parents(spark: SparkSession, sf: str, name: str = "edge") -> Engine:
    """A forest over the customers: each number's parent is a tenth of it. 0 would be its own
    parent; the programs' guards leave that edge out."""
    e = Engine(spark)
    e.bind(name, read(spark, sf, "customer").select("c_custkey", F.expr("c_custkey div 10").alias("up")), ["i64", "i64"])
    return e


def closure(name: str, program: str, sql: str) -> None:
    @query(name, sql)
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return parents(spark, sf).run_text("relation path(i64, i64) " + program).query("path(x, y) print(x, y)")


closure("tc_linear", "rule edge(x, y), if x > 0i64 { set path(x, y) } rule path(x, z), edge(z, y), if z > 0i64 { set path(x, y) } run saturate", _PARENT + _CLOSED + "SELECT x, y FROM p")
closure("tc_nonlinear", "rule edge(x, y), if x > 0i64 { set path(x, y) } rule path(x, z), path(z, y) { set path(x, y) } run saturate", _PARENT + _CLOSED + "SELECT x, y FROM p")
_BOUNDED = "p(x, y, d) AS (SELECT x, y, 1 FROM e UNION SELECT p.x, e.y, d + 1 FROM p JOIN e ON p.y = e.x WHERE d < {}) SELECT DISTINCT x, y FROM p"
closure("run_repeat_2", "rule edge(x, y), if x > 0i64 { set path(x, y) } rule path(x, z), edge(z, y), if z > 0i64 { set path(x, y) } run repeat 2", _PARENT + _BOUNDED.format(2))
closure("rule_group", 'rule "base" edge(x, y), if x > 0i64 { set path(x, y) } rule "step" path(x, z), edge(z, y), if z > 0i64 { set path(x, y) } run saturate "base"', _PARENT.replace("RECURSIVE ", "").rstrip(", ") + " SELECT DISTINCT x, y FROM e")
closure("run_program", 'rule "base" edge(x, y), if x > 0i64 { set path(x, y) } rule "step" path(x, z), edge(z, y), if z > 0i64 { set path(x, y) } run saturate { run-all }'.replace("{ run-all }", '{ saturate "base" repeat 1 "step" }'), _PARENT + _CLOSED + "SELECT x, y FROM p")


@query("incremental", _PARENT + _CLOSED + "SELECT x, y FROM p")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark)
    e.run_text("relation edge(i64, i64) relation path(i64, i64) rule edge(x, y), if x > 0i64 { set path(x, y) } rule path(x, z), path(z, y) { set path(x, y) }")
    c = read(spark, sf, "customer").select("c_custkey", F.expr("c_custkey div 10").alias("up"))
    for part in ("c_custkey % 2 = 0", "c_custkey % 2 = 1"):  # two batches of facts, a run after each
        e.insert_df("edge", c.where(part))
        e.run_text("run saturate")
    return e.query("path(x, y) print(x, y)")


_TREE = "SELECT CAST(1000 + s_suppkey AS BIGINT) AS x, CAST(100 + s_nationkey AS BIGINT) AS y FROM supplier UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation"


@query("same_generation", f"WITH RECURSIVE e AS ({_TREE}), g(a, b) AS (SELECT x.x, z.x FROM e x JOIN e z ON x.y = z.y UNION SELECT x.x, z.x FROM g JOIN e x ON x.y = g.a JOIN e z ON z.y = g.b) SELECT a, b FROM g")
def _(spark: SparkSession, sf: str) -> DataFrame:
    # suppliers below nations below regions: pairs of one region at one level
    e = Engine(spark)
    below = read(spark, sf, "supplier").selectExpr("cast(1000 + s_suppkey as bigint) as x", "cast(100 + s_nationkey as bigint) as y")
    e.bind("up", below.union(read(spark, sf, "nation").selectExpr("cast(100 + n_nationkey as bigint)", "cast(n_regionkey as bigint)")), ["i64", "i64"])
    return e.run_text("relation sg(i64, i64) rule up(a, p), up(b, p) { set sg(a, b) } rule up(a, p), sg(p, q), up(b, q) { set sg(a, b) } run saturate").query("sg(a, b) print(a, b)")


_PART_EDGES = "WITH RECURSIVE e AS (SELECT p_partkey AS x, p_partkey // 2 AS y, p_size AS w FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3, p_size + 1 FROM part WHERE p_partkey > 0), p(x, y, d) AS (SELECT x, y, w FROM e UNION SELECT p.x, e.y, d + w FROM p JOIN e ON p.y = e.x) "


def part_edges(spark: SparkSession, sf: str) -> Engine:
    e = Engine(spark)
    p = read(spark, sf, "part")  # the programs leave out the edges of 0, which would be loops
    df = p.select("p_partkey", F.expr("p_partkey div 2"), "p_size").union(p.select("p_partkey", F.expr("p_partkey div 3"), F.col("p_size") + 1))
    e.bind("edge", df, ["i64", "i64", "i32"])
    return e


for _n, _m in (("shortest_path", "min"), ("longest_path", "max")):

    @query(_n, _PART_EDGES + f"SELECT x, y, CAST({_m}(d) AS INTEGER) AS d FROM p GROUP BY x, y")
    def _(spark: SparkSession, sf: str, merge: str = _m) -> DataFrame:
        return part_edges(spark, sf).run_text(f"function dist(i64, i64) -> i32 merge {merge} rule edge(x, y, w), if x > 0i64 {{ set dist(x, y) = w }} rule leteq d = dist(x, z), edge(z, y, w), if z > 0i64 {{ set dist(x, y) = add(d, w) }} run saturate").query("leteq d = dist(x, y) print(x, y, d)")


# --- classes

_NODES = "data Node = C(i64) | Named(str) function least(Node) -> i64 merge min "


@query("components", "SELECT c_custkey AS c, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS r FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "customer")
    e.run_text("data Node = C(i64) data Group = G(i32, str) function member(Group) -> Node function least(Node) -> i64 merge min rule customer(c, _, n, _, s) { set member(Group.G(n, s)) = Node.C(c); set least(Node.C(c)) = c } run saturate")
    return e.query("leteq v = Node.C(c), leteq r = least(v) print(c, r)")


@query("dup_docs", "SELECT doc_id AS d, min(doc_id) OVER (PARTITION BY text) AS r FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark)
    e.bind("doc", read(spark, sf, "documents").select("doc_id", "text"), ["i64", "str"])
    e.run_text("data Doc = D(i64) function by(str) -> Doc function least(Doc) -> i64 merge min rule doc(d, t) { set by(t) = Doc.D(d); set least(Doc.D(d)) = d } run saturate")
    return e.query("leteq v = Doc.D(d), leteq r = least(v) print(d, r)")


_S = "data V = N(i32) | S(V) function least(V) -> i32 merge min relation in(i32, i32) "


@query("congruence", "SELECT n_nationkey AS n, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS r FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "nation")
    e.run_text("data V = N(i32) | S(V) data R = K(i32) function any(R) -> V function least(V) -> i32 merge min rule nation(n, _, r) { set any(R.K(r)) = V.N(n); set least(V.S(V.N(n))) = n } run saturate")
    return e.query("leteq a = V.N(n), leteq s = V.S(a), leteq r = least(s) print(n, r)")


@query("fd_union", "SELECT c_custkey AS c, c_nationkey AS n FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "customer")
    e.run_text("data Node = C(i64) function rep(i32) -> Node rule customer(c, _, n, _, _) { set rep(n) = Node.C(c) } run saturate")
    return e.query("leteq v = Node.C(c), leteq v = rep(n) print(c, n)")


@query("hashcons_count", "SELECT DISTINCT p_brand AS b, p_size AS s FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "part")
    e.run_text("data Kind = B(str) | Sized(Kind, i32) rule part(_, _, b, _, s, _) { set Kind.Sized(Kind.B(b), s) } run saturate")
    return e.query("Kind.Sized(k, s), leteq k = Kind.B(b) print(b, s)")


@query("nested_pattern", "SELECT DISTINCT n_nationkey AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "nation", "region")
    e.run_text("data Place = Reg(str) | Nat(i32, Place) rule nation(n, _, k), region(k, r) { set Place.Nat(n, Place.Reg(r)) } run saturate")
    return e.query("Place.Nat(n, Place.Reg(r)) print(n, r)")


@query("union_action", "SELECT s_suppkey AS s, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS r FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "supplier")
    e.run_text("data Node = S(i64) | Home(i32) function least(Node) -> i64 merge min rule supplier(s, _, n, _) { union Node.S(s) with Node.Home(n); set least(Node.S(s)) = s } run saturate")
    return e.query("leteq v = Node.S(s), leteq r = least(v) print(s, r)")


@query("relation_id", "SELECT DISTINCT n_nationkey AS n, n_name AS name FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "nation")  # a fact is a row with an id of its own, which patterns can share
    return e.query("leteq f = nation(n, _, _), leteq f = nation(_, name, _) print(n, name)")


@query("enode_count", "SELECT r_regionkey AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from relsat.operators.extract import enodes

    e = engine(spark, sf, "nation")
    e.run_text("data Node = N(i32) function home(i32) -> Node rule nation(n, _, r) { set home(r) = Node.N(n) } run saturate")
    rows = enodes(e.catalog, e.store).groupBy("class").agg(F.count("*").alias("n"))
    homes = e.query("leteq v = home(r) print(r, v)")
    return homes.join(rows, homes.v == rows["class"]).select("r", "n")


@query("eclass_cost", "SELECT DISTINCT p_partkey AS p, CAST(least(7, p_size) AS BIGINT) AS cost FROM (SELECT p_partkey, CASE WHEN p_size < 25 THEN 3 ELSE 7 END AS p_size FROM part) t")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from relsat.operators.extract import best_nodes

    e = engine(spark, sf, "part")
    e.run_text("data T = Dear(i64) | Cheap(i64) cost T.Dear = 7 cost T.Cheap = 3 rule part(p, _, _, _, s, _) { set T.Dear(p) } rule part(p, _, _, _, s, _), if s < 25i32 { union T.Dear(p) with T.Cheap(p) } run saturate")
    best = best_nodes(e.catalog, e.store)
    of = e.query("leteq v = T.Dear(p) print(p, v)")
    return of.join(best, of.v == best["class"]).select("p", F.col("cost").cast("bigint").alias("cost"))


# --- extraction and terms


def term(name: str, program: str, command: str, wanted: str) -> None:
    quoted = wanted.replace("'", "''")

    @query(name, f"SELECT '{quoted}' AS term")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return spark.createDataFrame([(Engine(spark).run_text(program).extract(command).term,)], "term string")


_E = "data E = Add(E, E) | Mul(E, E) | Const(i32) cost E.Add = 10 cost E.Mul = 5 cost E.Const = 1 "
term("extract_greedy", "data T = A(i32) | B(i32) cost T.A = 10 cost T.B = 5 fact union T.A(1i32) with T.B(1i32)", "extract T.A(1i32)", "(T.B 1)")
term("extract_let", _E + "fact set E.Mul(E.Add(E.Const(2i32), E.Const(2i32)), E.Const(2i32))", "extract Mul(Add(Const(2i32), Const(2i32)), Const(2i32))", "(let ([_t0 (E.Const 2)]) (E.Mul (E.Add _t0 _t0) _t0))")
term("extract_optimal", "data E = Pair(E, E) | F(E) | G(E) | H(E) | S(i32) | L(i32) cost E.F = 1 cost E.G = 1 cost E.H = 1 cost E.S = 10 cost E.L = 8 fact set E.Pair(E.G(E.S(1i32)), E.F(E.S(1i32))) fact union E.G(E.S(1i32)) with E.H(E.L(1i32))", "extract optimal E.Pair(E.G(E.S(1i32)), E.F(E.S(1i32)))", "(let ([_t0 (E.S 1)]) (E.Pair (E.G _t0) (E.F _t0)))")
term("extract_atom", "", "extract 42u64", "42")
term("extract_missing", "data Tree = Leaf(i32) | Fork(Tree, Tree) fact set Tree.Leaf(42i32)", "extract Tree.Fork(Tree.Leaf(42i32), Tree.Leaf(7i32))", "<error: Tree.Leaf has no row with these arguments>")


@query("extract_table", "SELECT p_partkey AS p, CASE WHEN p_size < 25 THEN '(T.Tag (T.Cheap ' || p_partkey || '))' ELSE '(T.Tag (T.Dear ' || p_partkey || '))' END AS v FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    # the cheapest term of a class for every part
    e = engine(spark, sf, "part")
    e.run_text("data T = Dear(i64) | Cheap(i64) | Tag(T) cost T.Dear = 7 cost T.Cheap = 3 cost T.Tag = 1 relation tagged(i64, T) rule part(p, _, _, _, s, _) { set tagged(p, T.Tag(T.Dear(p))) } rule part(p, _, _, _, s, _), if s < 25i32 { union T.Dear(p) with T.Cheap(p) } run saturate")
    return e.query_terms("tagged(p, v) print(p, v)", cheapest=True).selectExpr("cast(p as bigint) as p", "v")


@query("render_table", "SELECT DISTINCT '(Kind.Sized (Kind.B ' || p_brand || ') ' || p_size || ')' AS k FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, "part")
    e.run_text("data Kind = B(str) | Sized(Kind, i32) | Unused(Kind) rule part(_, _, b, _, s, _) { set Kind.Sized(Kind.B(b), s) } run saturate")
    return e.query_terms("leteq k = Kind.Sized(_, _) print(k)")


PROGRAMS = Path(__file__).parent / "programs"


@query("module_load", _PARENT + _CLOSED + "SELECT x, y FROM p")
def _(spark: SparkSession, sf: str) -> DataFrame:
    # a program file that loads modules which load each other
    from relsat.sources.modules import Modules

    e = parents(spark, sf)
    Modules(e).run(PROGRAMS / "go.rsat")
    return e.query("path(x, y) print(x, y)")


@query("module_folder", "SELECT DISTINCT p_brand AS b, p_size AS s FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    # a scanned folder, and one of its modules as the main one
    from relsat.sources.modules import Modules

    e = engine(spark, sf, "part")
    modules = Modules(e)
    modules.scan(PROGRAMS / "parts")
    modules.run(modules.known["main_brands"])
    return e.query("leteq k = Product.Brand(b), Product.Sized(k, s) print(b, s)")


@query("query_term", "SELECT * FROM (VALUES ('(Expr.Const 1)'), ('(Expr.Const 2)'), ('(Expr.Add (Expr.Const 2) (Expr.Const 4))')) t(v)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark).run_text("data Expr = Add(Expr, Expr) | Const(i32) fact set Expr.Const(0i32); set Expr.Const(1i32); set Expr.Add(Expr.Const(1i32), Expr.Const(0i32)); set Expr.Add(Expr.Const(2i32), Expr.Const(0i32)); set Expr.Add(Expr.Const(2i32), Expr.Const(4i32)) rule leteq r = Expr.Add(a, Expr.Const(0i32)) { union r with a } run saturate")
    return e.query_terms("leteq v = Expr.Add(_, _) print(v)")
