"""A session: declarations, facts, rules, runs, queries and extraction over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from relsat.catalog import BASE, Catalog, Native, Table, spark_type
from relsat.errors import Diverged, ModuleError, RelsatError, UndefinedVariable, UnknownGroup, VariableInExtract, WidthMismatch
from relsat.functions.natives import prelude
from relsat.operators.actions import Actions, check_args, check_bodies
from relsat.operators.extract import Extracted, class_terms, enodes, extract, show
from relsat.operators.match import MatchPlan, column, compile_heads, many, match
from relsat.operators.staging import mark, staged, sweep
from relsat.operators.store import Store
from relsat.sources import parser as p


#: Bytes of an exchange that one task reads: in memory they become up to forty times as many.
TASK_BYTES = 8 << 20


def tuned(spark: SparkSession) -> None:
    """Small partitions after exchanges for this session, unless it has a setting of its own."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(key) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(key, str(TASK_BYTES))


@dataclass
class RulePlan:
    group: str | None
    plan: MatchPlan
    bodies: tuple
    seen: int | None = None

    def simple(self, natives: dict) -> bool:
        """One write without calls of tables: the matches are used once and need no table of their own,
        and what is written is told apart anyway."""
        def plain(x: object) -> bool:
            return not isinstance(x, p.App) or x.name in natives and all(map(plain, x.args))

        b = self.bodies[0]
        return len(self.bodies) == 1 and isinstance(b, p.Set) and all(map(plain, (*b.call.args, b.value)))


class Engine:
    """``max_rounds`` and ``max_rows`` guard against programs that never saturate."""

    def __init__(self, spark: SparkSession, max_rounds: int | None = None, max_rows: int | None = None) -> None:
        self.spark, self.max_rounds, self.max_rows = spark, max_rounds, max_rows
        tuned(spark)
        self.catalog = Catalog(natives=prelude())
        self.store = Store(spark)
        self.actions = Actions(self.catalog, self.store)
        self.rules: list[RulePlan] = []
        self.output: list[str] = []
        #: What takes the lines of queries and extractions, one by one as they arrive; ``output`` by default.
        self.sink: Callable[[str], object] = self.output.append
        self.warnings: list[str] = []
        self.last: Extracted | None = None

    # --- declarations

    def register_native(self, name: str, args: Iterable[str], value: str, function: Callable, python: bool = False) -> None:
        """A scalar function of columns; with ``python``, of pandas series (Arrow batches)."""
        if python:
            function = F.pandas_udf(function, spark_type(value), F.PandasUDFType.SCALAR)
        self.catalog.natives[name] = Native(tuple(args), value, function)

    def bind(self, name: str, df: DataFrame, types: Iterable[str], value: str | None = None, merge: str | None = None) -> Table:
        """A relation, or with ``value`` a function, whose rows are those of ``df`` (columns in order).

        Nulls are values that equal themselves when rows are stored; no pattern joins or compares them.
        """
        types = tuple(types)
        if len(df.columns) != len(types) + (value is not None):
            raise WidthMismatch(f"{name}: {len(df.columns)} columns")
        t = self.catalog.add_relation(name, types) if value is None else self.catalog.add_function(name, types, value, merge)
        self.store.version += 1
        self.store.bind(t, df)
        return t

    def insert_df(self, name: str, df: DataFrame) -> None:
        """Rows into a declared table: keys in order, then the value where a function has one."""
        t = self.catalog.table(name)
        names = [*t.keys, "v"][: len(df.columns)]
        self.store.insert(t, df.toDF(*names))
        self._close()

    def fresh_id(self, n: int = 1) -> int:
        """An id that no row has or will get; with ``n``, the first of so many."""
        return self.store.reserve(n)

    def union_df(self, df: DataFrame) -> None:
        """Make the ids in the two columns of ``df`` equal."""
        self.store.union(df.toDF("a", "b"))
        self._close()

    def _close(self) -> None:
        self.store.rebuild()
        self.store.step()

    # --- commands

    def run_text(self, text: str) -> "Engine":
        """Execute a program: loads are left to the caller; types first, then the rest in order."""
        self.execute(p.parse(text))
        return self

    def execute(self, commands: list[object]) -> None:
        errors = []
        for c in commands:
            if isinstance(c, p.Data):
                try:
                    self.declare(c)
                except RelsatError as e:
                    errors.append(e)
        if errors:
            raise errors[0] if len(errors) == 1 else type(errors[0])("; ".join(map(str, errors)))
        facts: list[tuple] = []
        for c in commands:
            if isinstance(c, p.Fact):
                check_bodies(self.catalog, {}, c.bodies)
                facts.append(c.bodies)
                continue
            if facts:
                self.facts(facts)
                facts = []
            if isinstance(c, p.Load):
                raise ModuleError(f'load "{c.name}" needs a program file')
            if not isinstance(c, p.Data):
                self.command(c)
        if facts:
            self.facts(facts)

    def declare(self, c: object) -> None:
        if isinstance(c, p.Data):
            for t in self.catalog.add_type(c.name, list(c.constructors)):
                self.store.add(t)
        elif isinstance(c, p.Relation):
            self.store.add(self.catalog.add_relation(c.name, c.args))
        elif isinstance(c, p.Function):
            self.store.add(self.catalog.add_function(c.name, c.args, c.value, c.merge))
        elif isinstance(c, p.Cost):
            self.catalog.set_cost(c.name, c.value)
        elif isinstance(c, p.Rule):
            plan = compile_heads(self.catalog, c.heads)
            check_bodies(self.catalog, plan.types, c.bodies)
            for a in plan.atoms:
                if a.value is not None:
                    self.store.need_values(a.table)
            self.rules.append(RulePlan(c.group, plan, c.bodies))
            self._deal(plan, c.bodies)
        else:
            raise ModuleError(f"{type(c).__name__.lower()} is no declaration")

    def _deal(self, plan: MatchPlan, bodies: tuple) -> None:
        """A table that its own rows extend is dealt by the key which joins it to the others."""
        written = {b.call.name for b in bodies if isinstance(b, p.Set)}
        for a in plan.atoms:
            if a.table.name in written:
                others = {n for b in plan.atoms if b is not a for n in b.names}
                for c, x in zip(a.table.keys, a.keys):
                    if isinstance(x, p.Var) and x.name in others:
                        self.store.deal(a.table, c)

    def command(self, c: object) -> None:
        if isinstance(c, p.Run):
            self.run(c)
        elif isinstance(c, p.Query):
            names = list(c.names)
            for r in self.show(c).toLocalIterator():
                self.sink(", ".join(f"{n}: {r[column(n)]}" for n in names))
        elif isinstance(c, p.Extract):
            self.last = self.extract_term(c.term, c.optimal)
            self.warnings += self.last.warnings
            self.sink(self.last.term)
        elif isinstance(c, p.Fact):
            check_bodies(self.catalog, {}, c.bodies)
            self.facts([c.bodies])
        else:
            self.declare(c)

    # --- facts

    def facts(self, facts: list[tuple]) -> None:
        """A batch of ground facts: terms are interned level by level, then written, then closed."""
        terms = [x for bodies in facts for b in bodies for x in (((b.call, b.value) if isinstance(b, p.Set) else (b.left, b.right)) if not isinstance(b, p.Let) else (p.Var(""),))]
        if any(self._needs_columns(x) for x in terms if x is not None):
            one = self.spark.range(1).select(F.lit(1).alias("__unit"))
            for bodies in facts:
                self.actions.apply(one, [], bodies)
            self._close()
            return
        ids: dict[object, int] = {}
        written: dict[str, list[tuple]] = {}
        edges: list[tuple[int, int]] = []
        wanted: list[p.App] = []
        for bodies in facts:
            for b in bodies:
                if isinstance(b, p.Set):
                    wanted += [x for x in (*b.call.args, b.value) if isinstance(x, p.App)]
                    if self.catalog.tables[b.call.name].kind == "constructor" and b.value is None:
                        wanted.append(b.call)
                else:
                    wanted += [b.left, b.right]
        self._intern(wanted, ids, create=True)
        value = lambda x: x.value if isinstance(x, p.Lit) else ids[x]
        for bodies in facts:
            for b in bodies:
                if isinstance(b, p.Union):
                    edges.append((value(b.left), value(b.right)))
                elif not (self.catalog.tables[b.call.name].kind == "constructor" and b.value is None):
                    key = tuple(value(x) for x in b.call.args)
                    written.setdefault(b.call.name + ("=" if b.value is not None else ""), []).append(key if b.value is None else (*key, value(b.value)))
        for name, rows in written.items():
            t = self.catalog.tables[name.rstrip("=")]
            if name.endswith("=") and t.name not in self.store.valued:
                self.store.need_values(t)
            self.store.insert(t, self._local(t, rows, name.endswith("=")))
        if edges:
            self.store.union(self.spark.createDataFrame(edges, "a bigint, b bigint"))
        self._close()

    def _needs_columns(self, x: object) -> bool:
        if isinstance(x, p.Var):
            return True
        if isinstance(x, p.Lit):
            return False
        t = self.catalog.tables.get(x.name)
        return x.name in self.catalog.natives or t is None or any(map(self._needs_columns, x.args))

    def _local(self, t: Table, rows: list[tuple], valued: bool, number: bool = False) -> DataFrame:
        from decimal import Decimal

        kinds = [*t.args, *([t.value] if valued else [])]
        fix = lambda v, k: Decimal(v) if k == "u64" else v
        data = [tuple(fix(v, k) for v, k in zip(r, kinds)) + ((i,) if number else ()) for i, r in enumerate(rows)]
        fields = [f"{c} {spark_type(k)}" for c, k in zip([*t.keys, "v"], kinds)] + (["i int"] if number else [])
        return self.spark.createDataFrame(data, ", ".join(fields)) if fields else self.spark.range(1).select()

    def _intern(self, terms: list, ids: dict[object, int], create: bool) -> None:
        """Ids of ground terms, children first; missing ones stay out unless ``create``."""
        depth: dict[object, int] = {}

        def level(x: object) -> int:
            if not isinstance(x, p.App):
                return 0
            if x not in depth:
                depth[x] = 1 + max(map(level, x.args), default=0)
            return depth[x]

        for x in terms:
            level(x)
        for d in sorted(set(depth.values())):
            by: dict[str, list[p.App]] = {}
            for x, k in depth.items():
                if k == d and x not in ids and all(not isinstance(a, p.App) or a in ids for a in x.args):
                    by.setdefault(x.name, []).append(x)
            for name, apps in by.items():
                t = self.catalog.tables[name] if create else self.catalog.constructor(name)
                if t.name not in self.store.valued:
                    self.store.need_values(t)
                if not t.args:
                    if create:
                        self.store.intern(t, self.spark.range(1))
                    found = [(0, r["v"]) for r in self.store.rows[t.name].select("v").take(1)]
                else:
                    keys = self._local(t, [tuple(a.value if isinstance(a, p.Lit) else ids[a] for a in x.args) for x in apps], False, True)
                    if create and t.has_id:
                        self.store.intern(t, keys)
                    found = [(r["i"], r["v"]) for r in keys.join(self.store.rows[t.name], t.keys).select("i", "v").collect()]  # as many as the program has terms
                for i, v in found:
                    ids[apps[i]] = v

    # --- running

    def run(self, c: p.Run) -> bool:
        """Whether the run ended because nothing was new."""
        if isinstance(c.inner, tuple):
            times = 0
            while c.times is None or times < c.times:
                times += 1
                if all([self.run(x) for x in c.inner]) and times:
                    return True
            return False
        rules = self.rules if c.inner is None else [r for r in self.rules if r.group == c.inner]
        if c.inner is not None and not rules:
            raise UnknownGroup(str(c.inner))
        return self.saturate(rules, c.times)

    def saturate(self, rules: list[RulePlan] | None = None, times: int | None = None) -> bool:
        """Rounds: all rules match the same state, then all bodies are applied and closed."""
        rules = self.rules if rules is None else rules
        rounds, began = 0, mark()
        while times is None or rounds < times:
            if self.max_rounds is not None and rounds >= self.max_rounds:
                raise Diverged(f"no fixpoint after {rounds} rounds")
            rounds += 1
            now = self.store.version
            matches = []
            for r in rules:
                simple = r.simple(self.catalog.natives)
                if simple and self.store.starts(r.bodies[0].call.name) and many(r.plan, self._used(r)):
                    self.store.start(self.catalog.tables[r.bodies[0].call.name], match(self.store, r.plan, r.seen, self._used(r), False))
                deal = self._dealt(r) if simple else None
                m = match(self.store, r.plan, r.seen, self._used(r), not simple, deal)
                r.seen = now
                if m is not None:
                    matches.append((r, m if simple else staged(m, "matches"), deal))
            for r, m, deal in matches:
                if r.simple(self.catalog.natives) or not m.isEmpty():
                    self.actions.apply(m, self._used(r), r.bodies, deal is not None)
            self._close()
            done = all(v <= now for v in self.store.changed.values())
            if done or rounds % 8 == 0:  # versions of tables that no later round reads
                sweep(began, *self.store.rows.values())
            if done:
                return True
            if self.max_rows is not None and (n := sum(self.store.rows[t].count() for t, v in self.store.changed.items() if v > now)) > self.max_rows:
                raise Diverged(f"{n} rows after {rounds} rounds")
        return False

    def _dealt(self, r: RulePlan) -> tuple[str, int] | None:
        """The variable by which what a rule writes is dealt, and the number of buckets."""
        call = r.bodies[0].call
        if call.name not in self.store.logs:
            return None
        x = call.args[self.catalog.tables[call.name].keys.index(self.store.deals[call.name])]
        return (x.name, self.store.buckets[call.name]) if isinstance(x, p.Var) else None

    def _used(self, r: RulePlan) -> list[str]:
        """The variables of the heads that the bodies read: the others are pruned before joining on."""
        seen: set[str] = set()

        def walk(x: object) -> None:
            if isinstance(x, p.Var):
                seen.add(x.name)
            elif isinstance(x, p.App):
                for a in x.args:
                    walk(a)

        for b in r.bodies:
            for x in (b.term,) if isinstance(b, p.Let) else (b.call, b.value) if isinstance(b, p.Set) else (b.left, b.right):
                walk(x)
        return [n for n in r.plan.visible if n in seen]

    # --- queries

    def query(self, text: str) -> DataFrame:
        """The bindings of ``query ... print(a, b)`` as columns a, b: values, or ids of classes."""
        c = p.parse(text if text.lstrip().startswith("query") else f"query {text}")[0]
        return self.query_df(c)  # type: ignore[arg-type]

    def query_df(self, c: p.Query) -> DataFrame:
        plan = compile_heads(self.catalog, c.heads)
        for n in c.names:
            if n not in plan.types:
                raise UndefinedVariable(n)
        m = match(self.store, plan, None, list(dict.fromkeys(c.names)))
        return m.select(*(F.col(column(n)).alias(n) for n in dict.fromkeys(c.names)))  # type: ignore[union-attr]

    def query_terms(self, text: str, cheapest: bool = False) -> DataFrame:
        """Like ``query``, with classes and values rendered as terms: each class by its lowest term,
        or with ``cheapest`` by the one that a greedy extraction gives, shared parts written out."""
        c = p.parse(text if text.lstrip().startswith("query") else f"query {text}")[0]
        out = self.show(c, cheapest)  # type: ignore[arg-type]
        return out.select(*(F.col(column(n)).alias(n) for n in dict.fromkeys(c.names)))  # type: ignore[attr-defined]

    def show(self, c: p.Query, cheapest: bool = False) -> DataFrame:
        plan = compile_heads(self.catalog, c.heads)
        df = self.query_df(c)
        names = list(dict.fromkeys(c.names))
        df = df.select(*(F.col(f"`{n}`").alias(column(n)) for n in names))
        if any(plan.types[n] not in BASE for n in names):
            roots = None
            df = staged(df, "bindings")
            for n in names:
                if plan.types[n] not in BASE:
                    ids = df.select(F.col(column(n)).alias("class"))
                    roots = ids if roots is None else roots.unionByName(ids)
            terms = class_terms(self.catalog, self.store, roots, cheapest)  # type: ignore[arg-type]
            for n in names:
                if plan.types[n] not in BASE:
                    df = df.join(terms.select(F.col("class").alias(column(n)), F.col("term").alias("__term")), column(n), "left").withColumn(column(n), F.coalesce("__term", F.lit("..."))).drop("__term")
        return df.select(*(F.regexp_replace(F.col(column(n)).cast("string"), r"\.0$", "").alias(column(n)) if plan.types[n] in ("f32", "f64") else F.col(column(n)).cast("string").alias(column(n)) for n in names)).distinct()

    def enodes_of(self, class_id: int) -> DataFrame:
        """The constructor rows of a class."""
        df = enodes(self.catalog, self.store)
        if df is None:
            return self.spark.createDataFrame([], "class bigint, ord int, keys array<string>")
        return df.where(F.col("class") == class_id)

    def extract(self, text: str, **options: object) -> Extracted:
        """``extract [optimal] term``; the command word may be left out."""
        c = p.parse(text if text.lstrip().startswith("extract") else f"extract {text}")[0]
        return self.extract_term(c.term, c.optimal, **options)  # type: ignore[attr-defined]

    def extract_term(self, term: object, optimal: bool, **options: object) -> Extracted:
        if isinstance(term, p.Lit):
            return Extracted(show(term.value, term.kind), 0, optimal or None)
        full = self._full_names(term)
        ids: dict[object, int] = {}
        self._intern([full], ids, create=False)
        if full not in ids:
            missing = self._first_missing(full, ids)
            return Extracted(f"<error: {missing} has no row with these arguments>")
        return extract(self.catalog, self.store, ids[full], optimal, **options)  # type: ignore[arg-type]

    def _full_names(self, x: object) -> object:
        if isinstance(x, p.Var):
            raise VariableInExtract(x.name)
        if isinstance(x, p.Lit):
            return x
        t = self.catalog.constructor(x.name)
        full = p.App(t.name, tuple(map(self._full_names, x.args)))
        check_args(self.catalog, {}, full, t.args)
        return full

    def _first_missing(self, x: p.App, ids: dict[object, int]) -> str:
        for a in x.args:
            if isinstance(a, p.App) and a not in ids:
                return self._first_missing(a, ids)
        return x.name


def run_file(spark: SparkSession, path: str | Path, **options: object) -> Engine:
    from relsat.sources.modules import Modules

    engine = Engine(spark, **options)  # type: ignore[arg-type]
    Modules(engine).run(Path(path))
    return engine
