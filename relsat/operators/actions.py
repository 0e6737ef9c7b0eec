"""Rule bodies over a DataFrame of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relsat.catalog import BASE, Catalog, Table, check_literal, spark_type
from relsat.errors import TypeMismatch, UndefinedVariable, UnionOfBaseValues, UnknownTable, WidthMismatch
from relsat.operators.match import column, literal_column
from relsat.operators.store import Store
from relsat.sources.parser import App, Let, Lit, Set, Union, Var


def type_of(catalog: Catalog, types: dict[str, str], term: object) -> str:
    """The type of a body term; every nested call is checked."""
    if isinstance(term, Lit):
        check_literal(term.kind, term.value)
        return term.kind
    if isinstance(term, Var):
        if term.name not in types:
            raise UndefinedVariable(term.name)
        return types[term.name]
    native = catalog.natives.get(term.name)
    if native is None and term.name not in catalog.tables:
        raise UnknownTable(term.name)
    args, value = (native.args, native.value) if native else (catalog.tables[term.name].args, catalog.tables[term.name].value)
    check_args(catalog, types, term, args)
    return value


def check_args(catalog: Catalog, types: dict[str, str], call: App, args: tuple[str, ...]) -> None:
    if len(call.args) != len(args):
        raise WidthMismatch(f"{call.name} takes {len(args)} arguments, not {len(call.args)}")
    for x, kind in zip(call.args, args):
        if (t := type_of(catalog, types, x)) != kind:
            raise TypeMismatch(f"{call.name}: {t} for {kind}")


def check_bodies(catalog: Catalog, types: dict[str, str], bodies: tuple) -> None:
    types = dict(types)
    for b in bodies:
        if isinstance(b, Let):
            kind = type_of(catalog, types, b.term)
            if types.setdefault(b.name, kind) != kind:
                raise TypeMismatch(b.name)
        elif isinstance(b, Set):
            t = catalog.table(b.call.name)
            check_args(catalog, types, b.call, t.args)
            if b.value is None and t.kind == "function" and t.value in BASE:
                raise TypeMismatch(f"{t.name} needs a value")
            if b.value is not None and (k := type_of(catalog, types, b.value)) != t.value:
                raise TypeMismatch(f"{t.name}: {k} for {t.value}")
        else:
            a, z = type_of(catalog, types, b.left), type_of(catalog, types, b.right)
            if a != z:
                raise TypeMismatch(f"union of {a} with {z}")
            if a in BASE:
                raise UnionOfBaseValues(a)


class Actions:
    """Applies bodies to matches: calls are resolved bottom-up, then the rows are written."""

    def __init__(self, catalog: Catalog, store: Store) -> None:
        self.catalog, self.store, self.count = catalog, store, 0

    def value(self, m: DataFrame, env: dict[str, Column], term: object) -> tuple[DataFrame, Column]:
        if isinstance(term, Lit):
            return m, literal_column(term)
        if isinstance(term, Var):
            return m, env[term.name]
        args = []
        for x in term.args:
            m, c = self.value(m, env, x)
            args.append(c)
        self.count += 1
        out = f"__t{self.count}"
        if native := self.catalog.natives.get(term.name):
            m = m.withColumn(out, native.function(*args).cast(spark_type(native.value)))
            return m, F.col(out)
        t: Table = self.catalog.tables[term.name]
        if t.has_id and t.name not in self.store.valued:
            self.store.need_values(t)
        return self.store.lookup(t, m, args, out, create=t.has_id), F.col(out)

    def apply(self, m: DataFrame, names: list[str], bodies: tuple, dealt: bool = False) -> None:
        """``dealt``: the matches lie in the buckets of the table that is written."""
        env = {n: F.col(column(n)) for n in names}
        for b in bodies:
            if isinstance(b, Let):
                m, env[b.name] = self.value(m, env, b.term)
            elif isinstance(b, Set):
                t = self.catalog.tables[b.call.name]
                cols = {}
                for c, x, kind in zip(t.keys, b.call.args, t.args):
                    m, v = self.value(m, env, x)
                    cols[c] = v.cast(spark_type(kind)).alias(c)
                if b.value is not None:
                    if t.name not in self.store.valued:
                        self.store.need_values(t)
                    m, v = self.value(m, env, b.value)
                    cols["v"] = v.cast(spark_type(t.value)).alias("v")
                self.store.insert(t, m.select(*cols.values()) if cols else m, dealt)
            else:
                m, a = self.value(m, env, b.left)
                m, z = self.value(m, env, b.right)
                self.store.union(m.select(a.alias("a"), z.alias("b")))
