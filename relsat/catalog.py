"""Types, tables, costs and native functions that a program has declared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from relsat.errors import DuplicateTable, DuplicateType, LiteralOutOfRange, MergeOnNonNumeric, MergeRequired, UnknownConstructor, UnknownTable, UnknownType

#: Surface type -> Spark type. Unsigned types are held in the next wider signed one.
BASE = {"bool": "boolean", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "f32": "float", "f64": "double", "str": "string"}
RANGES = {f"i{b}": (-(1 << b - 1), (1 << b - 1) - 1) for b in (8, 16, 32, 64)} | {f"u{b}": (0, (1 << b) - 1) for b in (8, 16, 32, 64)}
#: The type of the hidden value of a relation.
ROW_ID = "Id"


def spark_type(kind: str) -> str:
    return BASE.get(kind, "bigint")


def check_literal(kind: str, value: object) -> object:
    if kind in RANGES:
        lo, hi = RANGES[kind]
        if not lo <= value <= hi:  # type: ignore[operator]
            raise LiteralOutOfRange(f"{value} is no {kind}")
    return value


@dataclass(frozen=True)
class Table:
    """``kind``: constructor, relation or function. Keys are c0, c1, ..., the value is v."""

    name: str
    kind: str
    args: tuple[str, ...]
    value: str
    merge: str | None = None
    order: int = 0

    @property
    def keys(self) -> list[str]:
        return [f"c{k}" for k in range(len(self.args))]

    @property
    def has_id(self) -> bool:
        return self.value not in BASE

    @property
    def id_columns(self) -> list[str]:
        return [c for c, t in zip([*self.keys, "v"], [*self.args, self.value]) if t not in BASE]


@dataclass(frozen=True)
class Native:
    args: tuple[str, ...]
    value: str
    function: Callable


@dataclass
class Catalog:
    types: set[str] = field(default_factory=set)
    tables: dict[str, Table] = field(default_factory=dict)
    costs: dict[str, int] = field(default_factory=dict)
    natives: dict[str, Native] = field(default_factory=dict)

    def add_type(self, name: str, constructors: list[tuple[str, tuple[str, ...]]]) -> list[Table]:
        """All or nothing; argument types may be declared later or never."""
        if name in self.types or name in BASE:
            raise DuplicateType(name)
        new = [Table(f"{name}.{c}", "constructor", tuple(a), name, order=len(self.tables) + k) for k, (c, a) in enumerate(constructors)]
        names = [t.name for t in new]
        for t in names:
            if t in self.tables or names.count(t) > 1:
                raise DuplicateTable(t)
        self.types.add(name)
        self.tables |= {t.name: t for t in new}
        return new

    def known_type(self, kind: str) -> str:
        if kind not in BASE and kind not in self.types and kind != ROW_ID:
            raise UnknownType(kind)
        return kind

    def add_relation(self, name: str, args: tuple[str, ...]) -> Table:
        return self._add(Table(name, "relation", tuple(map(self.known_type, args)), ROW_ID, order=len(self.tables)))

    def add_function(self, name: str, args: tuple[str, ...], value: str, merge: str | None) -> Table:
        for t in (*args, value):
            self.known_type(t)
        if value in BASE and merge is None:
            raise MergeRequired(name)
        if value == "str" and merge:
            raise MergeOnNonNumeric(name)
        return self._add(Table(name, "function", tuple(args), value, merge, len(self.tables)))

    def _add(self, t: Table) -> Table:
        if t.name in self.tables:
            raise DuplicateTable(t.name)
        self.tables[t.name] = t
        return t

    def table(self, name: str) -> Table:
        if name in self.tables:
            return self.tables[name]
        raise UnknownTable(name)

    def constructor(self, name: str) -> Table:
        """A constructor by its full or, where that is unique, its short name."""
        t = self.tables.get(name)
        if t is not None and t.kind == "constructor":
            return t
        short = [t for t in self.tables.values() if t.kind == "constructor" and t.name.endswith(f".{name}")]
        if len(short) != 1:
            raise UnknownConstructor(f"{name} ({'ambiguous' if short else 'not declared'})")
        return short[0]

    def set_cost(self, name: str, cost: int) -> None:
        t = self.tables.get(name)
        if t is None or t.kind != "constructor":
            raise UnknownConstructor(name)
        self.costs[name] = int(check_literal("u64", cost))  # type: ignore[call-overload]
