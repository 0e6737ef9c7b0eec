"""Rule heads to DataFrames: scans, guards, natural joins, semi-naive variants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from relsat.catalog import BASE, Catalog, Table, check_literal, spark_type
from relsat.errors import OrderOnClass, TypeMismatch, UndefinedVariable, WidthMismatch
from relsat.operators.store import Store
from relsat.sources.parser import Any_, App, Guard, Let, Lit, Var

COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


#: Tables of less than 8 MB on disk are small.
SMALL_BYTES = 8 << 20


@dataclass
class Atom:
    """A scan: for each key column, and the value column, a variable, a literal or nothing."""

    table: Table
    keys: list[object]
    value: object | None = None

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in [*self.keys, self.value] if isinstance(x, Var)))


@dataclass
class MatchPlan:
    atoms: list[Atom] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    guards: list[tuple[str, str, Var | Lit]] = field(default_factory=list)
    visible: list[str] = field(default_factory=list)


def column(name: str) -> str:
    """The DataFrame column of a variable."""
    return "x_" + "".join(c if c.isalnum() or c == "_" else f"_{ord(c):x}_" for c in name)


def compile_heads(catalog: Catalog, heads: tuple) -> MatchPlan:
    plan, hidden = MatchPlan(), [0]

    def typed(name: str, kind: str) -> None:
        if plan.types.setdefault(name, kind) != kind:
            raise TypeMismatch(f"{name} is {plan.types[name]} and {kind}")

    def literal(x: Lit, kind: str) -> Lit:
        if x.kind != kind:
            raise TypeMismatch(f"{x.kind} literal for {kind}")
        check_literal(kind, x.value)
        return x

    def atom(app: App, value: object | None) -> Atom:
        t = catalog.table(app.name)
        if len(app.args) != len(t.args):
            raise WidthMismatch(f"{t.name} has {len(t.args)} columns, not {len(app.args)}")
        a = Atom(t, [], value)
        plan.atoms.append(a)  # before its nested patterns: textual order
        for x, kind in zip(app.args, t.args):
            if isinstance(x, Lit):
                literal(x, kind)
            elif isinstance(x, Var):
                typed(x.name, kind)
            elif isinstance(x, App):
                hidden[0] += 1
                inner = Var(f"nested {hidden[0]}")
                typed(inner.name, kind)
                nested = atom(x, inner)
                if nested.table.value != kind:
                    raise TypeMismatch(f"{nested.table.name} is {nested.table.value}, not {kind}")
                x = inner
            a.keys.append(None if isinstance(x, Any_) else x)
        return a

    for h in heads:
        if isinstance(h, App):
            atom(h, None)
        elif isinstance(h, Let) and isinstance(h.term, App):
            a = atom(h.term, Var(h.name))
            typed(h.name, a.table.value)
        elif isinstance(h, Let):
            right = h.term
            if isinstance(right, Any_):
                continue
            if h.name not in plan.types:
                raise UndefinedVariable(h.name)
            if isinstance(right, Var):
                if right.name not in plan.types:
                    raise UndefinedVariable(right.name)
                typed(right.name, plan.types[h.name])
            else:
                literal(right, plan.types[h.name])
            plan.guards.append((h.name, "==", right))
        else:
            if h.left not in plan.types:
                raise UndefinedVariable(h.left)
            kind = plan.types[h.left]
            if isinstance(h.right, Var):
                if h.right.name not in plan.types:
                    raise UndefinedVariable(h.right.name)
                typed(h.right.name, kind)
            else:
                literal(h.right, kind)
            if kind not in BASE and h.op not in ("==", "!="):
                raise OrderOnClass(f"{h.left} {h.op} ...: classes have no order")
            plan.guards.append((h.left, h.op, h.right))
    plan.visible = [n for n in plan.types if not n.startswith("nested ")]
    return plan


def literal_column(x: Lit) -> Column:
    return F.lit(str(x.value) if x.kind == "u64" else x.value).cast(spark_type(x.kind))


def _kept(plan: MatchPlan, names: list[str]) -> list[list[str]]:
    """For each atom, the variables that the result, a guard between variables or another atom reads."""
    read = {*names, *(n for x, _, y in plan.guards if isinstance(y, Var) for n in (x, y.name))}
    return [[n for n in a.names if n in read or any(n in b.names for b in plan.atoms if b is not a)] for a in plan.atoms]


def _links(store: Store, plan: MatchPlan, kept: list[list[str]], k: int) -> bool:
    """Whether atom k has only variables of other atoms, in rows that may repeat."""
    a = plan.atoms[k]
    others = {n for j, x in enumerate(kept) if j != k for n in x}
    return bool(kept[k]) and set(kept[k]) <= others and (len(kept[k]) < len(a.keys) + (a.value is not None) or a.table.name in store.bound)


def _scan(store: Store, plan: MatchPlan, a: Atom, part: str, seen: int, kept: list[str]) -> DataFrame:
    df = store.part(a.table.name, part, seen)
    pairs = [*zip(a.table.keys, a.keys), ("v", a.value)]
    first: dict[str, str] = {}
    for c, x in pairs:
        if isinstance(x, Lit):
            df = df.where(F.col(c) == literal_column(x))
        elif isinstance(x, Var):
            if x.name in first:
                df = df.where(F.col(c) == F.col(first[x.name]))
            else:
                first[x.name] = c
    for left, op, right in plan.guards:  # guards with a literal hold at the scan
        if left in first and isinstance(right, Lit):
            df = df.where(COMPARE[op](F.col(first[left]), literal_column(right)))
    return df.select(*(F.col(c).alias(column(n)) for n, c in first.items() if n in kept))


def _joined(store: Store, plan: MatchPlan, parts: list[str], seen: int, names: list[str], scans: dict[int, DataFrame] | None = None, deal: tuple[str, int] | None = None) -> DataFrame:
    """Join the scans, starting with the delta and going on where variables are shared. ``scans``: taken instead.

    ``deal``: the result is wanted in so many partitions by a variable. It is dealt as soon as it has the variable
    where only small tables are left, which are broadcast then: their joins may make many rows of few.
    """
    left, kept = list(range(len(plan.atoms))), _kept(plan, names)
    small = lambda j: bool(kept[j]) and _scan(store, plan, plan.atoms[j], parts[j], seen, kept[j])._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL_BYTES
    dealt = False
    first = next((k for k in left if parts[k] == "new"), 0)
    df, have = None, set()
    while left:
        k = first if df is None else max(left, key=lambda j: (len(have & set(kept[j])) > 0, bool(kept[j]), -j))
        left.remove(k)
        scan = scans[k] if scans and k in scans else _scan(store, plan, plan.atoms[k], parts[k], seen, kept[k])
        if not kept[k]:
            scan = scan.limit(1).select(F.lit(1).alias("__one"))  # only whether there is a row
        elif _links(store, plan, kept, k):
            scan = scan.distinct()  # else each pair of repeated rows would be joined
        if df is None:
            df = scan
        else:
            scan = F.broadcast(scan) if dealt else scan
            shared = [column(n) for n in kept[k] if n in have]
            df = (df.join(scan, shared) if shared else df.crossJoin(scan)).drop("__one")
        have |= set(kept[k])
        if deal and not dealt and deal[0] in have and (not left or all(map(small, left))):
            df, dealt = df.repartition(deal[1], column(deal[0])), True
    assert df is not None
    for x, op, y in plan.guards:
        if isinstance(y, Var):
            df = df.where(COMPARE[op](F.col(column(x)), F.col(column(y.name))))
    return df


def _tasks(store: Store) -> int:
    """Partitions for work that is not in proportion to the bytes it reads."""
    conf = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, 4 * store.spark.sparkContext.defaultParallelism)


def _open(store: Store, plan: MatchPlan, names: list[str]) -> list[tuple[int, list[str]]]:
    """The atoms whose row is not known from the result, with the variables that are. None: no two
    combinations of rows give one result.

    The row of an atom is known where its keys are and the table has each of them once. Where
    nothing is known for sure, an atom counts as known by those of its variables that are; this
    is for the caller to see to.
    """
    kept, known, out = _kept(plan, names), set(names), []
    left = [k for k in range(len(plan.atoms)) if kept[k]]
    while left:
        def sure(k: int) -> bool:
            a = plan.atoms[k]
            if _links(store, plan, kept, k):
                return set(kept[k]) <= known
            return a.table.name not in store.bound and all(isinstance(x, Lit) or isinstance(x, Var) and x.name in known for x in a.keys)

        k = next((k for k in left if sure(k)), None)
        if k is None:
            k = max(left, key=lambda j: (len(known & set(kept[j])), -j))
            out.append((k, [n for n in kept[k] if n in known]))
        left.remove(k)
        known |= set(kept[k])
    return out


def many(plan: MatchPlan, names: list[str]) -> bool:
    """Whether several atoms have variables of their own: the join may be far larger than its tables."""
    kept = _kept(plan, names)
    return sum(any(all(n not in x for j, x in enumerate(kept) if j != k) for n in kept[k]) for k in range(len(kept))) > 1


def _split(store: Store, plan: MatchPlan, names: list[str], known: list[tuple[int, list[str]]]) -> DataFrame:
    """The distinct bindings of joins that are far larger than their tables, without an exchange of them.

    A row of an open atom is single where its known variables occur in no other. Whether a result
    comes from single rows is seen from the result, and single rows give it once; only results of
    other rows are told apart.
    """
    kept, single, several = _kept(plan, names), {}, {}
    for k, have in known:
        scan = _scan(store, plan, plan.atoms[k], "all", 0, kept[k])
        by, rest = [column(n) for n in have], [column(n) for n in kept[k] if n not in have]
        every = F.struct(*rest) if rest else F.lit(0)
        g = scan.repartition(_tasks(store), *by).groupBy(*by).agg(F.min(every).alias("lo"), F.max(every).alias("hi"))
        single[k] = g.where("lo <=> hi").select(*by, *(F.col(f"lo.{c}").alias(c) for c in rest))
        more = g.where("not (lo <=> hi)").select(*(F.col(c).alias(f"__m_{c}") for c in by))
        if rest and not more.isEmpty():
            same = F.lit(True)
            for c in by:
                same = same & F.col(c).eqNullSafe(F.col(f"__m_{c}"))
            several[k] = scan.join(more, same, "left_semi").distinct()
    cols, all_ = [column(n) for n in names], ["all"] * len(plan.atoms)
    out = _joined(store, plan, all_, 0, names, single).select(*cols)
    rest = None
    for i, (k, _) in enumerate(known):
        if k in several:
            scans = {j: single[j] if at < i else several[j] if at == i else single[j].unionByName(several[j]) if j in several else single[j] for at, (j, _) in enumerate(known)}
            part = _joined(store, plan, all_, 0, names, scans).select(*cols)
            rest = part if rest is None else rest.unionByName(part)
    return out if rest is None else out.unionByName(rest.distinct())


def match(store: Store, plan: MatchPlan, seen: int | None = None, names: list[str] | None = None, once: bool = True, deal: tuple[str, int] | None = None) -> DataFrame | None:
    """All bindings of ``names`` (all visible variables), or those with a row newer than ``seen``.

    The semi-naive variants are complete: for the i-th atom new, the atoms before it are old
    and those after it whole, so that no combination is missed or met twice. None: no atom
    has new rows. Without ``once``, bindings may come several times.
    ``deal``: a variable and the number of partitions in which the bindings are wanted.
    """
    for a in plan.atoms:
        if a.value is not None and a.table.name not in store.valued:
            store.need_values(a.table)
    names = plan.visible if names is None else names
    n = len(plan.atoms)
    known = _open(store, plan, names) if names else []
    if once and seen is None and sum(len(have) < len(_kept(plan, names)[k]) for k, have in known) > 1 and all(have for _, have in known):
        return _split(store, plan, names, known)
    if seen is None:
        out = [_joined(store, plan, ["all"] * n, 0, names, None, deal)]
    else:
        fresh = [store.changed[a.table.name] > seen for a in plan.atoms]
        out = [_joined(store, plan, ["old"] * i + ["new"] + ["all"] * (n - i - 1), seen, names, None, deal) for i in range(n) if fresh[i]]
        if not out:
            return None
    cols = [column(x) for x in names]
    df = out[0].select(*cols) if cols else out[0].select(F.lit(1).alias("__unit")).limit(1)
    for more in out[1:]:
        df = df.unionByName(more.select(*cols)) if cols else df.union(more.select(F.lit(1).alias("__unit")).limit(1))
    return df if names and not (known and once) else df.distinct()  # nothing open: no result occurs twice
