"""Terms of classes: cheapest term by a cost fixpoint, exact shared cost, and rendering."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, Row, functions as F

from relsat.catalog import BASE, Catalog, Table
from relsat.operators.staging import staged
from relsat.operators.store import Store

TOP = (1 << 64) - 1


@dataclass(frozen=True)
class Node:
    """A constructor row: its class, table, and key values (ids as int, the rest as printed)."""

    table: Table
    keys: tuple

    @property
    def children(self) -> list[int]:
        return [k for k, t in zip(self.keys, self.table.args) if t not in BASE]


@dataclass
class Extracted:
    term: str
    cost: int | None = None
    optimal: bool | None = None
    warnings: list[str] = field(default_factory=list)


def show(value: object, kind: str) -> str:
    if kind == "bool":
        return str(value).lower()
    if kind in ("f32", "f64"):
        x = float(value)  # type: ignore[arg-type]
        return str(int(x)) if x == int(x) else repr(x)
    return str(value)


def constructors(catalog: Catalog) -> list[Table]:
    return sorted((t for t in catalog.tables.values() if t.kind == "constructor"), key=lambda t: t.order)


def _printed(t: Table) -> Column:
    return F.array(*[F.col(c).cast("string") for c in t.keys]) if t.keys else F.array().cast("array<string>")


def enodes(catalog: Catalog, store: Store) -> DataFrame | None:
    """All constructor rows: ``class``, ``ord`` (the constructor), ``keys`` (as strings)."""
    out = None
    for t in constructors(catalog):
        df = store.rows[t.name].select(F.col("v").alias("class"), F.lit(t.order).alias("ord"), _printed(t).alias("keys"))
        out = df if out is None else out.unionByName(df)
    return out


def _kids(t: Table) -> list[str]:
    return [c for c, k in zip(t.keys, t.args) if k not in BASE]


def reached(catalog: Catalog, store: Store, roots: DataFrame) -> DataFrame:
    """``class``: the classes in column ``class`` of ``roots`` and all that their rows refer to."""
    new = staged(roots.select("class").where("class is not null").distinct(), "reached")
    done, rounds = new, 0
    while not new.isEmpty():
        rounds += 1
        done = staged(done, "reached") if rounds % 8 == 0 else done
        out = None
        for t in constructors(catalog):
            for c in _kids(t):
                df = store.rows[t.name].join(new, F.col("v") == F.col("class"), "left_semi").select(F.col(c).alias("class"))
                out = df if out is None else out.unionByName(df)
        if out is None:
            break
        new = staged(out.distinct().join(done, "class", "left_anti"), "reached")
        done = done.unionByName(new)
    return done


def best_nodes(catalog: Catalog, store: Store, only: DataFrame | None = None) -> DataFrame | None:
    """The cheapest row of each class (of ``only``): ``class``, ``cost``, ``h`` (height), ``ord``, ``keys``.

    A fixpoint of min over (cost, height, constructor, keys); costs saturate at 2**64 - 1.
    Taking height second keeps the choice acyclic where constructors cost nothing. A round
    prices the rows that refer to a class whose choice has changed, and no others.
    """
    tables = constructors(catalog)
    if not tables:
        return None
    rows = {t.name: store.rows[t.name] if only is None else store.rows[t.name].join(only, F.col("v") == F.col("class"), "left_semi") for t in tables}
    best: DataFrame | None = None
    changed: DataFrame | None = None
    appends = 0
    while True:
        out = None
        for t in tables:
            kids, df = _kids(t), rows[t.name]
            if bool(kids) != (best is not None):  # leaves in the first round, the others in all later ones
                continue
            if kids:
                news = [df.join(changed.select(F.col("class").alias(c)), c, "left_semi") for c in kids]  # type: ignore[union-attr]
                df = news[0]
                for more in news[1:]:
                    df = df.unionByName(more)
                df = df.distinct() if len(news) > 1 else df
            cost, height = F.lit(str(catalog.costs.get(t.name, 0))).cast("decimal(20,0)").cast("decimal(38,0)"), F.lit(0)
            for c in kids:
                df = df.join(best.select(F.col("class").alias(c), F.col("cost").alias(f"cost_{c}"), F.col("h").alias(f"h_{c}")), c)  # type: ignore[union-attr]
                cost, height = cost + F.col(f"cost_{c}"), F.greatest(height, F.col(f"h_{c}"))
            df = df.select(F.col("v").alias("class"), F.struct(F.least(cost, F.lit(str(TOP)).cast("decimal(38,0)")).cast("decimal(38,0)").alias("cost"), (height + 1).alias("h"), F.lit(t.order).alias("ord"), _printed(t).alias("keys")).alias("b"))
            out = df if out is None else out.unionByName(df)
        if out is None:
            return best
        now = out.groupBy("class").agg(F.min("b").alias("b"))
        if best is None:
            best = changed = staged(now.select("class", "b.cost", "b.h", "b.ord", "b.keys"), "best")
            continue
        was = best.select(F.col("class").alias("__c"), F.struct("cost", "h", "ord", "keys").alias("old"))
        now = now.join(was, F.col("class") == F.col("__c"), "left").where("old is null or b < old")
        changed = staged(now.select("class", "b.cost", "b.h", "b.ord", "b.keys"), "best")
        if changed.isEmpty():
            return best
        best = best.join(changed.select("class"), "class", "left_anti").unionByName(changed)
        appends += 1
        if appends % 4 == 0:
            best = staged(best, "best")


def class_terms(catalog: Catalog, store: Store, roots: DataFrame, cheapest: bool = False) -> DataFrame:
    """``class`` and ``term`` of the classes that ``roots`` (column ``class``) reaches: of each its
    lowest term, first constructor, least arguments; or with ``cheapest`` the one of least cost.

    Terms are written out in full, shared parts each time.
    """
    tables = constructors(catalog)
    done = store.spark.createDataFrame([], "class bigint, term string")
    if not tables:
        return done
    only = reached(catalog, store, roots)
    rows = {t.name: store.rows[t.name].withColumnRenamed("v", "class").join(only, "class", "left_semi") for t in tables}
    if cheapest:
        best = best_nodes(catalog, store, only)
        pick = staged(best.select("class", "ord", "keys"), "chosen")  # type: ignore[union-attr]
        for t in tables:
            own = pick.where(F.col("ord") == t.order).select(F.col("class").alias("__c"), F.col("keys").alias("__k"))
            rows[t.name] = rows[t.name].join(own, (F.col("class") == F.col("__c")) & (_printed(t) == F.col("__k")), "left_semi")
    first = True
    while True:
        out = None
        for t in tables:
            kids = _kids(t)
            if kids and first:
                continue
            df = rows[t.name].join(done.select("class"), "class", "left_anti")
            shown: dict[str, Column] = {}
            for c, kind in zip(t.keys, t.args):
                if kind in BASE:
                    s = F.col(c).cast("string")
                    shown[c] = F.regexp_replace(s, r"\.0$", "") if kind in ("f32", "f64") else s
                else:
                    df = df.join(done.select(F.col("class").alias(c), F.col("term").alias(f"t_{c}")), c)
                    shown[c] = F.col(f"t_{c}")
            term = F.concat(F.lit(f"({t.name} "), F.array_join(F.array(*[shown[c] for c in t.keys]), " ") if t.keys else F.lit(""), F.lit(")"))
            df = df.select("class", F.struct(F.lit(t.order).alias("ord"), F.length(term).alias("len"), term.alias("term")).alias("b"))
            out = df if out is None else out.unionByName(df)
        first = False
        if out is None:
            return done
        new = staged(out.groupBy("class").agg(F.min("b").alias("b")).select("class", "b.term"), "terms")
        if new.isEmpty():
            return done
        done = done.unionByName(new)


#: Rows up to which a whole graph is collected at once, and classes up to which a reached part is
#: priced on the driver (their number is checked first).
DRIVER_ROWS, DRIVER_CLASSES = 20_000, 20_000


def _collect(nodes: DataFrame, catalog: Catalog, root: int, most: int) -> dict[int, list[Node]] | None:
    """Rows of the classes that ``root`` reaches; None beyond ``most`` classes. A small graph comes
    in one piece, a larger one by a frontier join."""
    by_order = {t.order: t for t in constructors(catalog)}

    def node(r: Row) -> Node:
        t = by_order[r["ord"]]
        return Node(t, tuple(int(k) if kind not in BASE else show(k, kind) for k, kind in zip(r["keys"], t.args)))

    every: dict[int, list[Node]] | None = None
    some = nodes.limit(DRIVER_ROWS + 1).collect()
    if len(some) <= DRIVER_ROWS:
        every = {}
        for r in some:
            every.setdefault(r["class"], []).append(node(r))
    found: dict[int, list[Node]] = {}
    frontier = {root}
    while frontier:
        if len(found) + len(frontier) > most:
            return None
        for x in frontier:
            found[x] = every.get(x, []) if every is not None else []
        if every is None:
            ids = nodes.sparkSession.createDataFrame([(x,) for x in sorted(frontier)], "class bigint")
            for r in nodes.join(F.broadcast(ids), "class").toLocalIterator():  # rows of at most ``most`` classes
                found[r["class"]].append(node(r))
        frontier = {c for x in frontier for n in found[x] for c in n.children} - set(found)
    return found


def cheapest(nodes: dict[int, list[Node]], costs: dict[str, int]) -> dict[int, Node]:
    """The row that ``best_nodes`` takes, for a graph on the driver; classes without a finite term are left out."""
    best: dict[int, tuple[int, int, int, tuple[str, ...]]] = {}
    chosen: dict[int, Node] = {}
    users: dict[int, list[tuple[int, Node]]] = {}
    for x, ns in nodes.items():
        for n in ns:
            for c in set(n.children):
                users.setdefault(c, []).append((x, n))
    todo = [(x, n) for x, ns in nodes.items() for n in ns if not n.children]
    while todo:
        again: dict[int, None] = {}
        for x, n in todo:
            if all(c in best for c in n.children):
                cost = min(TOP, costs.get(n.table.name, 0) + sum(best[c][0] for c in n.children))
                rank = (cost, 1 + max((best[c][1] for c in n.children), default=0), n.table.order, tuple(map(str, n.keys)))
                if x not in best or rank < best[x]:
                    best[x], chosen[x] = rank, n
                    again[x] = None
        todo = list(dict.fromkeys(u for x in again for u in users.get(x, ())))
    return chosen


def build(root: int, chosen: dict[int, Node], lets: bool = True) -> str:
    """The term of ``root``; classes that the chosen graph refers to more than once are bound."""
    refs: dict[int, int] = {}
    stack, seen = [root], {root}
    while stack:
        for c in chosen[stack.pop()].children:
            refs[c] = refs.get(c, 0) + 1
            if c not in seen:
                seen.add(c)
                stack.append(c)
    names: dict[int, str] = {}
    bound: list[tuple[str, str]] = []
    done: dict[int, str] = {}

    def text(x: int) -> str:
        n = chosen[x]
        return f"({n.table.name} {' '.join(visit(k) if t not in BASE else k for k, t in zip(n.keys, n.table.args))})"

    def visit(x: int) -> str:
        if not lets or refs.get(x, 0) < 2:
            return text(x)
        if x not in names:
            names[x] = f"_t{len(names)}"
            done[x] = text(x)
            bound.append((names[x], done[x]))
        return names[x]

    body = text(root)
    if not bound:
        return body
    return f"(let ({''.join(f'[{n} {t}]' for n, t in bound)}) {body})"


def dag_cost(root: int, chosen: dict[int, Node], costs: dict[str, int]) -> int:
    seen, stack = {root}, [root]
    total = 0
    while stack:
        n = chosen[stack.pop()]
        total += costs.get(n.table.name, 0)
        for c in n.children:
            if c not in seen:
                seen.add(c)
                stack.append(c)
    return min(total, TOP)


def sharing(nodes: dict[int, list[Node]]) -> dict[int, int]:
    """Of each class the number of rows that refer to it."""
    parents: dict[int, set[tuple[int, int]]] = {}
    for x, ns in nodes.items():
        for k, n in enumerate(ns):
            for c in n.children:
                parents.setdefault(c, set()).add((x, k))
    return {c: len(p) for c, p in parents.items()}


class Search:
    """The acyclic choice of least total cost over distinct classes.

    A state is a set of chosen classes and the open ones that they refer to. Its bound is a
    relaxation: every class passes on to each class that may refer to it an equal share of its
    own least cost, so no choice can pay less in total; what is chosen or open already passes
    on nothing, for it is paid once elsewhere. Open classes that reach no common undecided
    class are independent and solved one by one, and equal states are solved once.
    """

    def __init__(self, nodes: dict[int, list[Node]], costs: dict[str, int], budget: int) -> None:
        self.left, self.known, self.none = budget, {}, {}
        self.bit = {x: 1 << k for k, x in enumerate(nodes)}
        self.price: dict[int, list[tuple[int, tuple[int, ...], Node]]] = {}
        for x, ns in nodes.items():
            rows = sorted(((costs.get(n.table.name, 0), tuple(dict.fromkeys(n.children)), k, n) for k, n in enumerate(ns) if x not in n.children), key=lambda r: (r[0], len(r[1]), r[2]))
            kept: list[tuple[int, tuple[int, ...], Node]] = []
            for c, kids, _, n in rows:  # a row that costs no less and needs no less than another is of no use
                if not any(set(k) <= set(kids) for _, k, _ in kept):
                    kept.append((c, kids, n))
            self.price[x] = kept
        users: dict[int, set[int]] = {}
        for x, rows in self.price.items():
            for _, kids, _ in rows:
                for c in kids:
                    users.setdefault(c, set()).add(x)
        self.users = {x: len(u) for x, u in users.items()}
        self._order()

    def _order(self) -> None:
        """Strongly connected parts, children first; what each class reaches; classes on cycles."""
        index: dict[int, int] = {}
        low: dict[int, int] = {}
        stack: list[int] = []
        part: dict[int, int] = {}
        self.reach: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.knotted = 0
        self.part = part
        kids = {x: list(dict.fromkeys(c for _, k, _ in rows for c in k)) for x, rows in self.price.items()}
        for root in self.price:
            work = [(root, iter(kids[root]))] if root not in index else []
            if work:
                index[root] = low[root] = len(index)
                stack.append(root)
            while work:
                x, it = work[-1]
                for c in it:
                    if c not in index:
                        index[c] = low[c] = len(index)
                        stack.append(c)
                        work.append((c, iter(kids[c])))
                        break
                    if c not in part:
                        low[x] = min(low[x], index[c])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[x])
                    if low[x] == index[x]:
                        members = []
                        while True:
                            members.append(y := stack.pop())
                            part[y] = index[x]
                            if y == x:
                                break
                        all_ = 0
                        for y in members:
                            all_ |= self.bit[y]
                            for c in kids[y]:
                                if c not in members:
                                    all_ |= self.reach[c]
                        for y in members:
                            self.reach[y] = all_
                            self.rank[y] = len(self.rank)
                            if len(members) > 1:
                                self.knotted |= self.bit[y]

    def bound(self, open_: frozenset[int], paid: int) -> int:
        """What is still to pay at least. Costs are whole numbers, so the sum of shares is rounded up."""
        free = paid
        for x in open_:
            free |= self.bit[x]
        g: dict[int, float] = {}
        stack = list(open_)
        need: set[int] = set(open_)
        while stack:
            for _, kids, _ in self.price[stack.pop()]:
                for c in kids:
                    if not free & self.bit[c] and c not in need:
                        need.add(c)
                        stack.append(c)
        for x in sorted(need, key=self.rank.__getitem__):  # children first; on cycles a class passes on nothing
            g[x] = min((c + sum(g.get(k, 0.0) / self.users[k] for k in kids if not free & self.bit[k] and self.part[k] != self.part[x]) for c, kids, _ in self.price[x]), default=float("inf"))
        total = sum(g[x] for x in open_)
        return TOP + 1 if total > TOP else ceil(total * (1 - 1e-12) - 1e-9)

    def parts(self, open_: frozenset[int], paid: int) -> list[frozenset[int]]:
        groups: list[tuple[int, set[int]]] = []
        for x in open_:
            mask, own = self.reach[x] & ~paid, {x}
            rest = []
            for m, g in groups:
                if m & mask or m & self.knotted and mask & self.knotted:
                    mask, own = mask | m, own | g
                else:
                    rest.append((m, g))
            groups = [*rest, (mask, own)]
        return [frozenset(g) for _, g in groups]

    def cyclic(self, x: int, kids: tuple[int, ...], chosen: dict[int, tuple[int, ...]]) -> bool:
        if not self.knotted & self.bit[x]:
            return False
        stack, seen = list(kids), set()
        while stack:
            y = stack.pop()
            if y == x:
                return True
            if y in chosen and y not in seen:
                seen.add(y)
                stack += chosen[y]
        return False

    def run(self, open_: frozenset[int], paid: int, chosen: dict[int, tuple[int, ...]], limit: int) -> tuple[int, dict[int, Node]] | None:
        """The best choice for what ``open_`` needs beyond ``paid``, if it costs less than ``limit``."""
        if not open_:
            return (0, {}) if limit > 0 else None
        self.left -= 1
        if self.left < 0:
            return None
        if len(groups := self.parts(open_, paid)) > 1:
            low = [self.bound(g, paid) for g in groups]
            total, got = 0, {}
            for k, g in sorted(enumerate(groups), key=lambda p: -low[p[0]]):
                room = limit - total - (sum(low) - low[k])
                found = self.run(g, paid, chosen, room) if room > 0 else None
                if found is None:
                    return None
                total, low[k] = total + found[0], 0
                got |= found[1]
            return (total, got) if total < limit else None
        if self.bound(open_, paid) >= limit:
            return None
        reach = 0
        for x in open_:
            reach |= self.reach[x]
        key = None if reach & self.knotted else (open_, reach & paid)
        if key in self.known:
            cost, got = self.known[key]
            return (cost, got) if cost < limit else None
        if limit <= self.none.get(key, 0):
            return None
        # forced classes first, then the one whose rows refer to the most shared classes
        x = min(open_, key=lambda y: (len(self.price[y]) > 1, -sum(self.users[k] for _, kids, _ in self.price[y] for k in kids), self.rank[y]))
        best, top = None, limit
        for c, kids, n in self.price[x]:
            if self.cyclic(x, kids, chosen):
                continue
            more = (open_ - {x}) | {k for k in kids if not paid & self.bit[k] and k != x}
            chosen[x] = kids
            found = self.run(more, paid | self.bit[x], chosen, top - c)
            del chosen[x]
            if found is not None:
                best, top = (c + found[0], {**found[1], x: n}), c + found[0]
        if key is not None and self.left >= 0:
            if best is not None:
                self.known[key] = best
            else:
                self.none[key] = limit
        return best


def solve(root: int, nodes: dict[int, list[Node]], greedy: dict[int, Node], costs: dict[str, int], budget: int = 1_000_000) -> tuple[dict[int, Node], bool]:
    """The acyclic choice of least total cost over distinct classes, and whether it is proven.

    ``greedy`` is any choice to start from. Where no class is referred to twice, the cheapest
    rows are the answer already.
    """
    once = all(len(set(n.children)) == len(n.children) for ns in nodes.values() for n in ns)
    if once and all(n < 2 for n in sharing(nodes).values()):
        return cheapest(nodes, costs), True
    search = Search(nodes, costs, budget)
    with deep(8 * len(nodes) + 1000):
        found = search.run(frozenset((root,)), 0, {}, dag_cost(root, greedy, costs))
    return found[1] if found else greedy, search.left >= 0


@contextmanager
def deep(calls: int) -> Iterator[None]:
    """Room for so many nested calls."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, calls))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def extract(catalog: Catalog, store: Store, root: int, optimal: bool, max_classes: int = 500, warn_shared: int = 50, budget: int = 1_000_000, lets: bool = True) -> Extracted:
    """The cheapest term of a class. Up to DRIVER_CLASSES reached classes are priced on the driver;
    of more, only the chosen rows, the parts of one term, are collected."""
    everything = enodes(catalog, store)
    nodes = _collect(everything, catalog, root, DRIVER_CLASSES) if everything is not None else {}
    if nodes is not None:
        greedy = cheapest(nodes, catalog.costs)
    else:
        only = reached(catalog, store, store.spark.createDataFrame([(root,)], "class bigint"))
        by_class = _collect(best_nodes(catalog, store, only), catalog, root, 1 << 62)  # type: ignore[arg-type]
        greedy = {x: ns[0] for x, ns in by_class.items() if ns}  # type: ignore[union-attr]
    if root not in greedy:
        return Extracted("<error: the class has no finite term>")

    def result(chosen: dict[int, Node], proven: bool | None, warnings: list[str]) -> Extracted:
        with deep(8 * len(chosen) + 1000):
            return Extracted(build(root, chosen, lets), dag_cost(root, chosen, catalog.costs), proven, warnings)

    if not optimal:
        return result(greedy, None, [])
    if nodes is None or len(nodes) > max_classes:
        return result(greedy, False, [f"more than {max_classes} classes: greedy term"])
    shared = sum(n for n in sharing(nodes).values() if n > 1)
    warnings = [f"{shared} shared edges: the search may take long"] if shared > warn_shared else []
    chosen, proven = solve(root, nodes, greedy, catalog.costs, budget)
    if not proven:
        warnings.append("the node budget ran out")
    return result(chosen, proven, warnings)
