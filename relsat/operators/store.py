"""Tables as DataFrames, fresh ids, merging and congruence closure.

Every row carries ``ver``, the version of the store at which it last changed: a rule's delta is
a filter on it, and a row whose ids changed is new again. Relations have a value column (the
id of the fact) only once some pattern binds it. What is written meets only the rows of its
own keys; a table is the rows of before without the keys that changed, and the changed rows,
and is written anew after some such changes. A null in a bound or inserted table is a value
that equals itself when rows are stored, while patterns never join or compare it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from relsat.catalog import BASE, Table, spark_type
from relsat.operators.components import connected_components
from relsat.operators.staging import dealt, staged

#: Up to so many edges, equal classes are found on the driver; their number is checked first.
DRIVER_EDGES = 50_000
#: From so many rows on a table that rules extend is dealt into buckets, at first of about so many rows each.
DEAL_ROWS, BUCKET_ROWS, MOST_BUCKETS = 100_000, 16_000, 4_000
#: Of so many parts a dealt table is written anew.
MOST_LOGS = 32


def same(df: DataFrame, other: DataFrame, keys: list[str], prefix: str) -> Column:
    """Rows of equal keys, nulls included; ``other`` has the keys under a prefix."""
    out = F.lit(True)
    for c in keys:
        out = out & df[c].eqNullSafe(other[f"{prefix}{c}"])
    return out


def matching(df: DataFrame, keys: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``df`` with (left_semi) or without (left_anti) the keys of another table; nulls are equal."""
    named = keys.select(*(F.col(c).alias(f"__m_{c}") for c in columns))
    return df.join(named, same(df, named, columns, "__m_"), how)


class Store:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.rows: dict[str, DataFrame] = {}
        self.valued: set[str] = set()
        #: Relations bound to tables, in which rows may repeat.
        self.bound: set[str] = set()
        self.changed: dict[str, int] = {}
        self.version = 1
        self.next_id = 1
        self.edges: list[DataFrame] = []
        self.appends: dict[str, int] = {}
        #: The key column by which a table is dealt once it is large, its rows so far, its buckets,
        #: and its name in the catalog with the number of its parts.
        self.deals: dict[str, str] = {}
        self.sizes: dict[str, int] = {}
        self.buckets: dict[str, int] = {}
        self.logs: dict[str, tuple[str, int]] = {}

    def columns(self, t: Table) -> list[str]:
        return [*t.keys, *(["v"] if t.name in self.valued else [])]

    def add(self, t: Table) -> None:
        self.tables[t.name] = t
        if t.kind != "relation":
            self.valued.add(t.name)
        fields = [f"{c} {spark_type(k)}" for c, k in zip(t.keys, t.args)] + ([f"v {spark_type(t.value)}"] if t.name in self.valued else []) + ["ver bigint"]
        self.rows[t.name] = self.spark.createDataFrame([], ", ".join(fields))
        self.changed[t.name] = 0

    def bind(self, t: Table, df: DataFrame) -> None:
        """Make ``df`` (keys, and the value of a function, in order) the rows of a new table.

        The rows stay where they are: scans keep filters and columns pushed down.
        """
        self.add(t)
        named = [*t.keys, *(["v"] if t.kind == "function" else [])]
        kinds = [*t.args, t.value]
        df = df.select(*(F.col(f"`{c}`").cast(spark_type(k)).alias(n) for c, n, k in zip(df.columns, named, kinds)))
        if t.kind == "relation":
            self.bound.add(t.name)
        if t.kind == "function":
            df = df.groupBy(*t.keys).agg((F.max if t.merge == "max" else F.min)("v").alias("v"))
        self.rows[t.name] = df.withColumn("ver", F.lit(self.version).cast("bigint"))
        self.changed[t.name] = self.version

    # --- ids

    def _numbered(self, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
        """Distinct ``keys`` with a fresh id in ``v``: places in buckets plus the buckets' offsets."""
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        b = staged(keys.withColumn("bucket", F.pmod(F.xxhash64(*columns) if columns else F.lit(0), F.lit(n)).cast("int")), "fresh")
        sizes = b.groupBy("bucket").count().orderBy("bucket").collect()  # one row for each bucket, as many as shuffle partitions
        offsets, base = [], self.next_id
        for r in sizes:
            offsets.append((r["bucket"], base))
            base += r["count"]
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(*columns) if columns else Window.partitionBy("bucket").orderBy("bucket"))
        first = F.broadcast(self.spark.createDataFrame(offsets, "bucket int, base bigint"))
        total, self.next_id = base - self.next_id, base
        return b.withColumn("place", place).join(first, "bucket").withColumn("v", (F.col("base") + F.col("place") - 1).cast("bigint")).drop("bucket", "place", "base"), total

    def reserve(self, n: int) -> int:
        """The first of ``n`` ids that nothing else will get."""
        self.next_id += n
        return self.next_id - n

    def need_values(self, t: Table) -> None:
        """Give a relation the ids of its facts."""
        if t.name not in self.valued:
            fresh, _ = self._numbered(self.rows[t.name].groupBy(*t.keys).agg(F.min("ver").alias("ver")) if t.keys else self.rows[t.name].limit(1), t.keys)
            self.rows[t.name] = staged(fresh.select(*t.keys, "v", "ver"), t.name)
            self.valued.add(t.name)
            self.bound.discard(t.name)
            for x in (self.deals, self.logs):
                x.pop(t.name, None)

    def intern(self, t: Table, keys: DataFrame) -> None:
        """Make sure that each of ``keys`` (columns of t) has a row, with a fresh id where it is new."""
        wanted = keys.select(*t.keys).distinct() if t.keys else keys.limit(1).select()
        old = self.rows[t.name]
        if t.keys:
            missing = matching(wanted, old, t.keys, "left_anti")
        else:
            missing = wanted if old.isEmpty() else None
        if missing is None:
            return
        fresh, n = self._numbered(missing if t.keys else missing.select(F.lit(0).alias("one")), t.keys or ["one"])
        if n:
            new = fresh.select(*t.keys, *(["v"] if t.name in self.valued else []), F.lit(self.version + 1).cast("bigint").alias("ver"))
            self._append(t, old, staged(new, t.name))

    def lookup(self, t: Table, m: DataFrame, args: list[Column], out: str, create: bool) -> DataFrame:
        """``m`` with the value of ``t`` for ``args`` in column ``out``; get-or-create for ids."""
        keyed = m.withColumns({f"__k{i}": a.cast(spark_type(k)) for i, (a, k) in enumerate(zip(args, t.args))}) if args else m
        if create:
            self.intern(t, keyed.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(t.keys))))
        named = self.rows[t.name].select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(t.keys)), F.col("v").alias(out))
        if not args:
            return keyed.crossJoin(named.limit(1))  # a nullary table has one row at most
        return keyed.join(named, [f"__k{i}" for i in range(len(args))]).drop(*(f"__k{i}" for i in range(len(args))))

    # --- writing

    def insert(self, t: Table, rows: DataFrame, dealt: bool = False) -> None:
        """Rows of keys, and of values where given. Conflicting ids become edges."""
        if t.kind == "relation" or "v" not in rows.columns:
            if t.has_id and t.name in self.valued:
                self.intern(t, rows)
                return
            if t.name in self.logs:
                self._merge_dealt(t, rows.select(*t.keys), dealt)
                return
            old = self.rows[t.name]
            if t.keys:
                fresh = rows.select(*t.keys).distinct()
                if self.changed[t.name]:
                    fresh = matching(fresh, old, t.keys, "left_anti")
            else:
                fresh = rows.limit(1).select() if old.isEmpty() else None
            if fresh is not None:
                fresh = staged(fresh.withColumn("ver", F.lit(self.version + 1).cast("bigint")), t.name)
                if not fresh.isEmpty():
                    self._append(t, old, fresh)
            return
        if t.name in self.logs:
            self._merge_dealt(t, rows.select(*t.keys, "v"), dealt)
            return
        self._merge(t, rows.select(*t.keys, "v"), self.rows[t.name])

    def _append(self, t: Table, old: DataFrame, fresh: DataFrame, most: int = 6) -> None:
        """The rows of ``t`` are ``old`` and ``fresh``; after some appends they are written as one
        table again, so that the plans of later rounds stay small."""
        self.appends[t.name] = self.appends.get(t.name, 0) + 1
        both = old.unionByName(fresh)
        if t.name in self.deals:
            self.sizes[t.name] = n = self.sizes.get(t.name, 0) + fresh.count()
            if n >= DEAL_ROWS:
                self.buckets[t.name] = self._count(n)
                self._log(t, both.repartition(self.buckets[t.name], self.deals[t.name]))
                return
        if self.appends[t.name] >= most:
            self.appends[t.name] = 0
            both = staged(both, t.name)
        self.rows[t.name] = both
        self.changed[t.name] = self.version + 1

    def _merge(self, t: Table, rows: DataFrame, old: DataFrame) -> None:
        """Write ``rows`` (keys, and ``v`` where the table has values) over ``old``: one row for
        each key, its value the merged one. Ids that meet become edges."""
        new = F.lit(self.version + 1).cast("bigint").alias("ver")
        if t.name not in self.valued:
            fresh = matching(rows.select(*t.keys).distinct(), old, t.keys, "left_anti") if t.keys else rows.limit(1).select()
            fresh = staged(fresh.select(*t.keys, new), t.name)
            if not fresh.isEmpty() and (t.keys or old.isEmpty()):
                self._append(t, old, fresh)
            return
        ids = t.has_id and not t.merge
        pick = F.max if t.merge == "max" else F.min
        own = rows.groupBy(*t.keys).agg(pick("v").alias("n"), F.max("v").alias("hi")).where("n is not null")
        # only the touched rows of the old table meet the new values
        now = own.select(*(F.col(c).alias(f"__n_{c}") for c in t.keys), "n", "hi")
        both = now.join(old, same(old, now, t.keys, "__n_"), "left") if t.keys else now.join(old, F.lit(True), "left")
        best = F.greatest("v", "n") if t.merge == "max" else F.least("v", "n")
        both = both.select(*(F.col(f"__n_{c}").alias(c) for c in t.keys), F.col("v").alias("was"), best.alias("v"), "n", "hi")
        fresh, other = "was is null or was <> v", "was is not null and was <> v"
        both = staged(both if ids else both.where(fresh), t.name)
        count = both.agg(*(F.count_if(F.expr(x)).alias(k) for k, x in (("fresh", fresh), ("other", other), ("met", "was <> n"), ("several", "hi <> n")))).first()
        if ids and count["met"]:
            self.edges.append(both.where("was <> n").selectExpr("least(was, n) as a", "greatest(was, n) as b"))
        if ids and count["several"]:
            # of several new ids for one key, each is equal to the least: edges, never lists
            lead = both.where("hi <> n").select(*(F.col(c).alias(f"__n_{c}") for c in t.keys), F.col("n").alias("a"))
            among = rows.join(lead, same(rows, lead, t.keys, "__n_") & (F.col("v") != F.col("a")))
            self.edges.append(staged(among.select("a", F.col("v").alias("b")).distinct(), "edges"))
        if not count["fresh"]:
            return
        rest = old
        if count["other"]:
            rest = matching(old, both.where(other), t.keys, "left_anti") if t.keys else old.limit(0)
        self._append(t, rest, both.where(fresh).select(*t.keys, "v", new))

    # --- dealt tables

    def deal(self, t: Table, column: str) -> None:
        """Rules join ``t`` to others by this key. Once it is large its parts are dealt by it: to be joined
        so, and to meet what is written, they need no exchange."""
        if t.name not in self.bound and all(k in BASE for k in t.args) and (t.name not in self.valued if t.kind == "relation" else t.value in BASE):
            self.deals.setdefault(t.name, column)

    def _count(self, rows: int) -> int:
        return max(self.spark.sparkContext.defaultParallelism, min(rows // BUCKET_ROWS, MOST_BUCKETS))

    def starts(self, name: str) -> bool:
        return name in self.deals and name not in self.logs and not self.changed[name]

    def start(self, t: Table, rows: DataFrame | None) -> None:
        """Deal an empty table at once where the rows to come, which may repeat, are many."""
        n = 0 if rows is None else rows.count()
        if n >= DEAL_ROWS:
            self.buckets[t.name] = self._count(n)
            self.logs[t.name] = dealt(self.rows[t.name], t.name, self.buckets[t.name], self.deals[t.name]), 0

    def _pick(self, t: Table) -> Callable:
        return F.max if t.merge == "max" else F.min

    def _last(self, t: Table, parts: DataFrame) -> DataFrame:
        """The rows of a table from its parts: of a function's row, the last of its ever better values."""
        return parts if t.kind == "relation" else parts.groupBy(*t.keys).agg(self._pick(t)("v").alias("v"), F.max("ver").alias("ver"))

    def _parts(self, t: Table) -> DataFrame:
        return self.spark.table(self.logs[t.name][0])

    def _log(self, t: Table, rows: DataFrame) -> None:
        n, by = self.buckets[t.name], self.deals[t.name]
        name, count = self.logs.get(t.name, (None, 0))
        name = dealt(rows, t.name, n, by, name)
        new = self.version + 1
        self.logs[t.name] = name, count + 1
        if self._parts(t).where(F.col("ver") == new).isEmpty():
            return
        if count == MOST_LOGS:
            self.logs[t.name] = dealt(self._last(t, self._parts(t)), t.name, n, by), 1
        # what is appended later is newer
        self.rows[t.name] = self._last(t, self._parts(t).where(F.col("ver") <= new))
        self.changed[t.name] = new

    def _merge_dealt(self, t: Table, rows: DataFrame, dealt: bool) -> None:
        """New rows and better values become a further part of a dealt table. Only they are exchanged:
        the parts lie in the buckets in which they are grouped."""
        value = F.col("v") if t.kind == "function" else F.lit(True)
        rows = (rows if dealt else rows.repartition(self.buckets[t.name], self.deals[t.name])).withColumn("n", value)
        none = F.lit(None).cast(rows.schema["n"].dataType)
        both = rows.where("n is not null").select(*t.keys, "n", none.alias("was"))
        both = both.union(self._parts(t).select(*t.keys, none.alias("n"), value.alias("was")))
        both = both.groupBy(*t.keys).agg(self._pick(t)("n").alias("n"), self._pick(t)("was").alias("was"))
        better = "n is not null and (was is null or n " + (">" if t.merge == "max" else "<") + " was)"
        self._log(t, both.where(better).select(*t.keys, *([F.col("n").alias("v")] if t.kind == "function" else []), F.lit(self.version + 1).cast("bigint").alias("ver")))

    def part(self, name: str, part: str, seen: int) -> DataFrame:
        """All rows of a table, or those that last changed after (new) or not after (old) a version."""
        if part == "new" and name in self.logs:
            return self._last(self.tables[name], self._parts(self.tables[name]).where((F.col("ver") > seen) & (F.col("ver") <= self.version)))
        df = self.rows[name]
        return df if part == "all" else df.where(F.col("ver") <= seen if part == "old" else F.col("ver") > seen)

    def union(self, edges: DataFrame) -> None:
        self.edges.append(edges.where("a <> b"))

    # --- closure

    def rebuild(self) -> None:
        """Congruence closure: until no two ids are equal, put the smallest id of each class in
        place of the others and merge the rows whose keys have become equal."""
        while self.edges:
            e = self.edges[0]
            for more in self.edges[1:]:
                e = e.union(more)
            self.edges = []
            e = staged(e.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a <> b").distinct(), "unions")
            few = e.limit(DRIVER_EDGES + 1).count()
            if not few:
                continue
            roots = self._driver_roots(e) if few <= DRIVER_EDGES else connected_components(e)
            roots = staged(roots.where("id <> root"), "roots")
            for t in self.tables.values():
                ids = [c for c in t.id_columns if c != "v" or t.name in self.valued]
                if ids and self.changed[t.name]:
                    self._rewrite(t, ids, roots)

    def _driver_roots(self, e: DataFrame) -> DataFrame:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for r in e.collect():  # DRIVER_EDGES at most
            a, b = find(r["a"]), find(r["b"])
            if a != b:
                parent[max(a, b)] = min(a, b)
        return self.spark.createDataFrame([(x, find(x)) for x in list(parent)], "id bigint, root bigint")

    def _rewrite(self, t: Table, ids: list[str], roots: DataFrame) -> None:
        """Put the roots in place of ids; rows without such ids are left as they are."""
        old = self.rows[t.name]
        df = old
        for c in ids:
            df = df.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"__r_{c}")), c, "left")
        hit = F.coalesce(*(F.col(f"__r_{c}") for c in ids)).isNotNull()
        moved = staged(df.where(hit), "moved")
        if moved.isEmpty():
            return
        # a row is known by its keys, as they were
        rest = matching(old, moved, t.keys, "left_anti") if t.keys else old.limit(0)
        now = moved.select(*(F.coalesce(f"__r_{c}", c).alias(c) if c in ids else F.col(c) for c in self.columns(t)))
        self.rows[t.name] = rest
        self.changed[t.name] = self.version + 1
        self._merge(t, now, rest)

    def step(self) -> None:
        """Close the round: what was written is now the past."""
        self.version += 1
