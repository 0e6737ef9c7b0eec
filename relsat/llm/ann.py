"""Operator 8, approximate nearest neighbours: balanced posting lists.

Nearness is the inner product. Vectors get one more component that makes their lengths equal,
which turns the largest inner product into the smallest distance. A balanced clustering of a
bounded sample gives the centroids; every vector is written to its nearest list and, near a
boundary, to up to REPLICAS lists whose distance is within (1 + SLACK) of the nearest. Vectors
and queries find their lists by a walk over an in-memory graph of the centroids; a query keeps
those within a distance ratio of the nearest one. SHELF neighbouring lists make a shelf, to
which a vector and a query travel once, with a bit for each of its lists; a query is compared
with the vectors that have a bit in common with it. Shelves are split by vectors and by
queries into groups of bounded size. A query whose lists hold fewer than k vectors is compared
with all.

Equal vectors count as one: only the k + 1 first rows of such a group can be among the nearest
k, so the group never meets in one task. Vectors that are null, zero, of another length than
most, without a number, or hold null or non-finite components take no part; lengths may differ
by any factor, for the index is fitted to scaled vectors. Scores that a double cannot hold are
infinite, or NaN, which ranks last. Rows that repeat a number are rows of their own, as queries
and as candidates, and a query's own row alone is left out. Ties go to the smaller number; with
fewer candidates than k, all are returned. Extra columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from relsat.llm.common import table, trimmed
from relsat.operators.staging import staged

K, SAMPLE, MAX_LISTS, REPLICAS, SLACK, RATIO, SEED = 20, 40_000, 8192, 4, 0.12, 1.6, 8
#: Lists for the square root of the vectors; the share of all lists that a query may probe, beside
#: one for each neighbour that it looks for. Vectors without any structure need as many for nine
#: in ten true neighbours; the distance ratio leaves fewer where there is structure.
DENSITY, SHARE = 4, 0.25
#: Lists that a query probes at least, whatever the distance ratio.
LEAST = 4
#: Lists of a shelf; vectors and queries of one group.
SHELF, PART, CHUNK = 16, 8000, 2000
#: Neighbours of a centroid in the graph, breadth of a walk, numbers that a step may gather.
NEIGHBOURS, BEAM, ROOM = 24, 32, 6_000_000


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Cells halved at their median along their main direction, down to even sizes; the means
    of the cells, in the order of the halvings, so that neighbours stand near each other."""
    rng = np.random.default_rng(SEED)
    out: list[np.ndarray] = []

    def halve(c: np.ndarray, parts: int) -> None:
        if parts < 2 or len(c) < 2:
            out.append(x[c].mean(0))
            return
        a, b = x[rng.choice(c, 2, replace=False)]
        cut = len(c) * (parts // 2) // parts
        for _ in range(rounds):
            order = np.argsort(x[c] @ (a - b), kind="stable")
            low, high = c[order[:cut]], c[order[cut:]]
            if not len(low):
                break
            a, b = x[high].mean(0), x[low].mean(0)
        halve(low, parts // 2)
        halve(high, parts - parts // 2)

    halve(np.arange(len(x)), min(lists, len(x)))
    return np.array(out)


class Graph:
    """Centroids with links to near ones; a query walks greedily with a beam."""

    def __init__(self, centroids: np.ndarray, neighbours: int = NEIGHBOURS) -> None:
        self.c = centroids.astype(np.float64)
        self.sq = (self.c**2).sum(1)
        n = len(self.c)
        k = min(neighbours, n - 1)
        near = np.zeros((n, k), np.int64)
        for at in range(0, n, 512):
            d = self.sq[None, :] - 2 * self.c[at : at + 512] @ self.c.T
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            if k:
                near[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
        # long links keep far regions connected
        far = np.random.default_rng(SEED).integers(0, n, (n, 4))
        self.links = np.concatenate((near, far), 1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 48)).astype(np.int64))

    def nearest(self, q: np.ndarray, most: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q`` up to ``most`` centroids, nearest first, with squared distances
        (infinite where the walk saw fewer)."""
        n = len(self.c)
        beam = min(max(beam, most), n)
        take = max(8, beam // 16)
        rows = max(1, ROOM // (take * self.links.shape[1] * self.c.shape[1]))
        got = [self._walk(q[at : at + rows], min(most, n), beam, take) for at in range(0, len(q), rows)]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def _walk(self, q: np.ndarray, most: int, beam: int, take: int) -> tuple[np.ndarray, np.ndarray]:
        m, qs = len(q), (q**2).sum(1)
        seen = np.zeros((m, len(self.c)), bool)
        best = np.tile(self.entries, (m, 1))
        seen[:, self.entries] = True
        dist = self.sq[best] - 2 * q @ self.c[self.entries].T + qs[:, None]
        open_ = np.ones(best.shape, bool)
        while True:
            score = np.where(open_, dist, np.inf)
            t = min(take, score.shape[1])
            pick = np.argpartition(score, t - 1, axis=1)[:, :t]
            live = np.isfinite(np.take_along_axis(score, pick, 1))
            if not live.any():
                break
            np.put_along_axis(open_, pick, False, 1)
            r, c = np.nonzero(live)
            nodes = self.links[best[r, pick[r, c]]]
            # every unseen node once for each row
            key = np.unique((r[:, None] * len(self.c) + nodes).ravel())
            r, v = key // len(self.c), key % len(self.c)
            fresh = ~seen[r, v]
            r, v = r[fresh], v[fresh]
            if not len(r):
                continue
            seen[r, v] = True
            d = self.sq[v] - 2 * np.einsum("ij,ij->i", q[r], self.c[v]) + qs[r]
            count = np.bincount(r, minlength=m)
            at = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            more, far = np.zeros((m, count.max()), np.int64), np.full((m, count.max()), np.inf)
            more[r, at], far[r, at] = v, d
            best, dist, open_ = np.concatenate((best, more), 1), np.concatenate((dist, far), 1), np.concatenate((open_, np.isfinite(far)), 1)
            if dist.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                best, dist, open_ = (np.take_along_axis(a, keep, 1) for a in (best, dist, open_))
        o = np.argsort(dist, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(best, o, 1), np.maximum(np.take_along_axis(dist, o, 1), 0)


class Lists:
    """What executors need to find the lists of vectors and queries; its size is fixed by MAX_LISTS."""

    def __init__(self, graph: Graph, scale: float, longest: float) -> None:
        self.graph, self.scale, self.longest = graph, scale, longest

    def of_vectors(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each posting."""
        s = v / self.scale
        tail = np.sqrt(np.maximum(self.longest - (s**2).sum(1, keepdims=True), 0))
        near, d = self.graph.nearest(np.concatenate((s, tail), 1), REPLICAS)
        r, c = np.nonzero(d <= d[:, :1] * (1 + SLACK) ** 2 + 1e-12)
        return r, near[r, c]

    def of_queries(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each probe: queries are as long as the longest vector."""
        q = np.pad(unit(v) * np.sqrt(self.longest), ((0, 0), (0, 1)))
        near, d = self.graph.nearest(q, int(np.ceil(SHARE * len(self.graph.c))) + K)
        r, c = np.nonzero((d <= d[:, :1] * RATIO**2 + 1e-12) | (np.arange(d.shape[1]) < LEAST) & np.isfinite(d))
        return r, near[r, c]


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one, of vectors of any length."""
    s = v / np.abs(v).max(1, keepdims=True)
    return s / np.sqrt((s**2).sum(1, keepdims=True))


def shelved(r: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shelf and bits of the row's lists on that shelf."""
    key, at = np.unique(r * (1 << 32) + lists // SHELF, return_inverse=True)
    bits = np.zeros(len(key), np.int64)
    np.bitwise_or.at(bits, at, 1 << (lists % SHELF))
    return key >> 32, key & ((1 << 32) - 1), bits


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def packed(v: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    ends = (np.arange(len(v) + 1) * 8 * v.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(v).tobytes())])


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    v = F.transform(vector, lambda c: c.cast("double"))
    d = df.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    d = d.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0))
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d.where(F.size("v") == (sizes["n"] if sizes else 0))


def fitted(groups: DataFrame, n: int, scale: float, longest: float) -> Lists:
    """The centroids, from about SAMPLE different vectors that a hash chooses."""
    share = F.lit(min(1.0, SAMPLE / n) * (1 << 20))
    sample = groups.where(F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(1 << 20)) < share).select("v").toArrow()
    if not sample.num_rows:
        sample = groups.orderBy("h").select("v").limit(1).toArrow()
    x = matrix(sample.column("v").combine_chunks()) / scale
    x = x[np.lexsort(x.T)]
    x = np.concatenate((x, np.sqrt(np.maximum(longest - (x**2).sum(1, keepdims=True), 0))), 1)
    lists = max(1, min(MAX_LISTS, int(DENSITY * n**0.5), len(x) // 4))
    return Lists(Graph(balanced_centroids(x, lists)), scale, longest)


def search(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's nearest found."""
    spark = vectors.sparkSession
    # a row is known by its place in this table, which is written once
    rows = staged(usable(vectors, vec_id, vector).withColumn("r", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scale = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / scale) * (c / scale)))).first()[0]
    # groups of equal vectors: the k + 1 first rows, first in salted parts of a group
    h = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(64)))
    part = h.withColumn("at", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id", "r"))).where(F.col("at") <= k + 1)
    copies = part.withColumn("at", F.row_number().over(Window.partitionBy("h", "v").orderBy("id", "r"))).where(F.col("at") <= k + 1)
    groups = copies.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("id", "r"))).alias("both"))
    groups = staged(groups.select("h", "v", F.col("both.id").alias("ids"), F.col("both.r").alias("rs")), "groups")
    lists = fitted(groups, n, float(scale), float(longest))
    shared = spark.sparkContext.broadcast(lists)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                v = matrix(b.column("v"))
                r, shelf, bits = shelved(*shared.value.of_vectors(v))
                yield pa.RecordBatch.from_arrays([pa.array(shelf, pa.int32()), pa.array(bits), b.column("ids").take(pa.array(r)), b.column("rs").take(pa.array(r)), packed(v[r])], ["shelf", "bits", "ids", "rs", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                v = matrix(b.column("v"))
                r, shelf, bits = shelved(*shared.value.of_queries(v))
                yield pa.RecordBatch.from_arrays([pa.array(shelf, pa.int32()), pa.array(bits), b.column("id").take(pa.array(r)), b.column("r").take(pa.array(r)), packed(v[r])], ["shelf", "bits", "id", "r", "v"])

    posted = staged(groups.select("ids", "rs", "v").mapInArrow(trimmed(post), "shelf int, bits long, ids array<long>, rs array<long>, v binary"), "postings")
    queries = rows.where(F.col("id") % every == 0).select("id", "r", "v")
    asked = staged(queries.mapInArrow(trimmed(probe), "shelf int, bits long, id long, r long, v binary"), "probes")

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(c):
            cv = np.frombuffer(b"".join(c.v), np.float64).reshape(len(c), -1)
            scaled, c_bits = cv / shared.value.scale, c.bits.to_numpy()
            count = np.array([len(i) for i in c.ids])
            ids, rs = np.concatenate(c.ids.to_list()), np.concatenate(c.rs.to_list())
            first = np.cumsum(count) - count
            # what rounding may do to a product of a unit vector
            error = 4e-16 * (cv.shape[1] + 4) * float(np.sqrt((scaled**2).sum(1).max()))
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                qv, qr, qi = np.frombuffer(b"".join(part.v), np.float64).reshape(len(part), -1), part.r.to_numpy(), part.id.to_numpy()
                s = unit(qv) @ scaled.T
                s[(part.bits.to_numpy()[:, None] & c_bits[None, :]) == 0] = -np.inf
                top = min(k + 1, s.shape[1])
                bound = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]
                r, j = np.nonzero((s >= bound[:, None] - error) & (s > -np.inf))
                m = count[j]
                r2, j2 = np.repeat(r, m), np.repeat(j, m)
                at2 = np.repeat(first[j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                ok = rs[at2] != qr[r2]
                r2, j2, at2 = r2[ok], j2[ok], at2[ok]
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (qv[r2] * cv[j2]).sum(1)
                o = np.lexsort((rs[at2], ids[at2], -np.where(np.isnan(exact), -np.inf, exact), r2))
                r2, at2, exact = r2[o], at2[o], exact[o]
                keep = np.arange(len(r2)) - np.searchsorted(r2, r2) < k
                r2, at2 = r2[keep], at2[keep]
                out.append((qr[r2], qi[r2], rs[at2], ids[at2], exact[keep]))
        z = [np.concatenate(a) for a in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("qr", "query_id", "vr", "vec_id", "score"), z)))

    held = staged(posted.groupBy("shelf").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "shelves")
    value = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy("qr").orderBy(value.desc(), "vec_id", "vr"))

    def ranked(asked: DataFrame) -> DataFrame:
        """The k nearest rows that each of ``asked`` (a row for each shelf) finds."""
        # one row for each shelf: MAX_LISTS / SHELF at most
        sizes = F.broadcast(staged(held.join(asked.groupBy("shelf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "shelf"), "sizes"))
        dealt = posted.join(sizes, "shelf").withColumn("p", F.pmod(F.xxhash64(F.element_at("rs", 1)), F.col("parts")).cast("int")).withColumn("z", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        questions = asked.join(sizes, "shelf").withColumn("z", F.pmod(F.xxhash64("r"), F.col("chunks")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = questions.select("shelf", "p", "z", "bits", "id", "r", "v").groupBy("shelf", "p", "z").cogroup(dealt.select("shelf", "p", "z", "bits", "ids", "rs", "v").groupBy("shelf", "p", "z"))
        found = met.applyInPandas(nearest, "qr long, query_id long, vr long, vec_id long, score double")
        # a replicated vector is found on several shelves; a query has k rows for each group it is in at most
        return found.dropDuplicates(["qr", "vr"]).withColumn("rank", rank).where(F.col("rank") <= k)

    best = staged(ranked(asked), "nearest")
    full = best.where(F.col("rank") == min(k, n - 1)).select("qr")
    short = staged(asked.select("id", "r", "v").dropDuplicates(["r"]).join(full, F.col("r") == F.col("qr"), "left_anti"), "short")
    if n > 1 and not short.isEmpty():
        last = (len(lists.graph.c) - 1) // SHELF
        everywhere = short.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shelf"), F.lit(-1).cast("long").alias("bits"), "id", "r", "v")
        best = best.join(short.select(F.col("r").alias("qr")), "qr", "left_anti").unionByName(ranked(everywhere))
    return best.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
