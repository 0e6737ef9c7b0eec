"""Operator 3, n-gram Jaccard join with set-relation skipping, exact up to 64-bit hashes.

A document's set holds the hashes of its five-word shingles. Equal sets are one set, known by
its fingerprint. Two sets link when 100 * |both| >= 80 * |either|.

1. One pass hashes every text; the sets are written to the shared folder and read from there.
2. Every shingle is counted over the corpus. The most frequent ones (at most MAX_HEAVY, a
   broadcast of fixed size) come last in the order that all sets share. The order decides what
   is compared with what, never the result.
3. Sets of which heavy shingles make up half are labelled with their three heaviest ones, and
   the sets of a label are joined among themselves in blocks of bounded size (``group_links``).
   Inside a block the answers of a pivot set, its overlaps with all others, are computed first;
   the answers of every other set are derived from them by the shingles in which it differs
   from the pivot. Across blocks only sets that no block has connected with the label's
   representative are compared again.
4. All other pairs must share a shingle of their prefixes. Prefixes are indexed along with the
   position of the shingle in its set. Each index list is ordered by label, set size and
   position and cut into blocks, and whole pairs of blocks are skipped when their labels are
   joined already, their sizes cannot match, or their positions lie so far apart that what is
   left of the sets cannot make up for it. Candidates are verified like the sets of a label.
5. Components of the links, labelled with the smallest document number.

Null texts and texts without words have the empty set, which links with nothing. Texts of
fewer than five words are one shingle; texts of any length are read whole. Rows are documents
of their own: rows that repeat a number keep their own texts and links, and a row without a
number links like any other (its component is the smallest number that it reaches, null if
there is none). Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relsat.llm.common import mix, plain_names, slices, table, trimmed, trimmed_group, tuned, word_hashes
from relsat.operators.components import connected_components
from relsat.operators.staging import forget, staged

WORDS = 5
#: A shingle of that many sets may count as heavy; so many heavy shingles at most (16 bytes each).
MIN_HEAVY, MAX_HEAVY = 16, 1 << 20
#: Sets and shingles of one block of a group; rows of keys that are broadcast at most.
BLOCK_SETS, BLOCK_SHINGLES, MAX_KEYS = 512, 500_000, 500_000
#: Shingles that a task holds at a time, candidate pairs likewise; bytes of text hashed in one go.
FLUSH, PAIRS, PIECE = 1_000_000, 1_000_000, 1 << 20
#: Odd, one for each place in a shingle.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)


def hashed_words(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, A to Z lower-cased; long texts piece by piece."""
    out, at = [], 0
    while at < len(text):
        to = at + PIECE
        if to < len(text):  # a piece ends behind white space; a word longer than a piece extends it
            found = SPACE.search(text, to)
            to = found.end() if found else len(text)
        out.append(word_hashes(text[at:to].lower().split()))
        at = to
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = hashed_words(text or b"")
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    a = np.full(n, np.uint64(k))
    for j in range(k):  # a linear form of the words' hashes; distinct shingles meet as rarely as random numbers
        a += h[j : j + n] * MULTIPLIERS[j]
    a ^= a >> np.uint64(32)
    a *= np.uint64(0xD6E8FEB86659FD93)
    a ^= a >> np.uint64(29)
    return np.unique(a)


def fingerprint(s: np.ndarray) -> int:
    x = int(mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return x - (1 << 64) if x >= 1 << 63 else x


def need(n: np.ndarray | int) -> np.ndarray | int:
    """Members of a set of ``n`` that a linked set must have at least: four fifths."""
    return (4 * n + 4) // 5


def links(size_a: np.ndarray | int, size_b: np.ndarray | int, both: np.ndarray | int) -> np.ndarray | bool:
    return 100 * both >= 80 * (size_a + size_b - both)


def hashed(docs: DataFrame) -> DataFrame:
    """``i`` (document number), ``h`` (hash of the text), ``n`` (size of its set), ``f``
    (fingerprint, null for no set) and ``s`` (the set; only in the first row of a task that has
    this fingerprint, as far as the task remembers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, "t", 2 * PIECE):
                n, f, s = [], [], []
                for t in b.column("t"):
                    x = shingles(t.as_py())
                    n.append(len(x))
                    f.append(fingerprint(x) if len(x) else None)
                    s.append(x.tobytes() if len(x) and f[-1] not in seen else None)
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(f[-1])  # type: ignore[arg-type]
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(s, pa.binary())], ["i", "h", "n", "f", "s"])

    shape = T.StructType([docs.schema["i"], *(T.StructField(c, T.LongType()) for c in "hnf"), T.StructField("s", T.BinaryType())])
    return docs.select("i", F.xxhash64(F.coalesce("t", F.lit(""))).alias("h"), F.col("t").cast("binary").alias("t")).mapInArrow(trimmed(run), shape)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Sets with their fingerprints, in lists of about FLUSH shingles."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for b in batches:
        for f, s in zip(b.column("f").to_pylist(), b.column("s")):
            held.append((f, np.frombuffer(s.as_py(), np.uint64)))
            size += len(held[-1][1])
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


def heavy_shingles(sets: DataFrame, total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The most frequent shingles by their leading bits: shift, sorted values, counts.

    Counts are exact up to shared leading bits, which only make a shingle count as heavier.
    """
    bits = min(18, max(6, int(total // 4_000_000).bit_length()))
    low, shift = np.uint64(64 - bits), np.uint64(32 - bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            h = np.sort(np.concatenate([s for _, s in held]))
            edge = np.searchsorted(h >> low, np.arange((1 << bits) + 1, dtype=np.uint64))
            rest = (h >> shift).astype(np.uint32)
            full = np.flatnonzero(np.diff(edge))
            yield pa.record_batch({"k": pa.array(full, pa.int32()), "v": pa.array([rest[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())})

    def counted(k: int, parts: list[bytes]) -> pa.RecordBatch:
        u, c = np.unique(np.frombuffer(b"".join(parts), np.uint32), return_counts=True)
        hot = c >= MIN_HEAVY
        return pa.record_batch({"p": pa.array((np.int64(k) << 32) | u[hot].astype(np.int64), pa.int64()), "c": pa.array(c[hot], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, []
        for b in batches:  # sorted, so a task holds one value of k at a time
            for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist()):
                if k != now:
                    if parts:
                        yield counted(now, parts)
                    now, parts = k, []
                parts.append(v)
        if parts:
            yield counted(now, parts)

    dealt = sets.mapInArrow(trimmed(spread), "k int, v binary").repartition(1 << bits if bits < 12 else 1 << 12 if bits < 16 else 20_000, "k").sortWithinPartitions("k")
    counts = staged(dealt.mapInArrow(trimmed(count), "p long, c long"), "shingle-counts")
    # the largest number of whole classes of counts that the table has room for
    step = F.floor(F.log2("c") * 16)
    room, cut = MAX_HEAVY, 1 << 30
    for r in counts.groupBy(step.alias("b")).count().orderBy(F.desc("b")).collect():  # a thousand rows at most
        room -= r["count"]
        if room < 0:
            break
        cut = r["b"]
    top = counts.where(step >= cut).toPandas().sort_values("p")
    return int(shift), top.p.to_numpy(np.uint64), top.c.to_numpy(np.int64)


class Order:
    """The order that all sets share: light shingles by hash, then heavy ones by count and hash."""

    def __init__(self, shift: int, values: np.ndarray, counts: np.ndarray) -> None:
        self.shift, self.values, self.counts = np.uint64(shift), values, counts

    def weights(self, s: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(s), np.int64)
        p = s >> self.shift
        at = np.minimum(np.searchsorted(self.values, p), len(self.values) - 1)
        return np.where(self.values[at] == p, self.counts[at], 0)

    def prefix(self, s: np.ndarray, w: np.ndarray) -> np.ndarray:
        n = len(s) - need(len(s)) + 1
        light = s[w == 0]
        if len(light) >= n:
            return light[:n]
        hot = w > 0
        return np.concatenate((light, s[hot][np.lexsort((s[hot], w[hot]))][: n - len(light)]))

    def labels(self, s: np.ndarray, w: np.ndarray) -> np.ndarray:
        hot = np.flatnonzero(w)
        if 2 * len(hot) < len(s) or not len(hot):
            return np.zeros(0, np.uint64)
        return s[hot[np.lexsort((s[hot], -w[hot]))][:3]]


def prefix_pairs(sets: DataFrame, order: "Order", total: int) -> DataFrame:
    """Pairs (``a``, ``b``) of fingerprints that may link and have no common label.

    They share a prefix shingle, fit in size and position, and share so many prefix shingles
    that the rest of the sets can make up what is missing.
    """
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast(order)
    parts = max(1, min(100_000, total // 5 // 1_000_000 + 1), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = shared.value
        for held in _held(batches):
            fp = np.array([f for f, _ in held], np.int64)
            n = np.array([len(s) for _, s in held], np.int32)
            lab = np.zeros((len(held), 3), np.uint64)
            keys = []
            for k, (_, s) in enumerate(held):
                w = o.weights(s)
                keys.append(o.prefix(s, w))
                for j, x in enumerate(o.labels(s, w).tolist()):
                    lab[k, j] = x or 1
            length = np.array([len(x) for x in keys])
            owner = np.repeat(np.arange(len(held), dtype=np.int32), length)
            place = (np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
            key = np.concatenate(keys)
            to = (mix(key) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[by], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(edge))
            cols: dict[str, list[bytes]] = {c: [] for c in "kqofnl"}
            for p in full.tolist():
                rows = by[edge[p] : edge[p + 1]]
                own, at = np.unique(owner[rows], return_inverse=True)
                for c, x in zip("kqofnl", (key[rows], place[rows], at.astype(np.int32), fp[own], n[own], lab[own])):
                    cols[c].append(x.tobytes())
            yield pa.record_batch({"p": pa.array(full, pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in cols.items()})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = -1, []
        for b in batches:
            for r in b.to_pylist():
                if r["p"] != now:
                    if rows:
                        yield from list_pairs(rows)
                    now, rows = r["p"], []
                rows.append(r)
        if rows:
            yield from list_pairs(rows)

    dealt = sets.mapInArrow(trimmed(spread), "p int, k binary, q binary, o binary, f binary, n binary, l binary").repartition(parts, "p").sortWithinPartitions("p")
    met = dealt.mapInArrow(trimmed(join), "a long, b long, c long, least long")
    return met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("least").alias("least")).where("c >= least").select("a", "b")


def list_pairs(rows: list[dict], block: int = 256) -> Iterator[pa.RecordBatch]:
    """The pairs of the index lists that ``rows`` hold parts of."""
    base = np.cumsum([0] + [len(r["f"]) // 8 for r in rows])
    own = np.concatenate([np.frombuffer(r["o"], np.int32) + at for r, at in zip(rows, base.tolist())])
    key, place = np.frombuffer(b"".join(r["k"] for r in rows), np.uint64), np.frombuffer(b"".join(r["q"] for r in rows), np.int32).astype(np.int64)
    fp, n = np.frombuffer(b"".join(r["f"] for r in rows), np.int64), np.frombuffer(b"".join(r["n"] for r in rows), np.int32).astype(np.int64)
    lab = np.frombuffer(b"".join(r["l"] for r in rows), np.uint64).reshape(-1, 3)
    _, first, same = np.unique(fp, return_index=True, return_inverse=True)  # copies from several tasks are one set
    own = same[own]
    fp, n, lab = fp[first], n[first], lab[first]
    label, kind = np.unique(lab, axis=0, return_inverse=True)
    order = np.lexsort((own, place, n[own], kind[own], key))
    key, own, place = key[order], own[order], place[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
    key, own, place = key[fresh], own[fresh], place[fresh]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    length = np.diff(edge)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two rows of labels have one in common."""
        got = np.zeros(len(a), bool)
        for j in range(3):
            got |= ((a[:, j : j + 1] == b) & (b != 0)).any(1)
        return got

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal held
        a, b = own[x], own[y]
        small = np.minimum(n[a], n[b])
        # all before the nearer place and all behind the farther one may be common, and no more
        most = np.minimum(n[a] - np.maximum(place[x] - place[y], 0), n[b] - np.maximum(place[y] - place[x], 0))
        ok = (5 * small >= 4 * np.maximum(n[a], n[b])) & (9 * most >= 4 * (n[a] + n[b]))
        a, b = a[ok], b[ok]
        ok = ~joined(lab[a], lab[b])
        a, b = a[ok], b[ok]
        if len(a):
            out.append(np.unique(np.minimum(a, b) * np.int64(len(fp)) + np.maximum(a, b), return_counts=True))
            held += len(out[-1][0])

    def flush() -> pa.RecordBatch:
        nonlocal out, held
        u, at = np.unique(np.concatenate([o[0] for o in out]), return_inverse=True)
        c = np.bincount(at, np.concatenate([o[1] for o in out]).astype(float)).astype(np.int64)
        i, j = u // len(fp), u % len(fp)
        out, held = [], 0
        # of the set whose prefix ends first, all but its prefix may be common besides the counted ones
        least = (4 * (n[i] + n[j]) + 8) // 9 - (need(np.maximum(n[i], n[j])) - 1)
        return pa.record_batch({"a": pa.array(np.minimum(fp[i], fp[j])), "b": pa.array(np.maximum(fp[i], fp[j])), "c": pa.array(c), "least": pa.array(least)})

    for m in np.unique(length[(length > 1) & (length <= block)]).tolist():
        at = edge[:-1][length == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, 400_000 // len(i))
        for k in range(0, len(at), step):
            lists = at[k : k + step, None] + np.arange(m)
            keep(lists[:, i].ravel(), lists[:, j].ravel())
            if held > PAIRS:
                yield flush()
    for e, m in zip(edge[:-1][length > block].tolist(), length[length > block].tolist()):
        of = kind[own[e : e + m]]
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        begin = np.unique(np.concatenate([np.arange(a, z, block) for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), m])]))
        end = np.r_[begin[1:], m]
        size, at = n[own[e : e + m]], place[e : e + m]
        size_lo, size_hi = np.minimum.reduceat(size, begin), np.maximum.reduceat(size, begin)
        at_lo, at_hi = np.minimum.reduceat(at, begin), np.maximum.reduceat(at, begin)
        names = label[of[begin]]
        for i in range(len(begin)):
            j = np.arange(i, len(begin))
            small, large = np.minimum(size_hi[i], size_hi[j]), np.maximum(size_lo[i], size_lo[j])
            apart = np.maximum(0, np.maximum(at_lo[i] - at_hi[j], at_lo[j] - at_hi[i]))
            near = (5 * small >= 4 * large) & (9 * (np.maximum(size_hi[i], size_hi[j]) - apart) >= 4 * (size_lo[i] + size_lo[j]))
            j = j[near & ~joined(np.broadcast_to(names[i], (len(j), 3)), names[j])]
            for k in j.tolist():
                x, y = np.arange(begin[i], end[i]), np.arange(begin[k], end[k])
                r, t = np.triu_indices(len(x), 1) if k == i else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
                keep(e + x[r], e + y[t])
                if held > PAIRS:
                    yield flush()
    if out:
        yield flush()


def derived_links(ids: np.ndarray, sets: list[np.ndarray], asked: np.ndarray | None = None) -> np.ndarray:
    """A forest (rows of two ids) that connects linked sets.

    The answers of a set are its overlaps with all the others. Those of a pivot are counted;
    those of any other set x follow from them: of the pivot's overlap with z, what x lacks of
    the pivot and z has goes, and what x has beyond the pivot and z has comes. Only the
    shingles in which sets differ from the pivot are indexed for that. Sets that are connected
    are not compared. With ``asked`` (one truth value a set), only pairs of an asked set and one
    that is not are compared.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    comp = np.arange(m)
    if m == 2:
        small, large = sorted(sets, key=len)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        linked = links(int(size[0]), int(size[1]), int((large[at] == small).sum()))
        return np.array([ids], np.int64) if linked else np.zeros((0, 2), np.int64)
    u, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    weight = np.bincount(flat, minlength=len(u))
    central = np.bincount(owner, weight[flat], m) / np.maximum(size, 1)
    pivot = int(np.argmax(np.round(central, 9)))
    inside = np.zeros(len(u), bool)
    inside[flat[owner == pivot]] = True
    extra = ~inside[flat]  # members that the pivot lacks
    answers = np.bincount(owner[~extra], minlength=m)  # the pivot's
    lacking = size[pivot] - answers
    diff = (size - answers) + lacking
    # the index: by shingle, the sets that differ from the pivot in it
    of_pivot = np.flatnonzero(inside)
    place = np.full(len(u), -1)
    place[of_pivot] = np.arange(len(of_pivot))
    e_flat, e_owner = [flat[extra]], [owner[extra]]
    step = max(1, min(256, 8_000_000 // max(1, len(of_pivot))))
    for at in range(0, m, step):
        rows = np.arange(at, min(m, at + step))
        got = np.zeros((len(rows), len(of_pivot)), bool)
        sel = (owner >= rows[0]) & (owner <= rows[-1]) & ~extra
        got[owner[sel] - at, place[flat[sel]]] = True
        r, c = np.nonzero(~got)
        e_flat.append(of_pivot[c])
        e_owner.append(rows[r])
    el, ow = np.concatenate(e_flat), np.concatenate(e_owner)
    by_set, by_el = np.argsort(ow, kind="stable"), np.argsort(el, kind="stable")
    set_edge, el_edge = np.searchsorted(ow[by_set], np.arange(m + 1)), np.searchsorted(el[by_el], np.arange(len(u) + 1))
    set_el, el_set = el[by_set], ow[by_el]
    forest = []
    turn = np.argsort(diff, kind="stable")
    for x in (turn if asked is None else turn[asked[turn]]).tolist():
        other = comp != comp[x] if asked is None else (comp != comp[x]) & ~asked
        # sets have no more differences in common than the smaller number: skip whom even that would not link
        other &= links(size[x], size, answers - lacking[x] + np.minimum(diff[x], diff))
        if not other.any():
            continue
        mine = set_el[set_edge[x] : set_edge[x + 1]]
        n = el_edge[mine + 1] - el_edge[mine]
        both = np.bincount(el_set[np.repeat(el_edge[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], minlength=m)
        # differences in common: lacking in both, so not to be taken off, or beyond the pivot in both
        derived = answers - lacking[x] + both
        for y in np.flatnonzero(other & links(size[x], size, derived)).tolist():
            if comp[y] != comp[x]:
                forest.append((ids[x], ids[y]))
                comp[comp == comp[y]] = comp[x]
    return np.array(forest, np.int64).reshape(-1, 2)


def _classes(m: int, ids: np.ndarray, forest: np.ndarray) -> np.ndarray:
    """A number for each of the sorted ``ids``; equal for those that the forest connects."""
    comp = np.arange(m)
    for a, b in np.searchsorted(ids, forest).tolist():
        comp[comp == comp[b]] = comp[a]
    return comp


def group_links(members: DataFrame, total: int) -> DataFrame:
    """Links (``a``, ``b``) that connect the sets of each group as far as they link.

    ``members``: ``k`` (group), ``f``, ``n`` and ``s``, read twice; ``total``: their shingles.
    A group is cut into blocks of bounded size. Each block joins its own sets and the group's
    representative. Sets that are connected with that are done with each other; only the
    others, dealt out in bounded parts, meet the blocks that they are not in.
    """
    counts = members.groupBy("k").agg(F.count("*").alias("m"), F.sum("n").alias("t"), F.min(F.struct(F.xxhash64("f").alias("r"), "f")).alias("first"))
    g = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("t") / BLOCK_SHINGLES)).cast("int")
    large = staged(counts.select("k", g.alias("g"), F.col("first.f").alias("rep")).where("g > 1"), "large")
    few = large.count()
    groups = total // (BLOCK_SHINGLES // 2) + 8
    sized = bounded(members, large, few, ["k"], "left")
    # small groups share a task's group, large ones have one for each block
    place = [F.col("g").isNotNull().alias("big"), F.coalesce(F.when(F.col("g").isNotNull(), F.col("k")), F.pmod(F.xxhash64("k"), F.lit(groups))).alias("t"), F.coalesce(F.pmod(F.xxhash64("f"), F.col("g")), F.lit(0)).cast("int").alias("x")]
    dealt = sized.select(*place, "k", "f", "s", F.coalesce(F.col("f") == F.col("rep"), F.lit(False)).alias("rep"), F.lit(False).alias("guest"))
    if few:
        own = F.pmod(F.xxhash64("f"), F.col("g")).cast("int")
        guests = bounded(members, large, few, ["k"], "inner").where("f = rep").groupBy("k", "f", "g").agg(F.first("s").alias("s"))
        guests = guests.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).where(F.col("x") != own)
        dealt = dealt.unionByName(guests.select(F.lit(True).alias("big"), F.col("k").alias("t"), "x", "k", "f", "s", F.lit(True).alias("rep"), F.lit(True).alias("guest")))

    def one_block(g: pd.DataFrame) -> pd.DataFrame:
        links_, left = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        big = bool(g.big.iloc[0])
        g = g.sort_values(["k", "f"]).drop_duplicates(["k", "f"])
        k, f, sets, rep, guest = g.k.to_numpy(), g.f.to_numpy(), g.s.to_list(), g.rep.to_numpy(), g.guest.to_numpy()
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            forest = derived_links(f[a:z], [np.frombuffer(s, np.uint64) for s in sets[a:z]]) if z - a > 1 else links_[0]
            links_.append(forest)
            if big:
                comp = _classes(z - a, f[a:z], forest)
                done = np.isin(comp, comp[rep[a:z]]) | guest[a:z]
                left.append(np.stack((k[a:z], f[a:z]), 1)[~done])
        e, o = np.concatenate(links_), np.concatenate(left)
        rows = np.concatenate((np.pad(e, ((0, 0), (0, 1))), np.pad(o, ((0, 0), (0, 1)), constant_values=1)))
        return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1], "open": rows[:, 2] == 1})

    found = staged(dealt.groupBy("big", "t", "x").applyInPandas(trimmed_group(one_block), "a long, b long, open boolean"), "block-links")
    near = found.where("not open").select("a", "b")
    if not few:
        return near
    open_ = staged(found.where("open").selectExpr("a as k", "b as f").distinct(), "open")
    n_open = open_.count()
    if not n_open:
        return near
    # parts of the sets that are left, for each group
    lefts = bounded(members, open_, n_open, ["k", "f"], "left_semi").select("k", "f", "n").distinct()
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    many = staged(large.join(lefts.groupBy("k").agg(parts.alias("z")), "k"), "parts")
    full = bounded(members, many, few, ["k"], "inner")
    home, part = F.pmod(F.xxhash64("f"), F.col("g")).cast("int"), F.pmod(F.xxhash64("f", F.lit(3)), F.col("z")).cast("int")
    mine = full.select("k", "f", "s", home.alias("x"), F.explode(F.sequence(F.lit(0), F.col("z") - 1)).alias("y"), F.lit(False).alias("guest"))
    theirs = bounded(full, open_, n_open, ["k", "f"], "left_semi").select("k", "f", "s", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("x"), part.alias("y"), home.alias("home")).where("x <> home")

    def two_blocks(g: pd.DataFrame) -> pd.DataFrame:
        if not g.guest.any() or g.guest.all():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        g = g.sort_values(["f", "guest"]).drop_duplicates("f")
        # the sets of a block have met each other
        e = derived_links(g.f.to_numpy(), [np.frombuffer(s, np.uint64) for s in g.s], g.guest.to_numpy(bool)) if len(g) > 1 else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    across = mine.unionByName(theirs.drop("home").withColumn("guest", F.lit(True))).groupBy("k", "x", "y").applyInPandas(trimmed_group(two_blocks), "a long, b long")
    return near.unionByName(staged(across, "across"))


def labelled(sets: DataFrame, order: "Order") -> DataFrame:
    """``f``, ``n``, ``l`` (labels) and ``s`` of the sets that have labels."""
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = shared.value
        for held in _held(batches):
            rows = [(f, len(s), x.view(np.int64), s.tobytes()) for f, s in held if len(x := o.labels(s, o.weights(s)))]
            for at in range(0, len(rows), 500):
                yield pa.record_batch({c: pa.array([r[j] for r in rows[at : at + 500]], k) for j, (c, k) in enumerate((("f", pa.int64()), ("n", pa.int64()), ("l", pa.list_(pa.int64())), ("s", pa.binary())))})

    return sets.mapInArrow(trimmed(run), "f long, n long, l array<long>, s binary")


def bounded(df: DataFrame, keys: DataFrame, rows: int, columns: list[str], how: str) -> DataFrame:
    """Join with a table of some 8-byte columns: by broadcast up to MAX_KEYS ``rows``, else by shuffle."""
    return df.join(F.broadcast(keys) if rows <= MAX_KEYS else keys, columns, how)


def candidates(own: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of each component of the candidate pairs, as members of a group."""
    comps = connected_components(pairs)
    place = staged(comps.selectExpr("id as f", "root as k"), "place")
    return bounded(sets, place, place.count(), ["f"], "inner").select("k", "f", "n", "s")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as ``i`` (its number), ``h`` (hash of its text), ``n`` (size of its set) and
    ``c`` (its class of linked sets; null for the empty set)."""
    sets = staged(hashed(docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))), "sets", "none")
    own, full = sets.select("i", "h", "n", "f"), sets.where("s is not null").select("f", "n", "s")
    total = int(full.agg(F.sum("n")).first()[0] or 0)
    order = Order(*heavy_shingles(full, total))
    label = staged(labelled(full, order), "labelled", "none")
    near = group_links(label.select(F.explode("l").alias("k"), "f", "n", "s"), 3 * total)
    forget(label)
    pairs = staged(prefix_pairs(full, order, total), "pairs")
    if not pairs.isEmpty():
        close = staged(candidates(own, full, pairs), "candidates", "none")
        near = staged(near.unionByName(group_links(close, total)), "links")
        forget(close)
    found = connected_components(near)
    out = own.join(found.selectExpr("id as f", "root"), "f", "left").select("i", "h", "n", F.coalesce("root", "f").alias("c"))
    out = staged(out, "classes")
    forget(sets)
    return out


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    own = classes(docs, doc_id, text)
    # most classes are one row's: only the others are joined
    least = own.where("c is not null").groupBy("c").agg(F.min("i").alias("component"), F.count("*").alias("m")).where("m > 1").select("c", "component")
    least = staged(least, "least")
    return bounded(own, least, least.count(), ["c"], "left").select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "i").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class: that with the smallest number (rows without one come last;
    of rows that repeat a number, one text of the class). Rows without words all stay."""
    tuned(spark)
    d, name = plain_names(docs)
    own = classes(d, name["doc_id"], name["text"])
    mine = F.struct(F.col("i").isNull().alias("none"), "i", "h")
    first = own.where("c is not null").groupBy("c").agg(F.min(mine).alias("first"), F.count("*").alias("m")).where("m > 1")
    first = staged(first.select("c", "first"), "first")
    rows = bounded(own, first, first.count(), ["c"], "inner")
    gone = staged(rows.where(mine != F.col("first")).select("i", "h").distinct(), "gone")
    twice = staged(rows.where(mine == F.col("first")).groupBy("i", "h").count().where("count > 1").select("i", "h"), "twice")
    d = d.withColumn("__h", F.xxhash64(F.coalesce(name["text"], F.lit(""))))

    def matched(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("i").alias("__i"), F.col("h").alias("__k"))
        keys = F.broadcast(keys) if keys.count() <= MAX_KEYS else keys
        return df.join(keys, (df["__h"] == keys["__k"]) & df[name["doc_id"]].eqNullSafe(keys["__i"]), how)

    kept = matched(d, gone, "left_anti")
    if not twice.isEmpty():
        # rows equal in number and text: one of them, the first in the order of the other columns' texts
        row = F.struct(*name.values())
        one = matched(kept, twice, "left_semi").groupBy(name["doc_id"], "__h").agg(F.min_by(row, F.to_json(row)).alias("row"))
        kept = matched(kept, twice, "left_anti").select(*name.values()).unionByName(one.select("row.*"))
    return kept.select(*name.values()).toDF(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, k) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.k FROM r JOIN e ON r.d = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, k AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(k) AS k FROM r GROUP BY d) m ON m.d = w.doc_id
"""
