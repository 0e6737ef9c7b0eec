"""Operator 2, benchmark decontamination: an FM-index of each training shard.

Words are maximal runs of letters, digits and bytes beyond ASCII, A to Z lower-cased. Test
phrases (windows of ten consecutive words of an item; all words of a shorter item) are searched
backwards in an index of each shard through wavelet-tree ranks, occurrences are located by
sampled suffix positions, and the spans merged. A shard is a run of rows of one task.

Words outside the benchmark's vocabulary are in no phrase, so the index holds each run of them
as one separator, and leaves out runs of vocabulary words that are shorter than every phrase.
The benchmark is read in blocks of about BLOCK_CHARS characters, long items cut at words into
overlapping pieces, with one pass over the corpus for each block; the block's size, not the
benchmark's, bounds what is broadcast.

Null and empty texts have no words. Items without words have no phrase; all items without a
number are one item that is not named; repeated items count once. Repeated document rows, with
or without a number, are judged one by one. Texts of any length are searched whole: a shard
ends with the document that fills it. Extra columns are carried along by ``stage`` and not
read. An empty benchmark hits nothing; an empty corpus gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relsat.llm.common import LOWER, UPPER, plain_names, slices, table, trimmed, tuned
from relsat.llm.fm_index import FMIndex
from relsat.operators.staging import forget, staged

WINDOW, SHARD_WORDS, BLOCK_CHARS, PIECE_WORDS = 10, 500_000, 4_000_000, 100_000
#: A word of items and documents, as a Java pattern; the bytes that make up words, lower-cased.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Phrases:
    """The windows of a block of items: a vocabulary, padded symbol rows, and each row's items."""

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        number: dict[str | None, int] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode("utf-8", "replace"))]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.setdefault(tuple(ids[at : at + window]), set()).add(number.setdefault(item, len(number)))
        self.items = list(number)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int32)
        for k, r in enumerate(rows):
            self.rows[k, : len(r)] = r
        self.least = int(self.lengths.min()) if rows else 0
        self.owner_at = np.cumsum([0] + [len(o) for o in rows.values()])
        self.owners = np.array([i for o in rows.values() for i in sorted(o)], np.int64)


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in a shard's documents (arrays of vocabulary numbers, 0 for other words).

    Returns the phrase of each occurrence and its position in the documents put end to end,
    each followed by one separator.
    """
    g = np.zeros(sum(len(d) + 1 for d in docs), np.int32)
    at = 0
    for d in docs:
        g[at : at + len(d)] = d
        at += len(d) + 1
    known = np.concatenate(([0], (g != 0).view(np.int8), [0]))
    edge = np.diff(known)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= phrases.least
    start, end = start[long], end[long]
    empty = np.zeros(0, np.int64)
    if not len(start) or not len(phrases.rows):
        return empty, empty
    mask = np.zeros(len(g) + 1, np.int32)
    mask[start] += 1
    mask[np.minimum(end + 1, len(g))] -= 1  # a run's own separator comes along
    pos = np.flatnonzero(np.cumsum(mask[:-1]) > 0)
    index = FMIndex(g[pos], len(phrases.vocabulary))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    n = hi - lo
    phrase = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return phrase, pos[index.locate(rows)]


def scan_block(docs: DataFrame, phrases: Phrases, text: str, carry: list[str]) -> DataFrame:
    """One pass: ``carry`` columns, ``n_words``, ``n_hit``, ``items`` and merged ``spans``.

    Spans are word intervals, first included, last not. Where ``docs`` has items and spans of
    an earlier pass, they are merged in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    again = "__items" in docs.columns

    def shard(held: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        ids = [d for _, ds in held for d in ds]
        begin = np.cumsum([0] + [len(d) + 1 for d in ids])
        phrase, pos = search_shard(ids, p)
        diff = np.zeros(int(begin[-1]) + 1, np.int64)
        np.add.at(diff, pos, 1)
        np.add.at(diff, pos + p.lengths[phrase], -1)
        doc = np.searchsorted(begin, pos, "right") - 1
        found: dict[int, set[str | None]] = {}
        if len(pos):
            for d, ph in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
                found.setdefault(d, set()).update(p.items[i] for i in p.owners[p.owner_at[ph] : p.owner_at[ph + 1]].tolist())
        at = 0
        for b, ds in held:
            if again:
                for k, (old, spans) in enumerate(zip(b.column("__items").to_pylist(), b.column("__spans").to_pylist())):
                    if old:
                        found.setdefault(at + k, set()).update(old)
                    for s in spans or ():
                        diff[begin[at + k] + s["lo"]] += 1
                        diff[begin[at + k] + s["hi"]] -= 1
            at += len(ds)
        hit = np.concatenate(([0], (np.cumsum(diff[:-1]) > 0).view(np.int8), [0]))
        edge = np.diff(hit)
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(begin, lo, "right") - 1
        spans_of: dict[int, list[dict[str, int]]] = {}
        for o, a, z in zip(owner.tolist(), (lo - begin[owner]).tolist(), (hi - begin[owner]).tolist()):
            spans_of.setdefault(o, []).append({"lo": a, "hi": z})
        at = 0
        for b, ds in held:
            spans = [spans_of.get(at + k, []) for k in range(len(ds))]
            new = [pa.array([len(d) for d in ds], pa.int64()), pa.array([sum(s["hi"] - s["lo"] for s in x) for x in spans], pa.int64()), pa.array([sorted(found.get(at + k, ()), key=lambda i: (i is not None, i or "")) for k in range(len(ds))], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *new], [*carry, "__words", "__hit", "__items", "__spans"])
            at += len(ds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        size = 0
        get = shared.value.vocabulary.get
        for whole in batches:
            for b in slices(whole, text, 1 << 20):
                ds = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in map(words_of, b.column(text).cast(pa.binary()).to_pylist())]
                size += sum(map(len, ds))
                held.append((b, ds))
                if size >= SHARD_WORDS:
                    yield from shard(held)
                    held, size = [], 0
        if held:
            yield from shard(held)

    span = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    shape = T.StructType([*(docs.schema[c] for c in carry), T.StructField("__words", T.LongType()), T.StructField("__hit", T.LongType()), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__spans", T.ArrayType(span))])
    return docs.mapInArrow(trimmed(run), shape)


def pieces(items: DataFrame, item_id: str, item_text: str, window: int, most: int = PIECE_WORDS) -> DataFrame:
    """``i`` and ``t`` of the items; an item of more than ``most`` windows in pieces that hold
    each of its windows once."""
    words = F.regexp_extract_all(F.translate(item_text, UPPER, LOWER), F.lit(ITEM_WORD), F.lit(0))
    w = items.select(F.col(item_id).cast("string").alias("i"), words.alias("w")).where("size(w) > 0")
    cut = w.select("i", "w", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.size("w") - window, F.lit(0))) / most))).alias("j"))
    return cut.select("i", F.array_join(F.slice("w", (F.col("j") * most + 1).cast("int"), F.lit(most + window - 1)), " ").alias("t"))


def scan(docs: DataFrame, items: DataFrame, text: str = "text", carry: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``carry`` (all columns by default) with ``__words``, ``__hit``, ``__items`` and ``__spans``."""
    tuned(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    known = staged(pieces(items, item_id, item_text, window, piece_words).distinct(), "items")
    blocks = max(1, -(-int(known.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        before, last = docs, k == blocks - 1
        docs = scan_block(docs, Phrases(((r["i"], r["t"]) for r in part.toLocalIterator()), window), text, carry if last else list(dict.fromkeys([*carry, text])))
        if not last:  # passes are not nested: a task holds one block's phrases
            docs = staged(docs, "pass")
            if k:
                forget(before)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), carry=["doc_id"])
    return found.select("doc_id", F.col("__words").alias("n_words"), F.col("__hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.col("__hit") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark phrase."""
    d, name = plain_names(docs)
    found = scan(d, table(spark, sf_dir, "benchmark", "item_id", "text"), name["text"])
    return found.where("__hit = 0").select(*name.values()).toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
a AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) ks WHERE len(w) >= k) x),
o AS (SELECT doc_id, i, a.k, item_id FROM a JOIN p ON a.s = p.s AND a.k = p.k),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM o) y GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM o) y GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
"""
