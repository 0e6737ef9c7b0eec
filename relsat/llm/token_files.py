"""Operator 7, token-ID output: block files in a static range asymmetric numeral system.

Texts become ids of a public tokenizer, an end id follows each document. One frequency table
over the whole corpus is shared by all blocks. A block holds whole documents and is encoded by
itself: LANES interleaved coder states over one stream of 32-bit words, with the states and
the stream position written down every CHECKPOINT symbols of a lane, so that a reader can
start there, and a CRC-32 of the ids. A folder holds three Parquet tables, so any store that
Spark reaches will do and Spark's commit protocol guards against lost executors: ``table``
(``id``, ``freq``: the shared frequencies), ``parts`` (``part``, ``base``, ``n_tokens``,
``n_docs``: the ids before each range of documents, and what it has) and ``blocks``. Any
session can read the folder by its path alone.

Block row: ``part`` (range of document numbers), ``start`` (ids of the part before the block), ``n_tokens``, ``crc32`` (of all ids as little-endian u32),
``n_docs``, ``doc_ids`` (i64 array, little-endian), ``lengths`` (u32 array), ``payload``:
magic ``RTB1``, u32 lanes, u32 tokens, u32 checkpoints, u32 words, then for each checkpoint a
u64 stream position and LANES u64 states, then the words.

A null text is an empty one: its document is the end id alone. Documents stand in ascending
order of their number, nulls first, repeated numbers in the order of their texts' hashes and
texts; rows equal in both are documents of their own. Texts of any length are encoded whole
(a block ends with the document that fills it). Extra columns are not read. An empty table
gives a folder without blocks and an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from relsat.llm.common import slices, table, trimmed, tuned
from relsat.operators.staging import forget, new_path, staged

END, LANES, SCALE, BLOCK_TOKENS, CHECKPOINT = 2, 1024, 20, 1 << 19, 128
#: How ids lie in the staged table; the vocabulary must fit, and be smaller than 2**SCALE.
IDS = np.dtype("<u2")
LOW = np.uint64(1 << 31)
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of pieces and ids that a worker keeps (with 150 of overhead for each piece), half of them
#: from the round before, and the longest piece that it keeps (characters).
CACHE_BYTES, CACHE_CHARS = 90_000_000, 40
#: Ranges of documents whose first places are broadcast at most; ranges that are summed up in one task.
MAX_PARTS, RUN_PARTS = 500_000, 4096


class Words:
    """Texts to ids by the pieces between single blanks; a missing piece is encoded by the library.

    The tokenizer splits a text by a fixed pattern and encodes the parts one by one. A blank
    begins a part unless white space stands before it and white space or the end behind it.
    So the pieces, each with its blank, can be encoded one by one. The same holds between a
    letter and a mark that ends a piece or line (TAIL), and around a line feed between two
    other characters than white space (FEED). Texts with a blank of the other kind (INNER), an
    added token or BARE go to the library whole, as does everything if the tokenizer is of
    another kind.

    A slice of texts is split at once and each different piece looked up once. Missing ones
    without white space go to the library in one text, for a part with a blank begins at each
    and nowhere else; the pattern is left out for pieces of letters, which are one part each.
    What was used since ``kept`` was begun stays for another round, in ``old``.
    """

    #: Stands before a piece that no blank stands before in the text.
    BARE = "\0"
    #: Python's white space, one by one for RE2, and what older versions of Unicode have besides.
    SPACES = " \t-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    INNER = f"[{SPACES}] (?:[{SPACES}]|\\z)"
    TAIL = r"(\pL)([.,;:!?])([ \n]|\z)", "\\1 \0\\2\\3"
    FEED = f"([^{SPACES}])\n([^{SPACES}])", "\\1 \0\n \0\\2"

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > np.iinfo(IDS).max:
            raise ValueError(f"the ids of {path} do not fit {IDS}")
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        split = how.get("pre_tokenizer") or {}
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not how.get("normalizer")
        self.added = [t["content"] for t in how.get("added_tokens") or []]
        self.has_space = re.compile(f"[{self.SPACES}]").search
        self.joins = self.by_piece and not any(map(self.has_space, self.added))
        self.old: dict[str, bytes] = {}
        self.begin()
        tokens = [self.tokenizer.id_to_token(k) or "" for k in range(np.iinfo(IDS).max + 1)]
        #: Which ids begin with a blank, and which are the line feed.
        self.blank, self.feed = np.array([t[:1] == "\u0120" for t in tokens]), np.array([t == "\u010a" for t in tokens])
        self.letters, self.lines = (Tokenizer(self.tokenizer.model) for _ in range(2))
        for t, mark, how in ((self.letters, " ", "merged_with_next"), (self.lines, "\n", "isolated")):
            t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(mark, how), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def begin(self) -> None:
        self.kept: dict[str, bytes] = {self.BARE: b""}  # of a text that begins with a blank, or is empty
        self.room = CACHE_BYTES // 2

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def together(self, tokenizer: Any, mark: str, pieces: list[str], begins: np.ndarray, skip: int) -> list[bytes]:
        """Ids of pieces, encoded in one text with a mark before each; the first ``skip`` ids of each, the mark's, are left out."""
        ids = np.array(tokenizer.encode_batch_fast([mark + mark.join(pieces)], add_special_tokens=False)[0].ids, IDS)
        at = np.flatnonzero(begins[ids])
        if len(at) != len(pieces):  # not a vocabulary of bytes
            return []
        raw, at = ids.tobytes(), at * IDS.itemsize
        return [raw[i:j] for i, j in zip((at + skip * IDS.itemsize).tolist(), [*at[1:].tolist(), len(raw)])]

    def learn(self, pieces: list[str]) -> list[str]:
        """Ids of these pieces into ``kept``; the pieces that are too long to stay there."""
        new: dict[str, bytes] = {}
        if self.old:
            new = {x: ids for x in pieces if (ids := self.old.get(x))}
            pieces = [x for x in pieces if x not in new]
        if self.joins:
            letters, rest = [], []
            for x in pieces:
                (letters if x.isalpha() else rest).append(x)
            lines = [x for x in rest if x[1:].isalpha() and x[0] == self.BARE]
            others = [x for x in rest if x and x[0] != self.BARE and not self.has_space(x)]
            if letters:
                new.update(zip(letters, self.together(self.letters, " ", letters, self.blank, 0)))
            if lines:
                new.update(zip(lines, self.together(self.lines, "\n", [x[1:] for x in lines], self.feed, 1)))
            if others:
                new.update(zip(others, self.together(self.tokenizer, " ", others, self.blank, 0)))
        for x in pieces:
            if x not in new:
                new[x] = self.whole(x[1:] if x[:1] == self.BARE else f" {x}")
        self.kept.update(new)
        self.room -= 150 * len(new) + sum(map(len, new)) + sum(map(len, new.values()))
        return [x for x in new if len(x) > CACHE_CHARS]

    def look(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        missing = [x for x in pieces if x not in self.kept]
        passing = self.learn(missing) if missing else []
        out = list(map(self.kept.__getitem__, pieces))
        for x in passing:
            del self.kept[x]
        if self.room < 0:
            self.old = self.kept
            self.begin()
        return out

    def encode_all(self, texts: pa.Array, last: bytes = b"") -> pa.Array:
        """Ids of each text, with ``last`` behind them, as binary values."""
        none = pa.scalar("", texts.type)
        texts = pc.fill_null(texts, none)
        aside = pa.array(np.full(len(texts), not self.by_piece))
        for found in [pc.match_substring_regex(texts, self.INNER), *(pc.match_substring(texts, t) for t in [self.BARE, *self.added])]:
            aside = pc.or_(aside, found)
        rows = np.flatnonzero(aside)
        split = pc.binary_join_element_wise(pa.scalar(self.BARE, texts.type), pc.if_else(aside, none, texts), none)
        for pattern, put in (self.TAIL, self.FEED):
            split = pc.replace_substring_regex(split, pattern, put)
        lists = pc.split_pattern(split, " ")
        ends, pieces = np.asarray(lists.offsets).astype(np.int64), lists.values.dictionary_encode()
        ids = self.look(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = np.array(pieces.indices)
        at[ends[rows]] = len(ids) + np.arange(len(rows))
        ids += [self.whole(x) for x in texts.take(pa.array(rows)).to_pylist()] + [last]
        all_ids = pa.array(ids, pa.binary()).take(pa.array(np.insert(at, ends[1:], len(ids) - 1)))
        ends = np.frombuffer(all_ids.buffers()[1], "<i4", len(all_ids) + 1)[ends + np.arange(len(ends))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), all_ids.buffers()[2]])

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].as_py()


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    """One cache for all tasks of a worker process."""
    return Words(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


TOKENS = "part int, at long, doc_id long, n long, ids binary, counts binary"


def ordered_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """The documents' ids in ascending order of their numbers, from ranges of these.

    ``part`` is the range, ``at`` the ids of the range before the document, ``ids`` an array
    of IDS. The last row of each range has the occurrences of every id instead, in ``counts``.
    """
    spark = docs.sparkSession
    path = path or default_tokenizer()
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = docs.count()
    parts = max(1, min(n, max(shuffle, n // 20_000)))
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("t"))
    ranged = keyed.repartitionByRange(parts, "i", "h").sortWithinPartitions("i", "h", "t").select("i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = words(path).encode_all
        part, at = TaskContext.get().partitionId(), 0
        last = np.array([end], IDS).tobytes()
        total = np.zeros(1, np.int64)
        for whole in batches:
            for b in slices(whole, "t", 1 << 20):
                ids = encode(b.column("t"), last)
                size = np.asarray(pc.binary_length(ids)).astype(np.int64) // IDS.itemsize
                ends = at + np.cumsum(size)
                at = int(ends[-1])
                c = np.bincount(np.frombuffer(ids.buffers()[2], IDS, int(size.sum())), minlength=len(total))
                c[: len(total)] += total
                total = c
                yield pa.record_batch({"part": pa.array(np.full(len(ids), part), pa.int32()), "at": pa.array(ends - size), "doc_id": b.column("i"), "n": pa.array(size), "ids": ids, "counts": pa.nulls(len(ids), pa.binary())})
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "at": pa.array([at]), "doc_id": pa.nulls(1, pa.int64()), "n": pa.array([0]), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    return ranged.mapInArrow(trimmed(run), TOKENS)


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over all ranges; the result's length is that of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for v in b.column("counts").to_pylist():
                c = np.frombuffer(v, "<i8")
                if len(c) > len(total):
                    total = np.r_[total, np.zeros(len(c) - len(total), np.int64)]
                total[: len(c)] += c
        k = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(k, pa.int32()), "c": pa.array(total[k], pa.int64())})

    counted = tokens.where("counts is not null").select("counts").mapInArrow(count, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(int(counted.k.max()) + 1 if len(counted) else 1, np.int64)
    out[counted.k.to_numpy()] = counted.c.to_numpy()
    return out


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2**scale``; every id that occurs gets one at least."""
    total = int(counts.sum())
    if not total:
        return counts
    f = np.where(counts > 0, np.maximum(1, np.floor(counts / total * (1 << scale))), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    over = int(f.sum()) - (1 << scale)
    for k in order.tolist():  # what is missing or too much goes to the most frequent ids
        step = min(over, int(f[k]) - 1) if over > 0 else over
        f[k] -= step
        over -= step
        if not over:
            break
    return f


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """The payload of one block. Symbol i belongs to lane i mod ``lanes``."""
    n = len(ids)
    rows = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    words = 0
    f_all, c_all = freq[ids].astype(np.uint64), cum[ids].astype(np.uint64)
    room, m = np.uint64(63 - SCALE), np.uint64(SCALE)
    for r in range(rows - 1, -1, -1):
        f, c = f_all[r * lanes : (r + 1) * lanes], c_all[r * lanes : (r + 1) * lanes]
        y = x[: len(f)]
        full = y >= (f << room)
        if full.any():
            out.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            words += int(full.sum())
            y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[: len(f)] = (q << m) + (y - q * f) + c
        if r % every == 0:
            marks.append((words, x.copy()))
    stream = np.concatenate(out[::1])[::-1] if out else np.zeros(0, "<u4")
    body = b"".join(np.array([words - w], "<u8").tobytes() + s.astype("<u8").tobytes() for w, s in reversed(marks))
    return b"RTB1" + np.array([lanes, n, len(marks), words], "<u4").tobytes() + body + stream.astype("<u4").tobytes()


@lru_cache(maxsize=2)
def _slots(freq: bytes) -> np.ndarray:
    """The id of each of the ``2**SCALE`` slots."""
    f = np.frombuffer(freq, np.int64)
    return np.repeat(np.arange(len(f), dtype=np.int32), f)


def decode_block(payload: bytes, freq: np.ndarray, cum: np.ndarray, first: int = 0, last: int | None = None, every: int = CHECKPOINT) -> np.ndarray:
    """The ids of a block, or those between two of its checkpoints."""
    if payload[:4] != b"RTB1":
        raise ValueError("not a token block")
    lanes, n, marks, words = np.frombuffer(payload, "<u4", 4, 4).tolist()
    size = 8 * (1 + lanes)
    stream = np.frombuffer(payload, "<u4", words, 20 + marks * size).astype(np.uint64)
    rows = -(-n // lanes)
    if not rows:
        return np.zeros(0, np.int64)
    mark = np.frombuffer(payload, "<u8", 1 + lanes, 20 + first * size)
    at, x = int(mark[0]), mark[1:].astype(np.uint64)
    stop = rows if last is None else min(rows, last * every)
    ids = np.empty((stop - first * every) * lanes, np.int64)
    mask, m = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    symbol = _slots(freq.tobytes())
    starts, f_all = cum.astype(np.uint64), freq.astype(np.uint64)
    for k, r in enumerate(range(first * every, stop)):
        w = min(lanes, n - r * lanes)
        y = x[:w]
        slot = y & mask
        s = symbol[slot]
        ids[k * lanes : k * lanes + w] = s
        y = f_all[s] * (y >> m) + slot - starts[s]
        low = y < LOW
        c = int(low.sum())
        if c:
            y[low] = (y[low] << np.uint64(32)) | stream[at : at + c]
            at += c
        x[:w] = y
    return ids[: min(n, stop * lanes) - first * every * lanes]


BLOCKS = "part int, start long, n_tokens long, crc32 long, n_docs int, doc_ids binary, lengths binary, payload binary"
BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("crc32", pa.int64()), ("n_docs", pa.int32()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())])


def manifest(tokens: DataFrame) -> DataFrame:
    """``part``, ``base``, ``n_tokens`` and ``n_docs`` of each range: sums over runs of ranges,
    then inside each run, so that no task meets more than RUN_PARTS of them and the runs."""
    sizes = tokens.groupBy("part").agg(F.sum("n").alias("n_tokens"), F.count("ids").alias("n_docs")).withColumn("run", F.floor(F.col("part") / RUN_PARTS))
    sizes = staged(sizes, "sizes")
    runs = sizes.groupBy("run").agg(F.sum("n_tokens").alias("n"))
    before = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("first"))
    inside = F.sum("n_tokens").over(Window.partitionBy("run").orderBy("part")) - F.col("n_tokens")
    return sizes.withColumn("inside", inside).join(before, "run").select("part", (F.col("first") + F.col("inside")).alias("base"), "n_tokens", "n_docs")


def write_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, tokenizer: str | None = None) -> str:
    """Encode every document into a folder of block files, and return the folder.

    Without a ``path`` it lies in the shared folder and goes with the session.
    """
    spark = docs.sparkSession
    tuned(spark)
    path = path or new_path(spark, "token-files")
    tokens = staged(ordered_tokens(docs, doc_id, text, tokenizer), "tokens", "zstd")
    freq = scaled(frequencies(tokens))
    used = np.flatnonzero(freq)
    spark.createDataFrame(pd.DataFrame({"id": used.astype(np.int32), "freq": freq[used]}), "id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    manifest(tokens).write.parquet(f"{path}/parts")
    shared = spark.sparkContext.broadcast((freq, np.cumsum(freq) - freq))  # one number for each id of the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.cache_clear()  # the pieces of the encoding tasks
        where: tuple[int, int] | None = None  # range and place of the block's first document
        numbers: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal where, numbers, held, size
            ids = np.frombuffer(b"".join(held), IDS).astype("<u4")
            row = {"part": where[0], "start": where[1], "n_tokens": len(ids), "crc32": zlib.crc32(ids.tobytes()), "n_docs": len(held), "doc_ids": np.array(numbers, "<i8").tobytes(), "lengths": np.array([len(x) // IDS.itemsize for x in held], "<u4").tobytes(), "payload": encode_block(ids, *shared.value)}  # type: ignore[index]
            where, numbers, held, size = None, [], [], 0
            return pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)

        for whole in batches:
            for b in slices(whole, "ids", 1 << 20):
                for part, at, i, x in zip(*(b.column(c).to_pylist() for c in ("part", "at", "doc_id", "ids"))):
                    if held and (where[0] != part or where[1] + size != at):  # another range or file  # type: ignore[index]
                        yield close()
                    where = where or (part, at)
                    numbers.append(NULL if i is None else i)
                    held.append(x)
                    size += len(x) // IDS.itemsize
                    if size >= BLOCK_TOKENS:
                        yield close()
        if held:
            yield close()

    tokens.where("ids is not null").select("part", "at", "doc_id", "ids").mapInArrow(trimmed(blocks), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    forget(tokens)
    return path


#: Stands for a null document number inside a block.
NULL = -(1 << 63)


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The frequencies of a folder, by id; as many numbers as the vocabulary has at most."""
    rows = spark.read.parquet(f"{path}/table").toPandas()
    freq = np.zeros(int(rows.id.max()) + 1 if len(rows) else 1, np.int64)
    freq[rows.id.to_numpy()] = rows.freq.to_numpy()
    return freq


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document as a folder has it: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Every block is decoded by itself and held against its checksum.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    freq = read_table(spark, path)
    shared = spark.sparkContext.broadcast((freq, np.cumsum(freq) - freq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in (x for b in slices(whole, "payload", 1 << 20) for x in b.to_pylist()):
                ids = decode_block(r["payload"], *shared.value).astype("<u4")
                raw = ids.tobytes()
                if len(ids) != r["n_tokens"] or zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"block {r['part']}/{r['start']} is damaged")
                n = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                end = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(end.tolist(), n.tolist())]
                i = np.frombuffer(r["doc_ids"], "<i8")
                yield pa.record_batch({"part": pa.array(np.full(len(n), r["part"]), pa.int32()), "doc_id": pa.array(i, pa.int64(), mask=i == NULL), "at": pa.array(r["start"] + end - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    docs = blocks.select("part", "start", "n_tokens", "crc32", "doc_ids", "lengths", "payload").mapInArrow(trimmed(run), "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    base = spark.read.parquet(f"{path}/parts").select("part", "base")
    base = F.broadcast(base) if base.count() <= MAX_PARTS else base
    return docs.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_blocks(table(spark, sf_dir, "documents", "doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Write the corpus as token blocks; the rows are the documents as the files have them."""
    return read_documents(spark, write_blocks(docs, path=path))
