"""What the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Letters that lower-casing touches: A to Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One word of the white-space kind, as a Java and RE2 pattern.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, and no others, so that extra columns never clash."""
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1 and so on, which no column that an operator adds can clash
    with, and the new name of each column; ``toDF(*docs.columns)`` gives the old ones back."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_of(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned 64-bit integers."""
    a = a ^ (a >> np.uint64(30))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a = a ^ (a >> np.uint64(27))
    a = a * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL | None:
    try:
        c = ctypes.CDLL("libc.so.6")
        c.mallopt(-3, 1 << 20)  # arrays from a megabyte on are mapped, and given back when they are freed
        return c
    except (OSError, AttributeError):  # another C library
        return None


def trim() -> None:
    """Give a worker's unused memory back: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    if c := _c_library():
        c.malloc_trim(0)


def trimmed(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A partition function that holds little unused memory, and gives it back when it is done."""

    def run(*batches: Iterator) -> Iterator:
        _c_library()
        pa.set_memory_pool(pa.system_memory_pool())
        yield from f(*batches)
        trim()

    return run


def trimmed_group(f: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """The same for a function of one group."""

    def run(group: Any) -> Any:
        _c_library()
        out = f(group)
        if len(group) > 64:
            trim()
        return out

    return run


#: Bytes of an Arrow batch between the executors and their Python workers; Spark's default is 64 MB.
BATCH_BYTES = 4 << 20


def tuned(spark: SparkSession) -> None:
    """Small Arrow batches for this session, unless it has a setting of its own: a batch lies in
    the executor's direct memory and in the worker, several times over while it is copied."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(key, str(BATCH_BYTES))


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return trimmed(run)


def slices(b: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64)
    end = np.cumsum(size)
    at = 0
    while at < b.num_rows:
        base = end[at] - size[at]
        to = max(at + 1, int(np.searchsorted(end, base + most, "right")))
        yield b.slice(at, to - at)
        at = to


def fraction_of(df: DataFrame, group: Column, bound: int, key: Column) -> DataFrame:
    """About ``bound`` rows of each group at most, chosen by a hash of ``key``.

    The counts are taken over all rows; the same rows are chosen in every run. Only groups that
    exceed the bound are collected, so their number is below the rows divided by the bound.
    """
    over = df.groupBy(group.alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > bound).orderBy("g").collect()
    shares = {r["g"]: bound / r["n"] for r in over}
    share = F.lit(shares.pop(None, 1.0))
    if shares:
        named = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
        share = F.when(group.isNull(), share).otherwise(F.coalesce(named[group], F.lit(1.0)))
    return df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < share * float(1 << 30))
