"""Operator 6, URL filters: a sorted digest array of allow and block rules.

Rules (host, path prefix, verdict) are stored as one file: sorted 64-bit xxhash keys, offsets,
the lengths of the path prefixes and the full strings. The file lies in the shared folder;
Spark brings it to every executor, where it is memory-mapped and only the pages that probes
touch are read. A batch of URLs is probed by vectorised binary search, once for every host
suffix and every length of a rule's path, and each hit is confirmed against the stored string.

A URL that is null or has no ``://`` has empty host and path and fits no rule. Where no rule
fits, the verdict is ``allow``: the list names what is blocked. Of several fitting rules the
one with most characters wins. Repeated rules count once; of two verdicts for one rule, block.
Rows that repeat, or have no number, are judged one by one; URLs of any length are read whole.
Extra columns are not read. An empty table gives an empty result, an empty list allows all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from relsat.llm.common import ascii_lower, per_batch, table
from relsat.operators.staging import new_path

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAGIC = b"RSURL002"


def packed(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file: magic, counts of rules and of path lengths, sorted keys (u64), offsets (u64, one
    more), path lengths in bytes (u64), verdicts (u8), strings."""
    verdicts: dict[bytes, int] = {}
    lengths = set()
    for host, prefix, verdict in rules:
        key = f"{host}{prefix}".encode()
        lengths.add(len(prefix.encode()))
        verdicts[key] = max(verdicts.get(key, 0), int(verdict == "block"))
    keyed = sorted((xxhash.xxh64_intdigest(k), k) for k in verdicts)
    ends = np.cumsum([0] + [len(k) for _, k in keyed]).astype("<u8")
    head = MAGIC + np.array([len(keyed), len(lengths)], "<u8").tobytes()
    arrays = np.array([h for h, _ in keyed], "<u8").tobytes() + ends.tobytes() + np.array(sorted(lengths), "<u8").tobytes()
    return head + arrays + np.array([verdicts[k] for _, k in keyed], "u1").tobytes() + b"".join(k for _, k in keyed)


def published(spark: SparkSession, data: bytes) -> str:
    """Write the file to the shared folder and have Spark bring it to the executors; its name there."""
    name = f"rules-{uuid.uuid4().hex}.bin"
    path = f"{new_path(spark, 'rules')}/{name}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return name


class Rules:
    """A memory-mapped rule file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a rule file")
        n, lengths = raw[8:24].view("<u8").tolist()
        at = 24 + 8 * n
        self.keys, self.ends = raw[24:at].view("<u8"), raw[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.lengths = raw[at : at + 8 * lengths].view("<u8").tolist()
        at += 8 * lengths
        self.block, self.text = raw[at : at + n], raw[at + n :]

    def string(self, i: int) -> bytes:
        return bytes(self.text[int(self.ends[i]) : int(self.ends[i + 1])])

    def find(self, probes: list[bytes]) -> np.ndarray:
        """For each probe the rule's index, or -1."""
        found = np.full(len(probes), -1)
        if not len(self.keys) or not probes:
            return found
        h = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, h)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h).tolist():
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == h[k]:  # equal digests stand side by side
                if self.string(i) == probes[k]:
                    found[k] = i
                    break
                i += 1
        return found


def parts(url: Column | str) -> tuple[Column, Column]:
    """Host and path of a URL."""
    found = lambda k: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(found(1)), found(2)


def suffixes(host: str) -> list[bytes]:
    """The host and the domains that it is a subdomain of."""
    tails = [host]
    while "." in tails[-1]:
        tails.append(tails[-1].split(".", 1)[1])
    return [t.encode("utf-8", "replace") for t in tails]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row."""
    name = published(pages.sparkSession, packed(rules))
    mapped: list[Rules] = []

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        if not mapped:
            mapped.append(Rules(SparkFiles.get(name)))
        index = mapped[0]
        hosts = {h: suffixes(h) for h in b.column("host").unique().to_pylist()}
        probes, owner = [], []
        for k, (host, path) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist())):
            if host or path:
                full = path.encode("utf-8", "replace")
                heads = [full[:n] for n in index.lengths if n <= len(full)]
                for tail in hosts[host]:
                    probes += [tail + head for head in heads]
                    owner += [k] * len(heads)
        best: dict[int, int] = {}
        hits = index.find(probes)
        for j in np.flatnonzero(hits >= 0).tolist():
            if owner[j] not in best or len(probes[j]) > len(index.string(best[owner[j]])):
                best[owner[j]] = int(hits[j])
        rule = [index.string(best[k]).decode() if k in best else None for k in range(b.num_rows)]
        verdict = ["block" if k in best and index.block[best[k]] else "allow" for k in range(b.num_rows)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = parts(F.col(url))
    shape = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    return pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(per_batch(one), shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


ORACLE = """
WITH r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, row_number() OVER () AS k,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""
