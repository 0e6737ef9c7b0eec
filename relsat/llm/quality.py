"""Operator 9, quality classifier: Bradley-Terry pairwise ranking.

A document's score is a linear function of its features. The weights are learnt from
preference pairs (a document of label 1 beats one of label 0) by logistic loss on feature
differences; the threshold is a quantile of the training scores, the one that separates the
labels best, and a monotone map puts it at 0.7.

Features come from the whole text: shares of character classes, word shapes, repetition and
line shapes, each as a value and as membership in quantile bins of the training rows; and how
often words and pairs of words occur, hashed into LEXICAL places.
Null and empty texts have all-zero features and get a score like any other. Labels other than
0 and 1 are not learnt from; of several labels of one number the greater counts; if one label
is missing, every score is 0.7. Equal margins have equal scores, and the quantile falls on the
lowest of equally good places. Rows that repeat are scored one by one; rows without a number
are scored, held out of nothing and not learnt from. Texts of any length are read whole, piece
by piece. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relsat.llm.common import crc_of, fraction_of, slices, table, trimmed, word_hashes

#: Labelled rows of one label that training reads (about), preference pairs, quantile bins.
TRAIN_ROWS, PAIRS, BINS, SEED = 3000, 40_000, 8, 9
#: Places of hashed words and pairs of words (a power of two); bytes of text that are split at a time.
LEXICAL, PIECE = 1024, 1 << 20
THRESHOLD = 0.7
CLASSES = np.zeros((256, 8))
for _b in range(256):
    CLASSES[_b] = [_b in (32, 9, 10, 11, 12, 13), 65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _b >= 128, _b in b".,;:", _b in b"!?", 33 <= _b <= 126 and not chr(_b).isalnum() and _b not in b".,;:!?'\"-()"]
ENDS = (b".", b"!", b"?", b":", b'"')


SURFACE = 20
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def features(text: bytes | None) -> np.ndarray:
    """SURFACE statistics, then the square roots of the LEXICAL places' shares."""
    text = text or b""
    n, out = len(text), np.zeros(SURFACE + LEXICAL, np.float32)
    hashes, sizes, titled, at = [], [], 0, 0
    while at < n:
        cut = WHITE.search(text, at + PIECE) if at + PIECE < n else None
        to = cut.end() if cut else n
        words = text[at:to].split()
        at = to
        sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
        titled += sum(map(bytes.istitle, words))
        hashes.append(word_hashes([x.lower() for x in words]))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    w = len(h)
    if not w:
        return out
    kind = sum(np.bincount(np.frombuffer(text, np.uint8, min(PIECE, n - k), k), minlength=256) for k in range(0, n, PIECE)) @ CLASSES / n
    size = np.concatenate(sizes)
    lines = text.split(b"\n")
    distinct = len(np.unique(h))
    letters = kind[1] + kind[2] + kind[4] + 1e-9
    out[:SURFACE] = [*kind, kind[1] / letters, np.log1p(w), size.mean(), size.std(), (size == 1).mean(), (size > 20).mean(), distinct / w, distinct / w**0.7, (h[1:] == h[:-1]).sum() / w, titled / w, len(set(lines)) / len(lines), sum(x.rstrip().endswith(ENDS) for x in lines) / len(lines)]
    pairs = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    places = np.concatenate((h, pairs ^ pairs >> np.uint64(31))) % np.uint64(LEXICAL)
    out[SURFACE:] = np.sqrt(np.bincount(places.astype(np.int64), minlength=LEXICAL) / len(places))
    return out


def preferences(z: np.ndarray, better: np.ndarray, worse: np.ndarray, w: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of the pairs, with weight decay, and its gradient.

    The loss depends on differences of rows; their gradient is gathered by row first.
    """
    s = z @ w
    d = np.clip(s[better] - s[worse], -30, 30)
    pull = 1 / (1 + np.exp(d)) / len(d)
    by_row = np.bincount(worse, pull, len(z)) - np.bincount(better, pull, len(z))
    return float(np.log1p(np.exp(-d)).mean() + 0.5 * (decay * w * w).sum()), by_row @ z + decay * w


class Ranker:
    """Standardised features with their bins, weights, and the map from margin to score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, bins: int = BINS, rounds: int = 300, decay: float = 1e-4) -> None:
        x = x.astype(np.float64)
        front = x[:, :SURFACE]
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        # the rarer label sets bins of its own, so that a small share of bad rows is seen
        rare = front[y == (0 if (y == 0).sum() <= (y == 1).sum() else 1)]
        at = np.arange(1, bins) / bins
        self.cuts = [np.unique(np.r_[np.quantile(a, at), np.quantile(c, at)]) for a, c in zip(front.T, rare.T)]
        z = self.expand(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        rng = np.random.default_rng(SEED)
        better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
        w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
        rate = np.full(z.shape[1], 0.1)
        rate[SURFACE : SURFACE + LEXICAL] = 0.01  # each of many words says little
        for t in range(1, rounds + 1):
            _, g = preferences(z, better, worse, w, decay)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        s = z @ w
        order = np.argsort(s, kind="stable")
        # errors when the k lowest are rejected; the threshold is that quantile of the scores
        wrong = np.cumsum(y[order] == 1) + (y == 0).sum() - np.cumsum(y[order] == 0)
        k = int(np.argmin(wrong))
        self.quantile = (k + 1) / len(s)
        ranked = s[order]
        self.cut = float((ranked[k] + ranked[min(k + 1, len(s) - 1)]) / 2)
        self.scale = float(1 / (np.quantile(s, 0.9) - np.quantile(s, 0.1) + 1e-9)) * 4

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = [np.clip((x - self.mean) / self.std, -5, 5)]
        for c, cuts in zip(x.T, self.cuts):
            z.append((c[:, None] > cuts[None, :]).astype(float))
        return np.concatenate(z, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.scale * (self.expand(x) @ self.weights - self.cut)
        return 1 / (1 + np.exp(-np.clip(margin + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def _with_features(df: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "t", PIECE):
                x = [features(t.as_py()).tobytes() for t in b.column("t")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.binary())], [*keep, "x"])

    return df.withColumn("t", F.col("t").cast("binary")).mapInArrow(trimmed(run), T.StructType([*(df.schema[c] for c in keep), T.StructField("x", T.BinaryType())]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Ranker | None:
    """Learn from about ``rows`` labelled documents of each label, chosen by a hash of the number.

    That many rows of features, 4 KB each, are collected.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    known = fraction_of(known, F.col("y"), rows, F.col("i")).groupBy("i").agg(F.max("y").alias("y"))  # some thousand rows
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    found = _with_features(texts.join(F.broadcast(known), "i"), ["i", "y"]).orderBy("i").toPandas()
    y = found.y.to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return Ranker(np.frombuffer(b"".join(found.x), np.float32).reshape(len(y), -1), y)


def judge(docs: DataFrame, ranker: Ranker | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row. The model's size does not depend on the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for whole in batches:
            for part in slices(whole, "t", PIECE):
                for at in range(0, part.num_rows, 256):
                    b = part.slice(at, 256)
                    s = r.score(np.stack([features(t.as_py()) for t in b.column("t")])) if r else np.full(b.num_rows, THRESHOLD)
                    yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(s)], [doc_id, "score"])

    shape = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(doc_id).alias("i"), F.col(text).cast("binary").alias("t")).mapInArrow(trimmed(run), shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    out = F.pmod(crc_of(F.col("doc_id")), F.lit(4)).eqNullSafe(2)
    scored = judge(docs, train(docs, labels.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
