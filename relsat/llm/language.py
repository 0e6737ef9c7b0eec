"""Operator 10, language ID: multilingual mixture inference.

Every word of a text is drawn from one of the text's languages. A word's likelihood in a
language comes from letter trigrams; expectation-maximisation estimates the document's
language proportions; nested language sets (the most probable language, the two most probable
ones, and so on up to all) are compared by likelihood less half the logarithm of the words for
each language beyond the first. The likelihood is concave in the proportions, so its gradient
bounds what more rounds, or any larger set, could still give: rounds end when that is next to
nothing, and sets that cannot win are not fitted.

Nulls and texts without a letter (Unicode category L) give ``und`` with score 0. Texts of any
length are read whole. Rows that repeat are judged one by one; a null document number is held
out of nothing; extra columns are carried along by ``detect`` and not read. An empty table
gives an empty result; without any learnable row every document is ``und``. Equal proportions
go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relsat.llm.common import crc_of, fraction_of, per_batch, plain_names, slices, table, tuned

BUCKETS = 1 << 16
#: Labelled documents of one language that training reads (about).
TRAIN_ROWS = 3000
#: Log-likelihood that further rounds may still give: of a text, and for each of its words.
SLACK, SLACK_WORD = 0.02, 1e-6
#: Bytes that are no part of a word become blanks.
WORD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter byte, first letter of each word, and each word's document."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    a = WORD[np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)]
    begins = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])
    at = np.flatnonzero(a != 32)
    h = (a[at - 1] * np.uint32(0x9E3779B1) + a[at] * np.uint32(0x85EBCA77) + a[at + 1] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    first = np.flatnonzero(a[at - 1] == 32)
    return h, first, np.searchsorted(begins, at[first], "right") - 1


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-likelihoods (bucket, language), of the labelled ``docs``."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sample = fraction_of(labelled, F.col(lang), rows, F.col(doc_id)).select(F.col(lang).alias("g"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices(b, "t", 4_000_000):
                by: dict[str, list[str]] = {}
                for g, t in zip(part.column("g").to_pylist(), part.column("t").to_pylist()):
                    by.setdefault(g, []).append(t)
                for g, texts in by.items():
                    totals[g] = totals.get(g, 0) + np.bincount(_grams(texts)[0], minlength=BUCKETS)
        for g, c in totals.items():
            k = np.flatnonzero(c)
            yield pa.record_batch({"g": pa.array([g] * len(k), pa.string()), "k": pa.array(k, pa.int32()), "c": pa.array(c[k], pa.int64())})

    # a row for each language, of at most BUCKETS pairs, whatever the corpus
    counted = sample.mapInArrow(count, "g string, k int, c long").groupBy("g", "k").agg(F.sum("c").alias("c"))
    per_lang = counted.groupBy("g").agg(F.collect_list(F.struct("k", "c")).alias("kc")).orderBy("g")
    langs, tables = [], []
    for r in per_lang.toLocalIterator():
        c = np.zeros(BUCKETS)
        for k, n in r["kc"]:
            c[k] = n
        langs.append(r["g"])
        tables.append(np.log((c + 0.5) / (c.sum() + 0.5 * BUCKETS)))
    return langs, np.array(tables, np.float32).T.reshape(BUCKETS, len(langs))


def fitted(p: np.ndarray, starts: np.ndarray, mask: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation, document by document: proportions within ``mask``, their
    log-likelihood, and a bound of the largest one.

    ``p``: likelihoods of words; ``starts``: each document's first word. A document is done
    when the bound is near, or is not above ``floor``.
    """
    m = len(starts)
    pi, fit, bound = mask / mask.sum(1, keepdims=True), np.zeros(m), np.zeros(m)
    live, size = np.arange(m), np.diff(np.r_[starts, len(p)])
    while len(live):
        own = np.repeat(np.arange(len(live)), size)
        mix = (pi[live][own] * p).sum(1)
        fit[live] = np.add.reduceat(np.log(mix), starts)
        gain = np.add.reduceat(p / mix[:, None], starts) / size[:, None]
        gap = size * (np.where(mask[live] > 0, gain, 0.0).max(1) - 1)
        bound[live] = fit[live] + gap
        go = (gap > SLACK + SLACK_WORD * size) & (bound[live] > floor[live])
        pi[live[go]] *= gain[go]
        if not go.all():
            p, live, size = p[np.repeat(go, size)], live[go], size[go]
            starts = np.cumsum(size) - size
    return pi, fit, bound


def mixture(like: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's best language and its proportion, from log-likelihoods of its words."""
    best, score = np.full(n, -1), np.zeros(n)
    if not len(doc):
        return best, score
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    seen, size = doc[starts], np.diff(np.r_[starts, len(doc)])
    p = np.exp(np.maximum(like - like.max(1, keepdims=True), -30.0)).astype(np.float64)
    k = p.shape[1]
    price = 0.5 * np.log(size + 1.0)
    alone = np.add.reduceat(np.log(p), starts)
    chosen, value = np.eye(k)[alone.argmax(1)], alone.max(1)
    rows = np.arange(len(starts))
    full, fit, bound = fitted(p, starts, np.ones((len(rows), k)), value + price)
    order = np.argsort(-full, axis=1, kind="stable")
    for more in range(1, k):  # languages beyond the first
        rows = rows[bound[rows] - more * price[rows] > value[rows]]
        if not len(rows):
            break
        pi, got = full[rows], fit[rows]
        if more < k - 1:
            mask = np.zeros((len(rows), k))
            np.put_along_axis(mask, order[rows, : more + 1], 1.0, 1)
            words = np.zeros(len(starts), bool)
            words[rows] = True
            pi, got, _ = fitted(p[np.repeat(words, size)], np.cumsum(size[rows]) - size[rows], mask, value[rows] + more * price[rows])
        got = got - more * price[rows]
        better = got > value[rows] + 1e-9
        chosen[rows[better]], value[rows[better]] = pi[better], got[better]
    best[seen], score[seen] = chosen.argmax(1), chosen.max(1)
    return best, score


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Every row with its columns, the predicted language and that language's share of the text.

    The model is broadcast: 4 * BUCKETS bytes for each language, whatever the corpus.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = [], []
        for part in slices(b, text, 4_000_000 // max(4, len(langs)) + 1):
            texts = [t or "" for t in part.column(text).to_pylist()]
            h, first, doc = _grams(texts)
            if len(first) and langs:
                best, score = mixture(np.add.reduceat(shared.value[h], first), doc, len(texts))
            else:
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for t, k, s in zip(texts, best.tolist(), score.tolist()):
                ok = k >= 0 and any(map(str.isalpha, t))
                names.append(langs[k] if ok else "und")
                scores.append(min(1.0, max(0.0, s)) if ok else 0.0)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang_col, score_col])

    return docs.mapInArrow(per_batch(one), T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = F.pmod(crc_of(F.col("doc_id")), F.lit(3)).eqNullSafe(1)
    found = detect(docs.select("doc_id", "text"), train(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Keep the documents whose main language is known and makes up ``least`` of the text."""
    tuned(spark)
    d, name = plain_names(docs)
    out = F.pmod(crc_of(F.col(name["doc_id"])), F.lit(3)).eqNullSafe(1)
    found = detect(d, train(d.where(~out), name["doc_id"], name["text"], name["lang"]), name["text"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*name.values()).toDF(*docs.columns)
