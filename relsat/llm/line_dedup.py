"""Operator 1, line dedup: a deletion-neighbourhood join. DataFrame functions only.

A line goes if a line that stands earlier, by (doc_id, line number), equals it or is within
one character edit of it. Lines are the parts of a text between line feeds; blank lines stay.
The edit is allowed from ``min_chars`` characters on: in a shorter line (a number, a list item,
a bracket) one other character makes another line. With 1 it is allowed in every line.

1. Equal lines meet in one aggregate, which keeps the earliest place.
2. Sound prefilters: of two lines within one edit either the first or the second half agrees,
   and all but one stretch of about the square root of their length. Only distinct lines that
   share a half, and then only stretches around which another line agrees, go on.
3. For these every variant with one character of the stretch deleted is emitted as a hashed
   key, along with the place of the deletion. Lines that share a substitution key form a
   clique, lines that share an insertion key a star around the shorter line: the earliest
   place of either side is an aggregate, never pairs.
4. The partner found is verified by edit distance on the texts.

Null texts have no lines, and rows without a number no place: nothing is removed from them and
they stand before nothing. Rows that repeat a number are one document: their lines of one line
number have the same place. Of equally early partners the one with the smaller hash is taken.
Lines and texts of any length are read whole. Extra columns are carried along by
``dedup_lines`` and not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relsat.llm.common import table
from relsat.operators.staging import staged

MIN_CHARS = 16
#: Lines so frequent that there can be no more than that many are broadcast; their occurrences stay where they are.
MAX_HOT = 20_000


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    placed = docs.where(F.col(doc_id).isNotNull())
    return placed.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _half_keys(n: Column, line: Column, length: Column) -> list[Column]:
    """Keys of the two halves under the geometry of a line of ``n`` characters."""
    h = F.floor(n / 2).cast("int")
    rest = (n - h).cast("int")
    return [F.xxhash64(F.lit("p"), n, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit("s"), n, F.substring(line, (length - rest + 1).cast("int"), rest))]


def _stretches(act: DataFrame, longer: bool) -> DataFrame:
    """A row for each stretch of a line: ``key`` of all that stands around it, and its ``body``.

    The geometry is that of a line of the same length or, for ``longer``, of a line that is
    one character shorter; then a stretch is one character wider, so that it is all in which
    the two lines can differ.
    """
    n = F.col("n").cast("int")
    g = n - 1 if longer else n
    s = F.greatest(F.lit(1), F.ceil(F.sqrt(g)).cast("int"))
    rows = act.select("k", "first", "line", n.alias("n"), g.alias("g"), s.alias("s"), F.explode(F.sequence(F.lit(0), (F.ceil(g / s) - 1).cast("int"))).alias("j"))
    rows = rows.withColumn("at", F.col("j") * F.col("s"))
    rows = rows.withColumn("size", F.least(F.col("s") + int(longer), F.col("n") - F.col("at")))
    before, after = F.substring("line", F.lit(1), F.col("at")), F.substring("line", F.col("at") + F.col("size") + 1, F.col("n"))
    return rows.select("k", "first", "size", F.lit(longer).alias("longer"), F.xxhash64("g", "j", before, F.lit(7), after).alias("key"), F.substring("line", F.col("at") + 1, F.col("size")).alias("body"))


def near_earlier(distinct: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``k`` of the distinct lines that an earlier line is within one edit of.

    ``distinct``: ``k`` (hash of the line), ``line`` and ``first`` (struct of its earliest place).
    """
    n = F.char_length("line")
    long = distinct.withColumn("n", n).where(F.col("n") >= min_chars)
    own = F.array(*_half_keys(F.col("n"), F.col("line"), F.col("n")), *_half_keys(F.col("n") - 1, F.col("line"), F.col("n")))
    halves = long.select("k", F.explode(F.array_distinct(own)).alias("half"))
    # a half that one line has alone is of no use; min and max tell without a list
    shared = halves.groupBy("half").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a <> z").select("half")
    active = halves.join(shared, "half", "left_semi").select("k").distinct()
    act = staged(long.join(active, "k").select("k", "line", "n", "first"), "active")
    around = staged(_stretches(act, False).unionByName(_stretches(act.where(F.col("n") > min_chars), True)), "stretches")
    met = around.groupBy("key").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a <> z").select("key")
    around = staged(around.join(met, "key", "left_semi"), "met")
    # every deletion of one character of the stretch, and the stretch as it is
    gone = lambda o: F.concat(F.substring("body", F.lit(1), o), F.substring("body", o + 2, F.col("size")))
    places = F.sequence(F.lit(0), F.col("size") - 1)
    own, long_ = around.where("not longer"), around.where("longer")
    same = own.select("k", "first", F.explode(F.transform(places, lambda o: F.xxhash64("key", F.lit("x"), o, gone(o)))).alias("v"), F.lit(0).alias("side"))
    longer = long_.select("k", "first", F.explode(F.array_distinct(F.transform(places, lambda o: F.xxhash64("key", F.lit("i"), gone(o))))).alias("v"), F.lit(1).alias("side"))
    shorter = own.select("k", "first", F.xxhash64("key", F.lit("i"), "body").alias("v"), F.lit(2).alias("side"))
    keys = staged(same.unionByName(longer).unionByName(shorter), "variants")
    side = lambda s: F.min(F.when(F.col("side") == s, F.struct("first", "k")))
    best = keys.groupBy("v").agg(F.min("k").alias("a"), F.max("k").alias("z"), side(0).alias("x"), side(1).alias("l"), side(2).alias("s")).where("a <> z").select("v", "x", "l", "s")
    partner = F.when(F.col("side") == 0, F.col("x")).when(F.col("side") == 1, F.col("s")).otherwise(F.col("l"))
    met = keys.join(best, "v").select("k", "first", partner.alias("p")).where("p is not null and p.first < first")
    met = met.groupBy("k").agg(F.min("p").alias("p")).select("k", F.col("p.k").alias("pk"))
    texts = act.select("k", "line")
    pairs = met.join(texts, "k").join(texts.selectExpr("k as pk", "line as other"), "pk")
    return pairs.where(F.levenshtein("line", "other", 1) >= 0).select("k")


def judged_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Every line that is not blank: ``doc_id``, ``line_no``, ``copy`` and ``near``."""
    lines = lines_of(docs, doc_id, text).where(F.trim("line") != "")
    key = F.xxhash64("line", F.lit(1))
    distinct = lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times")).withColumn("k", key)
    distinct = staged(distinct, "lines")
    near = near_earlier(distinct, min_chars).withColumn("near", F.lit(True))
    # only repeated or near lines need their occurrences judged one by one
    marked = distinct.select("k", "first", "times").join(near, "k", "left").where("times > 1 or near").select("k", "first", "times", F.coalesce("near", F.lit(False)).alias("near"))
    marked = staged(marked, "marked")
    often = (distinct.agg(F.sum("times")).first()[0] or 0) // MAX_HOT + 1
    hot = marked.where(F.col("times") > often).select("k", F.col("first").alias("hot_first"), F.col("near").alias("hot_near"))
    at = lines.select("doc_id", "line_no", key.alias("k")).join(F.broadcast(hot), "k", "left")
    # what is judged needs no partner: its key is spread, so that no task gets all of a line's occurrences
    away = F.when(F.col("hot_first").isNotNull(), F.xxhash64("doc_id", "line_no")).otherwise(F.col("k"))
    rest = marked.where(F.col("times") <= often).select(F.col("k").alias("at"), F.lit(False).alias("spread"), "first", "near")
    joined = at.withColumn("at", away).withColumn("spread", F.col("hot_first").isNotNull()).join(rest, ["at", "spread"], "left")
    first = F.coalesce("hot_first", "first")
    return joined.select("doc_id", "line_no", F.coalesce(first != F.struct("doc_id", "line_no"), F.lit(False)).alias("copy"), F.coalesce("hot_near", "near", F.lit(False)).alias("near"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with ``text`` rebuilt from the lines that stay; other columns as they are."""
    gone = judged_lines(docs, doc_id, text, min_chars).where("copy or near").groupBy("doc_id").agg(F.collect_set("line_no").alias("__gone")).withColumnRenamed("doc_id", "__id")
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    kept = F.transform("__stay", lambda i: F.get("__lines", i))
    both = docs.join(gone, docs[doc_id] == gone["__id"], "left").withColumn("__lines", lines).withColumn("__stay", stay)
    return both.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    gone = F.col("copy") | F.col("near")
    found = judged_lines(docs).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("copy").alias("n_copies"), F.count_if(F.col("near") & ~F.col("copy")).alias("n_near"), F.array_sort(F.collect_list(F.when(gone, F.col("line_no")))).alias("gone"))
    empty = F.lit(0).cast("long")
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", *(F.coalesce(c, empty).alias(c) for c in ("n_lines", "n_copies", "n_near")), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


ORACLE = """
WITH l AS (SELECT doc_id, i - 1 AS line_no, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) t, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) u WHERE trim(s[i], ' ') <> ''),
d AS (SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM l GROUP BY line),
g AS (SELECT line, first, n, n AS g FROM d WHERE n >= 16 UNION ALL SELECT line, first, n, n - 1 FROM d WHERE n >= 16),
h AS (SELECT *, 'p' || g || ':' || left(line, g // 2) AS half FROM g UNION ALL SELECT *, 's' || g || ':' || right(line, g - g // 2) FROM g),
near AS (SELECT DISTINCT a.line FROM h a JOIN h b ON a.half = b.half AND a.line <> b.line AND b.first < a.first WHERE abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
j AS (SELECT l.doc_id, l.line_no, (l.doc_id, l.line_no) <> d.first AS copy, near.line IS NOT NULL AS near FROM l JOIN d USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(line_no) AS n_lines, count(line_no) FILTER (copy) AS n_copies, count(line_no) FILTER (near AND NOT copy) AS n_near,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (copy OR near), '') AS removed
FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN j USING (doc_id) GROUP BY doc_id
"""
