"""Operator 4, mixing sources to target weights. DataFrame functions only.

Each source's documents stand in one stream, which is packed into blocks of ``block`` words.
The mix is a row of slots, dealt to output shards. Every slot of a shard draws its source with
the sources' shares, which makes a shard's counts a multinomial draw. A source's slots are
numbered through all shards; what it drew beyond the slots that its target needs is left out,
and what it lacks follows in closing shards, so that totals meet the targets whatever the draw.
Slot k takes, in pass k div blocks, the block at a pseudorandom permutation of k mod blocks, so
no block is taken oftener than there are passes (two at most) and no part of a source is
preferred. Blocks are joined by index. The seed is fixed: reruns agree.

Null texts have no words: size and taken are 0. A null source is a source of its own, the
last one. Repeated rows and rows without a number are documents of their own; the order in
their source is that of hashes, numbers and texts' hashes, ties among equal rows are of no
consequence. Texts of any length are packed whole. Extra columns are carried along by ``stage``
and not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from relsat.llm.common import SPACE_WORD, plain_names, table
from relsat.operators.staging import staged

BLOCK, SHARD, SHARE, MOST, SEED = 64, 4096, 1.5, 2, 20260
WEIGHTS = (3, 1, 2)
#: Rows that a running sum takes up in one task; rows of a table with one row a source that are broadcast at most.
RUN, MAX_SOURCES = 4096, 100_000


def running(df: DataFrame, order: str, value: str, out: str, key: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key that come before, by ``order``
    (distinct integers from 0): sums over runs of RUN numbers, then inside each run."""
    keys = [key] if key else []
    df = df.withColumn("__run", F.floor(F.col(order) / RUN))
    runs = df.groupBy(*keys, "__run").agg(F.sum(value).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__run") if key else Window.orderBy("__run")
    runs = runs.select(*keys, "__run", (F.sum("__n").over(before) - F.col("__n")).alias("__first"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "__run").orderBy(order)) - F.col(value)
    return df.withColumn("__in", inside).join(runs, [*keys, "__run"]).withColumn(out, F.col("__first") + F.col("__in")).drop("__run", "__in", "__first")


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with its place by ``order`` in ``rank``, from 0: places in the sorted ranges and the
    ranges' sizes, which are as few as the sort has partitions."""
    at = staged(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    sizes = at.groupBy(F.shiftright("__at", 33).alias("p")).count().orderBy("p").collect()
    base, first = [], 0
    for r in sizes:
        base += [F.lit(r["p"]), F.lit(first)]
        first += r["count"]
    offset = F.create_map(*base)[F.shiftright("__at", 33)] if base else F.lit(0)
    return at.withColumn("rank", (offset + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__at")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``src``, ``source_size``, ``rank`` and ``target`` of each source; one row per source.

    Shares stand to each other as the weights do, up to the caps; the excess is reshared until
    no more sources reach theirs. Each round is two sums over the sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked(sizes, F.col("src").isNull(), "src").withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    t = staged(t, "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at = t.agg(F.coalesce(F.sum(F.when(F.col("cap") <= F.lit(level) * F.col("w"), F.col("cap"))), F.lit(0.0)).alias("capped"), F.coalesce(F.sum(F.when(F.col("cap") > F.lit(level) * F.col("w"), F.col("w"))), F.lit(0.0)).alias("open"), F.count_if(F.col("cap") <= F.lit(level) * F.col("w")).alias("n")).first()
        if at["n"] == full or not at["open"]:
            break
        full, level = at["n"], (total * share - at["capped"]) / at["open"]
    return t.select("src", "rank", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def _uniform(n: Column, *key: Column) -> Column:
    """A number from 0 to n - 1 that the key fixes."""
    return F.pmod(F.xxhash64(F.lit(SEED), *key), n)


def permuted(df: DataFrame, k: str, n: str, out: str, *key: str, wide: bool = False) -> DataFrame:
    """``df`` with a permutation of 0..n-1 applied to ``k``: two rounds of a multiply, a rotation
    and a key-dependent shift.

    The multiplier is coprime to n: of some large primes, one that does not divide n. With
    ``wide``, for n from 2**31 on, products would not fit 63 bits and are taken as decimals of
    38 digits; both forms give the same numbers. Each step is a column of its own, so that its
    value is computed once.
    """
    primes = (1_000_000_007, 998_244_353, 1_000_000_009, 999_999_937)
    size, big = F.col(n), lambda c: c.cast("decimal(19,0)")
    p = F.lit(primes[-1]).cast("long")
    for q in primes[:-1]:
        p = F.when(size % F.lit(q) != 0, F.lit(q).cast("long")).otherwise(p)
    df = df.withColumn("__p", p).withColumn(out, F.col(k))
    for r in (1, 2):
        df = df.withColumn("__shift", F.pmod(F.xxhash64(F.lit(SEED + r), *key), size))
        if wide:
            moved = F.pmod(big(F.col(out)) * big(F.col("__p")), big(size)).cast("long") - (size - F.col("__shift"))
            df = df.withColumn("__m", moved).withColumn("__m", F.when(F.col("__m") < 0, F.col("__m") + size).otherwise(F.col("__m")))
        else:
            df = df.withColumn("__m", F.pmod(F.col(out) * F.pmod("__p", size) + F.col("__shift"), size))
        odd, half = F.col("__m").bitwiseAND(F.lit(1).cast("long")), F.shiftright("__m", 1)
        df = df.withColumn(out, half + odd * F.shiftright(size + 1, 1))
    return df.drop("__p", "__shift", "__m")


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows of documents with ``src``, ``size``, first word ``at`` in their source and ``copy``
    (a number among rows of one source that are equal in number and text); targets.

    Prefix sums are taken in buckets of documents and over the buckets of a source, so the
    documents of one source never meet in one task.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("src"), F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    sized = staged(sized.withColumn("sk", _source_key("src")), "sizes")  # the key joins on a null source too
    n = sized.count()
    buckets = max(16, n // 2000)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", F.lit(SEED)), F.lit(buckets)))
    part = staged(sized.groupBy("sk", "bucket").agg(F.sum("size").alias("in_bucket"), F.first("src", True).alias("src")), "buckets")
    goal = targets(part.groupBy("sk").agg(F.sum("in_bucket").alias("source_size"), F.first("src", True).alias("src")).drop("sk"))
    goal = staged(goal.withColumn("sk", _source_key("src")), "targets")
    base = running(part.select("sk", "bucket", "in_bucket"), "bucket", "in_bucket", "base", "sk").select("sk", "bucket", "base")
    same = Window.partitionBy("sk", "bucket").orderBy("doc_id", "h")
    inside = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = sized.withColumn("upto", F.sum("size").over(inside)).withColumn("copy", F.row_number().over(same) - F.rank().over(same))
    at = within.join(base, ["sk", "bucket"]).select("doc_id", "src", "sk", "h", "copy", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("at"))
    return at, goal


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def draw(goal: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """How often each block is taken: ``sk``, ``b``, ``times``, ``passes`` (bit set of passes)."""
    spark = goal.sparkSession
    full = goal.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # a source's last block is short: expect as many slots as give the target in words
    full = full.withColumn("need", F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long")).where("need > 0")
    full = staged(running(full.select("sk", "rank", "blocks", "need"), "rank", "need", "lo"), "needs")
    sums = full.agg(F.sum("need").alias("n"), F.count("*").alias("sources"), F.max("blocks").alias("blocks")).first()
    total, sources = sums["n"] or 0, sums["sources"]
    # the sources' stretches of 0..total-1, found by the cell that a drawn number falls into
    cells = max(1, 4 * sources)
    width = max(1, -(-total // cells))
    stretch = full.select("sk", "lo", (F.col("lo") + F.col("need")).alias("hi"), F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("need") - 1) / width))).alias("cell"))
    stretch = F.broadcast(stretch) if sources <= MAX_SOURCES else stretch
    slots = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), _uniform(F.lit(max(1, total)).cast("long"), F.col("id")).alias("u"))
    drawn = slots.withColumn("cell", F.floor(F.col("u") / width)).join(stretch, "cell").where("u >= lo and u < hi")
    counts = staged(drawn.groupBy("sk", "shard").agg(F.count("*").alias("c")), "draws")
    counts = running(counts, "shard", "c", "first", "sk")
    bounds = full.select("sk", "blocks", "need")
    kept = counts.join(bounds, "sk").where("first < need").select("sk", "shard", "blocks", "first", F.least(F.col("c"), F.col("need") - F.col("first")).alias("c"))
    shards = -(-total // shard)
    lack = bounds.join(counts.groupBy("sk").agg(F.sum("c").alias("got")), "sk", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < need")
    lack = lack.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - F.col("got") - 1) / shard))))
    closing = lack.select("sk", (F.lit(shards) + F.col("j")).alias("shard"), "blocks", (F.col("got") + F.col("j") * shard).alias("first"), F.least(F.lit(shard).cast("long"), F.col("need") - F.col("got") - F.col("j") * shard).alias("c"))
    # few rows that become many: dealt by number, so that they are not put together again
    rows = kept.unionByName(closing).repartition(min(20_000, shards // 50 + 4), "sk", "shard")
    taken = rows.select("sk", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("c") - 1)).alias("k"))
    taken = taken.withColumn("turn", F.floor(F.col("k") / F.col("blocks")).cast("int")).withColumn("k", F.col("k") % F.col("blocks"))
    taken = permuted(taken, "k", "blocks", "b", "sk", "turn", wide=(sums["blocks"] or 0) >= 1 << 31)
    return taken.select("sk", "b", "turn").groupBy("sk", "b").agg(F.count("*").alias("times"), F.sum(F.expr("shiftleft(1, turn)")).alias("passes"))


def taken_parts(at: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each document's stretches: ``lo`` to ``hi`` (words of the document) of a taken block."""
    spans = at.where("size > 0").select("doc_id", "h", "copy", "at", "size", "sk", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("b"))
    lo, hi = F.greatest(F.col("b") * block - F.col("at"), F.lit(0)), F.least((F.col("b") + 1) * block - F.col("at"), F.col("size"))
    return spans.join(drawn, ["sk", "b"]).select("doc_id", "h", "copy", "at", "sk", lo.alias("lo"), hi.alias("hi"), "times", "passes")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every document."""
    at, goal = placed(docs, doc_id, text, source)
    at = staged(at, "placed")
    words = taken_parts(at, draw(goal, block), block).groupBy("sk", "at").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("t"))
    small = goal.select("sk", "source_size", "target")
    # a document of a source is known by its first word; empty ones take nothing
    full = at.where("size > 0").join(words, ["sk", "at"], "left").unionByName(at.where("size = 0").withColumn("t", F.lit(None).cast("long")), allowMissingColumns=True)
    return full.join(small, "sk").select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document once for every pass that takes some of it.

    A pass that takes the whole document gives its text as it is; otherwise the words of the
    blocks taken, joined by blanks. Columns stay those of ``docs``.
    """
    d, name = plain_names(docs)
    text = F.col(name["text"])
    at, goal = placed(d, name["doc_id"], name["text"], name["source"])
    at = staged(at, "placed")
    parts = taken_parts(at, draw(goal))
    turns = parts.select("sk", "doc_id", "h", "copy", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("turn"), "passes").where("shiftright(passes, turn) % 2 = 1")
    want = turns.groupBy("sk", "doc_id", "h", "copy", "turn").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("got"))
    want = want.withColumnsRenamed({"sk": "w_sk", "doc_id": "w_id", "h": "w_h", "copy": "w_copy"})
    keyed = d.withColumn("sk", _source_key(name["source"])).withColumn("h", F.xxhash64(F.coalesce(text, F.lit(""))))
    # rows of one source that are equal in number and text take their numbers in the order of the other columns
    again = staged(at.where("copy > 0").select(F.col("sk").alias("w_sk"), F.col("doc_id").alias("w_id"), F.col("h").alias("w_h")).distinct(), "twice")
    same = lambda df, k: (df["sk"] == k["w_sk"]) & (df["h"] == k["w_h"]) & df[name["doc_id"]].eqNullSafe(k["w_id"])
    if again.isEmpty():
        numbered = keyed.withColumn("copy", F.lit(0))
    else:
        order = Window.partitionBy("sk", name["doc_id"], "h").orderBy(F.to_json(F.struct(*name.values())))
        numbered = keyed.join(again, same(keyed, again), "left_anti").withColumn("copy", F.lit(0)).unionByName(keyed.join(again, same(keyed, again), "left_semi").withColumn("copy", F.row_number().over(order) - 1))
    both = numbered.join(want, same(numbered, want) & (numbered["copy"] == want["w_copy"])).withColumn("words", F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0)))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("words"), (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")
    both = both.withColumn(name["text"], F.when(F.col("got") >= F.size("words"), text).otherwise(cut))
    if "n_chars" in name:
        both = both.withColumn(name["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return both.select(*name.values()).toDF(*docs.columns)
