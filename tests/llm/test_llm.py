"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("relsat.llm.registry")

import __spark_entry__ as entry
from conftest import canonical, oracle_rows
from pyspark.sql import functions as F
from relsat.llm import ann, decontaminate, html_extract, jaccard, language, line_dedup, mixing, quality, token_files, url_filter
from relsat.llm.fm_index import FMIndex
from relsat.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, bucket string, v double, first string"
ODD = [None, "", " ", "\n\n", "word", "one two three four five six seven eight nine ten eleven", "é ü ß 漢字", "x " * 5000, "same text here for all of us to see", "same text here for all of us to see", "A\tB\x0bC\r\nD", "1 2 3 !!!"]


def odd(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(i, t, ["en", None][i % 2], ["b", "a", None][i % 3], 0, "clash", 1.0, "x") for i, t in enumerate(rows)], DOC)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of odd rows."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "Five SIX seven"), (2, None), (3, "..."), (4, "two three four five six seven eight nine ten eleven"), (4, "two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, None, None), (1, "", ""), (2, "no scheme", "<p>x"), (3, "HTTP://EXAMPLE.NET/en/?q", "<article><p>Hi &amp; bye.</p></article>"), (4, "a://b.net", "<div"), (4, "a://b.net", "<div")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (5, [0.0, 0.0]), (6, None), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == oracle_rows(ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows_equal_sql(spark, name, folder):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    assert canonical(QUERIES[name](spark, folder).toPandas()) == canonical(c.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, name, folder, nothing):
    table = {"op5": "pages", "op6": "pages", "op8": None}.get(name[:3], "documents")
    got = QUERIES[name](spark, folder)
    if table:
        assert got.count() == spark.read.parquet(f"{folder}/{table}.parquet").count()
    assert QUERIES[name](spark, nothing).count() == 0


def test_entry_has_all(spark):
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_lines(spark):
    base = "the quick brown fox jumps over it"
    docs = odd(spark, [base, base.replace("quick", "quack"), base + "!", "a\n\n" + base[:-4], "short\nshorts\nshort", None])
    got = {r["doc_id"]: (r["copy"], r["near"]) for r in line_dedup.judged_lines(docs).collect() if r["line_no"] == 0}
    assert got[0] == (False, False) and got[1] == (False, True) and got[2] == (False, True)
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert clean[0] == base and clean[1] == "" and clean[3] == "a\n\n" + base[:-4] and clean[4] == "short\nshorts" and clean[5] is None


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    seeds = ["".join(rng.choice("abcdefgh ñ") for _ in range(rng.randint(16, 40))).strip() + "." * 8 for _ in range(6)]
    lines = []
    for _ in range(120):
        s = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(s))
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        lines.append("".join(s))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return a == b
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    got = {r["doc_id"]: r["copy"] or r["near"] for r in line_dedup.judged_lines(odd(spark, lines)).collect()}
    assert got == {i: any(near(a, b) for b in lines[:i]) for i, a in enumerate(lines)}


def test_fm_index_equals_scan():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sym = rng.integers(0, 5, 200)
        sym[-1] = 0
        index = FMIndex(sym, 4, every=8)
        pats = rng.integers(1, 5, (30, 4))
        lengths = rng.integers(1, 5, 30)
        lo, hi = index.search(pats, lengths)
        for p, n, a, z in zip(pats, lengths, lo, hi):
            want = [i for i in range(len(sym) - n + 1) if (sym[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def test_decontamination_in_blocks(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    cols = ["doc_id", "__words", "__hit", "__items", "__spans"]
    one, many = (sorted(map(str, decontaminate.scan(docs, items, block_chars=n).select(cols).collect())) for n in (10**6, 20))
    assert one == many
    r = QUERIES["op2_decontamination"](spark, folder).where("doc_id = 5").first()
    assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (11, 10, 2, True)
    assert r["items_sha256"] == hashlib.sha256(b"1,4").hexdigest()


def test_jaccard_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MIN_HEAVY", 4)  # labels and blocks at this size
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = [None, "", "a b"]
    for _ in range(8):
        base = [word() for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, 14)):
            t = base.copy()
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t + (passage if rng.random() < 0.3 else [])))
    texts += texts[5:9]
    sets = [set(map(tuple, ([w[i : i + 5] for i in range(max(1, len(w) - 4))] if (w := (t or "").lower().split()) else []))) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(odd(spark, texts)).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}


def test_mix(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "w " * rng.randint(0, 300), rng.choice(["a", "b", "c", "c", "c", None])) for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and len(rows) == 600
    total = rows["size"].sum()
    by = rows.assign(s=rows.source_size).groupby("s").agg(target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * total) < 1 and ((by.taken - by.target).abs() < 0.03 * by.target + 64).all() and (by.target <= 2 * by.index + 1e-6).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
        narrow, wide = (sorted((r["id"], r["p"]) for r in mixing.permuted(df, "id", "n", "p", "n", wide=w).collect()) for w in (False, True))
        assert sorted(p for _, p in narrow) == list(range(n)) and narrow == wide
    far = spark.range(2000).selectExpr("id * 9999991 as id", "20000000000 as n")
    got = [r["p"] for r in mixing.permuted(far, "id", "n", "p", "n", wide=True).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) and max(got) < 20_000_000_000


def test_extraction():
    chain = html_extract.trained()
    page = '<html><head><title>T</title><script>x("<p>no</p>")</script></head><body><nav><a href=/>Home</a></nav><div class="cookie">We use cookies.</div><article><h1>A title here</h1><p>First  text &amp; more,\n with <b>bold</b> words in it.</p><div class="ad">Buy this now</div><p>Second paragraph of the text.</p></article><section class="comments"><p>I like it.</p></section><form><p>Sign up</p></form><footer>&copy; Us</footer></body></html>'
    assert html_extract.main_text(page, chain) == "A title here First text & more, with bold words in it. Second paragraph of the text."
    for page in (None, "", "<", "<p", "&am", "</p></div>", "<!-- x", "<script>", "<p>" * 3000):
        html_extract.main_text(page, chain)
    rng, wrong, total = random.Random(77), 0, 0
    for _ in range(100):
        page, main = html_extract.training_page(rng)
        bs = html_extract.blocks(page)
        y = html_extract.labels_of(bs, main)
        wrong += sum(a != b for a, b in zip(y, chain.decode(html_extract.block_features(bs))))
        total += len(bs)
    assert wrong < 0.02 * total


def test_url_parts(spark):
    df = spark.createDataFrame([("HTTPS://A.Ex.NET:80/B?c#d",), ("x",), (None,), ("a://É.b#c",), ("a://b://c/d\ne?f",)], "u string").select(*url_filter.parts("u"))
    assert [tuple(r) for r in df.collect()] == [("a.ex.net:80", "/B"), ("", ""), ("", ""), ("É.b", ""), ("b:", "//c/d\ne")]


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)  # everything collides
    (tmp_path / "r").write_bytes(url_filter.packed([(f"h{i}.net", "/" * (1 + i % 2), "block") for i in range(50)]))
    r = url_filter.Rules(str(tmp_path / "r"))
    found = r.find([f"h{i}.net{'/' * (1 + i % 2)}".encode() for i in range(60)])
    assert all((found[i] >= 0) == (i < 50) for i in range(60)) and r.string(found[8]) == b"h8.net/" and r.lengths == [1, 2]


def test_tokens_round_trip(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    rng, words = random.Random(5), token_files.Words(token_files.default_tokenizer())
    for _ in range(3000):
        x = "".join(rng.choice([" ", " ", "\n", "\t", "a", "Bc", "é", "1", ".", ",", "'s", "’", "漢", "²", "<|endoftext|>", "\x85", "\xa0", "\u3000", "_"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(words.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids
    at = 0
    for r in sorted(QUERIES["op7_token_files"](spark, folder).collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*t.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_tokens_of_slices(monkeypatch):
    """New pieces go to the library together, not one by one; what is kept, dropped or split changes no id."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, rng, calls = Tokenizer.from_file(token_files.default_tokenizer()), random.Random(6), []
    monkeypatch.setattr(token_files.Words, "whole", lambda self, x, whole=token_files.Words.whole: calls.append(x) or whole(self, x))
    words = token_files.Words(token_files.default_tokenizer())
    text = "x " + " ".join("".join(rng.choices("abcdeéß", k=9)) + rng.choice(["", ",", ".\nThe", "###", "7"]) for _ in range(3000))
    assert np.frombuffer(words.encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids and len(calls) < 50
    letters = [chr(c) for c in range(0x20000) if chr(c).isalpha() or chr(c).isspace()]
    odd = ["", None, " ", "\n", "\0", "a\0 b", " a  b", "a,\n", "a.\n\nb", "a\nb\nc\n", "a.\u180e b", "x" * 100, f"{'y' * 100}, z", "<|endoftext|>a b", *(f"a{c},\n{c}b {c}. c" for c in letters)]
    want = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in odd]
    monkeypatch.setattr(token_files, "CACHE_BYTES", 20_000)
    words = token_files.Words(token_files.default_tokenizer())
    for step in (1000, len(odd)):
        got = [x for k in range(0, len(odd), step) for x in words.encode_all(pa.array(odd[k : k + step]), b"\2\0").to_pylist()]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 600_000])
def test_coder(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000)
    freq = token_files.scaled(np.bincount(ids, minlength=50_001) if n else np.ones(5, int))
    cum = np.cumsum(freq) - freq
    payload = token_files.encode_block(ids, freq, cum)
    assert (token_files.decode_block(payload, freq, cum) == ids).all()
    step = token_files.CHECKPOINT * token_files.LANES
    parts = [token_files.decode_block(payload, freq, cum, k, k + 1) for k in range(-(-n // step))]
    assert n == 0 or (np.concatenate(parts) == ids).all()


def test_neighbours(spark, folder):
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["op8_nearest"](spark, folder).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 4, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 4, 0.5)]


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 16))
    v[1000:2000] = v[7]  # a third of the rows is one vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = 0
    queries = range(0, 3000, 20)
    for q in queries:
        s = (v * v[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20].tolist()
        hit += len(set(want) & {i for _, i in got[q]})
    assert hit >= 0.9 * 20 * len(queries)


def test_graph_walk_finds_near_centroids():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(3000, 8))
    g, q = ann.Graph(c), rng.normal(size=(50, 8))
    near, d = g.nearest(q, 10)
    want = np.argsort(((q[:, None] - c) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, want)]) > 0.9 and (np.diff(d, axis=1) >= 0).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    model = (["de", "en"], np.random.default_rng(0).normal(size=(language.BUCKETS, 2)).astype(np.float32))
    rows = {r["doc_id"]: r["lang_pred"] for r in language.detect(odd(spark), model).collect()}
    assert rows[0] == rows[1] == rows[11] == "und" and rows[4] in ("de", "en")


def test_pipeline(spark, folder, nothing):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "source_mixing", "token_files"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    kept = {r["doc_id"] for r in jaccard.stage(spark, docs, folder).collect()}
    assert kept == set(range(12)) - {9}
    assert {r["doc_id"] for r in decontaminate.stage(spark, docs, folder).collect()} == set(range(12)) - {5}
    assert corpus_pipeline.run(spark, nothing).count() == 0
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_mixing_stage_takes_what_the_mix_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = {}
    for r in mixing.stage(spark, docs, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert got == {i: t for i, t in want.items() if t}
