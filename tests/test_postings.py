"""Weighted postings against a plain count, and what moves and is written for them."""

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from packetloom.operators import postings as PO
from packetloom.operators import sparse as SP
from packetloom.plans.catalog import QUERIES
from packetloom.runtime import shared_dir

STOPS = set(SP.english_stop_words())
ODD = [
    (1, "Port scan, port SCAN; x y"), (1, "scan again"), (2, None), (3, ""), (4, "the of and"), (None, "null id port"), (None, "second scan"),
    (5, "Größe ÄRGER naïve città"), (6, "日本語 テスト 𝔘𝔫𝔦 𝔘 ２３ ½¼ été"), (7, "ends_with" ), (8, "begins with ends_with port"), (9, "word"), (10, "two  words\n\tport_443"),
]


def plain(rows):
    """{(scope, id): {term: (tf, df, weight)}}, rows (scope, id, text)."""
    n, counts = Counter(r[0] for r in rows), defaultdict(Counter)
    for scope, key, text in rows:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in STOPS]
        counts[scope, key].update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter((k[0], t) for k, c in counts.items() for t in c)
    out = {}
    for k, c in counts.items():
        raw = {t: (1 + math.log(f)) * (math.log((1 + n[k[0]]) / (1 + df[k[0], t])) + 1) for t, f in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out |= {k: {t: (c[t], df[k[0], t], round(x / norm, 9)) for t, x in raw.items()}} if c else {}
    return out


def read(df, scope=None):
    out = defaultdict(dict)
    for r in df.collect():
        assert r["term"] not in out[r[scope] if scope else 0, r["doc_id"]]
        out[r[scope] if scope else 0, r["doc_id"]][r["term"]] = (r["tf"], r["df"], round(r["weight"], 9))
    return dict(out)


@pytest.mark.parametrize("slot_rows", [1, 1_000_000])
def test_odd_rows(spark, slot_rows):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string").repartition(5)
    got = PO.Counted(docs, "doc_id", "text", SP.english_stop_words(), [], slot_rows).postings()
    assert read(got) == plain([(0, *r) for r in ODD])


@pytest.mark.parametrize("chars", [1, 300, 4_000_000])
@pytest.mark.parametrize("limit", [0, 200_000])
def test_bundles_of_any_size(spark, monkeypatch, chars, limit):
    """However documents are bundled, by scope and with repeated ids; a scope has its own frequencies, a row without one is left out."""
    monkeypatch.setattr(PO.bundles, "__defaults__", (1, chars))
    monkeypatch.setattr(PO, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(3)
    rows = [(f"s{rng.integers(3)}", f"d{rng.integers(150)}", " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(30)) if x < 50)) for _ in range(200)]
    docs = spark.createDataFrame([*rows, (None, "d1", "w1 w2")], "cap string, doc_id string, text string").repartition(3)
    got = PO.Counted(docs, "doc_id", "text", SP.english_stop_words(), ["cap"], 100).postings()
    assert read(got, "cap") == plain(rows)


def test_queries_see_their_terms_alone(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "port unheard"), (1, "port scan"), (2, "ärger"), (3, None)], "q bigint, text string")
    counted = PO.Counted(docs, "doc_id", "text", SP.english_stop_words(), [], queries=queries, query_id="q", query_text="text")
    wanted = {(r["q"], r["term"]): (r["tf"], r["df"]) for r in counted.asked().collect()}
    assert wanted == {(1, "port"): (2, 3), (1, "scan"): (1, 2), (1, "port scan"): (1, 1), (2, "ärger"): (1, 1)}
    terms = {t for _, t in wanted}
    assert read(counted.postings()) == {k: own for k, c in plain([(0, *r) for r in ODD]).items() if (own := {t: x for t, x in c.items() if t in terms})}


def test_wide_bundles():
    """Terms are told apart also where a number for word, word and document would not fit 64 bits."""
    line = np.array([1, 2, 3, 1, 2, 0, 3, 3, 3, 0], np.uint64)
    row = {"docs": pa.array([[{"k0": 7}, {"k0": 8}]])[0], "rows": pa.scalar(PO._packed(np.array([1, 1]))), "sizes": pa.scalar(PO._packed(np.array([6, 4]))),
           "codes": pa.scalar(zlib.compress(PO._packed(line))), "tokens": pa.scalar(10)}
    few, many = (PO.Bundle(row | {"words": pa.scalar(("aa\nbb\ncc" + extra).encode())}, 0) for extra in ("", "\nzz" * 2_500_000))
    for bundle in (few, many):
        assert [(bundle.doc[i], bundle.first[e], bundle.second[e], bundle.tf[i]) for i, e in enumerate(bundle.entry)] == [
            (0, 1, 0, 2), (0, 1, 2, 2), (0, 2, 0, 2), (0, 2, 3, 1), (0, 3, 0, 1), (1, 3, 0, 3), (0, 3, 1, 1), (1, 3, 3, 2)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    counted = PO.Counted(none, "doc_id", "text", [], [], queries=none, query_id="doc_id", query_text="text")
    assert counted.postings().count() == counted.asked().count() == 0
    asked = none.withColumnRenamed("doc_id", "q")
    some = spark.createDataFrame([(1, "port")], "q bigint, text string")
    for docs, queries in ((none, asked), (none, some), (some.withColumnRenamed("q", "doc_id"), asked)):
        best, reads = SP.search(docs, queries, "doc_id", "text", "q", "text")
        assert best.count() == reads.count() == 0


@pytest.mark.parametrize("cells, block_terms, chars", [(1, 1, 1), (7, 10, 200), (2_000_000, 200_000, 4_000_000)])
def test_search_in_blocks_and_bundles(spark, monkeypatch, cells, block_terms, chars):
    """The best rows do not depend on how queries and documents are cut; many copies tie, a null id stands last."""
    monkeypatch.setattr(PO, "CELLS", cells)
    monkeypatch.setattr(PO.Counted.best, "__defaults__", (block_terms,))
    monkeypatch.setattr(PO.bundles, "__defaults__", (1, chars))
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, 6)) for _ in range(12)]
    docs = [(f"d{i:03}" if i else None, texts[i % 12] if i % 3 else "w1 w2 w3") for i in range(60)]
    asked = [("a", "w1 w2"), ("b", "w3 w4 w5 w5"), ("c", "w11"), ("d", "unheard"), (None, "w7 w8")]
    best, _ = SP.search(spark.createDataFrame(docs, "doc_id string, text string").repartition(4),
                        spark.createDataFrame(asked, "q string, text string"), "doc_id", "text", "q", "text")
    got = {}
    for r in best.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["doc_id"], r["score"]))
    weights, want = {d: c for (_, d), c in plain([(0, *d) for d in docs]).items()}, {}
    n, df = len(docs), {t: f for c in weights.values() for t, (_, f, _) in c.items()}
    for q, text in asked:
        words = text.split()
        tf = Counter(t for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])] if t in df)
        raw = {t: (1 + math.log(f)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, f in tf.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        scores = [(d, round(sum(x / norm * c[t][2] for t, x in raw.items() if t in c), 6)) for d, c in weights.items()]
        top = sorted((s for s in scores if s[1] > 0), key=lambda s: (-s[1], s[0] is None, s[0]))[:6]
        want |= {q: top} if top else {}
    assert {q: [d for d, _ in x] for q, x in got.items()} == {q: [d for d, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q]))


def test_few_rows_per_query_leave_a_bundle(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one text for all").alias("text")).coalesce(1)
    queries = spark.createDataFrame([(i, "text for one") for i in range(50)], "q bigint, text string")
    counted = PO.Counted(docs, "doc_id", "text", [], [], queries=queries, query_id="q", query_text="text")
    vectors = SP.query_vectors(queries, counted.asked(), "q", "text", [])
    found = counted.best(vectors, 6, 6)
    assert found.count() == 300 * counted.made.count() and {r[0] for r in found.select("score").distinct().collect()} != {0.0}


@pytest.mark.parametrize("search", [False, True])
def test_postings_are_neither_written_nor_moved(spark, search):
    """What is written for an index or a search is less than the texts, and no posting is exchanged by its term."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), (F.xxhash64("doc_id", i) % 4000).cast("string"))))
    docs = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", text)
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    seen = set(Path(shared_dir(spark).removeprefix("file:")).glob("packetloom-*"))
    if search:
        queries = spark.createDataFrame([(1, "w17 w18")], "q bigint, text string")
        out = SP.search(docs, queries, "doc_id", "text", "q", "text")[0]
    else:
        out = SP.build_index(docs, "doc_id", "text", keep_tf=True)[0].groupBy("doc_id").agg(F.sum("weight"))
    plan = out._jdf.queryExecution().toString()
    assert out.count() > 0 and "Exchange hashpartitioning(term" not in plan and "_salt" not in plan
    made = set(Path(shared_dir(spark).removeprefix("file:")).glob("packetloom-*")) - seen
    assert 0 < sum(f.stat().st_size for p in made for f in p.rglob("*.parquet")) < 0.8 * size


def test_the_choice_moves_no_posting(spark):
    out = QUERIES["retrieval_choice"](spark, SMOKE_DIR)
    plan = out._jdf.queryExecution().toString()
    assert out.count() > 0 and "_salt" not in plan and "Exchange hashpartitioning(term" not in plan
