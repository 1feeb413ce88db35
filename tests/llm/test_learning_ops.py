"""Importance resampling, sharded centroids and the quality classifier against plain Python on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import centroids, nbsvm, resampling

LOWER = {i: i + 32 for i in range(65, 91)}
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = ["The same line here\nand one a b c", "é ß one", None, "", "one one\none"]


def grams(text, max_n):
    words = TOKEN.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, max_n, buckets, min_words, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text, max_n)[1]))
    for text in target:
        t.update(map(bucket, grams(text, max_n)[1]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in s}
    out = []
    for i, text in rows:
        n, found = grams(text, max_n)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    best = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(best) * percent // 100
    ranks = Counter()
    for k, r in enumerate(best[:drawn], 1):
        ranks[r, k] += 1
    taken = Counter(r for r in best[:drawn])
    left = Counter(out) - taken
    return sorted([(*r, k) for r, k in ranks] + [(*r, None) for r in left.elements()], key=str)


@pytest.mark.parametrize("max_n,buckets,min_words,percent", [(1, 10_000, 20, 10), (3, 997, 5, 60), (2, 50, 0, 100)])
def test_resampling(spark, odd, odd_rows, max_n, buckets, min_words, percent):
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TARGET)], "item_id long, text string, weight string")
    got = resampling.resample(odd.withColumn("weight", F.lit("clash")).withColumn("row", F.lit(1)), target, max_n, buckets, "2024", min_words, percent)
    want = brute_resample([r[:2] for r in odd_rows], TARGET, max_n, buckets, min_words, percent)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str) == want


def test_a_line_is_read_once(spark):
    texts = spark.createDataFrame([("a b\n\nc",), ("a b",), ("c\na b\nc",), (None,)], "text string")
    rows = resampling.distinct_lines(texts, 1, 100).select("occurrences", "n_words").collect()
    assert sorted(map(tuple, rows)) == [(3, 1), (3, 2)]


def test_features_over_line_breaks(spark):
    rows = spark.createDataFrame([(1, "a b\n!\nc\nd e"), (2, "x"), (3, None)], "row long, text string")
    cells = {r["row"]: np.frombuffer(r["buckets"], "<u4").tolist() for r in resampling.crossing_features(rows, 3, 1 << 16).collect()}
    want = ["b c", "c d", "a b c", "b c d", "c d e"]
    assert sorted(cells[1]) == sorted(zlib.crc32(g.encode()) % (1 << 16) for g in want) and not cells[2] and not cells[3]


def test_resampling_of_nothing(spark, odd, nothing):
    target = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert resampling.resample(nothing, target).collect() == []
    assert resampling.resample(odd, target.limit(0)).count() == odd.count()


def test_ranks_with_many_equal_scores(spark):
    scored = spark.range(0, 5000, 1, 7).select(F.col("id").alias("row"), (F.col("id") % 10).alias("doc_id"), F.lit(5).cast("long").alias("score"), (F.col("id") >= 1000).alias("eligible"))
    got = resampling.ranked(scored, 3210).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3211)) and all(r["eligible"] for r in got)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(r["doc_id"] for r in got)


def brute_clusters(rows, k, rounds, dims, scale):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(scale * float(np.float32(v))))) for v in x]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [[] for _ in cs]
        for _, x in kept:
            own[near(x)[1]].append(x)
        cs = [[sum(col) // len(xs) for col in zip(*xs)] if xs else c for xs, c in zip(own, cs)]
    found = [(i, near(x)[1], near(x)[0]) for i, x in kept]
    per = Counter()
    for _, c, d in found:
        per[c] += d
    return sorted(found, key=str), cs, per


def vectors(dims):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=dims).round(2).tolist()) for i in range(150)]
    rows += [rows[0]] * 60 + [(900 + i, rows[1][1]) for i in range(30)]
    rows += [(7, None), (8, []), (9, [1.0] * (dims - 1)), (10, [1.0] * (dims - 1) + [None]), (11, [float("nan")] * dims), (12, [float("inf")] + [0.0] * (dims - 1)),
             (None, [0.5] * dims), (None, [0.25] * dims), (13, [0.0] * dims), (3, [9.0] * dims)]
    return rows


@pytest.mark.parametrize("dims,k,blocks,chunk", [(6, 8, 3, 2048), (5, 300, 2, 16), (4, 1, 4, 2048), (6, 5, 1, 7)])
def test_clusters(spark, dims, k, blocks, chunk):
    rows = vectors(dims)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, cluster int, distance string").repartition(3)
    got, final = centroids.cluster(df, "vec_id", "embedding", k, 4, dims, 256, blocks, chunk_rows=chunk)
    want, cs, per = brute_clusters(rows, k, 4, dims, 256)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r["cluster"]: (r["centroid"], int(r["total"])) for r in final.collect()} == {c: (x, per[c]) for c, x in enumerate(cs)}


def test_clusters_of_huge_and_of_no_vectors(spark):
    ddl = "vec_id long, embedding array<float>"
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [2e6, 1e6]), (4, [0.0, 0.0])]
    got, _ = centroids.cluster(spark.createDataFrame(rows, ddl), "vec_id", "embedding", 2, 2, 2)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 2, 2, 2, 256)[0]
    for empty in ([], [(1, None)]):
        got, final = centroids.cluster(spark.createDataFrame(empty, ddl), "vec_id", "embedding", 2, 2, 2)
        assert got.count() == 0 and final.count() == 0


def brute_indicators(text, max_n, features):
    words = nbsvm._WORD.findall(text or "")
    forms = ["=" if i and words[i] == words[i - 1] else nbsvm.form(w) for i, w in enumerate(words)]
    return {("w", w) for w in words} | {(n, *forms[i:i + n]) for n in range(1, max_n + 1) for i in range(len(forms) - n + 1)}


def test_indicators_tell_ngrams_apart():
    memo, wide = nbsvm._Words(), 1 << 26
    for text in ["one two One two two two!", "a1 a1 B2## x###### ...", "", None, "word", "é ü É", "x " * 500]:
        want = brute_indicators(text, 3, wide)
        assert len(nbsvm.indicators(text, memo, 3, wide)) == len(want)
    assert set(nbsvm.indicators("b a", memo)) != set(nbsvm.indicators("B a", memo))


def test_form():
    assert [nbsvm.form(w) for w in ("Abc", "don't", "x9--", "#####", "ÉÈé", "AB12.5%")] == ["Aa", "a'a", "a0--", "###", "a", "A0.0%"]


def test_descent_reaches_the_optimum():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(60, 4))
    y = np.where(x[:, 0] + 0.3 * rnd.normal(size=60) > 0, 1.0, -1.0)
    cost = np.full(60, 0.7)
    w = nbsvm.descend([np.arange(4)] * 60, list(x), y, cost, 4, epochs=500)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))).sum()
    at = loss(w)
    assert all(loss(w + d) >= at - 1e-3 for d in 0.05 * rnd.normal(size=(300, 5)))


def test_scores_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = nbsvm.op13_nbsvm_quality(spark, folder).join(labels, "doc_id").where("held_out and quality is not null")
    rows = got.select("quality", "predicted", "score").collect()
    right = sum(r["quality"] == r["predicted"] for r in rows)
    assert right >= 0.98 * len(rows) and all(0 <= r["score"] <= 1 for r in rows) and len(rows) > 500
    assert got.count() < docs.count()
    # What is scored does not depend on the held-out labels.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = nbsvm.train(docs, labels), nbsvm.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1:] == b[1:]


def test_classifier_on_odd_rows(spark, odd, nothing):
    ddl = "doc_id long, quality int, text string"
    labels = spark.createDataFrame([(i, q, "clash") for i, q in [(2, 1), (9, 0), (9, 1), (None, 1), (11, None), (12, 7), (20, 1), (28, 0), (29, 0), (30, 1), (5, 1), (999, 0)]], ddl)
    drawn = {(r[0], r[1]) for r in nbsvm.learning_rows(labels, "quality").collect()}
    assert drawn == {(i, q) for i, q in [(2, 1), (20, 1), (28, 0), (29, 0), (30, 1), (5, 1), (999, 0)] if zlib.crc32(str(i).encode()) % 5}
    model = nbsvm.train(odd.withColumn("label", F.lit("x")).withColumn("features", F.lit(1)), labels)
    rows = nbsvm.score(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (23, 24, 25)}) == 1  # texts without a word
    assert nbsvm.score(nothing, model).count() == 0
    none = nbsvm.score(odd, nbsvm.train(odd, labels.limit(0))).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    single = nbsvm.score(odd, nbsvm.train(odd, spark.createDataFrame([(2, 1, ""), (20, 1, "")], ddl))).select("score").distinct().collect()
    positives = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (2, 20))
    assert single[0][0] == pytest.approx((positives + 1) / (positives + 2))
