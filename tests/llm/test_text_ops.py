"""Near copies, repeated passages and quality rules against brute force on odd rows."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import quality, runs, shared_windows, simhash, substrings
from packetloom.llm.links import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, k=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= k:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(odd, odd_rows):
    prints = [brute_fingerprint(r[1]) for r in odd_rows]
    roots = brute_components(prints)
    smallest = {}
    for row, root in zip(odd_rows, roots):
        if row[0] is not None:
            smallest[root] = min(row[0], smallest.get(root, row[0]))
    want = sorted(((r[0] or -1), f"{p:016x}", smallest.get(root)) for r, p, root in zip(odd_rows, prints, roots))
    got = simhash.near_duplicates(odd).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(((a or -1), b, c) for a, b, c in got) == want


def test_one_of_each(odd, odd_rows):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len(ids) == len(set(ids)) and {20, 23, 5, 30} <= set(ids) and not {21, 24, 25, 40} & set(ids)


def test_one_of_each_without_ids_and_under_one_id(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "green", "blue", "grey", "pink")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (3, texts[4]), (None, texts[4].upper()),
            (9, texts[2].upper()), (None, None), (None, "")]
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    assert len(set(roots)) == 6
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        kept = simhash.one_of_each(df).collect()
        want = {(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[4])}
        assert len(kept) == 6 and want < {tuple(r) for r in kept}
    with pytest.raises(ValueError):
        simhash.one_of_each(df, k=4)


@pytest.mark.parametrize("hot", [4096, 12])
def test_links_of_hot_keys(spark, hot):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = {int(c) for c in centres}
    while len(prints) < 150:
        x = int(centres[rng.integers(3)])
        for bit in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(bit)
        prints.add(x)
    signed = sorted(x - ((x >> 63) << 64) for x in prints)
    roots = brute_components([x % (1 << 64) for x in signed])
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(df, 3, hot)).collect()}
    assert [found.get(x, x) for x in signed] == [signed[r] for r in roots]


def brute_windows(rows, cut, width=50):
    """Per row the flags of removed units: windows that also start in a row of a smaller id (null ids are last)."""
    big = 1 << 63
    first = {}
    units = [cut(r[1] or "") for r in rows]
    ids = [big if r[0] is None else r[0] for r in rows]
    for i, u in zip(ids, units):
        for p in range(len(u) - width + 1):
            key = tuple(u[p:p + width])
            first[key] = min(i, first.get(key, i))
    flags = []
    for i, u in zip(ids, units):
        gone = [False] * len(u)
        last = -1
        for p in range(len(u) - width + 1):
            if first[tuple(u[p:p + width])] < i:
                for q in range(max(p, last + 1), p + width):
                    gone[q] = True
                last = p + width - 1
        flags.append((u, gone))
    return flags


@pytest.fixture(scope="module")
def short_rows(odd_rows):
    return [r for r in odd_rows if len(r[1] or "") < 20_000]


def test_relative_lz(spark, odd, odd_rows):
    want = {}
    for row, (u, gone) in zip(odd_rows, brute_windows(odd_rows, WORD.findall)):
        if any(gone):
            want[(row[0], hashlib.sha256(" ".join(u).encode()).hexdigest())] = (len(u), sum(gone), " ".join(w for w, g in zip(u, gone) if not g))
    got = {(None if r["doc_id"] == shared_windows.NO_ID else r["doc_id"], r["whole"]): r for r in substrings.factored(odd).collect()}
    assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in got.items()} == want
    for r in got.values():
        assert all(f["length"] >= 50 and f["source"] < r["doc_id"] for f in r["factors"])
    out = substrings.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(k[0], v[2]) for k, v in want.items()} <= texts and (24, None) in texts and (30, dict((r[0], r[1]) for r in odd_rows)[30]) in texts


def test_run_length_index(spark, short_rows):
    df = spark.createDataFrame([(r[0], r[1]) for r in short_rows], "doc_id long, text string").repartition(3)
    want = {}
    for row, (u, gone) in zip(short_rows, brute_windows(short_rows, lambda t: t.encode())):
        if any(gone):
            spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            want[(row[0], hashlib.sha256(u).hexdigest())] = (len(u), sum(gone), spans, bytes(b for b, g in zip(u, gone) if not g))
    got = {(None if r["doc_id"] == shared_windows.NO_ID else r["doc_id"], r["whole"]): (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in runs.long_matches(df).collect()}
    assert got == want


def test_rows_without_ids_are_kept_apart(spark):
    passage, tail = " ".join(f"word{i}" for i in range(60)), "".join(f" other{j}" for j in range(90))
    low = xxhash.xxh64_intdigest(f"cut {passage}".encode(), 42) & 0xFFFF
    clean = next(t for t in (f"{i}{tail}" for i in range(2_000_000)) if xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFF == low)
    rows = [(4, passage), (None, f"cut {passage}"), (None, clean), (None, f"also {passage}"), (8, f"x {passage}"), (8, f"y {passage}"), (8, f"x {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["whole"]: r["n_removed"] for r in runs.long_matches(df).collect()}
    flags = brute_windows(rows, lambda t: t.encode())
    assert got == {hashlib.sha256(u).hexdigest(): sum(gone) for u, gone in flags if any(gone)} and len(got) == 4
    own = shared_windows.shared_anchors(substrings.keyed(df), shared_windows.Words).collect()
    assert len(own) == 5 and max(len(r["anchors"]) for r in own) < 60


def test_document_minus_one(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(-1, f"a {passage}"), (3, f"b {passage}"), (None, f"c {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.factored(df).collect()} == {3: 60, shared_windows.NO_ID: 60}
    assert {r["doc_id"]: r["n_removed"] for r in runs.long_matches(df).collect()} == {3: len(passage) + 1, shared_windows.NO_ID: len(passage) + 1}


def test_index_runs_and_samples():
    strings = [b"x" * 60, b"x" * 55 + b"y" * 10, b"q" + b"x" * 52]
    found = runs.RunLengthIndex(strings, np.array([7, 3, 5])).first_documents()
    assert [f.tolist() for f in found] == [[3] * 11, [3] * 16, [5] + [3] * 3]


def test_ranges_of_smallest_hashes_are_equally_full():
    rng = np.random.default_rng(0)
    for grams in (27, 35, 43):
        least = np.sort((rng.integers(0, 1 << 48, (grams, 20_000))).min(axis=0).astype(np.uint64))
        at = shared_windows.ranges(least, grams, 50)
        assert (np.diff(at) >= 0).all() and at.min() == 0 and at.max() == 49
        assert 250 < np.bincount(at, minlength=50).min() and np.bincount(at, minlength=50).max() < 550
    assert shared_windows.ranges(np.array([0, (1 << 48) - 1], np.uint64), 27, 50).tolist() == [0, 49]


def test_texts_are_dealt_once_and_spans_come_one_list_a_row(spark, short_rows):
    df = spark.createDataFrame([(r[0], r[1]) for r in short_rows], "doc_id long, text string").repartition(3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.long_matches(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "ReusedExchange" in plan
    strings, passage = [b"x" * 55 + b"y" * 60, b"q" + b"x" * 55], np.array([0, 0, 1])
    batch = runs.long_spans(runs.RunLengthIndex(strings, np.array([3, 5])), passage, np.array([3, 9, 5]), np.array([1, 2, 4]), np.array([7, 100, 0]))
    # Row 2 has all of the first string again, row 4 its windows of x alone; row 1 is the first with all it has.
    assert batch.to_pylist() == [{"doc_id": 5, "row_key": 4, "spans": [1 << 32 | 56]}, {"doc_id": 9, "row_key": 2, "spans": [100 << 32 | 215]}]


def test_empty_tables(nothing):
    assert simhash.near_duplicates(nothing).count() == substrings.factored(nothing).count() == runs.long_matches(nothing).count() == 0
    assert substrings.without_repeats(nothing).columns == nothing.columns
    assert quality.passing(nothing).count() == simhash.one_of_each(nothing).count() == 0


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(q for p in places for q in range(p, p + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures(odd, odd_rows):
    m = odd.select("doc_id", "text", quality.measures(F.col("text")).alias("m")).select("doc_id", "text", "m.*").collect()
    for r in m:
        assert tuple(r)[2:] == brute_quality(r["text"]), r["doc_id"]
    assert len(m) == len(odd_rows)


def test_cascade_order_does_not_matter(odd):
    rules = quality.BASE_RULES + quality.METHOD_RULES
    estimates = quality.estimate(odd, rules, 30)
    assert [e.name for e in estimates] == [r.name for r in rules] and all(0 <= e.rejected <= 1 and e.seconds > 0 for e in estimates)
    ordered = quality.in_order(rules, [quality.Estimate(r.name, 1.0, i / 10) for i, r in enumerate(rules)])
    assert ordered == rules[::-1]
    a, b = (sorted(map(str, odd.where(quality.cascade(F.col("text"), x)).collect())) for x in (rules, ordered))
    assert a == b
    kept = {r["doc_id"] for r in quality.passing(odd).collect()}
    assert {2, 5, 30, 60, 80} <= kept and not kept & {23, 24, 25, 26, 28, 32, 33, 34}
    assert quality.passing(odd).columns == odd.columns
