"""Token files, packing, mixing, search, pages and chats on odd rows."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from packetloom.llm import chat, extraction, mixing, packing, rans, search, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_table_equals_library(plain, odd_rows):
    encode = tokens.encoder(tokens.tokenizer_path())
    odd_texts = ["Don't it's I'LL 've''s", "<|endoftext|>a<|startoftext|>", "a\x1cb\x85c\xa0d", "ΣΑΣ É İ ŉ ẞ Ǆ ä", "12,5 ٣ 你好", "(x)--y!! a|b <c> “q”", "\x00_a_"]
    for text in [r[1] for r in odd_rows if len(r[1] or "") < 20000] + odd_texts:
        assert [*encode(text).tolist(), 1] == plain(text)


@pytest.mark.parametrize("n", [0, 1, 31, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK - 7])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint16)
    frequencies = rans.Frequencies.of(np.bincount(ids, minlength=rans.VOCABULARY))
    assert int(frequencies.freq.sum()) == 1 << rans.SCALE_BITS
    blocks = rans.encode(ids, frequencies)
    assert np.array_equal(rans.decode(blocks, frequencies), ids)
    if n > 1000:
        assert sum(map(len, blocks)) < 2 * n
        at = len(blocks[0]) // 2
        damaged = [blocks[0][:at] + bytes([blocks[0][at] ^ 1]) + blocks[0][at + 1:], *blocks[1:]]
        with pytest.raises(ValueError):
            rans.decode(damaged, frequencies)


def by_doc(rows, plain):
    return sorted(((-1 if r[0] is None else r[0]), plain(r[1])) for r in rows)


@pytest.mark.parametrize("chars", [1, 300, 10**7])
def test_batches_of_texts_have_the_library_s_ids(odd_rows, plain, chars):
    texts = [r[1] for r in odd_rows] + ["a\x1cb", "<|x|> b", "\u0130stanbul", "ab  c\n", "   ", "don\u2019t stop", "x\u00a0y", "tab\tand\x0bvt"] * 2
    got = list(tokens.batch_encoder(tokens.tokenizer_path(), 50, chars)(texts))
    assert [g.tolist() for g in got] == [plain(t)[:-1] for t in texts]


def test_token_file(spark, odd, odd_rows, nothing, plain):
    got = rans.read_token_file(spark, rans.write_token_file(odd)).collect()
    got.sort(key=lambda r: r["start"])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(-1 if r[0] is None else r[0] for r in odd_rows)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == by_doc(odd_rows, plain)
    place = 0
    for r in got:
        assert r["start"] == place and len(r["ids"]) == 4 * r["n_tokens"]
        place += r["n_tokens"]
    assert rans.read_token_file(spark, rans.write_token_file(nothing)).count() == 0


def test_token_file_is_read_by_another_session(spark, odd, odd_rows, plain, tmp_path):
    """Nothing but the path goes over: a new Python process with a session of its own decodes the file."""
    file = rans.write_token_file(odd, str(tmp_path / "file"))
    script = """
import sys
from packetloom.llm import rans
from packetloom.session import build_session
spark = build_session("reader", "local[2]", spark__ui__enabled="false", spark__sql__warehouse__dir=sys.argv[2])
spark.sparkContext.setLogLevel("OFF")
for r in rans.read_token_file(spark, sys.argv[1]).collect():
    print("row", r["doc_id"], r["n_tokens"], r["ids"].hex())
"""
    done = subprocess.run([sys.executable, "-c", script, file, str(tmp_path / "warehouse")], capture_output=True, text=True, check=True, timeout=300,
                          env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])})
    got = [x.split() for x in done.stdout.splitlines() if x.startswith("row ")]
    assert sorted(((-1 if x[1] == "None" else int(x[1])), np.frombuffer(bytes.fromhex(x[3]), "<u4").tolist()) for x in got) == by_doc(odd_rows, plain)


def test_damaged_frequency_table_is_noticed():
    kept = rans.Frequencies.of(np.arange(rans.VOCABULARY))
    format_, scaled, crc = kept.row()
    assert np.array_equal(rans.Frequencies.from_row(format_, bytes(scaled), crc).freq, kept.freq)
    scaled[5] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.Frequencies.from_row(format_, bytes(scaled), crc)
    with pytest.raises(ValueError, match="format"):
        rans.Frequencies.from_row([2, *format_[1:]], bytes(scaled), crc)


def check_packing(pieces, want):
    by_sequence, by_row = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    for own in by_sequence.values():
        place = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == place and p["length"] > 0
            place += p["length"]
        assert place <= packing.CAPACITY
    tokens_of = Counter()
    for p in pieces:
        by_row[(p["doc_id"], p["start"], p["length"])].append(p)
        tokens_of[p["doc_id"]] += p["length"]
    expected = Counter()
    for doc_id, n in want:
        expected[doc_id] += n
    assert tokens_of == expected


def test_packing(odd, odd_rows, nothing, plain):
    pieces = packing.pack(odd).collect()
    check_packing(pieces, [(r[0], len(plain(r[1]))) for r in odd_rows])
    ids = {r[0]: plain(r[1]) for r in odd_rows}
    for p in pieces:
        if p["doc_id"] is not None:
            assert np.frombuffer(p["ids"], "<u4").tolist() == ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
            assert p["doc_tokens"] == len(ids[p["doc_id"]])
    assert packing.pack(nothing).count() == 0


def test_differencing_levels_the_windows():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 2047) for _ in range(300)]
    k = -(-sum(sizes) // 2048)
    slots = packing.difference(sizes, k)
    assert sorted(i for s in slots for i in s) == list(range(300)) and len(slots) == k
    sums = [sum(sizes[i] for i in s) for s in slots]
    assert max(sums) - min(sums) < 2048
    windows = packing.fill(sizes)
    assert len(windows) == k and all(sum(b - a for _, a, b in w) <= 2048 for w in windows)
    assert sum(len(w) for w in windows) <= 300 + 2 * k
    seen = defaultdict(list)
    for w in windows:
        for i, a, b in w:
            seen[i] += range(a, b)
    assert all(sorted(seen[i]) == list(range(s)) for i, s in enumerate(sizes))
    assert sorted(packing.difference([8, 7, 6, 5, 4], 2)) == sorted(packing.difference([8, 7, 6, 5, 4], 2))
    best = min(abs(30 - 2 * sum(c)) for n in range(6) for c in combinations([8, 7, 6, 5, 4], n))
    two = [sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.difference([8, 7, 6, 5, 4], 2)]
    assert abs(two[0] - two[1]) <= best + 2


def test_mixing(odd, odd_rows, nothing):
    sizes, cuts = mixing.plan_mix(odd)
    plan = {r["source"]: r for r in cuts.collect()}
    total, per = 0, Counter()
    for r in odd_rows:
        n = len(WORD.findall(r[1] or ""))
        per[r[3]] += n
        total += n
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, level = set(), 0.0
    while True:
        level = (1.5 * total - sum(2 * per[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 2 * per[s]}
        if not over:
            break
        full |= over
    for s in order:
        want = 2 * per[s] if s in full else level * weight[s]
        assert plan[s]["source_size"] == per[s] and math.isclose(plan[s]["target"], want, rel_tol=1e-12)
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns
    rows = mixed.collect()
    assert max(Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] not in (None, 5)).values()) <= 2
    largest = {s: max([len(WORD.findall(r[1] or "")) for r in odd_rows if r[3] == s]) for s in order}
    for s in order:
        taken = sum(len(WORD.findall(r["text"] or "")) for r in rows if r["source"] == s)
        assert abs(taken - plan[s]["target"]) <= 3 * largest[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_rows(odd.repartition(5)).collect()))
    assert mixing.mixed_rows(nothing).count() == 0


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_mixing_draws_every_row_by_itself(spark, ids):
    """Two sources of which one is a thousand rows alike, with no id, with one, or with ids that several texts share."""
    text = {"null": lambda i: "a b c", "one": lambda i: "a b c", "few": lambda i: f"a b w{i % 300}"}[ids]
    rows = [({"null": None, "one": 7, "few": i % 5}[ids], text(i), s, i) for s in ("x", "y") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _n long").repartition(7)
    sizes, cuts = mixing.plan_mix(df)
    plan = {r["source"]: r for r in cuts.collect()}
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    got = mixed.groupBy("source").count().collect()
    for r in got:
        assert abs(3 * r["count"] - plan[r["source"]]["target"]) <= 3
    assert {r["source"] for r in got} == {"x", "y"}
    assert mixed.groupBy("source", "_n").count().agg(F.max("count")).first()[0] <= 2  # rows that only differ elsewhere stay apart
    draws = lambda frame: sorted(map(tuple, mixing.plan_mix(frame)[0].select("source", "rank").collect()))
    assert draws(df) == draws(df.repartition(3)) and sizes.select("source", "rank").distinct().count() == 2000


def test_large_documents_have_better_odds(spark):
    rows = [(i, "w " * (20 if i % 2 else 2), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, cuts = mixing.plan_mix(df, share=0.5)
    cut = cuts.first()["cut"]
    taken = {r["size"]: r["n"] for r in sizes.where(F.col("rank") <= cut).groupBy("size").agg(F.count("*").alias("n")).collect()}
    words = sum(n * size for size, n in taken.items())
    assert taken[20] > 1.3 * taken[2] and abs(words - 11_000) <= 20  # half of 22,000


def test_search(spark, odd, odd_rows, nothing):
    docs = odd.select("doc_id", "text")
    queries = docs.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text")
    got = search.top_k(docs, queries, k=4, query_block=2).collect()
    lower = {i: i + 32 for i in range(65, 91)}
    bags = [(r[0], Counter(WORD.findall((r[1] or "").translate(lower)))) for r in odd_rows]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(t for _, b in bags for t in b)
    want = []
    for q in [r for r in odd_rows if r[0] is not None and r[0] % 20 == 0]:
        terms = set(WORD.findall((q[1] or "").translate(lower)))
        scored = []
        for i, b in bags:
            length = sum(b.values())
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in terms if t in b)
            if s:
                scored.append((-round(s, 6), -1 if i is None else i))
        want += [(q[0], d, -s) for s, d in sorted(scored)[:4]]
    got = [(r["query_id"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(x[2], y[2], abs_tol=2e-6) for x, y in zip(got, want))
    assert search.top_k(nothing.select("doc_id", "text"), queries.where("false")).count() == 0


def test_pruning_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(0)
    docs = [(i, *map(np.array, zip(*sorted(Counter(rng.zipf(1.4, 30).tolist()).items()))), 30) for i in range(2000)]
    term = np.concatenate([d[1] for d in docs])
    owner, tf = np.repeat(np.arange(2000, dtype=np.int32), [len(d[1]) for d in docs]), np.concatenate([d[2] for d in docs]).astype(np.int32)
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    row = {"doc_ids": np.arange(2000), "lengths": np.full(2000, 30), "terms": terms, "starts": np.append(starts, len(term)), "docs": owner[order], "tf": tf[order]}
    shard = search.Shard({k: v.tobytes() for k, v in row.items()}, 30.0)
    for q in (3, 77, 1500):
        weights = np.linspace(1, 5, len(docs[q][1]))
        ids, scores = shard.search([(docs[q][1], weights)], 5)[0]
        full = np.zeros(2000)
        for t, w in zip(docs[q][1], weights):
            at = np.searchsorted(shard.terms, t)
            span = slice(shard.starts[at], shard.starts[at + 1])
            full[shard.docs[span]] += w * shard.impact[span]
        full = np.round(full, 6)
        assert np.allclose(scores, np.sort(full)[::-1][:5], atol=2e-6) and ids[0] == np.lexsort((np.arange(2000), -full))[0]


def test_groups_have_rows_for_their_own_frequent_terms():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{'ab'[i % 2]}{w}" for w in rng.zipf(1.3, 40) % 3000) for i in range(2048)]
    (batch,) = search._shards([pa.RecordBatch.from_arrays([pa.array(range(2048)), pa.array(texts)], names=["doc_id", "text"])])
    shard = search.Shard(batch.to_pylist()[0], 40.0)
    # Every posting is in one group's matrix or among the others; a group has rows for the terms that are frequent there, not for all.
    assert sum(np.count_nonzero(exact) for _, exact, _, _ in shard.groups) + len(shard.left_docs) == len(shard.docs)
    assert all(0 < len(columns) <= shard.column.max() for columns, _, _, _ in shard.groups)
    bags = [Counter(t.split()) for t in texts]
    asked = [search.terms_of(texts[q])[0] for q in range(0, 2048, 64)]
    weights = [1 + (t % 97) / 10 for t in asked]
    found = shard.search(list(zip(asked, weights)), 7)
    assert len(found) == 32
    for terms, weight, (ids, scores) in zip(asked, weights, found):
        worth = dict(zip(terms.tolist(), weight.tolist()))
        full = np.zeros(2048)
        for i, bag in enumerate(bags):
            hashes = {w: xxhash.xxh64_intdigest(w) for w in bag}
            full[i] = sum(worth.get(h - (h >> 63 << 64), 0) * bag[w] * 2.2 / (bag[w] + 1.2) for w, h in hashes.items())
        order = np.lexsort((np.arange(2048), -np.round(full, 6)))[:7]
        assert ids.tolist() == order.tolist() and np.allclose(scores, full[order], atol=2e-6)


def test_a_block_of_queries_names_each_term_once():
    rows = pa.table({"query_id": [20, 40], "terms": pa.array([[1, 5, 9], [5, 9]], pa.list_(pa.int64())), "weights": [[0.5, 2.0, 3.0], [2.0, 3.0]]})
    block = search.Queries(rows)
    assert block.terms.tolist() == [1, 5, 9] and block.weights.tolist() == [0.5, 2.0, 3.0]
    assert block.counts.tolist() == [3, 2] and block.numbers.tolist() == [0, 1, 2, 1, 2]


PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies. Accept them now please.</div><div class="layout"><div class="sidebar"><ul><li><a href=1>One</a></li></ul></div>
<main><article><h1>Title &amp; more</h1><p>First  para with <em>in</em>line mark<br>up. It is long enough.<p>Second.<div class="ad-slot">Buy now!</div>
<ul><li>Item one</li></ul><!-- no --><script>var a = "</p>";</script></article><section id="comments"><article class="comment"><p>A fine long comment by a
reader of the page who liked it a lot and says so here.</p></article></section></main></div><form><label>Name</label></form>
<aside>Other</aside><footer>&copy; 2020 Me.</footer></body></html>"""


def test_extraction(spark):
    want = "Title & more First para with inline mark up. It is long enough. Second. Item one"
    assert extraction.main_text(PAGE) == want
    assert [extraction.main_text(x) for x in (None, "", "<p>", "<a", "<!-- x", "<script>a", "&am")] [:6] == [""] * 6
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "", "")], "page_id long, url string, html string, text string")
    got = extraction.extract(pages).collect()
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got) == {(1, "u", want): 2, (2, None, ""): 1, (None, "v", ""): 1}
    assert extraction.extract(pages.where("false")).count() == 0


ARTICLE = "<p>The council met on Monday evening and agreed after a long debate to build the new bridge over the river.</p>"
TEXT = ARTICLE[3:-4]


@pytest.mark.parametrize("page", [
    f'<body><nav><svg class="icon"/>Menu</nav><article>{ARTICLE}</article></body>',
    f'<body><svg class="icon" /><article>{ARTICLE}</article><footer><svg><path/><text>logo</text></svg></footer></body>',
    f'<body><math/><article>{ARTICLE}</article></body>',
    f'<head><title>t</title><meta charset=utf-8><article>{ARTICLE}</article>',
    f'<html><head><title>t</title><style>p {{}}</style><div>{ARTICLE}</div>',
    *[f'<body><{t}><article>{ARTICLE}</article></body>' for t in "button select object iframe noscript svg canvas video template".split()],
    f'<body><button><article>{ARTICLE}</article><footer><button>Send</button></footer></body>',
    f'<body><article>{ARTICLE}<svg><!-- <svg> --><svg><text>in</text></svg><text>out</text></svg></article></body>',
    f'<body><article>{ARTICLE}</article><object><object>a b</object>c d</object></body>',
])
def test_unread_elements(page):
    assert extraction.main_text(page) == TEXT


@pytest.mark.parametrize("page", [
    *[f'<body><{tag} class="{names}">{ARTICLE}</{tag}></body>' for tag, names in [
        ("article", "post comments-open"), ("div", "entry has-comments"), ("article", "post category-commentary"), ("div", "post category-football"),
        ("div", "post tag-navy"), ("div", "entry shared-memory"), ("div", "content noticeable"), ("article", "alerted"), ("div", "post promo")]],
    *[f'<body><article>{ARTICLE}<section id="{name}">{ARTICLE}</section></article></body>' for name in (
        "discussion", "feedback", "related-work", "alert", "football", "sharecropping", "notice")],
])
def test_words_of_names_do_not_hide_the_article(page):
    assert extraction.main_text(page) == " ".join(re.sub("<[^>]*>", " ", page).split())


def test_edges_decide_on_hints_inside_content():
    short = "<p>Only five words are here.</p>"
    assert extraction.main_text(f'<article>{ARTICLE}<p class="notice">{short[3:]}{ARTICLE}</article>') == f"{TEXT} {short[3:-4]} {TEXT}"
    links = "".join(f'<li><a href="{i}">Other story {i}</a></li>' for i in range(4))
    for name in ("related-posts", "post-footer", "share-buttons", "newsletter", "comments", "comment-list", "entry-comments"):
        assert extraction.main_text(f'<article>{ARTICLE}<div class="{name}"><ul>{links}</ul></div></article>') == TEXT
    for name in ("navbar", "site-footer", "comments-area", "sidebar", "cookieBanner", "related"):
        assert extraction.main_text(f'<body><div class="{name}">{ARTICLE}</div></body>') == ""


def test_raw_elements_reach_to_the_end():
    for tag in ("script", "style", "textarea", "title"):
        assert extraction.main_text(f"<body><article>{ARTICLE}<{tag}>{ARTICLE}</article></body>") == TEXT


def test_minimum_cut():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randint(1, 9)
        scores = [rnd.randint(-100, 100) for _ in range(n)]
        edges = [(i, j, rnd.randint(0, 90)) for i, j in combinations(range(n), 2) if rnd.random() < 0.4]

        def cost(labels):
            return sum(-s if s < 0 and x else s if s > 0 and not x else 0 for s, x in zip(scores, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])

        assert cost(extraction.min_cut(scores, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes \\ <|end|>"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None),
            (3, 1, "assistant", said), (3, 0, "user", said), (4, 0, "user", "hi"), (5, 0, None, ""), (None, 0, "assistant", "lost"),
            (6, 0, "user", "hi"), (6, 0, "user", "hi"), (7, None, "assistant", "<|text|>\\\\"), (8, 0, "user", "hi"), (8, 1, "assistant", "no"), (8, 2, "user", "more")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, path string")
    out = chat.format_conversations(df).coalesce(1)
    turns = defaultdict(list)
    for r in rows:
        turns[r[0]].append((-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    want = {}
    for c, own in turns.items():
        learned = "".join(t for _, role, t in sorted(own) if role == "assistant")
        text = "".join(f"{role}\n{t}\n" for _, role, t in sorted(own))
        want[c] = (len(own), hashlib.sha256(text.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    got = chat.read_back(out).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want and len(got) == len(want)
    nodes = [r for r in out.collect() if r["text"] is not None]
    for r in nodes:
        spans = r["attends"]
        assert spans[-1]["start"] <= r["start"] and spans[-1]["stop"] == r["start"] + r["length"] == r["start"] + len(r["text"])
        assert sum(s["stop"] - s["start"] for s in spans) == r["position"] + r["length"] and len(spans) <= r["depth"] + 1
        assert all(a["stop"] < b["start"] for a, b in zip(spans, spans[1:]))  # neighbours are merged
    # The intervals are exactly the turns on the way from the root, replayed from the depths in stream order.
    for shard in {r["shard"] for r in nodes}:
        path = []
        for r in sorted((r for r in nodes if r["shard"] == shard), key=lambda r: r["seq"]):
            del path[r["depth"]:]
            path.append((r["start"], r["start"] + r["length"]))
            assert {c for s in r["attends"] for c in range(s["start"], s["stop"])} == {c for a, b in path for c in range(a, b)}
    by_shard = Counter((r["shard"], r["text"]) for r in nodes if r["depth"] == 0)
    assert max(by_shard.values()) == 1
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


@pytest.mark.parametrize("piece", ["<b", "<div>a</p>", '<a "', "<svg><script>", "<li>a", "<ul><li>", "<div>a</b>", "<!--", "<table><tr><td>x", "&amp"])
def test_a_megabyte_of_bad_markup_takes_seconds(piece):
    page = "<article><p>Some words that stand here before the trouble begins, quite a few of them.</p></article>" + piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    assert "Some words that stand here" in extraction.main_text(page)
    assert time.perf_counter() - start < 20


def test_a_repeated_query_row_asks_once(spark):
    docs = spark.createDataFrame([(20, "a b c"), (2, "a a b x"), (3, "c x y z"), (4, "x y")], "doc_id long, text string")
    queries = docs.where("doc_id = 20").selectExpr("doc_id AS query_id", "text")
    once = sorted(map(tuple, search.top_k(docs, queries).collect()))
    assert once and once == sorted(map(tuple, search.top_k(docs, queries.unionByName(queries)).collect()))


def test_a_long_conversation_has_few_intervals(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t}" if c == 1 or t < 3000 else f"other {t}") for c in (1, 2) for t in range(4000)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert sum(len(r["attends"]) for r in out) <= 2 * len(out) and max(len(r["attends"]) for r in out) <= 2 and len(out) >= 5002


def test_pipeline(spark, odd, nothing, plain):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == before.columns
    pieces = docs.collect()
    check_packing(pieces, [(r["doc_id"], len(plain(r["text"]))) for r in before.collect()])
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
