"""The whole pipeline on the smallest documents against a plain Python version of every stage."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from packetloom.llm import mixing, tokens
from tests.llm.test_text_ops import brute_components, brute_fingerprint, brute_quality, brute_windows

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(text):
    n, chars, symbols, dup_lines, repeats = brute_quality(text)
    return (n >= 10 and repeats * 100 <= 20 * n and symbols * 100 <= 10 * n and text.count("!") * 100 <= 20 * n
            and (dup_lines <= 2 or dup_lines * 100 <= 30 * (text.count("\n") + 1)) and 2 * n <= chars <= 20 * n)


def brute_mix(rows):
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    per = Counter()
    for i, _, source in rows:
        per[source] += size[i]
    order = sorted(per, key=lambda s: s.encode())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        level = (1.5 * sum(per.values()) - sum(2 * per[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 2 * per[s]}
        if not over:
            break
        full |= over
    times = {}
    for s in order:
        target = 2 * per[s] if s in full else level * weight[s]
        whole = math.floor(target / per[s]) if per[s] else 0
        left, total = target - whole * per[s], 0
        u = {i: (int(hashlib.md5(f"{mixing.SEED}:{i}:{hashlib.md5(t.encode()).hexdigest()}:0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i, t, _ in rows}
        own = sorted((u[i] / (1 - u[i]) / size[i] if size[i] else math.inf, i) for i, _, source in rows if source == s)
        for _, i in own:
            total += size[i]
            times[i] = whole + (target / per[s] > whole and size[i] > 0 and total - size[i] / 2 <= left)
    return times


def test_pipeline_against_plain_python(spark):
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]
    rows = [r for r in rows if passes(r[1])]
    roots = brute_components([brute_fingerprint(r[1]) for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]  # rows ascend by id, so a root has the smallest
    flags = brute_windows([(r[0], r[1]) for r in rows], WORD.findall)
    rows = [(r[0], " ".join(w for w, gone in zip(u, g) if not gone) if any(g) else r[1], r[2]) for r, (u, g) in zip(rows, flags)]
    times = brute_mix(rows)
    encode = Tokenizer.from_file(tokens.tokenizer_path()).encode
    ids = {r[0]: np.array([*encode(r[1], add_special_tokens=False).ids, 1], "<u4") for r in rows}
    want = Counter({i: n * len(ids[i]) for i, n in times.items() if n})

    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    got, sequences = Counter(), defaultdict(int)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]] += p["length"]
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"]:p["start"] + p["length"]].tobytes())
    assert got == want
    assert max(sequences.values()) <= 2048
