"""Every registered corpus query against a brute-force version on the smallest tables."""

import hashlib
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixeltide.llm import language_id, queries as Q, simhash

WORD, BYTE = Q.vocabulary(Q.WORD_VOCABULARY), Q.vocabulary(Q.BYTE_VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows(df, key="doc_id"):
    found = df.collect()
    out = {r[key]: r for r in found}
    assert len(out) == len(found)
    return out


def test_op1(spark, sf_dir, docs):
    got, t, start = rows(Q.op1_token_store(spark, sf_dir)), Tokenizer.from_file(WORD), 0
    assert set(got) == set(docs)
    for i in sorted(docs):
        ids = t.encode(docs[i]["text"], add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3(spark, sf_dir, docs):
    got, t = rows(Q.op3_token_counts(spark, sf_dir)), Tokenizer.from_file(WORD)
    for i, d in docs.items():
        n = len(t.encode(d["text"], add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(d["text"].encode()), n, n > 2048)


def test_op4(spark, sf_dir, docs):
    got = rows(Q.op4_language_id(spark, sf_dir))
    held = {i: g for i, g in got.items() if g["held_out"]}
    assert set(held) == {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(g["lang_pred"] == docs[i]["lang"] for i, g in held.items() if any(map(str.isalpha, docs[i]["text"])))
    assert right >= 0.95 * len(held)
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_op5(spark, sf_dir, docs):
    got, t = rows(Q.op5_bpe(spark, sf_dir)), Tokenizer.from_file(BYTE)
    for i, d in docs.items():
        ids = t.encode(d["text"], add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert tuple(got[i])[:4] == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op6(spark, sf_dir, docs):
    got = rows(Q.op6_mixing(spark, sf_dir))
    by = defaultdict(list)
    for i, g in got.items():
        by[docs[i]["source"]].append(g)
    total = sum(g["size"] for g in got.values())
    caps = {s: 3 * sum(g["size"] for g in gs) for s, gs in by.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    target, free, left = {}, set(by), total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > caps[s]}
        if not over:
            break
        for s in over:
            target[s] = caps[s]
            left -= caps[s]
        free -= over
    target |= share
    for s, gs in by.items():
        assert gs[0]["target"] == pytest.approx(target[s])
        assert {g["source_size"] for g in gs} == {caps[s] // 3}
        taken = sum(g["taken"] for g in gs)
        whole = int(target[s] // gs[0]["source_size"])
        left_out = [g["size"] for g in gs if g["size"] and g["taken"] == whole * g["size"]]
        assert abs(taken - target[s]) <= min(left_out, default=0) / 2 + 1
        assert all(g["taken"] <= 3 * g["size"] for g in gs)


def slow_fingerprint(text):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def slow_components(fp):
    ids = sorted(fp)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_op7(spark, sf_dir, docs):
    got = rows(Q.op7_simhash(spark, sf_dir))
    fp = {i: slow_fingerprint(d["text"]) for i, d in docs.items()}
    assert {i: g["fingerprint"] for i, g in got.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    assert {i: g["component_id"] for i, g in got.items()} == slow_components(fp)


def test_op8(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    v = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64) for r in table}
    want = set()
    for q in v:
        if q % 50 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in Q.op8_topk(spark, sf_dir).collect()} == want


def test_op9(spark, sf_dir, docs):
    got, groups = rows(Q.op9_exact_dedup(spark, sf_dir)), defaultdict(list)
    for i, d in docs.items():
        groups[d["text"]].append(i)
    for text, ids in groups.items():
        for i in ids:
            assert tuple(got[i]) == (i, max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())


def slow_repeats(texts, length=50):
    """texts: (order, bytes); bytes kept and spans of each."""
    first = {}
    for order, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, order), order)
    out = []
    for order, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < order:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op10(spark, sf_dir, docs):
    got = rows(Q.op10_suffix_dedup(spark, sf_dir))
    ids = sorted(docs)
    want = slow_repeats([(i, docs[i]["text"].encode()) for i in ids])
    assert [tuple(got[i])[1:] for i in ids] == want
    assert any(w[1] for w in want)


def test_op2(spark, sf_dir, docs):
    got = rows(Q.op2_license_scan(spark, sf_dir))
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "All rights reserved.": "all-rights-reserved"}
    for i, d in docs.items():
        want = {f for line, f in lines.items() if line in d["text"]}
        assert set(filter(None, got[i]["families"].split(","))) == want, d["text"][-200:]


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as P

    at, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, at, sf_dir)
        assert after.columns == at.columns
        seen[name] = after.collect()
        at = spark.createDataFrame(seen[name], after.schema)
    one = [r["doc_id"] for r in seen["language_id"]]
    assert set(one) == {i for i, d in docs.items() if any(map(str.isalpha, d["text"]))}
    last = {}
    for r in seen["language_id"]:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(last.values())
    texts = {r["doc_id"]: r["text"] for r in seen["exact_dedup"]}
    cut = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.encode().lower().split()]}
    alike = {(i, j): len(cut[i] & cut[j]) / len(cut[i] | cut[j]) for i in cut for j in cut if i < j and cut[i] & cut[j]}
    root = {i: i for i in cut}
    for (i, j), s in sorted(alike.items()):
        if s >= 0.8:
            a, b = sorted((find(root, i), find(root, j)))
            root[b] = a
    kept = {r["doc_id"] for r in seen["near_dedup"]}
    assert all(find(root, i) in kept | {find(root, k) for k in kept} for i in cut)  # every group keeps a document
    assert all(i in kept for i in cut if sum(find(root, j) == find(root, i) for j in cut) == 1)  # unlike texts stay
    assert not any(s >= 0.9 and i in kept and j in kept for (i, j), s in alike.items())
    assert {r["doc_id"] for r in seen["near_dedup"]} <= set(last.values())
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["near_dedup"]}
    final = P.run(spark, sf_dir)
    t = Tokenizer.from_file(BYTE)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in final.collect()) == sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids)) for r in seen["mixing"])
