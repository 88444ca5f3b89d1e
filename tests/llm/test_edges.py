"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing column names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixeltide.llm import bpe, exact_dedup, language_id, license_scan, mixing, queries as Q, simhash, suffix_dedup, token_counts, token_store, topk_search

WORD, BYTE = Q.vocabulary(Q.WORD_VOCABULARY), Q.vocabulary(Q.BYTE_VOCABULARY)
SCHEMA = "doc_id bigint, text string, lang string, source string, id string, uid int, digest string, content string, fp string, size int, q string, bucket string, winner string, document string, copies int"
rng = random.Random(7)
LONG = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(30_000))
TEXTS = [
    "Plain words here.", "Plain words here.", "plain WORDS here.", "", " ", None, "\n\t \x0b\x0c\r", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> <|EndOfText|>", "don't can't I'll we've 'tis the's",
    "İstanbul ΣΑΣ ﬁne é e ́", "nb\xa0space  em \x1c fs \x85", "日本語のテキスト 漢字", "😀😀 👩‍👩‍👧", "1234567 ½ ² Ⅷ", "!!!??? ... ---", "a" * 3000, "ab" * 2000 + "!" * 500, LONG, "x" * 70_000, "  lead and trail  ", "one", "two words",
    "Licensed under CC BY-NC 4.0.", "퟿�", "à" * 300, "#$%&* word,%%% word.", "-" * 200 + "\n" + "=" * 200,
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, "x", 1, "d", "c", "f", 5, "q", "b", "w", "doc", 9) for i, t in enumerate(TEXTS)]
    rows += [(None, "Plain words here.", "en", None, *rows[0][4:]), (None, None, None, None, *[None] * 11), rows[0], rows[0], rows[18]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs(table):
    return [(r["doc_id"], r["text"]) for r in table.collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_token_store(spark, table, pairs, tmp_path):
    path, t = str(tmp_path / "store"), Tokenizer.from_file(WORD)
    token_store.write_token_store(table, path, WORD, block_tokens=2000)
    got = token_store.read_token_store(spark, path, with_ids=True).orderBy("start").collect()
    want = {}
    for i, x in pairs:
        want.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [2])
    start = 0
    for r in got:
        assert r["start"] == start and r["ids"] in want[r["id"]] and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        want[r["id"]].remove(r["ids"])
        start += r["n_tokens"]
    assert not any(want.values())
    order = [r["id"] for r in got]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_token_store_of_a_tokenizer_that_keeps_space(spark, table, pairs, tmp_path):
    path, t = str(tmp_path / "store"), Tokenizer.from_file(BYTE)
    token_store.write_token_store(table, path, BYTE)
    got = [(r["id"], tuple(r["ids"])) for r in token_store.read_token_store(spark, path, with_ids=True).collect()]
    same(got, [(i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in pairs])


def test_token_store_of_nothing(spark, nothing, tmp_path):
    assert token_store.stored_tokens(nothing, WORD).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_length_limited_codes(seed):
    r = np.random.default_rng(seed)
    counts = np.sort((r.pareto(0.4, 3000) * 3 + 1).astype(np.int64))[::-1].copy()
    lengths = token_store.code_lengths(counts)
    assert lengths.max() <= token_store.MAX_LENGTH and sum(2.0 ** -lengths) <= 1
    book = token_store.Codebook(np.arange(3000) * 7, lengths)
    ids = np.repeat(np.arange(3000) * 7, np.minimum(counts, 5))
    r.shuffle(ids)
    for step in (1, 3, 256):
        assert np.array_equal(book.decode(*book.encode(ids, step), len(ids), step), ids)


def test_code_lengths_are_optimal():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34])
    heap = [(int(c), [i]) for i, c in enumerate(counts)]
    depth = np.zeros(len(counts), int)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        depth[a[1] + b[1]] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
    assert (counts * token_store.code_lengths(counts)).sum() == (counts * depth).sum()
    tight = token_store.code_lengths(counts, 4)
    assert tight.max() == 4 and sum(2.0**-tight) <= 1
    assert token_store.code_lengths(np.array([5])).tolist() == [1]


def test_token_counts(table, pairs):
    t = Tokenizer.from_file(WORD)
    want = [(i, len((x or "").encode()), n, n > 2048) for i, x in pairs for n in [len(t.encode(x or "", add_special_tokens=False).ids)]]
    for chunk, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), (700, 150)):
        same([tuple(r) for r in token_counts.count_tokens(table, WORD, chunk=chunk, overlap=overlap).collect()], want)


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("seed", range(3))
def test_spliced_ids_are_whole_ids(path, seed):
    t, r = Tokenizer.from_file(path), random.Random(seed)
    text = "".join(r.choice(["word ", "x" * r.randint(1, 400), "<|endoftext|>", " \n ", "é́", "don't ", "12 ", "... "]) for _ in range(600))
    got = [i for part in token_counts.spliced(t, text, 500, 100, 20) for i in part]
    assert got == t.encode(text, add_special_tokens=False).ids


def test_token_counts_of_nothing(nothing):
    assert token_counts.count_tokens(nothing, WORD).count() == 0


def test_language(spark, table, pairs, nothing, sf_dir):
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = language_id.predict(table, model).collect()
    assert len(got) == len(pairs)
    texts = dict(pairs)
    for r in got:
        x = texts[r["id"]] if r["id"] is not None else None
        if r["id"] is not None:
            letters = any(map(str.isalpha, x or ""))
            assert (r["lang_pred"] == "und") == (not letters) and (r["score"] > 0) == letters
    assert language_id.predict(nothing, model).count() == 0
    none = language_id.train(nothing)
    assert {r["lang_pred"] for r in language_id.predict(table, none).collect()} == {"und"}
    kept = language_id.filter_language(table, model)
    assert kept.schema == table.schema and all(any(map(str.isalpha, r["text"])) for r in kept.collect())


def test_mixture_finds_both_languages():
    words = {"en": ["the", "house", "white", "with"], "de": ["schön", "über", "zwei", "jetzt"]}
    counts = np.zeros((language_id.BUCKETS, 2))
    for j, lang in enumerate(("de", "en")):
        at, _ = language_id.trigram_cells(words[lang])
        np.add.at(counts[:, j], at, 50)
    p = language_id.Predictor(language_id.LanguageModel(["de", "en"], counts))
    some, pi = p.shares(["the house " * 30 + "schön über " * 10, "the white house with", "zwei jetzt", "12 !"])
    assert some.tolist() == [0, 1, 2]
    assert pi[0, 1] == pytest.approx(0.75, abs=0.02) and (pi[0] > 0).all()
    assert pi[1].tolist() == [0, 1] and pi[2].tolist() == [1, 0]


def test_unlearned_languages_are_rejected(spark):
    """Each language in turn is left out of the training; every other language's texts stay, its own go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 200")
    rng = random.Random(5)
    junk = [(-i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(80)), "junk") for i in range(1, 41)]
    other = [(-41, "это другой язык которого модель никогда не видела", "ru"), (-42, "tämä on teksti jota malli ei ole koskaan nähnyt eikä tunnista", "fi")]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(junk + other, "doc_id bigint, text string, lang string"))
    total = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(set(total) - {"junk", "ru", "fi"})
    for left_out in [None, *names]:
        model = language_id.train(docs.where(language_id.fold(F.col("doc_id")) != 0).where(F.col("lang") != (left_out or "")))
        kept = {r["lang"]: r["count"] for r in language_id.filter_language(rows, model, low=1 / 3).groupBy("lang").count().collect()}
        assert all(kept[x] >= 0.998 * total[x] for x in names if x != left_out), (left_out, kept, total)
        assert not kept.keys() & {"junk", "ru", "fi"}, kept
        assert left_out is None or kept.get(left_out, 0) <= 0.1 * total[left_out], (left_out, kept, total)


def test_short_texts_need_clear_evidence_to_be_rejected(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = language_id.train(train)
    frequent = train.where("lang = 'fr'").select(F.explode(F.split(F.lower("text"), "[^a-zéèêàç]+")).alias("w")).where("length(w) > 2").groupBy("w").count().orderBy(F.desc("count"), "w").limit(5)
    words = [r["w"] for r in frequent.collect()]
    short, foreign = " ".join(words), "xqzv wkjq zzxw qvkx jxqz wqkz vzxj kqxw zqjv xwvk"
    rows = [(1, f"{short} {foreign}"), (2, foreign), (3, f"{short} {foreign * 40}"), (4, short)]
    kept = language_id.filter_language(spark.createDataFrame(rows, "doc_id bigint, text string"), model, low=0.4).collect()
    assert {r["doc_id"] for r in kept} == {1, 4}


def test_foreign_level_needs_two_languages():
    counts = np.zeros((language_id.BUCKETS, 2))
    counts[:50, 0], counts[50:90, 1] = 7, 9
    both = language_id.LanguageModel(["de", "en"], counts)
    fit = np.log([(7.05) / (350 + 0.05 * language_id.BUCKETS), 0.05 / (360 + 0.05 * language_id.BUCKETS)])
    other = np.log([(9.05) / (360 + 0.05 * language_id.BUCKETS), 0.05 / (350 + 0.05 * language_id.BUCKETS)])
    assert both.foreign == pytest.approx(min(fit.mean(), other.mean()), abs=1e-4)
    one = language_id.LanguageModel(["de"], counts[:, :1])
    assert one.foreign is None and language_id.LanguageModel([], counts[:, :0]).foreign is None
    some, pi = language_id.Predictor(one, foreign=True).shares(["abc def"])
    assert pi.tolist() == [[1.0]]


def test_bpe(table, pairs, nothing):
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, x in pairs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([tuple(r) for r in bpe.round_trip(table, BYTE).collect()], want)
    back = bpe.decode(bpe.encode(table, BYTE), BYTE)
    same([tuple(r) for r in back.collect()], [(i, x or "") for i, x in pairs])
    assert bpe.round_trip(nothing, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_rounds_and_heap_agree(seed):
    made, r = bpe.ByteBpe(open(BYTE, encoding="utf-8").read()), random.Random(seed)
    words = [bytes(r.choices(b"aabbcthe in\xc3\xa9", k=r.randint(1, 60))) for _ in range(300)] + [b"a" * n for n in range(1, 40)]
    assert [x.tolist() for x in made.merge_rounds(words)] == [made.merge_heap(w).tolist() for w in words]


def test_decode_bad_bytes():
    made, t = bpe.ByteBpe(open(BYTE, encoding="utf-8").read()), Tokenizer.from_file(BYTE)
    for seed in range(50):
        ids = np.random.default_rng(seed).integers(0, 50257, 12)
        assert made.decode_text(ids) == t.decode(ids.tolist(), skip_special_tokens=False)


def test_mixing(table, pairs, nothing, spark):
    rows = mixing.mix_sizes(table).collect()
    assert len(rows) == len(pairs) and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    again = mixing.mix_sizes(table.repartition(7)).collect()
    same([tuple(r) for r in rows], [tuple(r) for r in again])
    mix = mixing.mix_sources(table)
    assert mix.columns == table.columns and mix.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sizes(nothing).count() == 0 and mixing.mix_sources(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix_sizes(blank).collect()} == {(0, 0.0, 0)}


def test_mixing_importance_raises_the_odds(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("imp"))
    got = mixing.mix_sizes(df, importance_col="imp", weights=(1, 3)).where("source = 'a'").collect()
    even, odd = (sum(r["copies"] for r in got if r["id"] % 2 == k) for k in (0, 1))
    assert abs(even + odd - 1000) <= 1 and even > 2.5 * odd


def slow_groups(pairs):
    from test_contracts import slow_fingerprint

    fps = sorted({slow_fingerprint(x or "") for _, x in pairs})
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    least = {}
    for i, x in pairs:
        f = find(slow_fingerprint(x or ""))
        least[f] = min((y for y in (least.get(f), i) if y is not None), default=None)
    return [(i, f"{slow_fingerprint(x or ''):016x}", least[find(slow_fingerprint(x or ""))]) for i, x in pairs]


def test_simhash(table, pairs, nothing):
    same([tuple(r) for r in simhash.near_duplicates(table).collect()], slow_groups(pairs))
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns and kept.count() == len({g for *_, g in slow_groups(pairs)})
    wide = simhash.drop_near_duplicates(table, shingle=5, similarity=0.8)
    assert wide.columns == table.columns and 0 < wide.count() <= kept.count() + 3
    assert simhash.drop_near_duplicates(nothing, shingle=5, similarity=0.8).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("run", [4, 16_384])
def test_links_lose_nothing(spark, run):
    r = np.random.default_rng(11)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:12] for i, j in r.integers(0, 64, (30, 2))]
    fps = sorted({*map(int, base), *near, 0, 1, 3, 7, 15})
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp bigint")
    from pixeltide.llm.components import components

    root = {r["node"]: r["root"] for r in components(simhash.links(df, run=run)).collect()}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {x: root.get(x, x) for x in signed} == {x: min(y for y in signed if find(y) == find(x)) for x in signed}


def slow_similar(texts, shingle=5, least=0.8):
    def cut(x):
        w = x.encode().lower().split()
        return {b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({b" ".join(w)} if w else set())

    sets = [cut(x) for x in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= least * max(1, len(sets[i] | sets[j]))}


@pytest.mark.parametrize("run", [3, 16_384])
def test_similar_texts_are_grouped(spark, run):
    r = random.Random(5)
    base = [" ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(150)) for _ in range(30)]
    texts = list(base)
    for b in base[:12]:
        for k in (1, 2, 60):
            w = b.split()
            for _ in range(k):
                w[r.randrange(len(w))] = "".join(r.choices("xyz", k=5))
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = simhash.NearDuplicates(df, shingle=5, similarity=0.8, run=run)
    got = {x["id"]: x["component_id"] for x in found.per_document().collect()}
    true = slow_similar(texts)
    assert sum(got[i] == got[j] for i, j in true) >= 0.9 * len(true) > 0
    parent = list(range(len(texts)))
    for i, j in sorted(true):
        a, b = sorted((got_root(parent, i), got_root(parent, j)))
        parent[b] = a
    for i, c in got.items():
        assert got_root(parent, i) == got_root(parent, c)  # nothing is joined that is not similar
    assert simhash.drop_near_duplicates(df, shingle=5, similarity=0.8).count() == len(set(got.values()))


def got_root(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def test_candidate_pairs_lose_nothing(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for k in (1, 4, 6, 9):
            fps.append(int(b) ^ sum(1 << int(i) for i in r.choice(64, k, replace=False)))
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "node bigint, fp bigint")
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 6}
    for run in (3, 16_384):
        assert {tuple(x) for x in simhash.candidate_pairs(df, 6, run).collect()} == want


def test_dense_buckets_keep_members_together():
    r = np.random.default_rng(4)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64)))
    a, b = simhash._first_tries(fps[:, None], 6, 6)
    parent = list(range(len(fps)))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        parent[max(got_root(parent, i), got_root(parent, j))] = min(got_root(parent, i), got_root(parent, j))
    assert len({got_root(parent, i) for i in range(len(fps))}) == 1 and len(a) <= 2 * len(fps)


def test_thresholds_are_allocated():
    cost, chosen = simhash.allocate([[0, 5, 50, 500], [0, 1, 2, 900]], 2)
    assert sum(t + 1 for t in chosen) == 3 and (cost, chosen) == (7, [0, 1])


def test_components_of_a_long_chain(spark):
    from pixeltide.llm.components import components

    df = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(df.unionByName(spark.createDataFrame([(100, 101)], "a bigint, b bigint")))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, None), (150, [1.0, None, 0.0, 0.0]), (200, [nan, 0.0, 0.0, 0.0]), (250, [inf, 0.0, 0.0, 0.0]), (300, [1.0, 2.0]), (301, [3.0, -1.0]), (302, []), (None, [1.0] * 4), (61, rows[3][1]), (61, rows[3][1]), (50, rows[50][1]), (350, [3e5, 1e5, 0.0, 2e5]), (62, [2e5, 1.0, 1.0, 3e5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("x"))
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, qv in {i: v for i, v in fine if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), c) for c, v in fine if c != q and len(v) == len(qv))[:5]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    for block in (2, 4096):
        got = [tuple(x) for x in topk_search.top_k(df, F.col("vec_id") % 50 == 0, block=block).collect()]
        assert set(got) == want
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def slow_exact(pairs):
    out = []
    for i, x in pairs:
        group = [j for j, y in pairs if (y or "") == (x or "")]
        keep = max((j for j in group if j is not None), default=None)
        out.append((i, keep, len(group), hashlib.sha256((x or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("k", [1, 3, 1024])
def test_exact_dedup(table, pairs, nothing, k):
    got = exact_dedup.exact_duplicates(table, k=k).collect()
    same([(r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], slow_exact(pairs))
    for digest in {r["text_sha256"] for r in got}:
        assert [r["id"] == r["keep_id"] for r in got if r["text_sha256"] == digest and r["kept"]] == [True]
    kept = exact_dedup.drop_exact_duplicates(table, k=k)
    assert kept.columns == table.columns
    same([(r["doc_id"], r["text"] or "") for r in kept.collect()], [(r["id"], next(x or "" for _, x in pairs if hashlib.sha256((x or "").encode()).hexdigest() == r["text_sha256"])) for r in got if r["kept"]])
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0


def test_frequent_digests_are_found(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("digest")).repartition(9)
    found = [bytes(r[0]) for r in exact_dedup.frequent_digests(df, 10).collect()]
    assert found == [b"hot"]


def test_suffix_dedup(spark, table, pairs, nothing):
    from test_contracts import slow_repeats

    small = [(i, x) for i, x in pairs if len(x or "") < 5000]
    df = spark.createDataFrame(small, "doc_id bigint, text string")
    big = 2**63 - 1
    want = slow_repeats([(big if i is None else i, (x or "").encode()) for i, x in small])
    for options in ({"slice_bytes": 300, "gram": 8}, {"shallow": 0, "hot": 0}):
        got = [tuple(r) for r in suffix_dedup.remove_repeats(df, **options).collect()]
        same(got, [(i, *w) for (i, _), w in zip(small, want, strict=True)])
    whole = slow_repeats([(big if i is None else i, (x or "").encode()) for i, x in pairs])
    same([tuple(r) for r in suffix_dedup.remove_repeats(table).collect()], [(i, *w) for (i, _), w in zip(pairs, whole, strict=True)])
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed, hot", [(0, 1024), (1, 0), (2, 1), (3, 2)])
def test_suffix_dedup_of_woven_passages(spark, seed, hot):
    from test_contracts import slow_repeats

    r = random.Random(seed)
    shared = ["".join(r.choices("abcd ", k=r.randint(40, 120))) for _ in range(6)] + ["ab" * 60, "a" * 90]
    docs = [(i, "".join(r.choice([*shared, "".join(r.choices("abcdefgh ", k=r.randint(0, 60)))]) for _ in range(r.randint(0, 6)))) for i in r.sample(range(100), 25)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = [tuple(x) for x in suffix_dedup.remove_repeats(df, slice_bytes=400, hot=hot).collect()]
    same(got, [(i, *w) for (i, _), w in zip(docs, slow_repeats([(i, t.encode()) for i, t in docs]), strict=True)])


@pytest.mark.parametrize("chunk", [60, 1000, 1 << 20])
def test_anchors_serve_every_window_once(monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    r = np.random.default_rng(0)
    docs = [r.integers(97, 100, n, dtype=np.uint8).tobytes() for n in (0, 10, 49, 50, 51, 3000, 0, 0, 2500, 70, 1100, 5)]
    ends, data = np.cumsum([len(d) for d in docs]), np.frombuffer(b"".join(docs), np.uint8)
    at, h, first, last = suffix_dedup.anchors(data, ends)
    served = [(p, a - p, x) for a, x, f, z in zip(at.tolist(), h.tolist(), first.tolist(), last.tolist(), strict=True) for p in range(f, z + 1)]
    starts = ends - [len(d) for d in docs]
    assert [p for p, *_ in served] == [p for s, d in zip(starts.tolist(), docs, strict=True) for p in range(s, s + len(d) - 49)]
    whole = suffix_dedup.anchors(np.frombuffer(docs[5], np.uint8), np.array([3000]))
    assert [(o, x) for p, o, x in served if starts[5] <= p < ends[5]] == [(a - p, x) for a, x, f, z in zip(*(v.tolist() for v in whole), strict=True) for p in range(f, z + 1)]


@pytest.mark.parametrize("shallow", [0, 8, 24])
def test_suffixes_are_sorted(shallow):
    r = random.Random(shallow)
    data = "".join(r.choice(["abab", "aaaa", "the same long passage that comes again and again in here", "xyz"]) for _ in range(300)).encode()
    starts = np.arange(len(data) - 50)
    order, kind = suffix_dedup.sort_suffixes(np.frombuffer(data, np.uint8), starts, np.zeros(len(starts), np.int64), 50, shallow)
    strings = [data[p : p + 50] for p in order]
    assert strings == sorted(strings) and sorted(order) == starts.tolist()
    assert all((a == b) == (x == y) for a, b, x, y in zip(strings, strings[1:], kind, kind[1:], strict=False))


@pytest.fixture(scope="module")
def license_model(spark):
    return license_scan.train(spark)


def test_licenses(table, pairs, nothing, license_model):
    got = license_scan.summarised(license_scan.scan_licenses(table, license_model)).collect()
    assert len(got) == len(pairs)
    assert {r["id"]: r["families"] for r in got if r["n_notices"]} == {23: "cc-by-nc-4.0"}
    assert license_scan.summarised(license_scan.scan_licenses(nothing, license_model)).count() == 0


def test_license_families(spark, license_model):
    texts = [(f, t) for f, ts in license_scan.FAMILIES.items() for t in ts] + [("", t) for t in license_scan.OTHERS] + [("", "Nothing of the kind stands in this paragraph at all.")]
    df = spark.createDataFrame([(i, "First line of prose.\n" + t + "\nlast line.") for i, (_, t) in enumerate(texts)], "doc_id bigint, text string")
    got = {r["id"]: r["families"] for r in license_scan.summarised(license_scan.scan_licenses(df, license_model)).collect()}
    right = sum(got[i] == f for i, (f, _) in enumerate(texts))
    assert right >= 0.9 * len(texts)
    assert not any(got[i] for i, (f, _) in enumerate(texts) if not f)


def test_license_scan_needs_no_python(spark, table, license_model):
    plan = license_scan.scan_licenses(table, license_model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowScan", "")


def test_anchors_cover_the_vocabulary(license_model):
    anchors = set(license_model.anchors)
    assert license_model.weights and all(anchors & set(g.split()) for g in license_model.weights)
