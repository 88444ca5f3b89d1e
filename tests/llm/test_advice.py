"""Places where an operator once did less than the whole job."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pixeltide.llm import license_scan, mixing, simhash, topk_search


def connected(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return [root(i) for i in range(n)]


def templated(n):
    """Texts around one template, with similarities on both sides of 0.8."""
    r = random.Random(11)
    base, out = [f"w{i}" for i in range(300)], []
    for _ in range(n):
        w = list(base)
        for p in r.sample(range(300), r.choice([2, 5, 6, 7, 8])):
            w[p] = f"x{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def near(x, y, radius, reach):
    bits = [(a ^ b).bit_count() for a, b in zip(x, y, strict=True)]
    return min(bits) <= radius and sum(bits) <= reach


@pytest.mark.parametrize("block", [1 << 13, simhash.CROWD_BYTES])
def test_crowded_buckets_lose_no_link(spark, block):
    texts, radius, reach, least = templated(150), simhash.radius_for(0.8), simhash.reach_for(0.8), 0.8
    fps = [simhash.wide_fingerprint(t.encode(), 5) for t in texts]
    sets = [set(np.concatenate(list(simhash.shingle_hashes(t.encode(), 5))).tolist()) for t in texts]
    n = len(texts)
    alike = [(i, j) for i in range(n) for j in range(i + 1, n) if near(fps[i], fps[j], radius, reach) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    nodes = spark.createDataFrame([(i, *(f - 2**64 if f >> 63 else f for f in x)) for i, x in enumerate(fps)], "node bigint, fp bigint, fp1 bigint")
    pairs, crowds = simhash.candidates(nodes, radius, reach, 2)
    assert not crowds.isEmpty()
    held = spark.createDataFrame([(i, np.array(sorted(s), "<u8").tobytes(), 8 * len(s)) for i, s in enumerate(sets)], "node bigint, hashes binary, bytes bigint")
    links = [tuple(x) for x in simhash.crowd_links(crowds, nodes, held, radius, reach, 2, least, block).collect()]
    assert {tuple(sorted(x)) for x in links} <= set(alike)
    links += [x for x in map(tuple, pairs.collect()) if x in set(alike)]
    assert connected(n, links) == connected(n, alike)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=5, similarity=least).collect()}
    assert [got[i] for i in range(n)] == connected(n, alike)


def grouped(groups, members, shared, own, seed):
    """Groups of close texts around one base: ``shared`` words changed per group, ``own`` more per text."""
    r = random.Random(seed)
    base, out = [f"w{r.randrange(10**6)}" for _ in range(400)], []

    def changed(words, n):
        words = list(words)
        for p in r.sample(range(400), n):
            words[p] = f"x{r.randrange(10**9)}"
        return words

    for _ in range(groups):
        core = changed(base, shared)
        out += [" ".join(changed(core, own)) for _ in range(members)]
    return out


@pytest.mark.parametrize("groups, members, shared, own", [(30, 12, 10, 3), (1, 200, 0, 4)])
def test_dense_groups_lose_no_candidate_and_little_else(spark, groups, members, shared, own):
    texts, radius, reach, least = grouped(groups, members, shared, own, 17), simhash.radius_for(0.8), simhash.reach_for(0.8), 0.8
    fps = [simhash.wide_fingerprint(t.encode(), 5) for t in texts]
    sets = [set(simhash.distinct_shingles(t.encode(), 5).tolist()) for t in texts]
    n = len(texts)
    similar = [(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    shown = [(i, j) for i, j in similar if near(fps[i], fps[j], radius, reach)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=5, similarity=least).collect()}
    assert [got[i] for i in range(n)] == connected(n, shown)
    assert len(shown) >= 0.9 * len(similar) > 0 and sum(got[i] == got[j] for i, j in similar) >= 0.95 * len(similar)


def test_recall_at_the_threshold():
    texts = grouped(400, 2, 390, 5, 23)  # pairs of similarity about 0.8
    sets = [set(simhash.distinct_shingles(t.encode(), 5).tolist()) for t in texts]
    fps = [simhash.wide_fingerprint(t.encode(), 5) for t in texts]
    at = [i for i in range(0, len(texts), 2) if 0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.85]
    found = [i for i in at if near(fps[i], fps[i + 1], simhash.radius_for(0.8), simhash.reach_for(0.8))]
    assert len(at) > 50 and len(found) >= 0.9 * len(at)


def slack(sizes):
    """How far a greedy choice may end from its target: half of the smallest unit left out."""
    return min((n for n, taken in sizes if n and not taken), default=0) / 2 + 1e-6


def test_mixes_come_near_their_targets(spark):
    rows = [(f"a{s}", 10) for s in range(8) for _ in range(300)] + [(f"a{s}", 4000) for s in range(8)] + [("z", 100)] * 250
    rows += [(s, 50) for s in "bcd" for _ in range(400)] + [(s, 20_000) for s in "bcd"]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(rows)], "doc_id bigint, source string, text string")
    alike = docs.limit(0).unionByName(spark.createDataFrame([(None, "e", "v " * 7)] * 300 + [(i % 50, "e", "v " * (3 + i % 50)) for i in range(1000)] + [(i, "f", "u " * 5) for i in range(900)], "doc_id bigint, source string, text string"))
    mix = mixing.Mix(docs.unionByName(alike), weights=(1, 2))
    found = mix.per_document().collect()
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        units = {}
        for r in own:
            n, whole = units.get((r["id"], r["size"]), (0, r["copies"]))[0], int(r["target"] // r["source_size"])
            assert r["copies"] in (whole, whole + 1) and units.get((r["id"], r["size"]), (0, r["copies"]))[1] == r["copies"]  # rows alike go together
            units[r["id"], r["size"]] = (n + r["size"], r["copies"])
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= slack([(n, c > whole) for n, c in units.values()])
    mixed = {tuple(r) for r in mix.mixed(docs.unionByName(alike)).groupBy("doc_id", "source", "text").count().collect()}
    want = {}
    for r in found:
        want[r["id"], r["source"], r["size"]] = want.get((r["id"], r["source"], r["size"]), 0) + r["copies"]
    assert {(i, s, len(t.split())): n for i, s, t, n in mixed} == {k: n for k, n in want.items() if n}


def test_longer_documents_are_likelier(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "IF(id < 3000, 'a', 'b') AS source", "repeat('w ', IF(id % 2 = 0, 5, 45)) AS text")
    got = mixing.mix_sizes(docs, weights=(1, 3)).where("source = 'a'").collect()
    short, long = (sum(r["copies"] for r in got if r["id"] % 2 == k) for k in (0, 1))
    # a sample of half the words; inclusion odds of 0.2 and 1.8 over a common factor
    assert sum(r["taken"] for r in got) == 37_500 and 2 * short < long
    assert {r["copies"] for r in got} == {0, 1}


def test_long_vectors_behind_short_ones_are_scored():
    r = np.random.default_rng(3)
    files = [np.floor(r.normal(size=(1500, 8)) * scale) for scale in (900, 3, 700, 2, 800)]  # each longest first, as written
    x = np.concatenate([f[np.argsort(-(f * f).sum(1))] for f in files])
    ids = np.arange(len(x))
    queries = topk_search.Queries(ids[::500], x[::500], np.eye(8), 4, 5)
    batch = pa.record_batch({"id": pa.array(ids), "v": pa.array(list(x))})
    found = [b.to_pydict() for b in topk_search._task(SimpleNamespace(value=queries))(iter([batch]))]
    got = {(q, v, s) for b in found for q, v, s in zip(b["query_id"], b["vec_id"], b["score"], strict=True)}
    want = set()
    for q in ids[::500].tolist():
        scores = (x @ x[q]).astype(int)
        want |= {(q, int(v), int(scores[v])) for v in sorted(set(ids.tolist()) - {q}, key=lambda v: (-scores[v], v))[:5]}
    assert got == want


def test_sibling_licences_are_unknown(spark):
    siblings = [
        "licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is distributed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ]
    docs = spark.createDataFrame(list(enumerate([*siblings, "Licensed under CC BY-NC 4.0."])), "doc_id bigint, text string")
    got = {r["id"]: (r["families"], r["n_unknown"]) for r in license_scan.summarised(license_scan.scan_licenses(docs)).collect()}
    assert got == dict.fromkeys(range(len(siblings)), ("", 1)) | {len(siblings): ("cc-by-nc-4.0", 0)}
    folds = {label: {fold for y, _, fold, whole in license_scan._labelled(license_scan.MAX_ROWS) if y == label and whole} for label in range(len(license_scan.FAMILIES) + 1)}
    assert all(len(at) > 1 for at in folds.values()) and len(folds[len(license_scan.FAMILIES)]) == license_scan.FOLDS


def slow_notices(text, model):
    """Each paragraph scored by itself in Python."""
    import re

    found = []
    for place, paragraph in enumerate(re.split(license_scan.BREAKS, (text or "").lower())):
        words = license_scan.words_of(paragraph)
        matched = license_scan.grams_of(words) & set(model.weights)
        if not matched:
            continue
        share = license_scan.softmax(license_scan.possible(words, license_scan.scores_of(words, model.weights, model.intercepts)), model.temperature)[: len(model.families)]
        best = max(share)
        family = share.index(best)
        three = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
        templates = [license_scan.words_of(t) for t in license_scan.FAMILIES[model.families[family]]]
        cut = [{" ".join(w[i : i + 3]) for i in range(len(w) - 2)} for w in templates]
        shared = len(three & set().union(*cut))
        sure = best >= model.threshold and shared > 0 and shared >= min(-(-len(three) * license_scan.CONTAINED // 1), min(len(c) or 1 for c in cut))
        if sure or any(re.search("licen|rights reserved|copyright|spdx", g) for g in matched):
            found.append((place, model.families[family] if sure else license_scan.UNKNOWN, pytest.approx(best, abs=1e-9), sure))
    return found


def test_license_scan_is_the_model(spark, sf_dir):
    model = license_scan.train(spark)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    notices = [t for some in license_scan.FAMILIES.values() for t in some] + license_scan.OTHERS
    r = random.Random(3)
    texts += [None, "", *notices, *("\n".join(r.choices(notices, k=3)) for _ in range(40)), *(t[: len(t) // 2] + r.choice(["\n", " \n\n", "\n# "]) + t[len(t) // 2 :] for t in notices)]
    texts += ["# This work is licensed under the\n# GNU General Public License,\n# version 3.\nprint(1)", "a plain line\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    got = {x["id"]: [tuple(n) for n in x["notices"] or []] for x in license_scan.scan_licenses(docs, model).collect()}
    assert got == {i: slow_notices(t, model) for i, t in enumerate(texts)}
    assert [n[1] for n in got[len(texts) - 2]] == ["gpl-3.0"] and [n[1] for n in got[len(texts) - 1]] == ["mit", "apache-2.0"]
