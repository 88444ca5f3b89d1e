"""The near-duplicate search sends few rows and each text's shingles once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixeltide.llm import simhash


def test_a_wide_radius_is_searched_by_one_mask_more_than_its_bits(spark):
    fps = np.random.default_rng(5).integers(-(2**63), 2**63, 4000)
    distinct = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    radius = simhash.radius_for(0.8)
    masks = simhash.layout(distinct, len(fps), radius)
    assert len(masks) == radius + 1
    assert sum(m & 2**64 - 1 for m in masks) == 2**64 - 1  # they part the bits, so some mask misses every difference


def test_islands_are_what_candidates_connect():
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, (6, 2)).astype(np.uint64)
    fps = np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, (20, 2)).astype(np.uint64)) for b in base] + [r.integers(0, 2**63, (30, 2)).astype(np.uint64)])
    found = {frozenset(x.tolist()) for x in simhash.islands(fps, 11, 30)}
    assert found == {frozenset(range(i, i + 20)) for i in range(0, 120, 20)}


@pytest.mark.parametrize("most", [0, 3000, simhash.CROWD_BYTES])
def test_groups_whole_or_by_pairs_give_the_same_links(spark, most):
    r = random.Random(9)
    base = [[f"w{r.randrange(10**6)}" for _ in range(60 + 40 * (g % 3))] for g in range(12)]
    texts = [" ".join(w if r.random() > 0.02 else f"x{r.randrange(10**9)}" for w in base[i % 12]) for i in range(90)]
    texts += texts[:5]  # rows repeated
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    radius, reach, least = simhash.radius_for(0.8), simhash.reach_for(0.8), 0.8
    nodes = simhash.fingerprints(docs, shingle=5, words=2, distinct=True).select(F.col("content").alias("node"), "fp", "fp1", "shingles").distinct().localCheckpoint()
    pairs, crowds = simhash.candidates(nodes.select("node", "fp", "fp1"), radius, reach, 2, dense=1)
    with simhash.scratch():
        links = [tuple(x) for x in simhash.similar_pairs(pairs, crowds, nodes, docs, "text", 5, radius, reach, 2, least, most).collect()]
    at = {x["node"]: set(simhash.distinct_shingles(x["text"].encode(), 5).tolist()) for x in docs.select(F.xxhash64("text").alias("node"), "text").collect()}
    words = {x["node"]: np.array([x["fp"], x["fp1"]], np.int64).view(np.uint64) for x in nodes.collect()}
    assert all(len(at[a] & at[b]) >= least * len(at[a] | at[b]) for a, b in links)
    shown = [(a, b) for a in at for b in at if a < b and len(at[a] & at[b]) >= least * len(at[a] | at[b]) and simhash._within(words[a] ^ words[b], radius, reach)]

    def roots(edges):
        root = {n: n for n in at}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {n: find(n) for n in at}

    assert len(shown) > 50 and roots(links) == roots(shown)
