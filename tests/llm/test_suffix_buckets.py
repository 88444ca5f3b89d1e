"""Anchors, whose hashes are the least of many, are dealt evenly over the buckets."""

import random

import numpy as np

from pixeltide.llm import suffix_dedup


def test_buckets_hold_equal_parts_of_the_anchors():
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10**5)}" for _ in range(400)).encode() for _ in range(200)]
    row = {"ids": list(range(200)), "sizes": [len(t) for t in texts], "data": suffix_dedup.packed(b"".join(texts))}
    made = suffix_dedup.Slice(row, 64, suffix_dedup.LENGTH, suffix_dedup.GRAM)
    held = np.bincount(made.bucket, minlength=64)
    assert held.min() > 0.7 * held.mean() and held.max() < 1.3 * held.mean()


def test_contexts_are_numbered_by_bucket_with_their_least_document():
    r = random.Random(8)
    base = [bytes(r.randrange(97, 123) for _ in range(120)) for _ in range(3)]
    texts = [base[i % 3] if i % 4 else base[i % 3][:90] + bytes(r.randrange(97, 123) for _ in range(40)) for i in range(24)]
    row = {"ids": list(range(100, 76, -1)), "sizes": [len(t) for t in texts], "data": suffix_dedup.packed(b"".join(texts))}
    made = suffix_dedup.Slice(row, 16, suffix_dedup.LENGTH, suffix_dedup.GRAM)
    marks = [{"bucket": b, "bits": np.packbits(np.ones(e - a, bool)).tobytes(), "hot": None} for b, a, e in made.per_bucket()]
    found = made.contexts(marks)
    least = made.least_of(found)
    want = {}
    for first, last, at, b, n, doc in zip(made.first, made.last, made.at, found.bucket, found.number, found.doc, strict=True):
        key = bytes((at - first,)) + made.raw[first : last + suffix_dedup.LENGTH]
        assert list(found.found[int(b)]).index(key) == n
        want[int(b), key] = min(want.get((int(b), key), 10**9), row["ids"][doc])
    assert {(b, k): int(least[b][n]) for b, own in found.found.items() for k, n in own.items()} == want
