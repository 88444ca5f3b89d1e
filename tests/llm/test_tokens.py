"""Token ids and counts against the tokenizers library on odd letters, marks and special strings."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pixeltide.llm import token_counts, token_store, word_memory

WORD = str(public_tokenizers.path("word_bpe_49k.json"))
PARTS = [
    *"abzKTIHJWY .,!?'-_<|>\n\t\r\x0b\x0c  \u0085\u001c\u200b", *"İẞßſŉǰΣσςéÉÅ\u212a\u2126ﬁᾳᾼǄǅ१²ª中文😀𐐀𝐀", *map(chr, range(0x958, 0x960)), *"\u0308\u0307\u0331\u030a\u030c\u0327\u0301",
    *"\ufb1d\ufb1f\ufb2a\u05d0\u05bc\u1100\u1161\uac00\u11a8", "<|endoftext|>", "<|startoftext|>", "<|END", "hello", "World", "the", "'s", "'LL",
]


def strings(seed, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_remembered_words_are_the_librarys(seed):
    model, t = open(WORD, encoding="utf-8").read(), Tokenizer.from_file(WORD)
    encoder = word_memory.WordMemory(word_memory.tokenizer_of(model), 2, "<u4")
    for at in range(10):
        texts = ["İ!", "\u0921\u093c.", "T\u0308.", *strings((seed, at).__hash__(), 500, 14)]
        ids, n = encoder.encode(pa.array(texts))
        ends = np.cumsum(n)
        assert [ids[a:b].tolist() for a, b in zip(ends - n, ends)] == [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_and_stores_on_both_sides_of_a_chunk(spark):
    t = Tokenizer.from_file(WORD)
    long = [" ".join(strings(s, n, 14)) for s, n in ((1, 1500), (2, 2400), (3, 2600), (4, 9000))]
    edge = [("wort und İ! " * 4000)[: token_counts.CHUNK + d] for d in (-1, 0, 1, 2)]
    texts = ["İ!", "\u095c.", "", None, *strings(9, 400, 30), *long, *edge, "x" * 50_000, ("İ" * 300 + ".") * 100]
    assert any(len(x or "") > token_counts.CHUNK for x in long)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert {r["id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, WORD).collect()} == want
    assert {r["id"]: r["n_tokens"] - 1 for r in token_store.stored_tokens(docs, WORD).collect()} == want


def test_tokenizers_are_known_by_their_description():
    model = json.load(open(WORD, encoding="utf-8"))
    assert word_memory.drops_space(json.dumps(model))
    assert not word_memory.drops_space(open(str(public_tokenizers.path("byte_bpe_50k.json")), encoding="utf-8").read())
    other = model | {"normalizer": {"type": "Sequence", "normalizers": [*model["normalizer"]["normalizers"], {"type": "StripAccents"}]}}
    assert not word_memory.drops_space(json.dumps(other))
    model["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        word_memory.longest_special(json.dumps(model))
