"""Frequent words go through the library once, however many rare ones pass."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pixeltide.llm import word_memory

WORD = str(public_tokenizers.path("word_bpe_49k.json"))


class Counting:
    """The library's tokenizer, counting the words that it is sent."""

    def __init__(self, tokenizer):
        self.tokenizer, self.sent = tokenizer, Counter()

    def get_vocab(self, **options):
        return self.tokenizer.get_vocab(**options)

    def encode(self, text, **options):
        self.sent.update(text.split())
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        for text in texts:
            self.sent.update(text.split())
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.fixture
def counting():
    return Counting(word_memory.tokenizer_of(open(WORD, encoding="utf-8").read()))


def words(r, n):
    return ["".join(r.choice("abcdeghilnorstuäñé") for _ in range(r.randrange(4, 12))) for _ in range(n)]


def same(memory, tokenizer, texts):
    ids, n = memory.encode(pa.array(texts))
    want = [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert memory.count(pa.array(texts)).tolist() == [len(w) - 1 for w in want]


def test_frequent_words_outlive_rare_ones(counting, monkeypatch):
    monkeypatch.setattr(word_memory, "MEMORY", 4000)
    r = random.Random(3)
    memory, common = word_memory.WordMemory(counting, 2, "<u2"), words(r, 900)
    for _ in range(20):
        some = common + words(r, 600)
        r.shuffle(some)
        same(memory, counting.tokenizer, [" ".join(some[i : i + 50]) for i in range(0, len(some), 50)])
    assert max(counting.sent[w] for w in common) == 1


def test_words_are_known_with_any_punctuation_behind_them(counting):
    r = random.Random(4)
    memory, common = word_memory.WordMemory(counting, 2, "<u2"), words(r, 500)
    for signs in ["", ".", ",!!", "&&&", "." * word_memory.MOST_SIGNS]:
        same(memory, counting.tokenizer, [w + signs for w in common])
    assert max(counting.sent[w] for w in common) == 1 and not any(counting.sent[w + "."] for w in common)
    odd = ["!" * 9, "a" + "!" * 9, "?", "é.", "ŉ!", "İ,", "x'll.", "<|endoftext|>.", "12.", "", " ", "a.b.", "中.", "e.́ f."]
    same(memory, counting.tokenizer, odd)


def test_a_short_text_is_not_looked_up_among_many_words(counting):
    memory = word_memory.WordMemory(counting, 2, "<u2")
    same(memory, counting.tokenizer, words(random.Random(5), 5000))
    known = len(memory.words.known)
    same(memory, counting.tokenizer, ["some words, seen nowhere else"])
    assert len(memory.words.known) == known
    ids, n = memory.encode(pa.array([], pa.string()))
    assert (len(ids), len(n), ids.dtype) == (0, 0, np.dtype("<u2"))
