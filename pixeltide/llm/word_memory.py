"""Tokenizers on the executors, and a memory of encoded words.

The tokenizer's JSON is read by the driver and broadcast; files above ``MAX_MODEL_BYTES`` are refused.  If white space
only separates - neither normalisation nor pre-tokenisation reaches across it, as ``drops_space`` reads from the
tokenizer's own description - a text's ids are its words' ids in order, so that every distinct word goes through the
library once.  Texts are split and their words numbered and looked up in Arrow; simple letters with punctuation behind
them are two pre-tokens, remembered apart.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

MAX_MODEL_BYTES = 64 << 20
#: Words kept by a Python worker; beyond that the half used last stays, which changes nothing but speed.
MEMORY = 600_000
#: A look-up passes over all known words; parts of words of which there are fewer than one for so many known ones are encoded anew.
FEW = 8
#: Signs that, behind letters and before white space, are a pre-token of their own.
PUNCTUATION = ".,!?;:*#$%&"
#: Letters below U+0250 that normalisation leaves one letter each; none composes with its neighbours.
SIMPLE = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower().isalpha())
SIMPLE_WORD = f"^[{''.join(sorted(SIMPLE))}]+$"
#: Words with more signs behind them are encoded whole.
MOST_SIGNS = 8
IS_SIGN = np.isin(np.arange(256), np.frombuffer(PUNCTUATION.encode(), np.uint8))
#: Marks that may compose with an ASCII letter: a text with one keeps its case until the library has composed it.
MARKS = "[\u0300-\u036f]"
#: Fixed value: the pre-tokens of a tokenizer whose words may be encoded one by one; none holds white space.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def broadcast_model(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast string; its size is checked before."""
    if (n := os.path.getsize(path)) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has {n} bytes, more than {MAX_MODEL_BYTES}")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=4)
def tokenizer_of(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(model)
    made.no_truncation()
    made.no_padding()
    return made


def gathered(flat: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs at these places, one after the other, and the length of each; ``flat`` holds all runs in order.

    Arrow copies run by run, which needs no index of every element.
    """
    if not len(at):
        return flat[:0], length[:0]
    offsets = np.concatenate([[0], np.cumsum(length)]) * flat.itemsize
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    lengths, data = length[at], runs.take(pa.array(at)).buffers()[2]
    return np.frombuffer(data, flat.dtype, int(lengths.sum())) if data else flat[:0], lengths


class Words:
    """Distinct words in Arrow, their ids in one flat table, and the round in which each was asked for last."""

    def __init__(self, width: str):
        self.known, self.length, self.flat, self.used, self.round = pa.array([""]), np.zeros(1, np.int64), np.zeros(0, width), np.zeros(1, np.int64), 0

    def places(self, words: pa.Array, learn) -> np.ndarray:
        """Place of every word; ``learn`` gives ids and lengths of those that are new."""
        both = pa.chunked_array([self.known, words]).dictionary_encode().chunk(1)  # one dictionary: the known words, then the new ones
        if len(new := both.dictionary.slice(len(self.known))):
            ids, lengths = learn(new.to_pylist())
            self.known = both.dictionary
            self.flat, self.length = np.concatenate([self.flat, ids.astype(self.flat.dtype)]), np.concatenate([self.length, lengths])
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        place = both.indices.to_numpy()
        self.round += 1
        self.used[place] = self.round
        return place

    def forget(self, most: int) -> None:
        """Keep the empty word and at most ``most`` others, those used last."""
        stays = np.append(0, 1 + np.sort(np.argsort(-self.used[1:], kind="stable")[:most]))
        self.flat, self.length = gathered(self.flat, self.length, stays)
        self.known, self.used = self.known.take(pa.array(stays)), self.used[stays]


def in_parts(words: pa.Array) -> pa.Array:
    """Every word in two parts over the same bytes: simple letters and the punctuation behind them (two pre-tokens), or all of
    the word and nothing."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    begin, end = offsets[:-1], offsets[1:]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    core, live = end.copy(), np.flatnonzero(end > begin)
    for _ in range(MOST_SIGNS):
        live = live[IS_SIGN[raw[core[live] - 1]]]
        core[live] -= 1
        live = live[core[live] > begin[live]]
        if not len(live):
            break

    def parted() -> pa.Array:
        ends = np.column_stack([core, end]).ravel()
        return pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(np.append(offsets[:1], ends).astype(np.int32)), data)

    ended = np.flatnonzero(core < end)
    odd = ended[~pc.match_substring_regex(parted().take(pa.array(2 * ended)), SIMPLE_WORD).to_numpy(zero_copy_only=False)]
    core[odd] = end[odd]
    return parted()


class WordMemory:
    """Words between ASCII white space, each encoded by the library once."""

    def __init__(self, tokenizer, end_id: int, width: str):
        self.tokenizer, self.width = tokenizer, width
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end_id = end_id
        self.words = Words(width)

    def learn(self, words: list[str], at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has: letters first, then all others."""
        plain, odd = [], []
        for i, w in enumerate(words):
            (plain if w.isalpha() else odd).append(i)
        chunks = [plain[i : i + at_once] for i in range(0, len(plain), at_once)]
        ids, lengths, order = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for some, e in zip(chunks, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in c]) for c in chunks], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.int64)
            ends = np.flatnonzero(self.closes[np.minimum(got, len(self.closes) - 1)]) + 1
            if len(ends) != len(some):  # some word is more than one pre-token
                odd += some
                continue
            ids.append(got)
            lengths.append(np.diff(ends, prepend=0))
            order += some
        for i in range(0, len(odd), at_once):
            some = odd[i : i + at_once]
            e = self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False)
            at = np.fromiter((s for s, _ in e.offsets), np.int64, len(e.ids))
            starts = np.cumsum([0] + [len(words[i]) + 1 for i in some])[:-1]
            ids.append(np.array(e.ids, np.int64))
            lengths.append(np.diff(np.append(np.searchsorted(at, starts), len(at))))
            order += some
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return gathered(np.concatenate(ids), np.concatenate(lengths), place)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths of the distinct words, which of them each word of the texts is, and behind which word each text ends."""
        texts = pc.fill_null(texts, "")
        cased = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, MARKS))  # special strings keep their case
        low = pc.if_else(cased, texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(low)
        words = split.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        if not len(words):
            return np.zeros(0, self.width), np.zeros(0, np.int64), np.zeros(0, np.int64), ends
        parts = in_parts(words.dictionary.cast(pa.string()))
        if len(self.words.known) > MEMORY:
            self.words.forget(MEMORY // 2)
        held = self.words if len(parts) * FEW > len(self.words.known) else Words(self.width)
        place = held.places(parts, self.learn)  # before the table, which it may lengthen
        ids, lengths = gathered(held.flat, held.length, place)
        return ids, lengths.reshape(-1, 2).sum(1), words.indices.to_numpy(), ends

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, without the end id."""
        _, lengths, word, ends = self._split(texts)
        upto = np.concatenate([[0], np.cumsum(lengths[word])])
        return np.diff(upto[ends], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the end id, and the number of ids of each."""
        ids, lengths, word, ends = self._split(texts)
        ids, lengths = gathered(np.append(ids, np.array([self.end_id], self.width)), np.append(lengths, 1), np.insert(word, ends, len(lengths)))
        upto = np.cumsum(lengths)
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)


def longest_special(model: str) -> int:
    """Characters of the longest added token; those that take in or depend on what stands around them are refused."""
    added = json.loads(model).get("added_tokens") or []
    if odd := [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or not t["content"] or any(c.isspace() for c in t["content"])]:
        raise ValueError(f"added tokens that reach beyond their own text: {odd}")
    return max((len(t["content"]) for t in added), default=0)


def drops_space(model: str) -> bool:
    """Whether white space only separates and ASCII case is ignored: NFC, white space to blanks, lower case, then pre-tokens
    without white space, as the tokenizer's description states it."""
    d = json.loads(model)
    first = d.get("normalizer") or {}
    first = first["normalizers"] if first.get("type") == "Sequence" else [first]
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    second = d.get("pre_tokenizer") or {}
    second = second["pretokenizers"] if second.get("type") == "Sequence" else [second]
    split = {"type": "Split", "pattern": {"Regex": PRE_TOKENS}, "behavior": "Removed", "invert": True}
    return first == [{"type": "NFC"}, blanks, {"type": "Lowercase"}] and [split] == second[:1] and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in second[1:]] == [("ByteLevel", False, False)]


class WholeTexts:
    """Any other tokenizer: every text goes through the library whole."""

    def __init__(self, tokenizer, end_id: int, width: str):
        self.tokenizer, self.end_id, self.width = tokenizer, end_id, width

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(e) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids + [self.end_id] for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for r in rows for i in r], self.width), np.array([len(r) for r in rows], np.int64)


@lru_cache(maxsize=1)
def encoder_of(model: str, end_id: int = 0, width: str = "<u4"):
    """Kept by a Python worker from task to task."""
    longest_special(model)
    return (WordMemory if drops_space(model) else WholeTexts)(tokenizer_of(model), end_id, width)
