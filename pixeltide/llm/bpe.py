"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of many texts are looked up in a memory; those not yet known form one flat array of symbols.  A round looks
up all adjacent pairs by binary search over the sorted pair keys, takes each word's lowest rank (``minimum.reduceat``),
merges that pair everywhere in the word from left to right, and drops finished words.  A word longer than
``LONG_WORD`` bytes, which could need as many rounds as it has bytes, is merged with a heap instead; the result is the
same.  Special tokens are cut out of the text first, leftmost and longest first, as the library does.

Decoding gathers the bytes of all ids of a batch from one table and decodes UTF-8 with replacement.

The vocabulary JSON must be a byte-level BPE without normaliser, as its reader checks; driver reads it, broadcasts it.

Defined cases: a very long text is encoded whole, its words in batches; null text counts as empty (no ids, empty text); ids may be null or repeated (one row per input row); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import batch_of, bounded_batches, slices
from pixeltide.llm.word_memory import broadcast_model, longest_special

#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
MEMORY = 200_000
NO_RANK = np.int64(1 << 60)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        longest_special(text)  # refuses added tokens that are not plain strings
        if spec.get("normalizer") or model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("ignore_merges") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE")
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        self.first = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int64)
        if (self.first < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.specials.values(), 0)
        self.size = size
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        pieces: list[bytes] = [b""] * size
        for word, i in vocab.items():
            pieces[i] = bytes(back[c] for c in word)
        for word, i in self.specials.items():
            pieces[i] = word.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.words = regex.compile(PATTERN)
        found = sorted(self.specials, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        self.memory: dict[str, bytes] = {}

    # ---- encoding

    def _look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        hit = self.keys[at] == pairs
        return np.where(hit, self.ranks[at], NO_RANK), at

    def merge_rounds(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words are not empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        if not len(self.keys):
            return [self.first[np.frombuffer(w, np.uint8)].astype(np.uint32) for w in words]
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        pair_rank = None
        while len(symbols):
            same = word[1:] == word[:-1]
            if pair_rank is None:
                pair_rank, at = self._look_up(np.where(same, symbols[:-1] * self.size + symbols[1:], -1))
            rank = np.append(pair_rank, NO_RANK)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(word)))
            live = lowest < NO_RANK
            if not live.all():
                done = np.repeat(~live, counts)
                for i, ids in zip(word[starts[~live]].tolist(), np.split(symbols[done].astype(np.uint32), np.cumsum(counts[~live])[:-1]), strict=True):
                    out[i] = ids
                keep = ~done
                symbols, word, rank, lowest, counts = symbols[keep], word[keep], rank[keep], lowest[live], counts[live]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, counts)
            if len(runs := np.flatnonzero(hit[1:] & hit[:-1])):  # overlapping pairs, as in aaa: every second one of a run counts
                index = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), index, 0))
                hit &= (index - begin) % 2 == 0
            pos = np.flatnonzero(hit)
            pairs = symbols[pos] * self.size + symbols[pos + 1]
            symbols[pos] = self.made[np.searchsorted(self.keys, pairs)]
            keep = np.ones(len(symbols), bool)
            keep[pos + 1] = False
            # only pairs that touch a merged symbol have a new rank
            rank[pos] = -1
            rank[pos[pos > 0] - 1] = -1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            pair_rank = rank[:-1]
            stale = np.flatnonzero(pair_rank == -1)
            fresh = np.where(word[stale + 1] == word[stale], symbols[stale] * self.size + symbols[stale + 1], -1)
            pair_rank[stale], _ = self._look_up(fresh)
        return out

    def merge_heap(self, word: bytes) -> np.ndarray:
        """The same for one long word: a heap of (rank, place) over a linked list."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, size = self.by_pair.get, self.size
        heap = [(hit[0], i, ids[i], ids[i + 1], hit[1]) for i in range(n - 1) if (hit := get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (hit := get(ids[x] * size + ids[y])):
                    heapq.heappush(heap, (hit[0], x, ids[x], ids[y], hit[1]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def _learn(self, words: set[str]) -> None:
        known = self.memory
        short, texts = [], []
        for w in words:
            b = w.encode()
            if len(b) > LONG_WORD:
                known[w] = self.merge_heap(b).tobytes()
            else:
                short.append(b)
                texts.append(w)
        for i in range(0, len(short), 50_000):
            for w, ids in zip(texts[i : i + 50_000], self.merge_rounds(short[i : i + 50_000]), strict=True):
                known[w] = ids.tobytes()

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        find, special = self.words.findall, self.specials
        parts: list[list[str]] = []
        for t in texts:
            if self.cut is not None and any(s in t for s in special):
                pieces = self.cut.split(t)
                parts.append([w for i, p in enumerate(pieces) for w in ([p] if i % 2 else find(p))])
            else:
                parts.append(find(t))
        known = self.memory
        if len(known) > MEMORY:
            known.clear()
        for s, i in special.items():
            known[s] = np.array([i], np.uint32).tobytes()
        new = set().union(*map(set, parts)).difference(known) if parts else set()
        self._learn(new)
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    # ---- decoding

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.piece_len[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.piece_at[ids] - (ends - lengths), lengths)
        return self.piece_bytes[shift + np.arange(len(shift))].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def bpe_of(model: str) -> ByteBpe:
    return ByteBpe(model)


def _encode(model):
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(model.value)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode_texts([t or "" for t in part.column("text").to_pylist()])
                yield batch_of(schema, part.column("id"), [len(x) // 4 for x in ids], ids)

    return run


def _decode(model):
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(model.value)
        for batch in batches:
            for part in slices(batch, "ids"):
                yield batch_of(schema, part.column("id"), [bpe.decode_text(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()])

    return run


def _round_trip(model):
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(model.value)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode_texts([t or "" for t in part.column("text").to_pylist()])
                back = [bpe.decode_text(np.frombuffer(x, "<u4")).encode() for x in ids]
                yield batch_of(schema, part.column("id"), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in back])

    return run


def _rows(docs: DataFrame, id_col: str, column: str, name: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(column).alias(name))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids (little-endian u32)."""
    model = broadcast_model(docs.sparkSession, model_path)
    return _rows(docs, id_col, text_col, "text").mapInArrow(_encode(model), "id bigint, n_tokens bigint, ids binary")


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", id_col: str = "id") -> DataFrame:
    """id, text."""
    model = broadcast_model(tokens.sparkSession, model_path)
    return _rows(tokens, id_col, ids_col, "ids").mapInArrow(_decode(model), "id bigint, text string")


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens and the digests of ids and decoded text: encoding and decoding in one task, ids never leave it."""
    model = broadcast_model(docs.sparkSession, model_path)
    return _rows(docs, id_col, text_col, "text").mapInArrow(_round_trip(model), "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
