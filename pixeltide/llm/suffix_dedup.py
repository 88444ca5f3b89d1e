"""Removal of repeated byte strings with sorted suffixes, by deep-shallow sorting.

A byte of document d goes if some string of ``length`` bytes that covers it also starts in a document of smaller id.

1. Texts are cut into slices of whole documents, written once as (slice, ids, lengths, bytes).
2. Anchors: among the ``GRAM``-byte strings inside every ``length``-byte window the one of least hash is its anchor,
   so equal windows have equal anchors at equal offsets.  A slice sends each anchor's hash once per bucket of hashes (a
   third of all documents sharing a passage adds one entry per slice), and gets back one bit per hash: is it found in
   two documents or more?
3. Only windows of shared anchors go on.  A slice sends the text around them, each distinct string once with the least
   document that has it, to the anchor's bucket.  Of an anchor that more than ``HOT`` slices have (a passage that a
   third of all documents share, whose ends stand next to ever new text), every window goes by itself, to the bucket of
   its own hash, so that no bucket gathers the surroundings of a frequent anchor.
4. In a bucket, windows whose surroundings differ are sorted: a multikey quicksort, run for all groups at once, orders
   suffixes up to ``SHALLOW`` bytes; groups that still agree are ordered by blind tries, which compare each suffix with
   one other only.  Neighbours that agree in ``length`` bytes form a class; its least document is the answer.
5. A slice gets, per distinct string, the least document of each of its windows, and removes what a smaller one has.

Every message is bounded by its slice or its bucket and travels compressed; the number of buckets follows the input's
bytes.

Defined cases: null text counts as empty; texts shorter than ``length`` lose nothing; a null id counts as larger than
all others; a very long text is a slice of its own, cut nowhere; documents of equal id take nothing from each other; one row
per input row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import batch_of, bounded_batches, free_shuffles, release, written

LENGTH, GRAM = 50, 24
SLICE = 4 << 20
#: Positions looked at together, few enough that their hashes stay in a core's cache.
CHUNK = 1 << 16
SHALLOW = 24
BUCKET_BYTES = 4 << 20
#: Slices with one anchor beyond which its windows are dealt out one by one.
HOT = 256
#: Contexts whose windows are sorted together; groups are never split.
SORTED_CONTEXTS = 4096
NO_DOC = 2**63 - 1
LEAD = [bytes((i,)) for i in range(256)]
MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]
MIX = np.uint64(0xFF51AFD7ED558CCD)


# ---- messages


def packed(data: bytes | np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# ---- anchors


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every position on, built by doubling."""
    powers = [data.astype(np.uint64) + np.uint64(1)]
    width = 1
    while width * 2 <= gram:
        h = powers[-1]
        powers.append(h[:-width] * MULTIPLIERS[len(powers) - 1] + h[width:])
        width *= 2
    n = len(data) - gram + 1
    at, out = 0, np.zeros(n, np.uint64)
    for i in range(len(powers) - 1, -1, -1):
        if gram & (1 << i):
            out = (out ^ (out >> np.uint64(31))) * MIX + powers[i][at : at + n]
            at += 1 << i
    out = (out ^ (out >> np.uint64(33))) * MIX
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their hashes, and the first and last window start that each serves.

    ``ends``: where each document ends; windows that would leave theirs do not count.
    """
    parts = []
    span = length - gram + 1
    for c in range(0, max(0, len(data) - length + 1), CHUNK):
        piece = data[c : c + CHUNK + length - 1]
        h = gram_hashes(piece, gram)
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        some = ends[np.searchsorted(ends, c, side="right") : np.searchsorted(ends, c + len(low) - 1, side="right") + 1]
        upto = np.minimum(some, c + len(low))
        room = np.repeat(some, np.diff(upto, prepend=c)) - np.arange(c, c + len(low))
        inside = np.flatnonzero(room >= length)
        at = (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn = np.flatnonzero(np.diff(at, prepend=-1))
        stop = np.append(turn[1:], len(at)) - 1
        if len(turn):
            parts.append((at[turn] + c, h[at[turn]], inside[turn] + c, inside[stop] + c))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ---- sorting


class BlindTrie:
    """Orders strings of one length with one comparison each.

    A node is [byte depth, {byte: child}]; a leaf is a list of the members that are equal, the first standing for all.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.width = strings, len(strings[0])
        self.root: tuple | list = [0]
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        x, node = self.strings[i], self.root
        while type(node) is tuple:  # blind descent: looks at branching bytes only
            depth, children = node
            node = children.get(x[depth]) or next(iter(children.values()))
        y = self.strings[node[0]]
        if x == y:
            node.append(i)
            return
        differ = (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()
        lcp = self.width - (differ + 7) // 8
        above, node = None, self.root
        while type(node) is tuple and node[0] <= lcp:
            if node[0] == lcp:
                node[1][x[lcp]] = [i]
                return
            above, node = node, node[1][x[node[0]]]
        branch = (lcp, {y[lcp]: node, x[lcp]: [i]})
        if above is None:
            self.root = branch
        else:
            above[1][x[above[0]]] = branch

    def classes(self) -> Iterator[list[int]]:
        """Equal members together, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a big-endian number; zeros stand behind the end."""
    w = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return w[: len(data)]


def sort_suffixes(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort of suffixes by their first ``length`` bytes within given groups (non-decreasing numbers).

    Returns the order, and for every place in it the number of its class: equal groups and equal first bytes.
    """
    n = len(starts)
    order, word = np.arange(n), words_at(data)
    head = np.append(True, groups[1:] != groups[:-1]) if n else np.zeros(0, bool)
    depth = np.zeros(n, np.int64)  # by place, alike within a group
    shallow = min(shallow, length) // 8 * 8
    active = np.arange(n)  # places still in play
    while len(active):  # multikey quicksort, one three-way partition of every group a round
        first = np.flatnonzero(head[active])
        sizes = np.diff(np.append(first, len(active)))
        play = np.repeat((sizes > 1) & (depth[active[first]] < shallow), sizes)
        active = active[play]
        if not len(active):
            break
        first = np.flatnonzero(head[active])
        sizes = np.diff(np.append(first, len(active)))
        which = np.repeat(np.arange(len(first)), sizes)
        keys = word[starts[order[active]] + depth[active]]
        pivot = keys[first + sizes // 2][which]
        side = 1 + (keys > pivot).astype(np.int64) - (keys < pivot)
        code = which * 3 + side
        by = np.argsort(code, kind="stable")
        order[active] = order[active][by]
        code = code[by]
        depth[active] += np.where(code % 3 == 1, 8, 0)
        head[active] = np.append(True, code[1:] != code[:-1])
    if not n:
        return order, order
    # the groups that are left agree in the first ``shallow`` bytes
    first = np.flatnonzero(head)
    sizes = np.diff(np.append(first, n))
    raw = data.tobytes()
    for a, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        members = order[a : a + size].tolist()
        at = starts[members].tolist()
        trie = BlindTrie([raw[p + shallow : p + length] for p in at])
        place = a
        for members_alike in trie.classes():
            head[place] = True
            for i in members_alike:
                order[place] = members[i]
                place += 1
    return order, np.cumsum(head) - 1


# ---- slices


SLICES = "slice bigint, ids array<bigint>, sizes array<bigint>, data binary"


def _cut(limit: int):
    schema = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("data"), strict=True):
                t = t.as_py() or b""
                if texts and held + len(t) > limit:
                    yield batch_of(schema, [number], [ids], [[len(x) for x in texts]], [packed(b"".join(texts), 3)])
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield batch_of(schema, [number], [ids], [[len(x) for x in texts]], [packed(b"".join(texts), 3)])

    return run


class Slice:
    """A slice with its anchors; ``cells`` are the distinct (bucket, key) values, ``cell`` that of each anchor."""

    def __init__(self, row: dict, buckets: int, length: int, gram: int):
        self.ids = row["ids"]
        self.order = np.array([NO_DOC if i is None else i for i in self.ids], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.raw, self.length, self.buckets = unpacked(row["data"]), length, buckets
        self.data = np.frombuffer(self.raw, np.uint8)
        self.at, h, self.first, self.last = anchors(self.data, self.ends, length, gram)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.key_bits = 40
        h = h * MULTIPLIERS[0]  # the least of many hashes is small: spread over all buckets
        h = (h ^ (h >> np.uint64(32))) * MIX
        value = h >> np.uint64(64 - self.key_bits - buckets.bit_length() + 1)
        self.cells, self.cell = np.unique(value, return_inverse=True)
        self.bucket = (self.cells >> np.uint64(self.key_bits)).astype(np.int64)
        self.cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-2))

    def per_bucket(self) -> Iterator[tuple[int, int, int]]:
        """bucket and the range of its cells."""
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield int(self.bucket[a]), a, b

    def flagged(self, marks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the anchors whose cell a bucket found shared, and which of them are hot."""
        bits = {m["bucket"]: m for m in marks}
        shared, hot = np.zeros(len(self.cells), bool), np.zeros(len(self.cells), bool)
        for bucket, a, b in self.per_bucket():
            if bucket in bits:
                shared[a:b] = np.unpackbits(np.frombuffer(bits[bucket]["bits"], np.uint8), count=b - a)
                if bits[bucket]["hot"]:
                    hot[a:b] = np.unpackbits(np.frombuffer(bits[bucket]["hot"], np.uint8), count=b - a)
        flagged = np.flatnonzero(shared[self.cell])
        return flagged, hot[self.cell[flagged]]

    def contexts(self, marks: list[dict]) -> "Contexts":
        """The contexts of all flagged anchors: the text of all windows of an anchor, or of one window of a hot anchor."""
        flagged, hot = self.flagged(marks)
        count = np.where(hot, self.last[flagged] - self.first[flagged] + 1, 1)
        rep = np.repeat(np.arange(len(flagged)), count)
        anchor, single = flagged[rep], hot[rep]
        first = self.first[anchor] + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
        last, bucket = np.where(single, first, self.last[anchor]), self.bucket[self.cell[anchor]]
        if hot.any():
            own = gram_hashes(self.data, self.length)[first[single]]
            bucket[single] = (own >> np.uint64(64 - self.buckets.bit_length() + 1)).astype(np.int64)
        doc, raw = self.doc[anchor], self.raw
        found: dict[int, dict[bytes, int]] = {b: {} for b in np.unique(bucket).tolist()}
        number = []
        for p, end, off, b in zip(first.tolist(), (last + self.length).tolist(), (self.at[anchor] - first).tolist(), bucket.tolist(), strict=True):
            own = found[b]
            number.append(own.setdefault(LEAD[off] + raw[p:end], len(own)))
        return Contexts(first, doc, bucket, np.array(number, np.int64), found)

    def least_of(self, c: "Contexts") -> dict[int, np.ndarray]:
        """By bucket the least document of each distinct context."""
        sizes = np.array([len(own) for own in c.found.values()], np.int64)
        begin = np.cumsum(sizes) - sizes
        place = np.searchsorted(np.fromiter(c.found, np.int64, len(c.found)), c.bucket)
        least = np.full(int(sizes.sum()), NO_DOC)
        np.minimum.at(least, begin[place] + c.number, self.order[c.doc])
        return {b: least[i : i + n] for b, i, n in zip(c.found, begin.tolist(), sizes.tolist(), strict=True)}


class Contexts(NamedTuple):
    """Per context its first window, document, bucket and number within the bucket; and by bucket, in ascending order, each
    distinct context, led by the anchor's offset in it, with its number."""

    first: np.ndarray
    doc: np.ndarray
    bucket: np.ndarray
    number: np.ndarray
    found: dict[int, dict[bytes, int]]


def _send_cells(buckets: int, length: int, gram: int):
    schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                s = Slice(row, buckets, length, gram)
                low, high = np.full(len(s.cells), len(s.sizes)), np.full(len(s.cells), -1)
                np.minimum.at(low, s.cell, s.doc)
                np.maximum.at(high, s.cell, s.doc)
                keys = s.cells.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : s.key_bits // 8]
                out = [(b, row["slice"], keys[a:e].tobytes(), np.packbits(low[a:e] != high[a:e]).tobytes()) for b, a, e in s.per_bucket()]
                yield batch_of(schema, *(list(c) for c in zip(*out, strict=True))) if out else batch_of(schema, [], [], [], [])

    return run


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _shared_cells(limit: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: which keys do two slices or two documents of a slice have, and which more than ``limit`` slices?"""
        keys = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5) for x in table.column("keys")]
        counts = [len(k) for k in keys]
        flat = np.zeros((sum(counts), 8), np.uint8)
        flat[:, :5] = np.concatenate(keys)
        twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(table.column("twice"), counts, strict=True)])
        _, cell, times = np.unique(flat.view("<u8").ravel(), return_inverse=True, return_counts=True)
        shared, hot = (times + np.bincount(cell, twice, len(times)) > 1)[cell], (times > limit)[cell]
        ends = np.cumsum(counts)[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(shared, ends)]
        frequent = [np.packbits(x).tobytes() if x.any() else None for x in np.split(hot, ends)]
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary()), "hot": pa.array(frequent, pa.binary())})

    return run


def _send_contexts(buckets: int, length: int, gram: int):
    schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("sizes", pa.binary()), ("docs", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                s = Slice(row, buckets, length, gram)
                contexts = s.contexts(row["marks"])
                least, out = s.least_of(contexts), []
                for bucket, own in contexts.found.items():
                    sizes = np.fromiter(map(len, own), "<u2", len(own))
                    out.append((bucket, row["slice"], packed(sizes.tobytes()), packed(least[bucket].astype("<i8").tobytes()), packed(b"".join(own))))
                if out:
                    yield batch_of(schema, *(list(c) for c in zip(*out, strict=True)))

    return run


def _portions(groups: list[list[int]], limit: int) -> Iterator[list[list[int]]]:
    held, n = [], 0
    for g in groups:
        if held and n + len(g) > limit:
            yield held
            held, n = [], 0
        held.append(g)
        n += len(g)
    if held:
        yield held


def _least_documents(length: int, gram: int, shallow: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: the least document of every window of every context."""
        met: dict[bytes, int] = {}
        numbers, docs = [], []
        for data, sizes, own in zip(table.column("data"), table.column("sizes"), table.column("docs"), strict=True):
            data, ends = unpacked(data.as_py()), np.cumsum(np.frombuffer(unpacked(sizes.as_py()), "<u2"), dtype=np.int64).tolist()
            numbers.append(np.array([met.setdefault(data[a:b], len(met)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int32))
            docs.append(np.frombuffer(unpacked(own.as_py()), "<i8"))
        keys = list(met)
        least = np.full(len(keys), NO_DOC)
        np.minimum.at(least, np.concatenate(numbers), np.concatenate(docs))
        windows = np.fromiter(map(len, keys), np.int64, len(keys)) - length  # a key has one byte more than its text
        ends = np.cumsum(windows)
        begin = ends - windows
        answer = np.repeat(least, windows)
        # contexts of one anchor that differ: their windows are sorted
        groups: dict[bytes, list[int]] = {}
        for i, key in enumerate(keys):
            groups.setdefault(key[1 + key[0] : 1 + key[0] + gram], []).append(i)
        for several in _portions([g for g in groups.values() if len(g) > 1], SORTED_CONTEXTS):
            flat = np.array([i for g in several for i in g], np.int64)
            group = np.repeat(np.arange(len(several)), [len(g) for g in several])
            data = np.frombuffer(b"".join([keys[i][1:] for i in flat.tolist()]), np.uint8)
            size = windows[flat] + length - 1
            base = np.cumsum(size) - size
            count = windows[flat]
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            starts = np.repeat(base, count) + inner
            slot = np.repeat(begin[flat], count) + inner
            offset = np.repeat(np.array([keys[i][0] for i in flat.tolist()], np.int64), count) - inner  # of the anchor in its window
            code = np.repeat(group, count) * 256 + offset
            by = np.argsort(code, kind="stable")
            starts, slot, code = starts[by], slot[by], code[by]
            order, kind = sort_suffixes(data, starts, code, length, shallow)
            firsts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            docs = np.minimum.reduceat(answer[slot[order]], firsts)
            answer[slot[order]] = docs[kind]
        # runs of equal answers within a context
        new = np.append(True, answer[1:] != answer[:-1]) if len(answer) else np.zeros(0, bool)
        new[begin] = True
        run_at = np.flatnonzero(new)
        run_size = np.diff(np.append(run_at, len(answer)))
        run_first = np.searchsorted(run_at, begin)
        run_count = np.diff(np.append(run_first, len(run_at)))
        replies = []
        for own in numbers:
            n = run_count[own]
            pick = np.repeat(run_first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            replies.append(tuple(packed(x.tobytes()) for x in (n.astype("<u1"), run_size[pick].astype("<u1"), answer[run_at[pick]].astype("<i8"))))
        made = [pa.array(c, pa.binary()) for c in zip(*replies, strict=True)]
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "runs": made[0], "sizes": made[1], "docs": made[2]})

    return run


def _removed(s: Slice, marks: list[dict], replies: list[dict]) -> np.ndarray:
    """True for every byte of the slice that goes."""
    delta = np.zeros(len(s.data) + 1, np.int32)
    own = s.contexts(marks)
    by_bucket, number = np.argsort(own.bucket, kind="stable"), own.number
    sorted_bucket = own.bucket[by_bucket]
    for r in replies:
        mine = by_bucket[np.searchsorted(sorted_bucket, r["bucket"]) : np.searchsorted(sorted_bucket, r["bucket"], side="right")]
        runs = np.frombuffer(unpacked(r["runs"]), np.uint8).astype(np.int64)
        size, doc = np.frombuffer(unpacked(r["sizes"]), np.uint8).astype(np.int64), np.frombuffer(unpacked(r["docs"]), "<i8")
        first = (np.cumsum(runs) - runs)[number[mine]]
        n = runs[number[mine]]
        pick = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        total = np.cumsum(size[pick]) - size[pick]  # windows before, over all picked runs
        start_of = np.repeat(own.first[mine], n) + total - np.repeat(total[np.cumsum(n) - n], n)
        goes = doc[pick] < np.repeat(s.order[own.doc[mine]], n)
        np.add.at(delta, start_of[goes], 1)
        np.add.at(delta, start_of[goes] + size[pick][goes] - 1 + s.length, -1)
    return np.cumsum(delta[:-1]) > 0


KEPT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _finish(buckets: int, length: int, gram: int, with_text: bool):
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                data, at, out = unpacked(row["data"]), 0, []
                gone = _removed(Slice(row, buckets, length, gram), row["marks"], row["replies"]) if row["replies"] else np.zeros(len(data), bool)
                for i, size in zip(row["ids"], row["sizes"], strict=True):
                    mask = gone[at : at + size]
                    removed = int(mask.sum())
                    spans = int((mask[1:] > mask[:-1]).sum()) + int(size and mask[0]) if removed else 0
                    kept = np.frombuffer(data, np.uint8)[at : at + size][~mask].tobytes() if removed else data[at : at + size]
                    at += size
                    out.append((i, size, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
                yield batch_of(schema, *(list(c) for c in zip(*out, strict=True)))

    return run


def bucket_count(total_bytes: int, gram: int = GRAM, length: int = LENGTH, target: int = BUCKET_BYTES) -> int:
    """A power of two that keeps a bucket's keys near ``target`` bytes."""
    keys = 5 * total_bytes * 2 / (length - gram + 2)
    n = 16
    while n * target < keys:
        n *= 2
    return n


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, shallow: int = SHALLOW, slice_bytes: int = SLICE, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept on request."""
    if not 8 <= gram <= length <= 250:
        raise ValueError("8 <= gram <= length <= 250")
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("data"))
    slices = written(rows.mapInArrow(_cut(slice_bytes), SLICES), "slices")
    total = slices.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] or 0
    buckets = bucket_count(total, gram, length)
    cells = slices.mapInArrow(_send_cells(buckets, length, gram), "bucket int, slice bigint, keys binary, twice binary")
    bits = cells.groupBy("bucket").applyInArrow(_shared_cells(hot), "slice bigint, bucket int, bits binary, hot binary")
    marks = written(bits.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("marks")), "marks")
    free_shuffles(spark)
    sent = slices.join(marks, "slice").mapInArrow(_send_contexts(buckets, length, gram), "bucket int, slice bigint, sizes binary, docs binary, data binary")
    least = sent.groupBy("bucket").applyInArrow(_least_documents(length, gram, shallow), "slice bigint, bucket int, runs binary, sizes binary, docs binary")
    replies = least.groupBy("slice").agg(F.collect_list(F.struct("bucket", "runs", F.col("sizes"), "docs")).alias("replies"))
    replies = written(replies, "replies")
    free_shuffles(spark)
    done = slices.join(marks, "slice", "left").join(replies, "slice", "left")
    out = written(done.mapInArrow(_finish(buckets, length, gram, with_text), KEPT + ", kept binary" * with_text), "kept")
    release(slices, marks, replies)
    return out
