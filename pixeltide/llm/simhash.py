"""SimHash near-deduplication with the general pigeonhole principle.

Fingerprints: A-Z lower-cased, words, shingles of ``SHINGLE`` words (a shorter text as a whole), XXH64 with seed 42;
a bit is 1 if over half the hashes have it.  Two fingerprints link at ``RADIUS`` or fewer differing bits.

Search over distinct fingerprints, all counts from all of them:

* correlated bits are grouped: a 64 x 64 table of co-occurrences drives a greedy grouping into 1 to 4 partitions;
* general pigeonhole: with thresholds T_i whose T_i + 1 add up to RADIUS + 1, two linked fingerprints differ in at most
  T_i bits within some partition i (T_i = -1: the partition is not searched);
* dynamic programming allocates the thresholds: the cost of partition i at T is its probe rows plus its estimated
  candidate pairs - exact collision counts at T = 0, carried on with the agreement rates of its bits - and the layout
  with the least total is used.  As the table grows the choice moves by itself from few probes to selective ones;
* probe: a fingerprint goes to one bucket per searched partition and set of T bits left out of it;
* verify: the members of a bucket are compared by popcount, as runs of a sorted stream; only a spanning forest of the
  links found leaves the task, never its pairs.  A run of more than ``RUN`` distinct fingerprints is not compared:
  its members go to a second search in which every choice of RADIUS bits is masked, so that equal keys are links, which
  needs no comparison and no more memory than the first member.

With ``similarity`` a link needs that share of common shingles (Jaccard), and fingerprints only find candidates: they are
taken of distinct shingles and have ``WORDS`` words of 64 bits, each of its own hash.  Every word is searched by itself; a
pair is a candidate if some word differs in at most ``radius`` bits and all words together in at most ``reach``.
``radius_for`` gives the least radius at which ``RECALL`` of the pairs of just that similarity are candidates, ``reach_for``
a reach that ``REACHED`` of them keep; unrelated texts, for which one word may be near by chance, differ in the others.
Nodes are then distinct texts.  A candidate that several words or masks show is taken from the first of them.  A bucket
with more than ``DENSE`` new pairs per member, as a large group of near copies makes it, sends the members that candidates
connect as a crowd instead.  What pairs and crowds connect is a group: the shingles of its texts meet in one task, each
text's once, which tries the nearest and the member of most neighbours first and then every pair not yet connected, and
sends a spanning forest of the links verified.  Of groups of more than ``CROWD_BYTES`` of shingles every pair is verified
by itself, and crowds meet block by block.  Members of an oversized bucket are dealt out again by the bits the bucket left open.  So texts whose
fingerprints are candidates and that share enough shingles are always connected.

Defined cases: a very long text is cut into words a piece at a time, whole; null text counts as empty; no words give fingerprint 0, linked like any other; a null id never is a
component's id unless all its ids are null; repeated rows share a fingerprint and a component; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import batch_of, bounded_batches, free_shuffles, fresh, kept, key_filter, scratch, slices, split_by, written
from pixeltide.llm.components import components

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
RUN = 16_384
#: The same for fingerprints that find candidates, whose masks are coarser.
WIDE_RUN = 1 << 16
DENSE = 8
#: Words of a fingerprint that finds candidates; the shares of pairs of the least similarity that radius and reach keep.
WORDS, RECALL, REACHED = 2, 0.92, 0.995
#: Bytes of shingles of one block of a crowd; a task holds two.
CROWD_BYTES = 8 << 20
#: Rows of the candidate search: a pair of nodes, (mask, node) of an oversized bucket, (crowd, node).
PAIR, OVER, CROWD = 0, 1, 2
#: Bytes of one text cut into words at a time.
PIECE = 4 << 20
#: Relative cost of shuffling one probe and of comparing one pair.
ROW_COST, PAIR_COST = 1.0, 0.001


# ---- fingerprints


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a few megabytes at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end : end + 1].split():
            end += 1
        yield text[at:end].split()
        at = end


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles; a shorter text that has words is one shingle."""
    digest, n, tail = xxhash.xxh64_intdigest, 0, []
    for words in _pieces(text.lower()):
        words = tail + words
        if len(words) >= shingle:
            made = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            n += 1
            yield np.fromiter(map(digest, made, repeat(SEED)), "<u8", len(words) - shingle + 1)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not n and tail:
        yield np.array([digest(b" ".join(tail), SEED)], "<u8")


def _remixed(h: np.ndarray, word: int) -> np.ndarray:
    """Hashes as another function of the same shingles; word 0 leaves them as they are."""
    if not word:
        return h
    h = (h ^ np.uint64(word * 0x9E3779B97F4A7C15 & 2**64 - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _bits_of(hashes: Iterator[np.ndarray], words: int) -> list[int]:
    ones, n = np.zeros((words, BITS), np.int64), 0
    for h in hashes:
        for w in range(words):
            ones[w] += np.unpackbits(_remixed(h, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return [int.from_bytes(np.packbits(x * 2 > n, bitorder="little").tobytes(), "little") for x in ones]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return _bits_of(shingle_hashes(text, shingle), 1)[0]


def distinct_shingles(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, shingle)]))


def wide_fingerprint(text: bytes, shingle: int, words: int = WORDS) -> list[int]:
    """Words of the fingerprint of a text's distinct shingles."""
    return _bits_of(iter([distinct_shingles(text, shingle)]), words)


def word_names(words: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, words))]


def _fingerprints(shingle: int, words: int, distinct: bool):
    schema = pa.schema([("id", pa.int64()), ("content", pa.int64()), *((n, pa.int64()) for n in word_names(words)), *[("shingles", pa.int64())] * distinct])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = ((t or "").encode() for t in part.column("text").to_pylist())
                if distinct:
                    sets = (distinct_shingles(t, shingle) for t in texts)
                    made = [[*_bits_of(iter([x]), words), len(x)] for x in sets]
                else:
                    made = [_bits_of(shingle_hashes(t, shingle), words) for t in texts]
                fps = np.array(made, np.uint64).reshape(-1, words + distinct).view(np.int64)
                yield batch_of(schema, part.column("id"), part.column("content"), *fps.T)

    return run


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, words: int = 1, distinct: bool = False) -> DataFrame:
    """id, content (a hash of the text that tells rows of one id apart) and fp, the 64 bits as a signed number; more words
    are fp1 and so on.  ``distinct``: repeats of a shingle count once, and their number is returned as ``shingles``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    return rows.mapInArrow(_fingerprints(shingle, words, distinct), "id bigint, content bigint, " + ", ".join(f"{n} bigint" for n in word_names(words) + ["shingles"] * distinct))


# ---- layout


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield batch_of(pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.float64())]), i.astype(np.int32), j.astype(np.int32), total.ravel())


def bit_statistics(distinct: DataFrame) -> np.ndarray:
    """How many fingerprints have both bit i and bit j."""
    rows = distinct.select("fp").mapInArrow(_bit_counts, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4096 rows
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r["i"], r["j"]] = r["n"]
    return out


def grouped_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width, each grown around a bit by the greatest mean correlation."""
    p = both.diagonal() / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        group = [max(free, key=lambda b: (tied[b, free].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: (tied[b, group].mean(), -b)))
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def mask_of(bits) -> int:
    """The signed 64-bit number with these bits set."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def collisions(distinct: DataFrame, masks: list[int]) -> list[float]:
    """Pairs of fingerprints that agree under each mask, counted exactly."""
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key")
    sizes = distinct.select(keys).groupBy("mask", "key").agg(F.count("*").cast("double").alias("n"))
    found = {r["mask"]: r["pairs"] for r in sizes.groupBy("mask").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    return [found.get(i, 0.0) for i in range(len(masks))]


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds T_i >= -1 with sum(T_i + 1) = radius + 1 and the least sum of costs[i][T_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(radius + 2 - used):
                x = (cost + row[t], [*chosen, t - 1])
                if used + t not in now or x < now[used + t]:
                    now[used + t] = x
        best = now
    return best[radius + 1]


def layout(distinct: DataFrame, total: int, radius: int = RADIUS) -> list[int]:
    """The masks to search under, from statistics of all fingerprints.  A wide radius needs more partitions; with one more than
    it has bits each is searched by a single mask, the fewest rows that any layout sends."""
    both = bit_statistics(distinct)
    p = both.diagonal() / max(total, 1)
    agree = p**2 + (1 - p) ** 2
    counts = {*range(max(1, radius // 2), max(4, radius * 4 // 5) + 1), min(radius + 1, BITS // 5)}
    layouts = [grouped_bits(both, total, m) for m in sorted(counts)]
    exact = iter(collisions(distinct, [mask_of(g) for parts in layouts for g in parts]))
    options = []
    for parts in layouts:
        costs = []
        for group in parts:
            pairs, row = next(exact), [0.0]
            odds = [1.0] + [0.0] * radius  # elementary symmetric sums of (1 - a) / a
            for b in group:
                for t in range(radius, 0, -1):
                    odds[t] += odds[t - 1] * (1 - agree[b]) / agree[b]
            for t in range(radius + 1):
                if t >= len(group):
                    row.append(float("inf"))  # no bit would be left to search by
                    continue
                masks = comb(len(group), t)
                row.append(ROW_COST * total * masks + PAIR_COST * max(pairs, 1.0) * sum(odds[: t + 1]) * max(1, masks**0.5))
            costs.append(row)
        options.append((*allocate(costs, radius), parts))
    _, thresholds, parts = min(options, key=lambda x: x[:2])
    return [mask_of(set(g) - set(out)) for g, t in zip(parts, thresholds, strict=True) if t >= 0 for out in combinations(g, t)]


# ---- probe and verify


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member of its component) among the members of one bucket, by breadth-first search."""
    rest, left, right = fps, [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        root = front[0]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, (1 << 20) // len(rest))
            for i in range(0, len(front), step):
                near |= (np.bitwise_count(front[i : i + step, None] ^ rest[None, :]) <= radius).any(0)
            front, rest = rest[near], rest[~near]
            left.append(front)
            right.append(np.full(len(front), root))
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _within(differ: np.ndarray, radius: int, reach: int) -> np.ndarray:
    """Whether some word has at most ``radius`` bits and all words have at most ``reach``; words are the last axis."""
    counts = np.bitwise_count(differ)
    return (counts.min(-1) <= radius) & (counts.sum(-1) <= reach)


def islands(fps: np.ndarray, radius: int, reach: int) -> Iterator[np.ndarray]:
    """Places of members that candidates connect, two or more, by breadth-first search."""
    rest = np.arange(len(fps))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        found = [front]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, (1 << 20) // len(rest))
            for i in range(0, len(front), step):
                near |= _within(fps[front[i : i + step], None] ^ fps[None, rest], radius, reach).any(0)
            front, rest = rest[near], rest[~near]
            found.append(front)
        if sum(map(len, found)) > 1:
            yield np.concatenate(found)


def _first_tries(fps: np.ndarray, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of two pairs for each member of a crowd, the likeliest to hold: its nearest, and the member of most neighbours."""
    n = len(fps)
    step = max(1, (1 << 21) // n)
    degree, nearest, far = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(0, n, step):
        differ = fps[i : i + step, None] ^ fps[None, :]
        near = _within(differ, radius, reach)
        d = np.where(near, np.bitwise_count(differ).sum(-1, dtype=np.int64), 1 << 20)
        degree[i : i + step] = near.sum(1)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = 1 << 20
        nearest[i : i + step], far[i : i + step] = d.argmin(1), d.min(1)
    hub = int(degree.argmax())
    linked, near_hub = np.flatnonzero(far < 1 << 20), np.flatnonzero(_within(fps ^ fps[hub], radius, reach))
    return np.concatenate([linked, near_hub]), np.concatenate([nearest[linked], np.full(len(near_hub), hub)])


class Probe:
    """What a search under the masks of one word takes as a new pair."""

    def __init__(self, radius: int, reach: int, masks: list[int], word: int = 0):
        self.radius, self.reach, self.word, self.table = radius, reach, word, np.array(masks, np.int64).view(np.uint64)

    def takes(self, differ: np.ndarray, own: np.ndarray | int) -> np.ndarray:
        """``differ``: rows of words that differ by ``radius`` or less in the searched one; ``own``: number of their mask.  Pairs
        that an earlier word or mask shows are its."""
        counts = np.bitwise_count(differ)
        out = (counts.sum(1) <= self.reach) & (counts[:, : self.word] > self.radius).all(1)
        for m in range(int(np.max(own, initial=0))):
            out &= (m >= own) | ((differ[:, self.word] & self.table[m]) != 0)
        return out

    def pairs(self, fps: np.ndarray, own: int, most: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Places of all new pairs of one run; None if there are over ``most``."""
        n, a, b, found = len(fps), [], [], 0
        column = np.ascontiguousarray(fps[:, self.word])
        step = max(1, (1 << 21) // n)
        for i in range(0, n, step):
            x, y = np.nonzero(np.bitwise_count(column[i : i + step, None] ^ column[None, i:]) <= self.radius)
            x, y = x[y > x] + i, y[y > x] + i
            new = self.takes(fps[x] ^ fps[y], own)
            a.append(x[new])
            b.append(y[new])
            found += len(a[-1])
            if found > most:
                return None
        return np.concatenate(a), np.concatenate(b)

    def small_pairs(self, run: np.ndarray, fps: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all new pairs in runs of at most ``most`` members, for all runs at once."""
        a, b = [run[:0]], [run[:0]]
        column = np.ascontiguousarray(fps[:, self.word])
        for d in range(1, most):
            hit = np.flatnonzero((run[d:] == run[:-d]) & (np.bitwise_count(column[d:] ^ column[:-d]) <= self.radius))
            hit = hit[self.takes(fps[hit] ^ fps[hit + d], own[hit])]
            a.append(hit)
            b.append(hit + d)
        return np.concatenate(a), np.concatenate(b)


SMALL = 24


def _pairs(probe: Probe, names: list[str], run: int, dense: float, number: int):
    """Streams rows sorted by (mask, key): candidate pairs (a, b) of nodes; an oversized run's members as (mask, node); a
    run of more than ``dense`` pairs a member as (crowd, node), one crowd for those that candidates connect.

    A pair that agrees under several masks comes from the first of them only, whose run holds it in one of these ways.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32())])

    def pairs_of(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.append(True, (keys[1:] != keys[:-1]).any(1))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fps)))
        places = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        x, y = probe.small_pairs((np.cumsum(new) - 1)[places], fps[places], keys[places, 0], SMALL)
        a, b = [places[x]], [places[y]]
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            found = probe.pairs(fps[s : s + n], int(keys[s, 0]), dense * n)
            if found is None:
                for i, at in enumerate(islands(fps[s : s + n], probe.radius, probe.reach)):
                    crowd = np.array([xxhash.xxh64_intdigest(keys[s].tobytes() + i.to_bytes(4), number)], np.uint64).view(np.int64)
                    yield batch_of(schema, np.repeat(crowd, len(at)), nodes[s + at], np.full(len(at), CROWD, np.int32))
            else:
                a.append(found[0] + s)
                b.append(found[1] + s)
        left, right = nodes[np.concatenate(a)], nodes[np.concatenate(b)]
        low, high = np.minimum(left, right), np.maximum(left, right)
        yield batch_of(schema, low, high, np.full(len(low), PAIR, np.int32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, nodes, flowing = np.zeros((0, 2), np.int64), np.zeros((0, len(names)), np.uint64), np.zeros(0, np.int64), None
        for batch in batches:
            mask, key, node, *fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "node", *names))
            keys, fps, nodes = np.concatenate([keys, np.stack([mask, key], 1)]), np.concatenate([fps, np.stack(fp, 1).view(np.uint64)]), np.concatenate([nodes, node])
            if flowing is not None:
                other = (keys != flowing).any(1)
                n = int(other.argmax()) if other.any() else len(keys)
                yield batch_of(schema, keys[:n, 0], nodes[:n], np.full(n, OVER, np.int32))
                keys, fps, nodes = keys[n:], fps[n:], nodes[n:]
                if not len(keys):
                    continue
                flowing = None
            differs = (keys != keys[-1]).any(1)
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if last:
                yield from pairs_of(keys[:last], fps[:last], nodes[:last])
                keys, fps, nodes = keys[last:], fps[last:], nodes[last:]
            if len(keys) > run:
                yield batch_of(schema, keys[:, 0], nodes, np.full(len(keys), OVER, np.int32))
                flowing, keys, fps, nodes = keys[-1], keys[:0], fps[:0], nodes[:0]
        if len(keys):
            yield from pairs_of(keys, fps, nodes)

    return work


def candidate_pairs(nodes: DataFrame, radius: int, run: int = RUN, masks: list[int] | None = None) -> DataFrame:
    """All pairs (a, b) of ``node``, a < b, whose ``fp`` are within ``radius``."""
    return candidates(nodes, radius, run=run, masks=masks, dense=float("inf"))[0]


def candidates(nodes: DataFrame, radius: int, reach: int | None = None, words: int = 1, run: int = RUN, masks: list[int] | None = None, dense: float = DENSE) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``node``, a < b, and crowds (crowd, node): two of which some word is within ``radius`` and all words
    are within ``reach`` are a pair or stand in one crowd."""
    spark, total, names = nodes.sparkSession, nodes.count(), word_names(words)
    if total < 2:
        return spark.createDataFrame([], "a bigint, b bigint"), spark.createDataFrame([], "crowd bigint, node bigint")
    reach = radius * words if reach is None else reach

    def search(rows: DataFrame, word: int, masks: list[int], run: int, number: int) -> DataFrame:
        keys = F.posexplode(F.array(*[F.col(names[word]).bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key")
        probes = rows.select(keys, "node", *names).repartition("mask", "key").sortWithinPartitions("mask", "key", *names, "node")
        found = written(probes.mapInArrow(_pairs(Probe(radius, reach, masks, word), names, run, dense, number), "a bigint, b bigint, kind int"), "pairs")
        del probes
        free_shuffles(spark)
        return found

    out, number = None, 0
    for word, name in enumerate(names):
        table = masks or layout(nodes.select(F.col(name).alias("fp")), total, radius)
        found = search(nodes, word, table, run, number)
        out = found if out is None else out.unionByName(found)
        full = found.where(F.col("kind") == OVER).select(F.col("a").cast("int").alias("mask"), F.col("b").alias("node"))
        for (m,) in full.select("mask").distinct().orderBy("mask").collect():  # at most one per mask
            members = nodes.join(full.where(F.col("mask") == m).select("node"), "node", "left_semi")
            rest = [b for b in range(BITS) if not table[m] >> b & 1]
            number += 1
            out = out.unionByName(search(members, word, [table[m] | x for x in complement_masks(rest, radius)], 1 << 62, number))
        number += 1
    pairs = out.where((F.col("kind") == PAIR) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    return pairs, out.where(F.col("kind") == CROWD).select(F.col("a").alias("crowd"), F.col("b").alias("node"))


def complement_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over ``bits`` of which two members within ``radius`` share one: the fewest that keep half the bits or more."""
    options = []
    for parts in range(1, min(len(bits), radius + 1) + 1):
        groups = [bits[i::parts] for i in range(parts)]
        spare = radius + 1 - parts
        t = [spare // parts + (i < spare % parts) for i in range(parts)]
        if all(x < len(g) for x, g in zip(t, groups, strict=True)) and (n := sum(comb(len(g), x) for x, g in zip(t, groups, strict=True))) <= 4096:
            options.append((n, parts, groups, t))
    if not options:
        return [0]
    _, _, groups, t = next((o for o in sorted(options, key=lambda o: o[1]) if o[0] <= 256), min(options, key=lambda o: o[0]))
    return [mask_of(set(g) - set(out)) for g, x in zip(groups, t, strict=True) for out in combinations(g, x)]


def _upto(n: int, similarity: float) -> list[float]:
    """Chances that n bits of two sets of this Jaccard similarity differ in at most 0, 1, ... n places."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    out, total = [], 0.0
    for k in range(n + 1):
        total += comb(n, k) * p**k * (1 - p) ** (n - k)
        out.append(total)
    return out


def radius_for(similarity: float, words: int = WORDS, recall: float = RECALL) -> int:
    """The least radius that some of ``words`` words keep with a chance of ``recall`` or more."""
    return next(k for k, c in enumerate(_upto(BITS, similarity)) if 1 - (1 - c) ** words >= recall or k == BITS)


def reach_for(similarity: float, words: int = WORDS, share: float = REACHED) -> int:
    """The least number of differing bits of all words that a share of ``share`` or more keep."""
    return next(k for k, c in enumerate(_upto(BITS * words, similarity)) if c >= share or k == BITS * words)


def _shingle_sets(shingle: int, more: tuple[str, ...] = ()):
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary()), *((c, pa.int64()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [distinct_shingles((t or "").encode(), shingle).tobytes() for t in part.column("text").to_pylist()]
                yield batch_of(schema, part.column("node"), made, *(part.column(c) for c in more))

    return run


def _similar(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * max(1, len(x) + len(y) - common))
            keep = np.array(keep, bool)
            yield batch_of(schema, batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)))

    return run


def verified_forest(fps: np.ndarray, sets: list[np.ndarray], radius: int, reach: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect what all links of a crowd do: only pairs that are connected already go untried."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    sets = [tokens[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark, label, a, b = np.zeros(len(tokens), bool), np.arange(len(fps)), [], []

    def connect(i: int, others: np.ndarray) -> None:
        fits = np.minimum(sizes[others], sizes[i]) >= least * np.maximum(np.maximum(sizes[others], sizes[i]), 1) - 1e-6
        others = others[fits & (label[others] != label[i])]
        if not len(others):
            return
        mark[sets[i]] = True
        for j in others.tolist():
            if label[j] == label[i]:
                continue
            common = np.count_nonzero(mark[sets[j]])
            if common >= least * max(1, int(sizes[i] + sizes[j]) - common):
                label[label == label[j]] = label[i]
                a.append(i)
                b.append(j)
        mark[sets[i]] = False

    x, y = _first_tries(fps, radius, reach)
    by = np.argsort(y, kind="stable")
    x, y = x[by], y[by]
    cuts = np.flatnonzero(y[1:] != y[:-1]) + 1
    for some, to in zip(np.split(x, cuts), y[np.append(0, cuts)] if len(y) else [], strict=False):
        connect(int(to), some)
    for i in range(len(fps) - 1):
        connect(i, i + 1 + np.flatnonzero(_within(fps[i + 1 :] ^ fps[i], radius, reach) & (label[i + 1 :] != label[i])))
    return np.array(a, np.int64), np.array(b, np.int64)


def _crowd_links(names: list[str], radius: int, reach: int, least: float):
    """Streams rows sorted by (crowd, low, high, words, node), one run for each two blocks of a crowd; rows of one node count once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(rows: list) -> pa.RecordBatch:
        nodes, fps = np.array([r[0] for r in rows], np.int64), np.array([r[2:] for r in rows], np.int64).view(np.uint64)
        a, b = verified_forest(fps, [np.frombuffer(r[1], "<u8") for r in rows], radius, reach, least)
        return batch_of(schema, nodes[a], nodes[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("crowd", "low", "high", "node", "hashes", *names)]
            for row in zip(*columns, strict=True):
                key = row[:3]
                if key != at:
                    if held:
                        yield links_of(held)
                    held, at = [], key
                if not held or held[-1][0] != row[3]:
                    held.append(row[3:])
        if held:
            yield links_of(held)

    return run


def crowd_links(crowds: DataFrame, nodes: DataFrame, sets: DataFrame, radius: int, reach: int, words: int, least: float, block: int = CROWD_BYTES) -> DataFrame:
    """Links (a, b) that connect all members of a crowd within ``radius`` and ``reach`` and with a share of ``least`` common shingles."""
    parts = F.greatest(F.lit(1), F.ceil(F.sum(F.col("bytes") + 64) / block)).cast("int")
    sized = crowds.join(sets.select("node", "bytes"), "node").groupBy("crowd").agg(parts.alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = crowds.join(sized, "crowd").select("crowd", "node", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    placed = placed.where((F.col("parts") == 1) | (F.col("own") != F.col("other")))
    placed = placed.select("crowd", "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    names = word_names(words)
    rows = placed.join(nodes.select("node", *names), "node").join(sets.select("node", "hashes"), "node")
    rows = rows.repartition("crowd", "low", "high").sortWithinPartitions("crowd", "low", "high", *names, "node")
    return rows.mapInArrow(_crowd_links(names, radius, reach, least), "a bigint, b bigint")


def _texts_of(some: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """node and text of the documents whose node is in ``some``, with its other columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    _, maybe = split_by(docs.select(F.xxhash64(text).alias("node"), text.alias("text")), F.col("node"), key_filter(some, F.col("node")))
    return maybe.join(some, "node")


def whole_groups(pairs: DataFrame, crowds: DataFrame, nodes: DataFrame, words: int, most: int = CROWD_BYTES) -> DataFrame:
    """(node, crowd, fp, ...) of the nodes that pairs and crowds connect to groups of at most ``most`` bytes of shingles."""
    firsts = crowds.groupBy("crowd").agg(F.min("node").alias("b"))
    roots = components(pairs.unionByName(crowds.join(firsts, "crowd").select(F.col("node").alias("a"), "b")))
    sized = written(roots.join(nodes.select("node", *word_names(words), "shingles"), "node"), "groups")
    fit = sized.groupBy("root").agg(F.sum(8 * F.col("shingles") + 64).alias("bytes")).where(F.col("bytes") <= most).select("root")
    return written(sized.join(fit, "root").select("node", F.col("root").alias("crowd"), *word_names(words)), "members")


def similar_pairs(pairs: DataFrame, crowds: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int, radius: int, reach: int, words: int, least: float, most: int = CROWD_BYTES) -> DataFrame:
    """Links (a, b) that connect what all pairs, and all candidates of a crowd, connect whose texts share at least ``least`` of
    their shingles; only texts that stand in a pair or crowd are read on.

    A group that pairs and crowds connect and that is small enough meets in one task, each text's shingles once.  Of larger
    groups every pair is verified by itself and every crowd block by block.
    """
    names = word_names(words)
    members = whole_groups(pairs, crowds, nodes, words, most)
    rows = _texts_of(members, docs, text_col).mapInArrow(_shingle_sets(shingle, ("crowd", *names)), "node bigint, hashes binary, crowd bigint, " + ", ".join(f"{n} bigint" for n in names))
    rows = rows.withColumns({"low": F.lit(0), "high": F.lit(0)}).repartition("crowd").sortWithinPartitions("crowd", "low", "high", *names, "node")
    out = written(rows.mapInArrow(_crowd_links(names, radius, reach, least), "a bigint, b bigint"), "group_links")
    done = members.select("node")
    pairs = written(pairs.join(done.withColumnRenamed("node", "a"), "a", "left_anti").select("a", "b"), "large_pairs")
    crowds = written(crowds.join(done, "node", "left_anti").select("crowd", "node"), "large_crowds")
    del rows
    free_shuffles(docs.sparkSession)
    some = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowds.select("node")).distinct(), "nodes")
    if some.isEmpty():
        return out
    made = _texts_of(some, docs, text_col).mapInArrow(_shingle_sets(shingle), "node bigint, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = written(made.withColumn("bytes", F.length("hashes").cast("bigint")), "sets")
    left, right = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("a", "x"), ("b", "y")))
    out = out.unionByName(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_similar(least), "a bigint, b bigint"))
    if crowds.isEmpty():
        return out
    return out.unionByName(crowd_links(crowds, nodes, sets, radius, reach, words, least))


def _verify(radius: int, run: int, linked: bool):
    """Streams rows sorted by (mask, key, fp); ``linked``: equal keys are links already."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("over", pa.bool_())])

    def links_of(keys: np.ndarray, fps: np.ndarray):
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        sizes = np.diff(np.append(starts, len(fps)))
        a, b = [], []
        if linked:
            first = np.repeat(fps[starts], sizes)
            return fps[fps != first], first[fps != first]
        two = starts[sizes == 2]
        close = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        a.append(fps[close + 1])
        b.append(fps[close])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = _forest(fps[s : s + n], radius)
            a.append(x)
            b.append(y)
        return np.concatenate(a), np.concatenate(b)

    def rows(a: np.ndarray, b: np.ndarray, over: bool) -> pa.RecordBatch:
        return batch_of(schema, a.view(np.int64), b.view(np.int64), np.full(len(a), over))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        flowing = None  # key of a run too large to compare
        for batch in batches:
            mask, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp"))
            keys = np.concatenate([keys, np.stack([mask.astype(np.int64), key], 1)])
            fps = np.concatenate([fps, fp.astype(np.int64).view(np.uint64)])
            if flowing is not None:
                same = (keys == flowing).all(1)
                n = int(same.argmin()) if not same.all() else len(same)
                yield rows(fps[:n], fps[:n], True)
                keys, fps = keys[n:], fps[n:]
                if len(fps):
                    flowing = None
                else:
                    continue
            last = int(np.flatnonzero((keys != keys[-1]).any(1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if last:
                yield rows(*links_of(keys[:last], fps[:last]), False)
                keys, fps = keys[last:], fps[last:]
            if linked and len(fps) > 1:  # the first member is enough to go on
                yield rows(*links_of(keys, fps), False)
                keys, fps = keys[:1], fps[:1]
            elif len(fps) > run:
                yield rows(fps, fps, True)
                flowing, keys, fps = keys[-1], keys[:0], fps[:0]
        if len(fps) and flowing is None:
            yield rows(*links_of(keys, fps), False)

    return work


def _search(distinct: DataFrame, masks: list[int], radius: int, run: int, linked: bool) -> DataFrame:
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key")
    probes = distinct.select(keys, "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return probes.mapInArrow(_verify(radius, run, linked), "a bigint, b bigint, over boolean")


def links(distinct: DataFrame, radius: int = RADIUS, run: int = RUN, masks: list[int] | None = None) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of ``fp`` within ``radius`` bits of each other."""
    total = distinct.count()
    if total < 2:
        return distinct.sparkSession.createDataFrame([], "a bigint, b bigint")
    found = written(_search(distinct, masks or layout(distinct, total, radius), radius, run, False), "links")
    out = found.where("NOT over").select("a", "b")
    over = found.where("over").select(F.col("a").alias("fp")).distinct()
    if not over.isEmpty():
        every = [mask_of(set(range(BITS)) - set(x)) for x in combinations(range(BITS), radius)]
        out = out.unionByName(_search(written(over, "over"), every, radius, run, True).select("a", "b"))
    return out


class NearDuplicates:
    """``rows``: id, content, fp, node of every document; ``groups``: node, component_id, keeper of every node.

    Nodes are distinct fingerprints, or with ``similarity`` distinct texts.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int | None = None, shingle: int = SHINGLE, run: int | None = None, similarity: float | None = None, words: int = WORDS):
        words = words if similarity else 1
        run = run or (WIDE_RUN if similarity else RUN)
        radius = radius if radius is not None else radius_for(similarity, words) if similarity else RADIUS
        names = word_names(words)
        with scratch() as held:
            made = fingerprints(docs, text_col, id_col, shingle, words, bool(similarity)).withColumn("node", F.col("content" if similarity else "fp"))
            rows = written(made, "fingerprints")
            keeper = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("keeper")
            distinct = written(rows.groupBy("node", *names, *["shingles"] * bool(similarity)).agg(keeper), "distinct")
            if similarity:
                reach = reach_for(similarity, words)
                pairs, crowds = candidates(distinct.select("node", *names), radius, reach, words, run)
                joined = similar_pairs(written(pairs, "candidates"), crowds, distinct, docs, text_col, shingle, radius, reach, words, similarity)
            else:
                joined = links(distinct.select("fp"), radius, run)
            roots = components(joined).withColumnRenamed("node", "member")
            joined = written(distinct.join(roots, F.col("node") == F.col("member"), "left").select("node", F.coalesce("root", "node").alias("root"), "keeper"), "joined")
            least = joined.groupBy("root").agg(F.min("keeper").alias("keeper"))
            groups = joined.select("node", "root").join(least, "root").select("node", F.col("keeper.id").alias("component_id"), "keeper")
            self.rows, self.groups = kept(held, rows), kept(held, written(groups, "groups"))

    def per_document(self) -> DataFrame:
        joined = self.rows.join(self.groups, "node")
        return joined.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, fingerprint, component_id."""
    return NearDuplicates(docs, **options).per_document()


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each component, the one of the smallest id, with all columns."""
    found = NearDuplicates(docs, text_col, id_col, **options)
    kid, kcontent, content = (fresh(c, docs.columns) for c in ("kept_id", "kept_content", "content"))
    keep = found.groups.select(F.col("keeper.id").alias(kid), F.col("keeper.content").alias(kcontent)).distinct()
    keep = written(keep, "keep")
    same_row = (F.col("id").eqNullSafe(F.col(kid))) & (F.col("content") == F.col(kcontent))
    again = written(found.rows.join(keep, same_row, "left_semi").groupBy("id", "content").count().where("count > 1").select(F.col("id").alias(kid), F.col("content").alias(kcontent)), "again")
    rows = docs.withColumn(content, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    lost = found.rows.join(keep, same_row, "left_anti").select("id", "content")
    lost = lost.unionByName(again.select(F.col(kid).alias("id"), F.col(kcontent).alias("content")))
    clear, rows = split_by(rows, F.struct(F.col(id_col).cast("bigint"), F.col(content)), key_filter(lost, F.struct("id", "content")))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(kid)) & (F.col(content) == F.col(kcontent))
    kept = rows.join(keep, same, "left_semi")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, content]))
    free_shuffles(docs.sparkSession)
    return clear.unionByName(kept).select(*docs.columns)
