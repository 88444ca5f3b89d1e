"""Token-id files under one canonical length-limited Huffman code.

``write_token_store`` makes a folder of three Parquet tables:

* ``codebook``: the code length of every id that occurs (canonical codes follow from the lengths);
* ``blocks``: independent blocks of whole documents in ascending id order - ids and token counts of the documents, the
  bit string, and the bit offset of every ``STEP``-th token, from which decoding can start;
* ``parts``: number of tokens before each part, a row per file of blocks.

Passes: tokenise once (ids as binary, written) and count ids per task; sum the counts (at most one row per vocabulary
entry reaches the driver); package-merge gives lengths of at most ``MAX_LENGTH`` bits; range-partition by id and encode.
Decoding looks up ``MAX_LENGTH`` bits at a time in a table of 2**MAX_LENGTH entries, all checkpoints of a block in step.

Words between ASCII white space are encoded by the tokenizers library once and remembered; neither normalisation nor
pre-tokenisation of a tokenizer that drops white space reaches across it, so a text's ids are its words' ids in order.

Defined cases: a very long text is stored whole, in one block; null text counts as empty and holds the end id alone; null ids come first; rows repeated with one id
stand side by side, ordered by their tokens; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.llm.common import batch_of, bounded_batches, new_path, release, slices, written
from pixeltide.llm.word_memory import broadcast_model, encoder_of, tokenizer_of

MAX_LENGTH = 20
STEP = 256
BLOCK_TOKENS = 1 << 19
#: Text split into words at once.
TEXT_BYTES = 8 << 20

BLOCKS = "part int, block int, start_in_part bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, offsets binary, bits binary"


# ---- tokenising


def _tokenise(model, end_id: int, width: str):
    """Rows of documents (id, ids), and at the end of a task one row with its counts of all ids."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = encoder_of(model.value, end_id, width), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                ids, lengths = encoder.encode(part.column("text"))
                seen = np.bincount(ids, minlength=len(counts))
                seen[: len(counts)] += counts
                counts = seen
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * ids.dtype.itemsize
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids)])
                yield batch_of(schema, part.column("id"), binary, pa.nulls(len(lengths), pa.binary()))
        if len(counts):
            yield batch_of(schema, [None], [None], [counts.astype("<i8").tobytes()])

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tasks added up."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column(0):
            n = np.frombuffer(x.as_py(), "<i8").copy()
            small, total = sorted((n, total), key=len)
            total[: len(small)] += small
    seen = np.flatnonzero(total)
    yield batch_of(pa.schema([("token", pa.int64()), ("n", pa.int64())]), seen, total[seen])


# ---- the code


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; counts are positive."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    rows: list[np.ndarray] = []  # per level, True where the merged list holds a leaf
    packages = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        rows.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(rows):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in code order (by length, then symbol) and their codes."""
    order = np.lexsort((symbols, lengths))
    length = lengths[order]
    steps = np.left_shift(np.uint64(1), (MAX_LENGTH - length).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(steps)[:-1]]).astype(np.uint64)  # left-aligned to MAX_LENGTH bits
    return order, first >> (MAX_LENGTH - length).astype(np.uint64)


class Codebook:
    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order, codes = canonical_codes(symbols, lengths)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[symbols[order]], self.length[symbols[order]] = codes, lengths[order]
        self.symbols, self.lengths = symbols[order], lengths[order]

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for every string of MAX_LENGTH bits."""
        if not hasattr(self, "_table"):
            runs = np.left_shift(1, MAX_LENGTH - self.lengths)
            short = (1 << MAX_LENGTH) - int(runs.sum())
            runs, symbols, lengths = np.append(runs, short), np.append(self.symbols, 0), np.append(self.lengths, 1)
            self._table = np.repeat(symbols.astype(np.uint32), runs), np.repeat(lengths.astype(np.int64), runs)
        return self._table

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
        """Offsets (u64, every ``step`` tokens) and the bit string, padded with zeros."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        where, room = at >> 6, 64 - (at & 63) - lengths
        codes = self.code[ids]
        fits = room >= 0
        high = np.where(fits, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        if len(ids):
            firsts = np.flatnonzero(np.diff(where, prepend=-1))
            words[where[firsts]] |= np.bitwise_or.reduceat(high, firsts)
            over = np.flatnonzero(~fits)
            words[where[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        return at[::step].astype("<u8").tobytes(), words.astype(">u8").tobytes()[: (total + 7) // 8]

    def decode(self, offsets: bytes, bits: bytes, n: int, step: int = STEP) -> np.ndarray:
        """All lanes, one per checkpoint, advance together."""
        symbols, lengths = self.table
        data = np.frombuffer(bits + bytes(16), np.uint8)
        at = np.frombuffer(offsets, "<u8").astype(np.int64)
        lanes = len(at)
        out = np.empty((step, lanes), np.uint32)
        last = n - (lanes - 1) * step if lanes else 0
        stop = len(bits) * 8
        words = data[:-7].astype(np.uint64)
        for shift in range(1, 5):  # 40 bits from every byte on
            words = (words << np.uint64(8)) | data[shift : len(data) - 7 + shift]
        for i in range(step):
            if i == last:
                at, out_lanes = at[:-1], lanes - 1
            elif i < last:
                out_lanes = lanes
            window = (words[np.minimum(at, stop) >> 3] >> (40 - MAX_LENGTH - (at & 7)).astype(np.uint64)) & np.uint64((1 << MAX_LENGTH) - 1)
            out[i, :out_lanes] = symbols[window]
            at = at + lengths[window]
        return out.T.reshape(-1)[:n]


@lru_cache(maxsize=2)
def _book(symbols: bytes, lengths: bytes) -> Codebook:
    return Codebook(np.frombuffer(symbols, np.int64), np.frombuffer(lengths, np.int64))


# ---- files


def _pack(book_bytes, block_tokens: int, width: str):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("offsets", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part = _book(*book_bytes.value), TaskContext.get().partitionId()
        block = start = held = 0
        ids: list[int | None] = []
        rows: list[np.ndarray] = []

        def flush():
            nonlocal block, start, held, ids, rows
            flat = np.concatenate(rows)
            offsets, bits = book.encode(flat.astype(np.int64))
            out = batch_of(schema, [part], [block], [start], [len(flat)], [ids], [[len(r) for r in rows]], [offsets], [bits])
            block, start, held, ids, rows = block + 1, start + len(flat), 0, [], []
            return out

        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                ids.append(i)
                rows.append(np.frombuffer(x.as_buffer(), width))
                held += len(rows[-1])
                if held >= block_tokens:
                    yield flush()
        if rows:
            yield flush()

    return run


def write_token_store(docs: DataFrame, path: str, model_path: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text, append ``end_id``, and write the files below ``path``."""
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    width = "<u2" if max(end_id, tokenizer_of(open(model_path, encoding="utf-8").read()).get_vocab_size() - 1) < 65536 else "<u4"
    tokenised = written(rows.mapInArrow(_tokenise(broadcast_model(spark, model_path), end_id, width), "id bigint, ids binary, counts binary"), "tokens")
    tokens = tokenised.where("ids IS NOT NULL").select("id", "ids")
    counts = tokenised.where("counts IS NOT NULL").select("counts").mapInArrow(_histogram, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").toPandas()
    symbols = counts["token"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.int64))
    spark.createDataFrame(pa.table({"token": pa.array(symbols, pa.int64()), "length": pa.array(lengths, pa.int64())})).coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((symbols.tobytes(), lengths.tobytes()))
    dealt = tokens.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
    dealt.mapInArrow(_pack(book, block_tokens, width), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    book.destroy()
    release(tokenised)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per file
    sums = np.array([r["n"] for r in totals], np.int64)
    starts = pa.table({"part": pa.array([r["part"] for r in totals], pa.int32()), "start": pa.array(np.cumsum(sums) - sums)})
    spark.createDataFrame(starts).coalesce(1).write.parquet(f"{path}/parts")  # from Arrow: rows of Python would start workers of another kind


def _read(book_bytes, starts, with_ids: bool):
    fields = [("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, start_of = _book(*book_bytes.value), starts.value
        for batch in batches:
            for b in batch.to_pylist():
                flat = book.decode(b["offsets"], b["bits"], b["n_tokens"])
                counts = np.array(b["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                first = start_of[b["part"]] + b["start_in_part"]
                rows = np.split(flat, ends[:-1])
                columns = [b["doc_ids"], first + ends - counts, counts, [zlib.crc32(r.astype("<u4").tobytes()) for r in rows]]
                yield batch_of(schema, *columns, *([[r.astype(np.int64) for r in rows]] if with_ids else []))

    return run


def read_token_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: id, start, n_tokens, ids_crc32, and on request the ids, a row per document."""
    codes = spark.read.parquet(f"{path}/codebook").orderBy("token").toPandas()  # bounded by the vocabulary
    book = spark.sparkContext.broadcast((codes["token"].to_numpy(np.int64).tobytes(), codes["length"].to_numpy(np.int64).tobytes()))
    starts = spark.sparkContext.broadcast({r["part"]: r["start"] for r in spark.read.parquet(f"{path}/parts").collect()})
    schema = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(_read(book, starts, with_ids), schema)


def stored_tokens(docs: DataFrame, model_path: str, end_id: int = 2, **options) -> DataFrame:
    """Write to the shared folder and read back."""
    path = new_path(docs.sparkSession, "token-store")
    write_token_store(docs, path, model_path, end_id, **options)
    return read_token_store(docs.sparkSession, path)
