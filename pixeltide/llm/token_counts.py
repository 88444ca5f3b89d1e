"""Token counts of whole texts, huge documents by overlap resynchronisation.

A text of up to ``chunk`` characters is one chunk; its words are encoded by the library once and remembered
(``word_memory``).  A longer text is encoded in chunks that overlap, each with offsets.  Two neighbours A (ending at a1) and B (starting at b0 < a1) are spliced at a position
p of the overlap that is provably stable:

* text[p-1] is no white space and text[p] is ASCII white space.  Normalisation and pre-tokenisation never reach across
  such a place (no special token, no composition and no pre-token holds white space), so what stands before p is
  encoded alike whatever follows, and what stands after p whatever came before;
* both sides have a token boundary there: a token of A ends at p and a token of B ends at p;
* p lies at least ``guard`` characters from either end of the overlap, and more than the tokenizer's longest special
  token, so neither a special string cut by A's end nor one cut by B's start can reach it.

By induction A is right up to p, and from p on B is right.  If the overlap holds no such place it is doubled, up to a
chunk that reaches the end of the text.  The tokens of a document are counted chunk by chunk, so memory is bounded by
a chunk, not by the document, unless no stable place exists at all.

Defined cases: a text of any length is counted whole, splicing beyond ``chunk``; one without white space is one ever
wider chunk; null text counts as empty (0 bytes, 0 tokens); ids may be null or repeated (one row per input row); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import batch_of, bounded_batches, slices
from pixeltide.llm.word_memory import broadcast_model, encoder_of, longest_special, tokenizer_of

CHUNK, OVERLAP, GUARD = 16_384, 512, 64
#: Text split into words at once.
TEXT_BYTES = 8 << 20
SPACES = " \t\n\r\x0b\x0c"


def stable_cut(text: str, low: int, high: int, ends_a: set[int], ends_b: set[int]) -> int | None:
    """The first stable position p with low <= p < high, or None."""
    for p in range(max(low, 1), min(high, len(text))):
        if text[p] in SPACES and not text[p - 1].isspace() and p in ends_a and p in ends_b:
            return p
    return None


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> Iterator[list[int]]:
    """Token ids of a text in pieces; their concatenation is what encoding the whole text gives."""

    def encode(a: int, b: int):
        e = tokenizer.encode(text[a:b], add_special_tokens=False)
        return e.ids, [(a + s, a + t) for s, t in e.offsets]

    n, at, end = len(text), 0, min(chunk, len(text))
    ids, spans = encode(0, end)
    while end < n:
        wide, reach = overlap, chunk
        while True:
            b0, b1 = max(at, end - wide), min(n, end + reach)
            ids_b, spans_b = encode(b0, b1)
            first = b0 if b0 == at else b0 + guard
            cut = stable_cut(text, max(first, at + 1), end - guard, {t for _, t in spans}, {t for _, t in spans_b})
            if cut is not None:
                break
            if b0 == at:  # the overlap is all that is not yet settled: no stable place, so encode it anew with more text behind it
                end, ids, spans = b1, ids_b, spans_b
                reach *= 2
                if end == n:
                    break
                wide = overlap
                continue
            wide *= 2
        if cut is None:
            break
        yield [i for i, (_, t) in zip(ids, spans, strict=True) if t <= cut]
        later = [(i, s) for i, s in zip(ids_b, spans_b, strict=True) if s[0] >= cut]
        ids, spans = [i for i, _ in later], [s for _, s in later]
        at, end = cut, b1
    yield ids


def _count(model, chunk: int, overlap: int, guard: int):
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, encoder, apart = tokenizer_of(model.value), encoder_of(model.value), max(guard, longest_special(model.value) + 1)
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                texts = part.column("text")
                huge = pc.greater(pc.fill_null(pc.utf8_length(texts), 0), chunk)
                counts = encoder.count(pc.if_else(huge, "", texts))
                for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)).tolist():
                    counts[i] = sum(map(len, spliced(tokenizer, texts[i].as_py(), chunk, overlap, apart)))
                yield batch_of(schema, part.column("id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), counts)

    return run


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit."""
    model = broadcast_model(docs.sparkSession, model_path)
    rows = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count(model, chunk, overlap, guard), "id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
