"""Exact deduplication with a heavy-hitter split.

1. Every row gets a SHA-256 digest of its whole text; the narrow table (uid, id, digest) is written once.
2. Each task keeps a Misra-Gries summary of k counters.  Summed over tasks, a digest of n rows keeps a counter of at
   least n - N/(k+1), so the digests whose summed counter reaches N/(k+1) - at most k+1 of them - include every one
   with 2N/(k+1) rows or more.
3. Those few candidates are verified: exact count and winner come from one map-side combined aggregation.  They are
   broadcast (k+1 rows at most), and their rows never meet in one task.
4. All other digests, each with less than 2N/(k+1) rows, are grouped by an ordinary shuffle.

Defined cases: null text counts as empty; of equal texts the largest id stays (a null id counts as smallest, so it
stays only if all are null); of rows repeated with the same id and text exactly one stays; an empty table gives an
empty result; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import batch_of, fresh, key_filter, split_by, written

#: Counters of a Misra-Gries summary; k+1 bounds the broadcast.
COUNTERS = 1024


def digest_of(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _summary(k: int):
    schema = pa.schema([("digest", pa.binary()), ("counter", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for x in batch.column(0).value_counts().to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > k:
                cut = sorted(held.values(), reverse=True)[k]
                held = {d: n - cut for d, n in held.items() if n > cut}
        if held:
            yield batch_of(schema, list(held), list(held.values()))

    return run


def frequent_digests(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most k+1 digests, among them all that make up 2/(k+1) of the rows or more."""
    total = digests.count()
    parts = digests.select("digest").mapInArrow(_summary(k), "digest binary, counter bigint")
    return parts.groupBy("digest").agg(F.sum("counter").alias("counter")).where(F.col("counter") * (k + 1) >= F.lit(total)).select("digest")


def winners_of(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays and the number of rows; both combine map-side."""
    return rows.groupBy("digest").agg(F.max(F.struct("id", "uid")).alias("winner"), F.count("*").alias("group_size"))


class Marked:
    """Digests of a table with the decision on each row.

    ``rows``: id, digest, keep_id, group_size, kept - one per input row.  ``heavy``: digest, winner of the frequent
    texts, at most k+1 rows.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = COUNTERS):
        keyed = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), digest_of(text_col).alias("digest"))
        self.digests = written(keyed, "digests")
        candidates = written(frequent_digests(self.digests, k), "frequent")
        self.heavy = written(winners_of(self.digests.join(F.broadcast(candidates), "digest", "left_semi")), "heavy")
        hot = self.digests.join(F.broadcast(self.heavy), "digest")
        light = self.digests.join(F.broadcast(candidates), "digest", "left_anti")
        cool = light.join(winners_of(light), "digest")
        self.rows = hot.unionByName(cool).select("id", "digest", F.col("winner.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("winner.uid")).alias("kept"))


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = Marked(docs, text_col, id_col, k).rows
    return rows.select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all columns.

    Copies of frequent texts go map-side, before any shuffle of texts.  Rows that a filter of fixed size tells from all
    dropped ones stay without a shuffle; the rest is matched by (id, digest).
    """
    marked = Marked(docs, text_col, id_col, k)
    digest, kid, kdigest, keep = (fresh(c, docs.columns) for c in ("digest", "kept_id", "kept_digest", "winner"))
    rows = docs.withColumn(digest, digest_of(text_col))
    heavy = marked.heavy.select(F.col("digest").alias(kdigest), F.col("winner.id").alias(kid), F.lit(True).alias(keep))
    rows = rows.join(F.broadcast(heavy), F.col(digest) == F.col(kdigest), "left").where(F.col(keep).isNull() | F.col(id_col).eqNullSafe(F.col(kid))).select(*docs.columns, digest)
    lost = key_filter(marked.rows.where("NOT kept"), F.struct("id", "digest"))
    clear, rows = split_by(rows, F.struct(F.col(id_col), F.col(digest)), lost)
    one = marked.rows.where("kept").select(F.col("id").alias(kid), F.col("digest").alias(kdigest))
    same = F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(digest) == F.col(kdigest))
    again = written(marked.rows.where("NOT kept AND id <=> keep_id").select(F.col("id").alias(kid), F.col("digest").alias(kdigest)).distinct(), "repeated")
    if not again.isEmpty():
        repeated = rows.join(again, same, "left_semi").dropDuplicates([id_col, digest])
        rows = rows.join(again, same, "left_anti").unionByName(repeated)
    return clear.unionByName(rows.join(one, same, "left_semi")).select(*docs.columns)
