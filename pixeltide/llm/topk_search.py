"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Components become integers floor(256 x), so scores are exact.  The second-moment matrix of all vectors (summed per
task) gives the rotation whose leading coordinates hold most of every product.  Vectors are range-partitioned and
sorted by descending length and written once.  Queries - a stated set of rows - go through in blocks of
``QUERY_BYTES`` of vectors at most, each broadcast for one pass over the vectors and destroyed after it; all passes append
their winners to one table, which holds k rows per query and task at most.  A task reads its files, each longest first,
and keeps the k best of each query:

* |q| |x| below the k-th best score for the longest of a block of vectors: that query skips the block;
* head product plus |q_tail| |x_tail| (Cauchy-Schwarz on the coordinates left out) below the k-th best: skipped;
* what is left gets its exact integer product.

Before, the k-th best among the ``HEAD`` longest vectors gives every query a floor to start from, so that tasks emit
only scores that can matter; the winners of all tasks meet in one aggregation by query.

Defined cases: vectors that are null, empty, of another length than the query's, or hold null or non-finite components take no part;
equal scores go to the smaller id; rows sharing a query's id are its own and are no candidates; a query id that is
repeated is answered once, for its least vector; null ids take no part; fewer than k candidates give all of them;
scores stay exact up to 64 bits, larger ones are an error; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixeltide.llm.common import batch_of, empty, new_path, release, written

SCALE, K = 256, 5
HEAD = 2048
#: Most bytes of a block's vectors, which bounds the broadcast whatever their dimension; at 64 components 65,536 queries.
QUERY_BYTES = 64 << 20
#: Scores held at once: vectors scored together follow from the number of queries.
SCORES = 1 << 22
HEAD_SHARE = 0.9
EXACT = float(2**53)
RESULT = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(table: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """id and v, the scaled components as doubles holding whole numbers."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    made = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"))
    return table.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), made.alias("v"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(v), -1)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch)
            total += x.T @ x
        schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
        yield batch_of(schema, np.arange(dim, dtype=np.int32), list(total))

    return run


def rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of all rows, and how many leading ones hold ``HEAD_SHARE`` of the squared length."""
    parts = vectors.select("v").mapInArrow(_moments(dim), "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("r")).select("i", "r.x").collect()  # a row per dimension
    total = np.zeros((dim, dim))
    for r in rows:
        total[r["i"]] = r["x"]
    values, basis = np.linalg.eigh((total + total.T) / 2)
    order = np.argsort(-values)
    values, basis = np.maximum(values[order], 0), basis[:, order]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return basis, int(min(dim, np.searchsorted(share, HEAD_SHARE) + 1))


class Queries:
    """One block of queries with rotated coordinates, lengths and floors."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, basis: np.ndarray, head: int, k: int):
        self.ids, self.q, self.basis, self.head, self.k = ids, q, basis, head, k
        self.length = np.sqrt((q * q).sum(1))
        r = q @ basis
        self.front, self.tail = r[:, :head], np.sqrt((r[:, head:] ** 2).sum(1))
        self.floor = np.full(len(ids), -np.inf)


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where no sum can pass 2**53, else with Python's integers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    wide = [[int(c) for c in row] for row in q], [[int(c) for c in row] for row in x]
    return np.array([[sum(a * b for a, b in zip(r, s, strict=True)) for s in wide[1]] for r in wide[0]], dtype=object).reshape(len(q), len(x)).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far; ``floor`` holds what a score must reach."""

    def __init__(self, queries: Queries):
        n, k = len(queries.ids), queries.k
        self.queries, self.score, self.id, self.filled = queries, np.full((n, k), -(2**62), np.int64), np.full((n, k), 2**62, np.int64), np.zeros((n, k), bool)
        self.floor = queries.floor.copy()

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates as parallel arrays: query row, vector id, score."""
        if not len(rows):
            return
        touched = np.unique(rows)
        place = np.searchsorted(touched, rows)
        k = self.queries.k
        has = self.filled[touched]
        all_rows = np.concatenate([np.repeat(np.arange(len(touched)), k)[has.ravel()], place])
        all_scores = np.concatenate([self.score[touched].ravel()[has.ravel()], scores])
        all_ids = np.concatenate([self.id[touched].ravel()[has.ravel()], ids])
        by = np.lexsort((all_ids, -all_scores, all_rows))
        all_rows, all_scores, all_ids = all_rows[by], all_scores[by], all_ids[by]
        first = np.searchsorted(all_rows, np.arange(len(touched)))
        rank = np.arange(len(all_rows)) - first[all_rows]
        top = rank < k
        self.filled[touched] = False
        at = (touched[all_rows[top]], rank[top])
        self.score[at], self.id[at], self.filled[at] = all_scores[top], all_ids[top], True
        full = touched[self.filled[touched].all(1)]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, k - 1])


def scan(best: Best, ids: np.ndarray, x: np.ndarray) -> None:
    """Score vectors against all queries that may still gain from them; those in descending length gain most."""
    queries = best.queries
    length = np.sqrt((x * x).sum(1))
    slack = 1e-6
    step = max(16, min(1024, SCORES // max(1, len(queries.ids))))
    for s in range(0, len(ids), step):
        some, some_ids, some_len = x[s : s + step], ids[s : s + step], length[s : s + step]
        live = np.flatnonzero(queries.length * some_len.max(initial=0) * (1 + slack) + slack >= best.floor)
        if not len(live):
            continue  # a batch may hold the start of another file, whose vectors are longer
        r = some @ queries.basis
        tail = np.sqrt((r[:, queries.head :] ** 2).sum(1))
        bound = queries.front[live] @ r[:, : queries.head].T + np.outer(queries.tail[live], tail)
        margin = slack * (1 + np.outer(queries.length[live], some_len))
        rows, columns = np.nonzero(bound + margin >= best.floor[live, None])
        if not len(rows):
            continue
        dense = len(rows) * 8 > bound.size
        if dense:
            scores = exact_products(queries.q[live], some)[rows, columns]
        else:
            scores = _pair_products(queries.q[live], some, rows, columns)
        rows = live[rows]
        good = (scores >= best.floor[rows]) & (some_ids[columns] != queries.ids[rows])
        best.add(rows[good], some_ids[columns][good], scores[good])


def _pair_products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < EXACT:
        step = max(1, (1 << 21) // max(1, q.shape[1]))
        return np.concatenate([np.einsum("ij,ij->i", q[rows[i : i + step]], x[columns[i : i + step]]) for i in range(0, len(rows), step)]).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)) for i, j in zip(rows, columns, strict=True)], np.int64)


def _task(broadcast):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(broadcast.value)
        for batch in batches:
            if batch.num_rows:
                scan(best, batch.column("id").to_numpy(), _matrix(batch))
        row, place = np.nonzero(best.filled)
        yield batch_of(schema, best.queries.ids[row], best.id[row, place], best.score[row, place])

    return run


def _query_blocks(queries: DataFrame, block: int) -> Iterator[list]:
    """Rows of the queries in id order, at most ``block`` at a time on the driver."""
    held = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def top_k(table: DataFrame, is_query: Column, k: int = K, vector_col: str = "embedding", id_col: str = "vec_id", block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query row; ``is_query`` is a condition on id_col's table.

    ``block``: most queries of a pass, if less than ``QUERY_BYTES`` hold.
    """
    spark = table.sparkSession
    flag = table.where(F.coalesce(is_query, F.lit(False)))
    vectors, queries = integer_vectors(table, vector_col, id_col), integer_vectors(flag, vector_col, id_col)
    vectors = vectors.withColumn("length", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    vectors = written(vectors.repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length"), "id"), "vectors")
    queries = written(queries.groupBy("id").agg(F.min("v").alias("v")).orderBy("id"), "queries")
    path, passes = new_path(spark, "scores"), 0
    dims = [r[0] for r in queries.select(F.size("v")).distinct().orderBy(F.size("v")).collect()]
    for dim in dims:
        alike = vectors.where(F.size("v") == dim)
        basis, head = rotation(alike, dim)
        longest = alike.orderBy(F.desc("length"), "id").limit(HEAD).collect()
        head_ids = np.array([r["id"] for r in longest], np.int64)
        head_x = np.array([r["v"] for r in longest], np.float64).reshape(len(longest), dim)
        for rows in _query_blocks(queries.where(F.size("v") == dim), max(1, min(block or QUERY_BYTES, QUERY_BYTES // (16 * dim)))):
            made = Queries(np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim), basis, head, k)
            if len(longest):
                first = Best(made)
                scan(first, head_ids, head_x)
                made.floor = np.maximum(made.floor, first.floor)
            sent = spark.sparkContext.broadcast(made)
            alike.select("id", "v").mapInArrow(_task(sent), RESULT).write.mode("append").parquet(path)
            sent.destroy()
            passes += 1
    release(vectors, queries)
    if not passes:
        return empty(spark, "query_id bigint, rank int, vec_id bigint, score bigint")
    found = spark.read.schema(RESULT).parquet(path)
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
