"""Plumbing shared by the corpus operators: tables in the shared folder, size-checked broadcasts, bounded text batches."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATED: dict[str, str] = {}

#: Text handled at once by a Python worker; a single longer document is still handled whole.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a Python worker; both hold whole batches.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``; a temporary one only if that is unset and all of Spark is
    in one process, as in tests."""
    app = spark.sparkContext.applicationId
    if app not in _CREATED:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="pixeltide-")
            spark.sparkContext.setCheckpointDir(base)
        _CREATED[app] = f"{base.rstrip('/')}/pixeltide-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _CREATED[app])
    return _CREATED[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this library made, through Hadoop's file system so that any shared store works."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._pixeltide_path = path
    if getattr(_SCOPES, "open", None):
        _SCOPES.open[-1].append(again)
    return again


_SCOPES = threading.local()


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those that are taken off the list by ``kept``."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    held: list[DataFrame] = []
    _SCOPES.open.append(held)
    try:
        yield held
    finally:
        _SCOPES.open.pop()
        for df in held:
            release(df)


def kept(held: list[DataFrame], df: DataFrame) -> DataFrame:
    """A written table that outlives the innermost scope; the next one holds it from then on."""
    held[:] = [x for x in held if x is not df]
    if len(_SCOPES.open) > 1:
        _SCOPES.open[-2].append(df)
    return df


def release(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        delete_path(df.sparkSession, df._pixeltide_path)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect finished plans, so that Spark drops their shuffle files before the next heavy phase."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, taken) -> str:
    """A column name that does not clash, without regard to case, with those of the input."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a table counted to have at most ``rows`` rows; beyond it Spark shuffles as usual."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Least and greatest bits of a key filter, as powers of two; the greatest is 2**21 rows of 64 bits.
FILTER_BITS = (18, 27)


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lower the session's limit on Arrow batches to ``BATCH_BYTES`` if it is higher; texts vary too much for a row limit."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name, "64m")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def _bytes(text: str) -> int:
    """A size setting in bytes; zero and below stand for no limit."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", text.strip().lower())
    n = int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]] if found else 0
    return n if n > 0 else 1 << 62


def key_filter(keys: DataFrame, key: Column) -> tuple[DataFrame, int]:
    """A one-hash Bloom filter of at least 64 bits a key, up to ``FILTER_BITS``: a table (word, bits) and its size's power.

    With more keys than that it says "maybe" too often, and the exact join behind it does all the work.
    """
    hashes = written(keys.select(F.xxhash64(key).alias("hash")), "filter_keys")
    size = min(max((64 * hashes.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    place = F.pmod("hash", F.lit(1 << size))
    bit = F.expr("shiftleft(1L, int(place % 64))")
    words = hashes.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), bit.alias("bit"))
    made = written(words.groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")
    if not getattr(_SCOPES, "open", None):
        release(hashes)
    return made, size


def split_by(df: DataFrame, key: Column, made: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key surely is not in the filter, and all others; only the latter need an exact join."""
    words, size = made
    place, word, bits = (fresh(c, df.columns) for c in ("filter_place", "filter_word", "filter_bits"))
    placed = df.withColumn(place, F.pmod(F.xxhash64(key), F.lit(1 << size)))
    held = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    joined = placed.join(F.broadcast(held), F.shiftright(place, 6) == F.col(word), "left")
    maybe = F.coalesce(F.expr(f"(shiftright({bits}, int({place} % 64)) & 1) = 1"), F.lit(False))
    return joined.where(~maybe).select(*[F.col(f"`{c}`") for c in df.columns]), joined.where(maybe).select(*[F.col(f"`{c}`") for c in df.columns])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece hold about ``limit`` bytes; every row comes through once, in order."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
