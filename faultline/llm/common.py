"""Small helpers of the training-data operators."""

from __future__ import annotations

import functools
import gc
import hashlib
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that a task turns into Python objects at once.
SLICE_ROWS = 128
SLICE_BYTES = 4_000_000


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``fn(spark, ...)`` whose Python workers find this package where the driver found it.

    On a cluster the package is installed, or sent with --py-files; then the
    folder named here is merely one more that does not exist.
    """
    @functools.wraps(fn)
    def run(spark: SparkSession, *args) -> DataFrame:
        env = spark.sparkContext.environment
        if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH")]))
        return fn(spark, *args)

    return run


def release(spark: SparkSession) -> None:
    """Let Spark clean up after finished steps.

    Broadcasts and shuffles of a step stay on executors, and their records on the driver, until the
    driver's memory happens to be collected; a driver that has memory to spare does that late.
    Called between stages and rounds, so that what a pipeline holds does not grow with its stages.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a task holds few texts as Python objects at a time.

    A slice ends after SLICE_ROWS rows, or sooner where its share of the batch
    would exceed SLICE_BYTES. A single long text stays whole.
    """
    for batch in batches:
        rows = batch.num_rows
        step = SLICE_ROWS
        if rows:
            step = max(1, min(SLICE_ROWS, int(SLICE_BYTES * rows / max(1, batch.nbytes))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def folds(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def beside_row(rows: DataFrame, ddl: str) -> T.StructType:
    """Schema of column ``row`` of ``rows`` followed by the columns of ``ddl``."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(ddl).fields])


#: Values of a list that one row of its packed form holds.
LIST_CHUNK = 4_096


def list_digests(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, n and sha256 (lowercase hex) of the comma-joined values of each key, in ascending order.

    No list is held whole: rows are sorted by ranges of (key, value), so a hot
    key is spread over tasks; each packs its stretch into strings of LIST_CHUNK
    values, and only these are streamed, key by key, through the digest.
    ``key`` and ``value`` are not null, and a value occurs once per key.
    """
    kinds = rows.schema[key].dataType.simpleString(), rows.schema[value].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        now, held = None, []

        def out() -> pa.RecordBatch:
            text = ",".join(map(str, held))
            return pa.RecordBatch.from_arrays(
                [pa.array([now], schema.field(0).type), pa.array([held[0]], schema.field(1).type),
                 pa.array([len(held)], pa.int64()), pa.array([text], pa.string())], names=["key", "first", "n", "part"])

        for batch in batches:
            schema = batch.schema
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != now or len(held) == LIST_CHUNK):
                    yield out()
                    held = []
                now = k
                held.append(v)
        if held:
            yield out()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, sha, kind = None, 0, None, None

        def out(keys: list, counts: list, hexes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(counts, pa.int64()), pa.array(hexes, pa.string())],
                                              names=["key", "n", "sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, counts, hexes = [], [], []
            for k, m, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if sha is None or k != now:
                    if sha is not None:
                        keys.append(now)
                        counts.append(n)
                        hexes.append(sha.hexdigest())
                    now, n, sha = k, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
                n += m
            yield out(keys, counts, hexes)
        if sha is not None:
            yield out([now], [n], [sha.hexdigest()])

    sorted_rows = (rows.select(F.col(key).alias("key"), F.col(value).alias("value"))
                   .repartitionByRange("key", "value").sortWithinPartitions("key", "value"))
    packed = sorted_rows.mapInArrow(pack, f"key {kinds[0]}, first {kinds[1]}, n long, part string")
    streamed = packed.repartition("key").sortWithinPartitions("key", "first")
    return streamed.mapInArrow(digest, f"key {kinds[0]}, n long, sha256 string").withColumnRenamed("key", key)
