"""Small Spark helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one Python step holds at a time (a longer document is a chunk by itself).
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and Python.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode one is set where there is none, elsewhere that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that later plans start there and survive lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside; afterwards they are as before."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Shuffle files of a job go when the job ends, not when the driver next collects garbage: for chains of jobs that each write a table.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _give_back() -> None:
    """Memory that a worker has freed goes back to the system, so that a reused worker stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What clears the caches that operators keep in a worker from task to task.
CACHES: list[Callable[[], None]] = []
_ran: list[str] = []


def _turn_to(module: str) -> None:
    """A worker that goes on to another operator gives up what the last one kept."""
    if _ran and _ran[0] != module:
        for clear in CACHES:
            clear()
        gc.collect()
    _ran[:] = [module]


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of ARROW_BYTES at most (one row if that is larger); a worker gives its memory back after each task."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _turn_to(step.__module__)
        try:
            yield from step(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def group_arrow(groups: GroupedData, step: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """groups.applyInArrow; a worker gives its memory back after each group."""

    def run(rows: pa.Table) -> pa.Table:
        _turn_to(step.__module__)
        try:
            return step(rows)
        finally:
            _give_back()

    return groups.applyInArrow(run, schema)


def in_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds `limit` text bytes at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > begin and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin, n - begin)


def held_out(column: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def may_learn(column: str = "doc_id"):
    """Rows a model may learn from: a known id outside the held-out fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 != 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reserved(keep: Iterable[str], results: Iterable[str]) -> None:
    """A kept column may not be named like a result, nor be kept twice: that is an error before anything runs."""
    keep = list(keep)
    clash = sorted(set(keep) & set(results)) or sorted({c for c in keep if keep.count(c) > 1})
    if clash:
        raise ValueError(f"kept columns are named like results, or kept twice: {clash}")


def schema_of(docs: DataFrame, keep: Iterable[str], more: str) -> T.StructType:
    """Fields of the kept columns, then those of the DDL text; none may be named like another."""
    keep = list(keep)
    reserved(keep, T.StructType.fromDDL(more).names)
    return T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *T.StructType.fromDDL(more).fields])
