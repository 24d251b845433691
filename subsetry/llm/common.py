"""Helpers shared by the training-data operators: shared folders, staging, ordered partitions."""

from __future__ import annotations

import ctypes
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

#: Arrow batches stay small, as one document may hold 100 KB and more.
ROWS_PER_BATCH = 1024


def tune(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size, for as long as it lasts, where it still is Spark's default.

    It is read when a plan runs, which may be long after the call, so it cannot be put back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession, name: str) -> str:
    """URI of a new folder that the driver and all executors can reach.

    It lies in spark.checkpoint.dir. Where that is unset (tests on one machine)
    a temporary folder is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="subsetry-")
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    elif "://" not in base and not base.startswith("file:"):
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        base = spark._jvm.org.apache.hadoop.fs.FileSystem.get(hadoop).makeQualified(
            spark._jvm.org.apache.hadoop.fs.Path(base)
        ).toString()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


#: Of each settled() that runs: the folders made meanwhile.
_MADE: list[list[str]] = []


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, written to the shared folder and read again; the folders that make staged are deleted then."""
    path, made = shared_dir(spark, name), []
    _MADE.append(made)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _MADE.remove(made)
        for other in made:
            p = spark._jvm.org.apache.hadoop.fs.Path(other)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, runs it once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(file system, path) by which Python code reaches a shared folder on any host."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use that clash with none of df's, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = next(x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count())) if x.lower() not in taken)
        taken.add(own.lower())
        out.append(own)
    return out


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def give_back() -> None:
    """Return to the system what this process has freed; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable, encoders: bool = False) -> Callable:
    """run for mapInArrow, in a worker that holds little beside it.

    Python workers go from one stage to the next: unless run uses encoders, those of an earlier stage
    go, with the units that they cached; what run has freed is given back at its end.
    """

    def own(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encoders:
            bpe.encoder.cache_clear()
        give_back()
        yield from run(stream)
        give_back()

    return own


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort, which for many numbers is faster than numpy's hash table."""
    found = np.sort(values)
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


#: Bytes of input, as the optimizer estimates them, for each task beyond the session's number of tasks.
TASK_BYTES = 128 << 20


def tasks_for(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """The session's number of shuffle partitions, or more where docs are large."""
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if docs is None:
        return tasks
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(tasks, min(size // TASK_BYTES, 1 << 20)) if size < 1 << 60 else tasks  # beyond: no estimate


def id_bounds(docs: DataFrame, id_col: str, parts: int) -> list:
    """At most parts - 1 ids, each of them in docs, that cut it into ranges of like row counts.

    Only the id column is read; the driver gets one value for each range.
    """
    if parts < 2:
        return []
    cuts = F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 100 * parts)
    found = docs.select(id_col).agg(cuts.alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_number(id_col: Column, bounds: list) -> Column:
    """How many bounds are at or below the id; null ids come first, in range 0."""
    if not bounds:
        return F.lit(0)
    # a bisection of literals, so the depth is the logarithm of the number of ranges
    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(id_col < F.lit(bounds[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return F.when(id_col.isNull(), F.lit(0)).otherwise(pick(0, len(bounds)))
