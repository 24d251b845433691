"""Small files and staged tables on any file system that Spark knows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through a file beside it and a rename over it, so that a reader sees the old text or the new."""
    beside = f"{path}.{uuid.uuid4().hex}"
    fs, p = _fs(spark, beside)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(fs.makeQualified(p), final, over)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def fetch(spark: SparkSession, url: str, path: str) -> None:
    """Copy what an http(s) URL gives to a file, as a stream."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, p = _fs(spark, path)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.net.URI(url).toURL().openStream(), fs.create(p, True), conf, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of a folder."""
    fs, p = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isFile())


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder, not yet there, below that of spark.checkpoint.dir, which executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = "file://" + tempfile.mkdtemp(prefix="subsetry-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH:
        made.append(path)
    return path


#: Of each scratch() that is open: the folders made meanwhile.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders of new_folder that are made meanwhile are deleted at the end; no frame may read them later."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            delete(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, run once and read again from a new shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
