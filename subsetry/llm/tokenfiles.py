"""Token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import batches, encoder, public_path

#: Stands for a null id in the files of document ids.
NULL_ID = -(1 << 63)
#: Rows that a reading task returns at once.
_ROWS = 20_000


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Write the ids of all texts, each with end_id after it, by ascending id; returns the shards.

    A shard holds a range of ids: <name>.tokens (unsigned little-endian integers, 2 bytes
    where the vocabulary allows), <name>.offsets (64-bit: the number of ids before each
    document in the whole data set, and one more for the end) and <name>.ids (64-bit document
    ids). manifest.json, written last, lists them in order.

    Rows shuffle once, by ranges of ids. Tasks write tokens and local offsets under names of
    their own attempt, and only the names that a finished task returned are used, so a lost
    executor leaves at most unused files. Each shard's base is the sum of the sizes of those
    before it; a second, small pass writes the offsets. A shard has about TASK_BYTES of texts where there
    are many. Ids are longs (others are cast); rows of one id go to one shard. Null ids come first, null and empty
    texts have end_id only, repeated rows are written each, rows of one id are ordered by text.
    """
    spark, path = docs.sparkSession, tokenizer or public_path("byte_bpe_50k.json")
    common.tune(spark)
    parts = parts or common.tasks_for(spark, docs)
    bounds = common.id_bounds(docs, id_col, parts)
    own = docs.select(docs[id_col].cast("long").alias("id"), common.text_of(docs, text_col).alias("text"))
    own = own.withColumn("part", common.range_number(F.col("id"), bounds))
    ordered = own.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "id", "text")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), None
        fs, root = common.filesystem(folder)
        out, name, part, sizes, ids = None, "", -1, [], []
        end = np.array([end_id], enc.dtype).tobytes()

        def close() -> pa.RecordBatch:
            out.close()
            local = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            with fs.open_output_stream(f"{root}/{name}.local") as f:
                f.write(local.tobytes())
            with fs.open_output_stream(f"{root}/{name}.ids") as f:
                f.write(np.array(ids, "<i8").tobytes())
            cols = [[part], [name], [len(sizes)], [int(local[-1])], [enc.dtype.itemsize]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "name", "docs", "tokens", "width"])

        for batch in stream:
            got_ids, texts, got_parts = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(texts):
                if got_parts[at] != part:
                    if out is not None:
                        yield close()
                    part, name, sizes, ids = got_parts[at], f"{got_parts[at]:06d}-{uuid.uuid4().hex}", [], []
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.tokens")
                stop = at
                while stop < len(texts) and got_parts[stop] == part:
                    stop += 1
                for a, b in batches(texts[at:stop]):
                    for raw in enc.encode_bytes(texts[at + a : at + b]):
                        out.write(raw)
                        out.write(end)
                        sizes.append(len(raw) // enc.dtype.itemsize + 1)
                ids += [NULL_ID if i is None else i for i in got_ids[at:stop]]
                at = stop
        if out is not None:
            yield close()

    written = common.staged(ordered.mapInArrow(run, "part long, name string, docs long, tokens long, width long"), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def finish(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        for batch in stream:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist()):
                local = np.frombuffer(fs.open_input_file(f"{root}/{name}.local").read(), "<i8")
                with fs.open_output_stream(f"{root}/{name}.offsets") as f:
                    f.write((local + base).astype("<i8").tobytes())
            yield batch

    done = common.staged(shards.repartition(max(1, min(parts, len(bounds) + 1)), "name").mapInArrow(finish, shards.schema), "shards")
    fs, root = common.filesystem(folder)
    fs.create_dir(root, recursive=True)
    listed = [r.asDict() for r in done.orderBy("part").collect()]  # one row for each shard
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"end_id": end_id, "shards": listed}).encode())
    return done


class _Ranged:
    """A file as an array that is read by ranges, a block at a time."""

    def __init__(self, file, dtype: str, block: int = 8 << 20):
        self.file, self.dtype, self.block = file, np.dtype(dtype), block
        self.start, self.held = 0, np.zeros(0, dtype)

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b = part.start, part.stop
        if a < self.start or b > self.start + len(self.held):
            size = self.dtype.itemsize
            raw = self.file.read_at(max(self.block, (b - a) * size), a * size)
            self.start, self.held = a, np.frombuffer(raw[: len(raw) // size * size], self.dtype)
        return self.held[a - self.start : b - self.start]


def _mapped(fs, path: str, dtype: str, whole: bool = False) -> np.ndarray | _Ranged:
    """The file as an array: memory-mapped where it is local, else read, by ranges or whole."""
    from pyarrow import fs as arrow_fs

    if fs.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, arrow_fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    file = fs.open_input_file(path)
    return np.frombuffer(file.read(), dtype) if whole else _Ranged(file, dtype)


def documents(folder: str, shard: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, start in the data set, token ids) of each document of a shard, from its files.

    Of a shard that is not local, offsets and document ids (16 bytes a document) are held, tokens are read by ranges.
    """
    fs, root = common.filesystem(folder)
    tokens = _mapped(fs, f"{root}/{shard['name']}.tokens", f"<u{shard['width']}")
    offsets = _mapped(fs, f"{root}/{shard['name']}.offsets", "<i8", True)
    ids = _mapped(fs, f"{root}/{shard['name']}.ids", "<i8", True)
    base = int(offsets[0])
    for i, doc_id in enumerate(ids.tolist()):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield (None if doc_id == NULL_ID else doc_id), a, tokens[a - base : b - base]


def read(spark: SparkSession, shards: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of each document, from the files: one task a shard."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "n_tokens", "ids_crc32"]
        for batch in stream:
            for shard in batch.to_pylist():
                rows = []
                for doc_id, start, ids in documents(folder, shard):
                    rows.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
                    if len(rows) >= _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    spread = shards.repartition(max(1, common.tasks_for(spark)), "name")
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a new shared folder and read the files back. An empty table gives no rows."""
    folder = common.shared_dir(docs.sparkSession, "tokens")
    return read(docs.sparkSession, write(docs, folder, id_col=id_col, text_col=text_col), folder, id_col)
