"""Vector bin packing of token sequences: dot-product heuristic under several limits at once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import batches, encoder, public_path


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. The loss limit and the segment limit hold together with tokens."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


class Packer:
    """Packs examples of one task, in bounded memory.

    add() takes an example's length and the number of its first tokens that bear no loss (a
    prompt). An example beyond the limits is cut: each full part is a sequence of its own.
    The rest waits in a pool of at most pool parts. A sequence is filled by taking, again and
    again, the part that fits all limits and has the largest dot product of its demand with
    the room left (each limit scaled to 1). Where nothing fits and half a percent of the room
    or more is left, a part is cut to fill it. Every token lies in exactly one piece.
    """

    def __init__(self, limits: Limits, emit: Callable[[object, int, int, int, int], None], pool: int = 256):
        self.limits, self.emit, self.pool = limits, emit, pool
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.need = np.zeros((pool, 3))
        self.parts: list[tuple[object, int, int, int] | None] = [None] * pool
        self.free = list(range(pool))
        self.bins = 0

    @staticmethod
    def _loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def _longest(self, start: int, length: int, prompt: int, tokens: int, loss: int) -> int:
        """How many tokens from start on stay within so many tokens and loss-bearing tokens."""
        return min(length, tokens, max(0, prompt - start) + loss)

    def add(self, key: object, length: int, prompt: int = 0) -> None:
        start, lim = 0, self.limits
        while length - start:
            n = self._longest(start, length - start, prompt, lim.tokens, lim.loss_tokens)
            if n == lim.tokens or n < length - start:
                self.emit(key, start, n, self.bins, 0)
                self.bins += 1
                start += n
            else:
                self._hold(key, start, n, prompt)
                return

    def _hold(self, key: object, start: int, n: int, prompt: int) -> None:
        if not self.free:
            self._fill()
        i = self.free.pop()
        self.parts[i] = (key, start, n, prompt)
        self.need[i] = (n, 1, self._loss(start, n, prompt))

    def _fill(self) -> None:
        """One sequence from the pool."""
        room, offset = self.cap.copy(), 0
        weight = 1 / self.cap**2
        first = True
        while True:
            live = self.need[:, 0] > 0
            fits = live & (self.need <= room).all(axis=1)
            if fits.any():
                gain = np.where(fits, self.need @ (room * weight), -1.0)
                i = int(self.need[:, 0].argmax()) if first and fits[int(self.need[:, 0].argmax())] else int(gain.argmax())
                key, start, n, prompt = self.parts[i]
                take = n
            else:
                if room[0] < self.cap[0] * 0.005 or room[1] < 1 or room[2] < 1 or not live.any():
                    break
                i = int(np.where(live, self.need[:, 0], -1).argmax())
                key, start, n, prompt = self.parts[i]
                take = self._longest(start, n, prompt, int(room[0]), int(room[2]))
                if take == 0:
                    break
            first = False
            self.emit(key, start, take, self.bins, offset)
            offset += take
            room -= (take, 1, self._loss(start, take, prompt))
            if take == n:
                self.parts[i], self.need[i] = None, 0
                self.free.append(i)
            else:
                self.parts[i] = (key, start + take, n - take, prompt)
                self.need[i] = (n - take, 1, self._loss(start + take, n - take, prompt))
        self.bins += 1

    def close(self) -> None:
        while len(self.free) < self.pool:
            self._fill()


#: Sequence ids of a task begin at its number times this.
SEQUENCES_PER_TASK = 1 << 40


def pack(
    docs: DataFrame,
    limits: Limits = Limits(),
    tokenizer: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_tokens_col: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of each example, packed under limits.

    Examples are the texts' ids and then end_id. prompt_tokens_col names a column with the
    number of first tokens that bear no loss (null: none). Columns: id_col, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and with with_ids the ids.

    Each task packs what it reads, so nothing shuffles and only the last sequence of a task
    is padded. Null and empty texts are examples of one token (end_id); long ones are cut into full
    sequences and a rest. Ids are longs (other types are cast; what cannot be is an error or null, as
    the session's ANSI mode has it); a null id is kept. Of parts that fit equally well the one that came
    first into its place of the pool is taken. Repeated rows are packed each. An empty table gives no
    rows. Other columns are ignored.
    A sequence_id is the task's number and a count: ids are unique and stable under retries.
    """
    path, spark = tokenizer or public_path("byte_bpe_50k.json"), docs.sparkSession
    common.tune(spark)
    own = docs.select(
        docs[id_col].cast("long").alias("id"),
        common.text_of(docs, text_col).alias("text"),
        (F.coalesce(docs[prompt_tokens_col].cast("long"), F.lit(0)) if prompt_tokens_col else F.lit(0).cast("long")).alias("prompt"),
        F.spark_partition_id().cast("long").alias("task"),
    )
    fields = [pa.field("id", pa.int64())] + [pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rows, task = encoder(path), [], [0]

        def emit(key, start, length, seq, offset):
            doc_id, ids, prompt = key
            part = ids[start : start + length]
            row = (doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), task[0] * SEQUENCES_PER_TASK + seq, offset, Packer._loss(start, length, prompt))
            rows.append(row + ((part.astype(np.int32),) if with_ids else ()))

        packer, end = Packer(limits, emit), np.array([end_id], enc.dtype)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        for batch in stream:
            ids, texts, prompts, tasks = (batch.column(i).to_pylist() for i in range(4))
            for a, b in batches(texts):
                for doc_id, found, prompt, task[0] in zip(ids[a:b], enc.encode(texts[a:b]), prompts[a:b], tasks[a:b]):
                    packer.add((doc_id, np.concatenate([found, end]), max(0, prompt)), len(found) + 1, max(0, prompt))
                    if len(rows) >= 20_000:
                        yield flush()
        packer.close()
        if rows:
            yield flush()

    ddl = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + (", ids array<int>" if with_ids else "")
    return own.mapInArrow(common.lean(run, encoders=True), ddl).withColumnRenamed("id", id_col)
