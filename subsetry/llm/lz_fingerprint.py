"""Lempel-Ziv phrase fingerprints: minimum hashes of the phrases that a text parses into."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Minimum hashes in a fingerprint, each of 32 bits.
BINS = 64
_EMPTY = np.uint32(0xFFFFFFFF)
_FACTOR = 0x9E3779B97F4A7C15
_STEP = 4096


class _Powers:
    """Powers of the odd factor modulo 2 ** 64 and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _of(factor: int, size: int) -> np.ndarray:
        out = np.full(size, factor, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), _STEP)
            self.up, self.down = (self._of(f, size) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def phrases(text: str, seen: set[str], start: int = 0) -> list[int]:
    """Ends of the phrases of text from start on: each the shortest that is not in seen yet.

    seen gets the phrases. What is left at the end is no phrase, as it is in seen already.
    """
    out, add, a = [], seen.add, start
    for b in range(start + 1, len(text) + 1):
        piece = text[a:b]
        if piece not in seen:
            add(piece)
            out.append(b)
            a = b
    return out


def _hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of text[start:end], a polynomial of the code points, mixed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    up, down = _POWERS.to(len(points) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(points * up[: len(points)], dtype=np.uint64)])
        h = (total[ends] - total[starts]) * down[starts]
        for shift in (30, 27, 31):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(_FACTOR)
        return h ^ (h >> np.uint64(32))


def _least(hashes: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """The least hash of each bin; a bin is chosen by other bits of the hash."""
    out = np.full(BINS, _EMPTY) if into is None else into.copy()
    np.minimum.at(out, (hashes >> np.uint64(32)).astype(np.int64) % BINS, hashes.astype(np.uint32))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of bins, of those that either fingerprint fills, with equal least hashes.

    It estimates the phrase sets' common share, as each bin's least hash is a random phrase of
    the union. Two empty fingerprints are alike.
    """
    filled = (a != _EMPTY) | (b != _EMPTY)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def as_text(bins: np.ndarray) -> str:
    return bins.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> np.ndarray:
    ends = np.array(phrases(text, set()), np.int64)
    return _least(_hashes(text, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)) if len(ends) else np.full(BINS, _EMPTY)


def with_edited(text: str, tail: str) -> tuple[np.ndarray, str, np.ndarray]:
    """The text's fingerprint, the text with its last quarter replaced by tail, and that one's.

    Both texts parse alike up to the edit, so the second parse begins there.
    """
    same = len(text) - len(text) // 4
    edited = text[:same] + tail
    seen: set[str] = set()
    ends = phrases(text[:same], seen)
    a = ends[-1] if ends else 0
    kept = set(seen)
    more, other = phrases(text, seen, a), phrases(edited, kept, a)
    head = np.array([0, *ends], np.int64)
    base = _least(_hashes(text, head[:-1], head[1:])) if len(ends) else np.full(BINS, _EMPTY)

    def full(whole: str, found: list[int]) -> np.ndarray:
        if not found:
            return base
        at = np.array([0, *found], np.int64)
        return _least(_hashes(whole[a:], at[:-1] - np.array([0] + [a] * (len(at) - 2), np.int64), at[1:] - a), base)

    return full(text, more), edited, full(edited, other)


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each row's fingerprint, its edited text's and the likeness to that and to the next row's.

    Rows are ordered by id (a long; others are cast; null ids first) and then text; the last row's next is the first.
    Null texts count as empty. The edited text has the last quarter of the code points (rounded
    down) replaced by the first as many, or all, of the next row's text. Columns: id_col,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts shuffle once, by ranges of ids; the first row of a range is also sent to the range
    before it, as the next of its last row. Repeated rows stay. A single row is its own next.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    bounds = common.id_bounds(docs, id_col, parts or common.tasks_for(spark, docs))
    # the least id begins range 0; each bound is an id that begins its range
    own = docs.select(docs[id_col].cast("long").alias("id"), common.text_of(docs, text_col).alias("text"))
    least = own.agg(F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    first = F.col("id").isNull() if least["nulls"] else F.col("id") == F.lit(least["least"])
    if bounds and bounds[0] == least["least"]:
        bounds = bounds[1:]
    number = common.range_number(F.col("id"), bounds)
    last = len(bounds)
    before = F.when(first, F.lit(last)).when(F.col("id").isin(bounds), number - 1) if bounds else F.when(first, F.lit(last))
    copies = F.filter(
        F.array(F.struct(number.alias("part"), F.lit(False).alias("copy")), F.struct(before.alias("part"), F.lit(True).alias("copy"))),
        lambda x: x["part"].isNotNull(),
    )
    spread = own.withColumn("to", F.explode(copies)).select("id", "text", F.col("to.part").alias("part"), F.col("to.copy").alias("copy"))
    ordered = spread.repartitionById(last + 1, F.col("part").cast("int")).sortWithinPartitions("part", "copy", "id", "text")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        rows: list[tuple] = []
        waiting = None  # the row before, which needs the next one's text and fingerprint
        done = None  # the range whose first copy has been taken

        def row(prev, text, ahead):
            doc_id, own_text, own_bins, edited, edited_bins = prev
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return (doc_id, len(own_text), digest, as_text(own_bins), as_text(edited_bins), likeness(own_bins, edited_bins), likeness(own_bins, ahead))

        pending = None  # (id, text) not yet parsed: its tail is in the next row
        for batch in stream:
            for doc_id, text, part, copy in zip(*(c.to_pylist() for c in batch.columns)):
                if copy and done == part:
                    continue
                if pending is not None:
                    own_id, own_text = pending
                    bins, edited, edited_bins = with_edited(own_text, text[: len(own_text) // 4])
                    if waiting is not None:
                        rows.append(row(waiting, own_text, bins))
                    waiting = (own_id, own_text, bins, edited, edited_bins)
                if copy:
                    if waiting is not None:
                        rows.append(row(waiting, text, fingerprint(text)))
                    waiting, pending, done = None, None, part
                else:
                    pending = (doc_id, text)
                if len(rows) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ddl = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
