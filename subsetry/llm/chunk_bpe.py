"""BPE encoding with content-defined chunks that are encoded once, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .bpe import UnitEncoder, batches, encoder, public_path

#: Characters that the rolling hash looks at, and the mean length of a chunk.
WINDOW = 16
MEAN = 1024
#: Ids, in characters of their chunks, that a task's dictionary of chunks may hold.
CACHED_CHARS = 24_000_000
_FACTOR = 0x9E3779B97F4A7C15


def cuts(text: str) -> list[int]:
    """Where chunks end: after each place whose last WINDOW characters hash to 0 modulo MEAN.

    The hash is a polynomial of the code points modulo 2 ** 64, so where a passage is
    repeated its inner cuts are the same, whatever stands before it.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) <= WINDOW:
        return [len(text)] if text else []
    h = np.zeros(len(points) - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = h * np.uint64(_FACTOR) + points[k : len(points) - WINDOW + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(_FACTOR)
    at = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + WINDOW
    out = at.tolist()
    if not out or out[-1] != len(text):
        out.append(len(text))
    return out


class ChunkEncoder:
    """encode(texts) equals the library's encoding of each text, token for token.

    Chunks of all texts of a call are looked up in a dictionary; new ones are encoded once.
    Joins are then repaired: a window that reaches over the join to a place before a blank on
    either side is encoded again, and is taken only if it begins with the ids that the left
    chunk and ends with those that the right chunk has beyond these places; else it grows by
    the next such place on both sides, at last to the whole of both parts.
    """

    def __init__(self, units: UnitEncoder):
        self.units = units
        self.known: dict[str, np.ndarray] = {}
        self.chars = 0
        self.repairs = self.grown = 0

    def _chunk_ids(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.known]
        if self.chars > CACHED_CHARS:
            self.known = {c: self.known[c] for c in chunks if c in self.known}
            self.chars = sum(map(len, self.known))
        for a, b in batches(new):
            self.known.update(zip(new[a:b], self.units.encode(new[a:b])))
        self.chars += sum(map(len, new))

    @staticmethod
    def _blank(text: str, start: int, step: int) -> int:
        """The next place from start, to the right or left, before a blank after a visible character."""
        i = start
        while 0 < i < len(text):
            if text[i] == " " and ("!" <= text[i - 1] <= "~" or text[i - 1].isalpha()):
                return i
            i += step
        return 0 if step < 0 else len(text)

    def _join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> tuple[np.ndarray, str, np.ndarray] | None:
        """The final ids up to a place in right, and what of right is beyond it; None: no place agrees."""
        self.repairs += 1
        a, b = self._blank(left, len(left) - 1, -1), self._blank(right, 1, 1)
        while b < len(right):
            a2, b2 = self._blank(left, a - 1, -1) if a else 0, self._blank(right, b + 1, 1)
            if b2 >= len(right):
                return None
            inner, outer, tail, head, before, after = self.units.encode(
                [left[a:] + right[:b], left[a2:] + right[:b2], left[a2:], right[:b2], left[a2:a], right[b:b2]]
            )
            if (
                np.array_equal(outer, np.concatenate([before, inner, after]))
                and np.array_equal(left_ids[len(left_ids) - len(tail) :], tail)
                and np.array_equal(right_ids[: len(head)], head)
                and np.array_equal(tail[: len(before)], before)
                and np.array_equal(head[len(head) - len(after) :], after)
            ):
                return np.concatenate([left_ids[: len(left_ids) - len(tail)], outer]), right[b2:], right_ids[len(head) :]
            self.grown += 1
            a, b = a2, b2
        return None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split, whole = [], []
        for t in texts:
            if any(x in t for x in self.units.added):
                split.append(None)  # an added token may lie across a join
                whole.append(t)
            else:
                ends = cuts(t)
                split.append([t[a:b] for a, b in zip([0, *ends], ends)])
        self._chunk_ids({c for s in split if s for c in s})
        rest = iter(self.units.encode(whole)) if whole else iter(())
        out = []
        for s in split:
            if s is None:
                out.append(next(rest))
            elif not s:
                out.append(np.zeros(0, self.units.dtype))
            else:
                out.append(self._assembled(s))
        return out

    def _assembled(self, chunks: list[str]) -> np.ndarray:
        parts: list[np.ndarray] = []
        # left begins where the library's pattern begins a piece; chunks that no join fits wait in it
        left, ids = [chunks[0]], self.known[chunks[0]]
        for right in chunks[1:]:
            if self._blank(right, self._blank(right, 1, 1) + 1, 1) >= len(right):
                left.append(right)
                ids = None
                continue
            text = "".join(left)
            if ids is None:
                ids = self.units.encode([text])[0]
            joined = self._join(text, ids, right, self.known[right])
            if joined is None:
                left, ids = [text, right], None
            else:
                parts.append(joined[0])
                left, ids = [joined[1]], joined[2]
        parts.append(self.units.encode(["".join(left)])[0] if ids is None else ids)
        return np.concatenate(parts)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row, and with with_ids ids and decoded.

    ids are those of the tokenizers library without special tokens added; decoded is its
    decode(ids, skip_special_tokens=False). Chunks are shared among the documents of a task, so
    nothing shuffles, a chunk that every document has costs no more than another, and the
    dictionary is bounded; a chunk that documents of several tasks share is encoded once in each.
    Null and empty texts have no ids; texts of any length are encoded whole, chunk by chunk. Null ids,
    equal ids, repeated rows and other columns change nothing. An empty table gives no rows.
    """
    path = tokenizer or public_path("byte_bpe_50k.json")
    common.tune(docs.sparkSession)
    own = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ChunkEncoder(encoder(path))
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])
        for batch in stream:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                ids = enc.encode(texts[a:b])
                decoded = enc.units.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
                cols = [
                    batch.column(0)[a:b],
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded], pa.string()),
                ]
                if with_ids:
                    cols += [pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = own.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return own.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
