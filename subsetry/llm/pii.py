"""Personal data: patterns propose, checksums confirm, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from . import common

# The patterns of the base kinds, in forms that take linear time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Z0-9])")

#: Spans are ordered by kind in this order and then by start.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
#: Before the words nearby: how sure a confirmed span of the kind is.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7}
#: A confirmed span of a kind that is not a base kind is one from this score on.
LEAST = 0.5
#: A span counts as sure from this score on.
SURE = 0.75
#: Words that make a kind likelier or less likely within so many characters of a span.
NEAR = 40
LIKELIER = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "bank", "account"),
}
UNLIKELIER = {
    "email": ("example", "noreply"), "ip": ("version", "release", "section"), "card": ("order", "serial", "isbn"),
    "phone": ("version", "ratio"), "iban": ("serial", "part"),
}


def luhn(digits: str) -> bool:
    """Whether the digits pass: from the right every other one is doubled, its digits added."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the account number passes: its first four characters last, letters from 10 on."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: its longest local part after the match before."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their validators confirm, by kind."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        # a following word in capitals may have joined: the longest confirmed cut at a blank
        found = m[0]
        while found:
            bare = found.replace(" ", "")
            if 15 <= len(bare) <= 34 and mod97(bare):
                yield "iban", m.start(), m.start() + len(found)
                break
            found = found.rpartition(" ")[0]


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    change = 0.15 * any(w in near for w in LIKELIER[kind]) - 0.3 * any(w in near for w in UNLIKELIER[kind])
    return min(1.0, max(0.0, round(PRIOR[kind] + change, 2)))


def find(text: str, least: float = LEAST) -> list[Span]:
    """All spans by kind and start; offsets in code points, the end exclusive.

    Base kinds stay whatever their score; of the others only what the words nearby leave at least or more.
    """
    found = (Span(k, a, b, _score(text, k, a, b)) for k, a, b in _proposed(text))
    return [s for s in found if s.kind in BASE or s.score >= least]


_SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts, digests and found (array of kind, start, end, score) of each row.

    Columns: id_col, n_email, n_ip, n_card, n_phone, n_iban, base_sha256, spans, scores (of the spans,
    in their order, comma-joined), n_sure (spans that score SURE or more) and best (the largest score,
    0 without spans), found. Null and empty texts have none; texts of any length are searched whole.
    Each row is judged alone, so repeated rows, null ids and any skew change nothing; nothing
    shuffles. An empty table gives no rows.
    """
    common.tune(docs.sparkSession)
    own = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            counts = np.zeros((len(KINDS), batch.num_rows), np.int64)
            base, spans, scores, sure, best, found = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = find(text)
                for s in got:
                    counts[KINDS.index(s.kind), i] += 1
                base.append(hashlib.sha256(",".join(str(s) for s in got if s.kind in BASE).encode()).hexdigest())
                spans.append(",".join(map(str, got)))
                scores.append(",".join(f"{s.score:.2f}" for s in got))
                sure.append(sum(s.score >= SURE for s in got))
                best.append(max((s.score for s in got), default=0.0))
                found.append([{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in got])
            cols = [batch.column(0), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string())]
            cols += [pa.array(scores, pa.string()), pa.array(sure, pa.int64()), pa.array(best, pa.float64()), pa.array(found, arrow_span)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scores", "n_sure", "best", "found"])

    schema = StructType(
        [own.schema["id"], *(StructField(f"n_{k}", LongType()) for k in KINDS), *(StructField(n, StringType()) for n in ("base_sha256", "spans", "scores")), StructField("n_sure", LongType()), StructField("best", DoubleType()), StructField("found", ArrayType(_SPAN))]
    )
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)
