"""Secrets by patterns, and credential values judged by the cost of guessing them."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from . import common

# The patterns of the base kinds.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Spans are ordered by start and then by kind in this order.
KINDS = ("assign", "access", "hex", "guess")
#: A credential's context: a name, perhaps after _ or - and quoted, and a separator; then the value,
#: all visible characters. Possessive, so that the time is linear.
_CONTEXT = re.compile(
    r"""(?ai:(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth))["']?[ \t]*+[:=][ \t]*+["']?([!-~]{8,}+)"""
)
_HINT = re.compile(r"(?ai:pass|pwd|secret|token|key|cred|auth)")
#: Bits of guess cost from which a credential value is a secret.
MIN_BITS = 36.0
#: Words of a corpus, the most frequent first, that join those below in its dictionary.
CORPUS_WORDS = 20_000
#: Tasks that look for them among the counted words; each sends so many words at most.
TOP_TASKS = 16
#: Words that people put into passwords, the most usual first.
WORDS = (
    "password", "admin", "welcome", "letmein", "login", "master", "dragon", "monkey", "qwerty", "sunshine",
    "princess", "football", "shadow", "secret", "summer", "winter", "spring", "autumn", "hello", "freedom",
    "whatever", "trustno", "superman", "batman", "internet", "service", "server", "access", "default", "changeme",
    "test", "example", "sample", "user", "root", "guest", "pass", "love", "money", "baseball",
)
#: What a corpus's words stand between.
_APART = "\t\n\r.,;:!?\"'()[]{}<>*$%&#|=/_-+@0123456789"
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")


def _neighbours() -> set[tuple[str, str]]:
    """Keys beside each other in a row or in rows above each other."""
    out = set()
    for r, row in enumerate(_ROWS):
        for i, c in enumerate(row):
            for dr, di in ((0, 1), (1, -1), (1, 0)):
                if r + dr < len(_ROWS) and 0 <= i + di < len(_ROWS[r + dr]):
                    d = _ROWS[r + dr][i + di]
                    out |= {(c, d), (d, c)}
    return out


_BESIDE = _neighbours()
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?[01]\d[-/.]?[0-3]\d|[0-3]\d[-/.]?[01]\d[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(value: str) -> float:
    """Characters that a brute-force search of the value's kinds of characters would try."""
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value)
    return float(size + 33 * any(not c.isalnum() for c in value) or 1)


class Dictionary:
    """Ranks of words, from 1 on."""

    def __init__(self, words: Iterable[str]):
        self.rank: dict[str, int] = {}
        for w in words:
            if len(w) >= 3:
                self.rank.setdefault(w.lower(), len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)


USUAL = Dictionary(WORDS)


def dictionary_of(docs: DataFrame, text_col: str = "text", words: int = CORPUS_WORDS) -> Dictionary:
    """WORDS, and after them the most frequent words (3 to 20 letters a-z, between blanks or punctuation) of all texts of docs.

    All documents are counted, each task's words before they shuffle, and written to the shared folder;
    the driver gets the most frequent words of each of TOP_TASKS tasks, whatever the input. Of words as
    frequent as each other the first in the alphabet count.
    """
    parted = F.split(F.translate(F.lower(common.text_of(docs, text_col)), _APART, " " * len(_APART)), " ")
    word = F.col("word")
    some = docs.select(F.explode(parted).alias("word")).where(F.octet_length(word).between(3, 20) & (F.octet_length(word) == F.length(word)))
    counted = common.staged(some.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & word.rlike("^[a-z]+$")), "words").coalesce(TOP_TASKS)
    return Dictionary([*WORDS, *(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(words).collect())])


def guess_bits(value: str, words: Dictionary = USUAL) -> float:
    """log2 of the guesses of the cheapest segmentation of value.

    Segments are known words (their rank, doubled for capitals), dates (days in 120 years),
    repeats of a shorter piece (the piece and the count), keyboard walks of 3 keys and more
    (start, turns) and single brute-force characters. best[i] is the least cost of the first i
    characters; every segment also costs a bit for the boundary.
    """
    n, low = len(value), value.lower()
    char = math.log2(_alphabet(value))
    rank, longest = words.rank, words.longest
    best = [0.0] + [math.inf] * n
    walk, turns = 1, math.inf  # length of the walk that ends at i, and its cost if it is a segment's end
    # of repeats of 1 to 4 characters: how many at i equal those a size before, and where they may begin
    equal, begins = [0] * 5, [[[] for _ in range(size)] for size in range(5)]
    for i in range(1, n + 1):
        walk = walk + 1 if i > 1 and (low[i - 2], low[i - 1]) in _BESIDE else 1
        cost = best[i - 1] + char
        turns = min(turns + 1.5 if walk > 3 else math.inf, best[i - 3] + 1 + math.log2(len(_BESIDE) / 6) + 3) if walk >= 3 else math.inf
        cost = min(cost, turns)
        for k in range(3, min(longest, i) + 1):
            part = low[i - k : i]
            if part in rank:
                capitals = value[i - k : i] != part
                cost = min(cost, best[i - k] + 1 + math.log2(rank[part] + 1) + capitals)
        for size in (1, 2, 3, 4):
            if i <= size or value[i - 1] != value[i - 1 - size]:
                if equal[size]:
                    equal[size], begins[size] = 0, [[] for _ in range(size)]
                continue
            equal[size] += 1
            fewest = 3 if size == 1 else 2
            if equal[size] >= size * (fewest - 1):
                # a begin that once costs no more than a later one never costs more, as the count's part
                # grows ever slower; one with a higher best than a later one always costs more
                new, least, kept = i - size * fewest, math.inf, []
                for j in [*(j for j in begins[size][i % size] if best[j] < best[new]), new]:
                    c = best[j] + 1 + size * char + math.log2((i - j) // size + 1)
                    if c < least:
                        least = c
                        kept.append(j)
                begins[size][i % size] = kept
                cost = min(cost, least)
        for k in (4, 8, 10):
            if k <= i and _DATE.fullmatch(value, i - k, i):
                cost = min(cost, best[i - k] + 1 + (math.log2(120) if k == 4 else math.log2(120 * 366)))
        best[i] = cost
    return best[n]


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    bits: float | None = None

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of characters that spans cover, in order."""
    starts, ends = [], []
    for s in sorted(spans, key=lambda s: s.start):
        if ends and s.start <= ends[-1]:
            ends[-1] = max(ends[-1], s.end)
        else:
            starts.append(s.start)
            ends.append(s.end)
    return starts, ends


@dataclass(frozen=True)
class Value:
    """A credential value and what it takes to guess it."""

    start: int
    end: int
    bits: float

    def __str__(self) -> str:
        return f"{self.start}:{self.end}:{self.bits:.1f}"


def values(text: str, words: Dictionary = USUAL) -> list[Value]:
    """Every value of 8 characters or more after a credential's name, with its guess cost."""
    if not _HINT.search(text):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip("\"',;.)]}>")
        if len(value) >= 8:
            out.append(Value(m.start(1), m.start(1) + len(value), guess_bits(value, words)))
    return out


def judged(text: str, min_bits: float = MIN_BITS, words: Dictionary = USUAL) -> tuple[list[Span], list[Value]]:
    """All spans of text, by start and kind, and all credential values with their costs.

    Offsets are in code points, the end exclusive. The base kinds are those of the patterns. A
    guess is a value after a credential's name that base spans do not cover fully and that would
    take 2 ** min_bits guesses; values that are easier to guess are no spans of their own.
    """
    out = []
    if _HINT.search(text):
        out += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    costed = values(text, words)
    if costed:
        starts, ends = _merged(out)
        for v in costed:
            at = bisect.bisect_right(starts, v.start) - 1
            if v.bits >= min_bits and not (at >= 0 and v.end <= ends[at]):
                out.append(Span("guess", v.start, v.end, round(v.bits, 2)))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s.start, order[s.kind])), costed


def find(text: str, min_bits: float = MIN_BITS, words: Dictionary = USUAL) -> list[Span]:
    """The spans of judged."""
    return judged(text, min_bits, words)[0]


def redact(text: str, mark: str = "[SECRET]", words: Dictionary = USUAL) -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at, end = [], 0, -1
    for s in find(text, words=words):
        if s.start < end:
            end = max(end, s.end)
        else:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at : s.start])
            end = s.end
    if end < 0:
        return text
    return "".join([*out, mark, text[end:]])


_SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("bits", DoubleType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Dictionary | None = None) -> DataFrame:
    """id, digests and counts of each row's secrets, and found (array of kind, start, end, bits).

    Columns: id_col, n_assign, n_access, n_hex, n_guess, base_sha256, spans, n_values and n_weak
    (credential values, and those of them that are cheaper to guess than MIN_BITS), costs (start:end:bits
    of every credential value, base ones too), found. words: the dictionary of the guess costs, by
    default that of all texts of docs. Null and empty texts have none; texts of any length are searched
    whole, in time linear in their length. Each row is judged alone, so repeated rows, null ids and any
    skew change nothing; only word counts shuffle. An empty table gives no rows.
    """
    common.tune(docs.sparkSession)
    words = words or dictionary_of(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(words)
    own = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_values", "n_weak", "costs", "found"]

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            counts = np.zeros((len(KINDS) + 2, batch.num_rows), np.int64)
            base, spans, costs, found = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got, costed = judged(text, words=sent.value)
                for s in got:
                    counts[KINDS.index(s.kind), i] += 1
                counts[-2:, i] = len(costed), sum(v.bits < MIN_BITS for v in costed)
                base.append(hashlib.sha256(",".join(str(s) for s in got if s.kind != "guess").encode()).hexdigest())
                spans.append(",".join(map(str, got)))
                costs.append(",".join(map(str, costed)))
                found.append([{"kind": s.kind, "start": s.start, "end": s.end, "bits": s.bits} for s in got])
            numbers, texts = [*map(pa.array, counts)], [pa.array(x, pa.string()) for x in (base, spans, costs)]
            cols = [batch.column(0), *numbers[:-2], *texts[:2], *numbers[-2:], texts[2], pa.array(found, arrow_span)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = {"base_sha256": StringType(), "spans": StringType(), "costs": StringType(), "found": ArrayType(_SPAN)}
    schema = StructType([own.schema["id"], *(StructField(n, kinds.get(n, LongType())) for n in names[1:])])
    return own.mapInArrow(common.lean(run), schema).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", words: Dictionary | None = None) -> DataFrame:
    """docs with the secrets of text_col replaced, and length_col, if there, set to the new length.

    All rows stay, with all columns; rows without secrets are as they were. words is as for scan.
    """
    common.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(words or dictionary_of(docs, text_col))
    at = docs.columns.index(text_col)
    names, schema = docs.columns, docs.schema

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t if t is None else redact(t, words=sent.value) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(common.lean(run), schema)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(f"`{text_col}`").isNull(), F.col(f"`{length_col}`")).otherwise(F.length(f"`{text_col}`").cast(kind)))
    return out
