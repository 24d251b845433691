"""Toxicity by two class-conditional Kneser-Ney models of words after words."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import common

#: Labelled documents of each class, chosen by the hash of their ids, that the models are fitted on.
SAMPLE = 10_000
#: Of these every fifth, so many of each class at most, gives no counts but fits the score.
CALIBRATION, EVERY = 2_000, 5
#: Absolute discounts of words and of pairs of words, of which the calibration takes the best.
GRID = ((3.0, 3.0), (3.0, 6.0), (6.0, 6.0))
#: Mass that goes to the shared shares of prefixes beside what the discounts take.
STRENGTH = 0.2
#: A word's prefix is its first characters, so many.
PREFIX = 4
#: Words of a passage.
PASSAGE = 2
THRESHOLD = 0.7
_EDGE = ".,;:!?\"'()[]{}<>*$%&#"
#: A word's key holds its prefix's hash above so many bits of its own.
_OWN_BITS = 36
#: Words, as they stand in texts, and word pairs that a task gathers before it writes out what it has.
_WORDS_AT_ONCE, _PAIRS_AT_ONCE = 200_000, 1_000_000
#: Bitmaps that count distinct contexts: bits of each, and how much rarer each is than the one before.
_BITS, _RARER, _LEVELS = 256, 8, 8
#: A bitmap with more bits set is full, and the next one counts.
_FULL = 205
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def remainder(id_col: Column) -> Column:
    """Of the id's text under CRC-32 by three: 1 is held out."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)).cast("int")


def key_of(word: str) -> int:
    """64 bits: the hash of the word's prefix, and of the word."""
    own = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ((1 << _OWN_BITS) - 1)
    return (xxhash.xxh64_intdigest(word[:PREFIX].encode("utf-8", "surrogatepass")) >> _OWN_BITS << _OWN_BITS) | own


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several."""
    h = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p) * _C[0]
            h = (h ^ (h >> np.uint64(30))) * _C[1]
            h = (h ^ (h >> np.uint64(27))) * _C[2]
            h ^= h >> np.uint64(31)
    return h


def _within(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of of in the sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return at, keys[at] == of


class _Numbers(dict):
    """Of each piece of text between blanks: the number of the word in it, -1 where it has none."""

    def __init__(self):
        self.words = {"": 0}

    def __missing__(self, piece: str) -> int:
        word = piece.strip(_EDGE)
        self[piece] = found = self.words.setdefault(word, len(self.words)) or -1
        return found


class Lexicon:
    """Numbers of the words read so far; 0 is a text's beginning, whose key is 0."""

    def __init__(self):
        self.numbers = _Numbers()
        self.keys = np.zeros(1, np.uint64)

    def read(self, texts: Iterable[str]) -> np.ndarray:
        """The words' numbers, with a 0 before each text's."""
        flat: list[int] = []
        for t in texts:
            flat.append(0)
            flat.extend(map(self.numbers.__getitem__, t.lower().split()))
        words = self.numbers.words
        new = itertools.islice(words, len(self.keys), None)
        self.keys = np.concatenate([self.keys, np.fromiter(map(key_of, new), np.uint64, len(words) - len(self.keys))])
        ids = np.fromiter(flat, np.int64, len(flat))
        return ids[ids >= 0]


def _triples(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, toxic): the distinct u, w (keys of two words in turn), v (hash of the word before them) and toxic."""

    def distinct(texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
        for toxic, own in enumerate(texts):
            lexicon = Lexicon()
            ids = lexicon.read(own)
            at = np.flatnonzero(ids)
            u = ids[at - 1]
            v = np.where(u == 0, 0, ids[np.maximum(at - 2, 0)])
            u, w, v = lexicon.keys[u], lexicon.keys[ids[at]], (_mixed(lexicon.keys[v]) >> np.uint64(32)).astype(np.uint32)
            _, first = np.unique(_mixed(u, w, v.astype(np.uint64)), return_index=True)
            for a in range(0, len(first), 50_000):
                x = first[a : a + 50_000]
                cols = [u[x].view(np.int64), w[x].view(np.int64), v[x].view(np.int32), np.full(len(x), toxic, np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u", "w", "v", "toxic"])
            own.clear()

    texts, size = [[], []], 0
    for batch in stream:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts[toxic].append(text)
            size += len(text)
        if size > 4 * _PAIRS_AT_ONCE:
            yield from distinct(texts)
            size = 0
    yield from distinct(texts)


def _masks(owner: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For small numbers and hashes of their contexts: number, slot and mask of the bitmaps that these set."""
    bit = (context & np.uint64(_BITS - 1)).astype(np.int64)
    rest, parts = context >> np.uint64(8), []
    for level in range(_LEVELS):
        parts.append((owner * _LEVELS + level) * _BITS + bit)
        on = (rest & np.uint64(_RARER - 1)) == 0
        owner, bit, rest = owner[on], bit[on], rest[on] >> np.uint64(3)
    found = common.distinct(np.concatenate(parts))
    slots = found >> 6
    first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, np.int64)
    masks = np.bitwise_or.reduceat(np.uint64(1) << (found & 63).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
    each = _LEVELS * _BITS // 64
    return slots[first] // each, slots[first] % each, masks


#: What a bitmap's owner is: a word, a prefix, or all.
_WORD, _PREFIX, _ALL = 0, 1, 2


def _contexts(words: np.ndarray, prefixes: np.ndarray):
    """A function that turns texts into bitmaps of the distinct words before each of words, of
    the distinct pairs that end in a word of each of prefixes, and of all pairs."""

    def bitmaps(lexicon: Lexicon, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = lexicon.keys
        u, w = keys[pairs >> 32], pairs & 0xFFFFFFFF
        pair = _mixed(u, keys[w])
        known = _within(words, keys)[1]
        on = known[w]
        own, prefix_of = np.unique(keys >> np.uint64(_OWN_BITS), return_inverse=True)
        wanted = _within(prefixes, own)[1][prefix_of[w]]
        for kind, names, owner, context in (
            (_WORD, keys, w[on], _mixed(u[on])), (_PREFIX, own, prefix_of[w[wanted]], pair[wanted]), (_ALL, np.zeros(1, np.uint64), np.zeros(len(pair), np.int64), pair),
        ):
            n, slot, mask = _masks(owner, context)
            for a in range(0, len(n), 50_000):
                b = slice(a, a + 50_000)
                cols = [np.full(len(n[b]), kind, np.int8), names[n[b]].view(np.int64), slot[b].astype(np.int16), mask[b].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "key", "slot", "mask"])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, found, waiting = Lexicon(), np.zeros(0, np.int64), []
        for batch in stream:
            ids = lexicon.read(batch.column(0).to_pylist())
            at = np.flatnonzero(ids)
            waiting.append(common.distinct(ids[at - 1] << 32 | ids[at]))
            if len(lexicon.numbers) > _WORDS_AT_ONCE or sum(map(len, waiting)) > _PAIRS_AT_ONCE:
                found, waiting = common.distinct(np.concatenate([found, *waiting])), []
                if len(lexicon.numbers) > _WORDS_AT_ONCE or len(found) > _PAIRS_AT_ONCE:
                    yield from bitmaps(lexicon, found)
                    lexicon, found = Lexicon(), found[:0]
        yield from bitmaps(lexicon, common.distinct(np.concatenate([found, *waiting])))

    return run


def _distinct_contexts(bitmaps: DataFrame) -> DataFrame:
    """kind, key and n, the estimated number of contexts (a few are counted almost exactly)."""
    merged = bitmaps.groupBy("kind", "key", "slot").agg(F.bit_or("mask").alias("mask"))
    set_bits = [F.sum(F.when(F.shiftright(F.col("slot").cast("int"), 2) == i, F.bit_count("mask"))).alias(f"c{i}") for i in range(_LEVELS)]
    estimate = [
        F.when((F.col(f"c{i}") <= _FULL) | F.lit(i == _LEVELS - 1), -F.lit(float(_BITS * _RARER**i)) * F.log(1 - F.least(f"c{i}", F.lit(_BITS - 1)) / _BITS))
        for i in range(_LEVELS)
    ]
    counted = merged.groupBy("kind", "key").agg(*set_bits).fillna(0)
    return counted.select("kind", "key", F.coalesce(*estimate).alias("n"))


class Model:
    """log P(toxic) - log P(ordinary) of words after words.

    Every count of either class is a continuation count: n(uw) is the number of distinct words
    before the pair uw, n(w) that of distinct words u before w, n(p) the sum of n(w) over the words
    w with prefix p. So a passage that many copies share counts once. With discounts d2 and d:

        P(w | u) = (max(n(uw) - d2, 0) + sum of min(n(u.), d2) * P(w)) / n(u.)
        P(w) = Q(p) * (max(n(w) - d, 0) + sum over p of min(n(.), d) * S(w | p)) / n(p)
        Q(p) = (max(n(p) - d, 0) + (sum of min(n(.), d) + STRENGTH * N) * S(p)) / (N * (1 + STRENGTH))

    S, which both classes share, are the shares of continuation counts of all documents. A word that
    neither class has, has the ratio of its prefix, and S cancels.
    """

    def __init__(self, words: dict[str, np.ndarray], pairs: dict[str, np.ndarray], discounts: tuple[float, float]):
        """words: sorted keys (the first is that of a text's beginning) with, for each class, n and its
        sums as first word, the distinct contexts shared, of the prefix, and of all."""
        d, d2 = discounts
        self.keys, prefix = words["key"], words["key"] >> np.uint64(_OWN_BITS)
        self.prefixes, of = np.unique(prefix, return_inverse=True)
        share_p = np.zeros(len(self.prefixes))
        share_p[of] = words["of_prefix"] / words["of_all"]
        inner_share = np.clip(words["contexts"] / np.maximum(words["of_prefix"], 1e-9), 1e-12, 1.0)
        self.after, self.word = np.zeros(len(self.keys)), np.zeros(len(self.keys))
        self.prefix, self.none = np.zeros(len(self.prefixes)), 0.0
        first, second = _within(self.keys, pairs["u"])[0], _within(self.keys, pairs["w"])[0]
        self.pair = np.zeros(len(pairs["u"]))
        for name, sign in (("toxic", 1), ("ordinary", -1)):
            n = words[name].astype(float)
            total = max(n.sum(), 1.0)
            under, kinds = np.bincount(of, n), np.bincount(of, np.minimum(n, d))
            free = np.minimum(under, d).sum() + STRENGTH * total
            q = (np.maximum(under - d, 0) + free * share_p) / (total * (1 + STRENGTH))
            inner = np.where(under[of] > 0, (np.maximum(n - d, 0) + kinds[of] * inner_share) / np.maximum(under[of], 1), inner_share)
            p = np.maximum(q[of] * inner, 1e-300)
            c = words[f"after_{name}"].astype(float)
            back = np.where(c > 0, words[f"least_{d2:g}_{name}"] / np.maximum(c, 1), 1.0)
            self.word += sign * np.log(p)
            self.after += sign * np.log(back)
            unseen = np.log(np.maximum(q, 1e-300)) + np.log(np.where(under > 0, kinds / np.maximum(under, 1), 1.0))
            self.prefix += sign * np.where(share_p > 0, unseen, 0.0)
            self.none += sign * np.log(free / (total * (1 + STRENGTH)))
            self.pair += sign * np.log(np.maximum(pairs[name] - d2, 0) / np.maximum(c[first], 1) + back[first] * p[second])
        key = _mixed(pairs["u"], pairs["w"])
        order = np.argsort(key)
        self.pairs, self.pair = key[order], self.pair[order]
        self.forget()

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lexicon", "a", "b")}

    def forget(self) -> None:
        self.lexicon, self.a, self.b = Lexicon(), np.zeros(0), np.zeros(0)

    def _ratios(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places where texts begin, and at each further place its word's ratio; 0 at a beginning."""
        if len(self.lexicon.numbers) > 2 * _WORDS_AT_ONCE:
            self.forget()
        ids = self.lexicon.read(texts)
        new = self.lexicon.keys[len(self.a) :]
        at, known = _within(self.keys, new)
        under, begun = _within(self.prefixes, new >> np.uint64(_OWN_BITS))
        self.a = np.concatenate([self.a, np.where(known, self.after[at], 0.0)])
        self.b = np.concatenate([self.b, np.where(known, self.word[at], np.where(begun, self.prefix[under], self.none))])
        place = np.flatnonzero(ids)
        u, w = ids[place - 1], ids[place]
        x = self.a[u] + self.b[w]
        if len(self.pairs):
            at, found = _within(self.pairs, _mixed(self.lexicon.keys[u], self.lexicon.keys[w]))
            x = np.where(found, self.pair[at], x)
        out = np.zeros(len(ids))
        out[place] = x
        return np.flatnonzero(ids == 0), out

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: the length-normalised ratio of the whole, and that of the passage where it is largest."""
        if not texts:
            return np.zeros((0, 2))
        starts, x = self._ratios(texts)
        ends = np.append(starts[1:], len(x))
        sums, n = np.concatenate([[0.0], np.cumsum(x)]), ends - starts - 1
        out = np.zeros((len(texts), 2))
        out[:, 0] = out[:, 1] = (sums[ends] - sums[starts]) / np.maximum(n, 1)
        # a passage may not begin before a text's first word, nor end beyond its last
        beyond = np.repeat(ends, ends - starts)
        at = np.arange(len(x))
        fits = (at + PASSAGE <= beyond) & (at > np.repeat(starts, ends - starts))
        means = np.where(fits, (sums[np.minimum(at + PASSAGE, len(x))] - sums[at]) / PASSAGE, -np.inf)
        long = n >= PASSAGE
        out[long, 1] = np.maximum.reduceat(means, starts)[long]
        return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss, means, scales and weights (the last: constant) by Newton steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(3), np.diag([0.1, 0.1, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), mean, scale, w


class Scorer:
    """Scores of texts; without two classes among the labels, one constant."""

    def __init__(self, model: Model | None, mean=None, scale=None, weights=None, constant: float = 0.0):
        self.model, self.mean, self.scale, self.weights, self.constant = model, mean, scale, weights, constant

    def score(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.constant)
        x = (self.model.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -30, 30)))


def _sample(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, toxic and place (1, 2 … by the hash of the id) of SAMPLE documents of each class at most; none is held out."""
    rows = (
        labels.where(labels[id_col].isNotNull() & labels[label_col].isin(0, 1))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
        .where(remainder(F.col("id")) != 1)
    )
    each = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for c in (1, 0)]
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    return each[0].unionByName(each[1]).withColumn("place", F.row_number().over(order))


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _counts(own: DataFrame, sample: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]] | None:
    """words and pairs for Model; None if the sample has no words."""
    spark = own.sparkSession
    chosen = own.join(F.broadcast(sample.where("counts")), "id").select("text", F.col("toxic").cast("int"))
    triples = chosen.mapInArrow(common.lean(_triples), "u long, w long, v int, toxic byte").repartition(common.tasks_for(spark), "u", "w")
    by_class = [F.count_if(F.col("toxic") == 1 - i).alias(c) for i, c in enumerate(("toxic", "ordinary"))]
    pairs = common.staged(triples.dropDuplicates().groupBy("u", "w").agg(*by_class), "pairs")
    most = sorted({d2 for _, d2 in GRID})
    as_second = _columns(pairs.groupBy("w").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in ("toxic", "ordinary")]))
    least = [F.sum(F.least(F.col(c).cast("double"), F.lit(d2))).alias(f"least_{d2:g}_{c}") for c in ("toxic", "ordinary") for d2 in most]
    as_first = _columns(pairs.groupBy("u").agg(*[F.sum(c).alias(f"after_{c}") for c in ("toxic", "ordinary")], *least))
    often = _columns(pairs.where(F.greatest("toxic", "ordinary") > most[0]))
    if not len(as_second["w"]):
        return None
    keys = np.append(as_second.pop("w").view(np.uint64), np.uint64(0))
    order = np.argsort(keys)
    words = {"key": keys[order]} | {c: np.append(v, 0)[order] for c, v in as_second.items()}
    at, _ = _within(words["key"], as_first.pop("u").view(np.uint64))
    for c, v in as_first.items():
        words[c] = np.zeros(len(keys))
        words[c][at] = v
    shared = np.unique(words["key"] >> np.uint64(_OWN_BITS))
    sent = spark.sparkContext.broadcast((words["key"], shared))

    def contexts(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contexts(*sent.value)(stream)

    found = _columns(_distinct_contexts(own.select("text").mapInArrow(common.lean(contexts), "kind byte, key long, slot short, mask long")))
    sent.unpersist()
    for kind, name, of, by in ((_WORD, "contexts", words["key"], words["key"]), (_PREFIX, "of_prefix", shared, words["key"] >> np.uint64(_OWN_BITS))):
        on, n = found["kind"] == kind, np.zeros(len(of))
        n[_within(of, found["key"][on].view(np.uint64))[0]] = found["n"][on]
        words[name] = n[_within(of, by)[0]]
    words["of_all"] = max(1.0, float(found["n"][found["kind"] == _ALL].sum()))
    often |= {c: often[c].view(np.uint64) for c in ("u", "w")}
    return words, often


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Class counts from a bounded sample of the labels not held out, backoff counts from all docs.

    The shared backoff takes in every word of every document, so what is gathered grows with the
    input; distinct contexts are counted by bitmaps of bounded size, which tasks merge. The tables
    that the driver collects and sends hold the sample's words and prefixes only, so their bound is
    that of the sample: one row for each distinct word of 2 * SAMPLE documents and each pair of
    words with more than 3 contexts in a class. The discounts and the score's weights are fitted on
    documents of the sample that gave no counts. A class of fewer than EVERY documents gives all of
    them to both.
    """
    spark = docs.sparkSession
    common.tune(spark)
    sample = common.staged(_sample(labels, id_col, label_col).coalesce(1), "labels")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.max("place").alias("n")).collect()}
    if set(size) != {0, 1}:
        return Scorer(None, constant=float(1 in size))
    tests, few = F.col("place") % EVERY == 0, F.col("toxic").isin(*[c for c, n in size.items() if n < EVERY])
    sample = sample.select("id", "toxic", (~tests | few).alias("counts"), ((tests & (F.col("place") <= CALIBRATION * EVERY)) | few).alias("tests"))
    own = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    counted = _counts(own, sample)
    if counted is None:
        return Scorer(None, constant=0.0)
    models = [Model(*counted, g) for g in GRID]
    sent = spark.sparkContext.broadcast(pickle.dumps(models))

    def features(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_models = pickle.loads(sent.value)
        for batch in stream:
            x = np.concatenate([m.features(batch.column(0).to_pylist()) for m in own_models], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    tested = own.join(F.broadcast(sample.where("tests")), "id").select("text", "toxic").mapInArrow(common.lean(features), "x array<double>, toxic int").toArrow()
    sent.unpersist()
    y = tested.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Scorer(None, constant=float(y.mean()) if len(y) else 0.0)
    x = np.array(tested.column("x").to_pylist())
    x, y = x[np.lexsort((*x.T, y))], np.sort(y)  # the order of rows shall not matter
    fits = [_logistic(x[:, 2 * i : 2 * i + 2], y) for i in range(len(GRID))]
    best = min(range(len(GRID)), key=lambda i: fits[i][0])
    return Scorer(models[best], *fits[best][1:])


def _scored(docs: DataFrame, scorer: Scorer, text_col: str, kept: list[Column], names: tuple[str, str], threshold: float) -> DataFrame:
    """kept, and the score and the decision under names."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scorer))
    out = len(kept)
    given = docs.select(*kept)
    own = docs.select(*kept, common.text_of(docs, text_col).alias(common.unused(given, "text")[0]))

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in stream:
            found = model.score(batch.column(out).to_pylist())
            cols = [*batch.columns[:out], pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:out], *names])

    return own.mapInArrow(common.lean(run), StructType([*given.schema, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of keep), held_out, score (0 to 1) and predicted (1: score at or above threshold).

    The whole text, however long, is scored: the toxic and the ordinary log-likelihood of its words,
    divided by their number, over the text and over the passage of PASSAGE words where they differ
    most. Null and empty texts get the score of a text without evidence. A null id is scored and
    not held out. Labels other than 0 and 1 are ignored; of several for one id the larger counts.
    Repeated rows get the same score. An empty table gives no rows; without labels of both classes
    all scores are 0 (only ordinary ones, or none) or 1. Added columns that clash replace those of docs.
    """
    kept = [F.col(f"`{c}`") for c in keep or docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    held_out = F.coalesce(remainder(docs[id_col]) == 1, F.lit(False)).alias("held_out")
    return _scored(docs, fit(docs, labels, id_col, text_col, label_col), text_col, [*kept, held_out], ("score", "predicted"), threshold)


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns and no others.

    Without labels of both classes nothing tells them apart, and all rows stay. Nulls, repeated
    rows and empty tables are as for score.
    """
    names, scorer = common.unused(docs, "score", "predicted"), fit(docs, labels, id_col, text_col, label_col)
    if scorer.model is None:
        return docs
    found = _scored(docs, scorer, text_col, [F.col(f"`{c}`") for c in docs.columns], tuple(names), threshold)
    return found.where(F.col(names[1]) == 0).drop(*names)
